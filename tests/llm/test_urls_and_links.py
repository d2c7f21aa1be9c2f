"""URL lists on hand-made events, and connected components against a union-find."""

import datetime as dt
import random
from collections import Counter

from quarry.llm import components, url_lists

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def judged(spark, events, captures, extra=""):
    listed = spark.createDataFrame(events, "list_name string, key string, action string, effective_on date")
    pages = spark.createDataFrame(captures, "page_id long, url string, fetched_on date")
    if extra:
        pages = pages.selectExpr("*", extra)
    return [(r.page_id, r.active, r.verdict) for r in url_lists.judge(pages, listed).collect()]


def test_entries_hold_from_their_day_until_they_are_removed(spark):
    events = [
        ("spam", "Bad.example", "add", day(10)),
        ("spam", "bad.example", "add", day(12)),
        ("spam", "bad.example", "remove", day(20)),
        ("spam", "bad.example", "add", day(30)),
        ("spam", "same.example", "add", day(5)),
        ("spam", "same.example", "remove", day(5)),
        ("allow", "bad.example/ok", "add", day(0)),
        ("spam", None, "add", day(0)),
        ("spam", "x.example", "add", None),
        ("spam", "x.example", "other", day(0)),
    ]
    urls = [(n, "https://user@www.BAD.example:8080/a/b?q#f", day(n)) for n in (9, 10, 15, 19, 20, 29, 30)]
    found = dict((p, v) for p, _, v in judged(spark, events, urls))
    assert found == {9: "clear", 10: "blocked", 15: "blocked", 19: "blocked", 20: "clear", 29: "clear", 30: "blocked"}
    more = [(1, "http://bad.example/ok/x", day(15)), (2, "http://bad.example/okay", day(15)), (3, "http://notbad.example/", day(15)), (4, "http://same.example", day(15)), (5, "http://x.example", day(15))]
    assert sorted(judged(spark, events, more)) == [
        (1, ["allow:bad.example/ok", "spam:bad.example"], "allowed"),
        (2, ["spam:bad.example"], "blocked"),
        (3, [], "clear"),
        (4, [], "clear"),
        (5, [], "clear"),
    ]


def test_nulls_repeats_and_empty_tables(spark):
    events = [("spam", "bad.example", "add", day(0))]
    captures = [(None, None, None), (1, "", day(1)), (2, "bad.example", day(1)), (3, "http://bad.example", None)]
    captures += [(4, "http://bad.example", day(1))] * 2
    found = Counter((p, v) for p, _, v in judged(spark, events, captures, "'x' AS key"))
    assert found == {(None, "clear"): 1, (1, "clear"): 1, (2, "clear"): 1, (3, "clear"): 1, (4, "blocked"): 2}
    assert [v for *_, v in judged(spark, [], captures[:3])] == ["clear"] * 3
    assert judged(spark, events, []) == []


def test_components_of_paths_stars_and_random_links(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 - i) for i in range(1, 20)]
    edges += [(rng.randrange(-200, 0), rng.randrange(-200, 0)) for _ in range(120)] + [(7, 7), (8, 9), (9, 8)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    found = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert found == {x: find(x) for x in linked}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0
