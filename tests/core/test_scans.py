"""Paged services: pages out of scope stay unopened; scope, sort, exclusion and dedup; greedy dedup in rounds."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import folds, scans
from quarry.sources import paged

ITEMS = "library string, position long, id long, title string, show string, code string, added long, locations array<string>, path string"


@pytest.fixture
def service(spark, tmp_path):
    rows = []
    for k in range(60):
        library = "abc"[k // 20]
        rows.append((library, k, f"t{k}", "Show", "s01e01", 1000 - k % 20, [f"/{library}/{k}", f"/{library}/{k - 1 if k % 4 == 1 else k}"], f"/{library}/{k}", k + 1))
    table = spark.createDataFrame(rows, "library string, id long, title string, show string, code string, added long, locations array<string>, path string, place long")
    known = spark.createDataFrame([("a", "Films", "movie", True), ("b", "Series", "episode", True), ("c", "Photos", "photo", False)], "library string, title string, kind string, enabled boolean")
    paged.publish(table, known, str(tmp_path / "s"), 5)
    return tmp_path / "s"


def _spoil(folder, *parts):
    """Makes pages unreadable: who opens one fails."""
    for part in parts:
        for file in (folder / part).glob("*.json"):
            file.write_text("{not json")


def test_pages_out_of_scope_are_never_opened(spark, service):
    _spoil(service, *[f"library=c/page={n}" for n in range(8, 12)], *[f"library=b/page={n}" for n in range(4, 8)])
    read = paged.items(spark, str(service), ITEMS, attempts="1")
    assert sorted(r.id for r in read.where("library = 'a'").collect()) == list(range(20))
    assert sorted(r.id for r in read.where("library IN ('a', 'x')").select("id").collect()) == list(range(20))
    with pytest.raises(Exception, match="not json|Expecting|JSONDecodeError"):
        read.where("library = 'b'").collect()
    assert scans.library_scan(read, paged.libraries(spark, str(service)), titles=["films"]).count() == 20


def test_bounds_prune_pages_and_rows(spark, service):
    _spoil(service, "library=a/page=3", "library=b/page=7", "library=c/page=11")
    read = paged.items(spark, str(service), ITEMS, attempts="1")
    assert sorted(r.id for r in scans.recent(read, 988).collect()) == [k for k in range(60) if 1000 - k % 20 >= 988]
    assert sorted(r.id for r in read.where("added > 997 AND library = 'b'").collect()) == [20, 21, 22]
    assert [r.added for r in read.where("added <= 985 AND added > 984 AND library = 'c'").limit(0).collect()] == []


def test_missing_first_page_is_an_empty_library(spark, service):
    for n in range(4, 8):
        for file in (service / f"library=b/page={n}").iterdir():
            file.unlink()
    (service / "library=b/page=4").rmdir()
    assert paged.items(spark, str(service), ITEMS).where("library = 'b'").count() == 0
    (service / "library=a/page=2").rename(service / "gone")
    with pytest.raises(Exception, match="page=2"):
        paged.items(spark, str(service), ITEMS, attempts="1").where("library = 'a'").collect()


def test_library_scan(spark, service):
    read, known = paged.items(spark, str(service), ITEMS), paged.libraries(spark, str(service))
    found = scans.library_scan(read, known, sort="oldest", rules=[("/a/1", "path"), ("/b/3[0-9]$", "regex")]).collect()
    films = [r.id for r in sorted((r for r in found if r.library == "a"), key=lambda r: r.place_key)]
    assert films == [k for k in range(19, -1, -1) if k != 1]
    # Oldest first, so of the two episodes at one place the later listed is met first.
    assert sorted(r.id for r in found if r.library == "b") == [k for k in range(20, 30) if k % 4 != 0]
    assert {r.title for r in found if r.library == "b"} == {"Show S01E01"} and {r.library_title for r in found} == {"Films", "Series"}
    assert scans.library_scan(read, known, ids=["c", "zz"]).count() == 0
    paths_of = scans.canonical_rows(read, known, "s", [("/a", "/x"), ("/a", "/y")], ids=["a", "c"]).collect()
    assert {(r.item_id, r.canonical_path) for r in paths_of} == {(k, f"/{m}/{k}") for k in range(20) for m in "xy"}


def test_plan_has_no_filter_on_the_library_left(spark, service):
    plan = paged.items(spark, str(service), ITEMS).where("library = 'a' AND added > 990")._jdf.queryExecution().executedPlan().toString()
    assert "= a)" not in plan and "> 990)" in plan


def _greedy(rows):
    seen, kept = {}, set()
    for group, turn, places, key in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        own = seen.setdefault(group, set())
        if not own & set(places or []):
            own |= set(places or [])
            kept.add(key)
    return kept


@pytest.mark.parametrize("rounds", [24, 1])
def test_overlap_rounds_equal_the_greedy_fold(spark, rounds):
    rng = random.Random(9)
    rows = [(rng.choice(["g", "h", None]), k, [f"p{rng.randrange(60)}" for _ in range(rng.choice([0, 1, 2, 2, 3]))], k) for k in range(400)]
    rows += [("chain", k, [f"c{k}", f"c{k + 1}"], 1000 + k) for k in range(60)] + [("hot", k, ["same", f"q{k % 5}"], 2000 + k) for k in range(300)] + [("g", 999, None, 3000)]
    table = spark.createDataFrame(rows, "g string, turn int, places array<string>, key int").repartition(3)
    found = folds.disjoint_rows(table, "g", "turn", "places", rounds)
    assert {r.key for r in found.collect()} == _greedy(rows) and found.columns == ["g", "turn", "places", "key"]


def test_overlap_rounds_of_nothing(spark):
    assert folds.disjoint_rows(spark.createDataFrame([], "g string, turn int, places array<string>"), "g", "turn", "places").count() == 0


def test_pages_without_metadata(spark, tmp_path):
    for n in range(20):
        (tmp_path / f"page-{n}.json").write_text(json.dumps({"id": n}))
    read = paged.items(spark, tmp_path.as_uri(), "id long, page int")
    assert sorted((r.id, r.page) for r in read.collect()) == [(n, n) for n in range(20)]
    assert read.where(F.col("id") > 15).count() == 4


def test_shaped_pages_are_moved_narrow_and_read_in_order(spark, tmp_path):
    """Fields are made after rows have been moved, pages may be compressed, and a page's rows keep their places."""
    rows = spark.range(3_000).select(F.lit("a").alias("library"), (F.col("id") * 7 % 3_000).alias("added")).withColumn("place", 3_000 - F.col("added"))
    known = spark.createDataFrame([("a", "Films", "movie", True)], "library string, title string, kind string, enabled boolean")
    paged.publish(rows.repartition(3), known, str(tmp_path / "s"), shape=[F.concat(F.lit("t"), "added").alias("title"), F.col("added")], compression="gzip")
    found = paged.items(spark, str(tmp_path / "s"), "library string, position long, title string, added long").where("library = 'a'").orderBy("position").collect()
    assert [(r.title, r.added) for r in found] == [(f"t{k}", k) for k in range(2_999, -1, -1)]
    assert len(list((tmp_path / "s" / "library=a").rglob("*.json.gz"))) == 3


def test_overlap_of_small_groups_takes_no_rounds(spark, monkeypatch):
    names, keep = [], folds.written
    monkeypatch.setattr(folds, "written", lambda df, what: (names.append(what), keep(df, what))[1])
    rows = [(k % 40, k, [f"p{k % 7}", f"p{k % 11}"], k) for k in range(400)] + [(50, 1, None, 900), (None, 1, ["x"], 901), (None, 2, ["x"], 902)]
    table = spark.createDataFrame(rows, "g int, turn int, places array<string>, key int")
    assert {r.key for r in folds.disjoint_rows(table, "g", "turn", "places").collect()} == _greedy(rows)
    assert names == ["items", "crowded"]


@pytest.mark.parametrize("small", [0, 20])
def test_overlap_of_small_and_crowded_groups(spark, small):
    rng = random.Random(4)
    rows = [(rng.choice(["g", "h", None]), k, [f"p{rng.randrange(30)}" for _ in range(rng.choice([0, 1, 2, 3]))], k) for k in range(120)]
    rows += [(f"s{k % 9}", k, [f"q{rng.randrange(4)}"], 1000 + k) for k in range(90)]
    table = spark.createDataFrame(rows, "g string, turn int, places array<string>, key int").repartition(3)
    assert {r.key for r in folds.disjoint_rows(table, "g", "turn", "places", small=small).collect()} == _greedy(rows)
