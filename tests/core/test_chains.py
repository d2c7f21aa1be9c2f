"""State machines and times to live over hot keys, against folds in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import chains, folds

MOVES = {("a", "x"): "b", ("b", "y"): "c", ("c", "x"): "a", ("b", "z"): "end", ("c", "z"): "a"}


def _folded(events):
    state = "a"
    for e in events:
        state = MOVES.get((state, e), state)
    return state


@pytest.mark.parametrize("run", [3, 1024])
def test_replay_equals_the_fold(spark, run):
    rng = random.Random(4)
    rows = [(rng.choice(["k1", "k2", None]), rng.randrange(200), rng.choice(["x", "y", "z", "w", None])) for _ in range(900)]
    found = chains.replayed(spark.createDataFrame(rows, "k string, t int, e string").repartition(5), "k", ["t"], "e", MOVES, "a", run)
    expected = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2] is not None, r[2] or ""))
        expected[key] = (_folded(e for *_, e in own), len(own))
    assert {r.k: (r.state, r.n) for r in found.collect()} == expected


def test_replay_of_one_key_with_a_million_events(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        size = 1_000_000
        pick = lambda i: "xyzw"[(i * 7919 + i // 13) % 4]
        code = (F.col("id") * 7919 + F.floor(F.col("id") / 13)) % 4
        rows = spark.range(size).select(F.lit("hot").alias("k"), F.col("id").alias("t"), F.substring(F.lit("xyzw"), (code + 1).cast("int"), F.lit(1)).alias("e"))
        row = chains.replayed(rows, "k", ["t"], "e", MOVES | {("end", "x"): "a"}, "a").first()
        state = "a"
        moves = MOVES | {("end", "x"): "a"}
        for i in range(size):
            state = moves.get((state, pick(i)), state)
        assert (row.state, row.n) == (state, size)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def _accepted(times, ttl):
    out = []
    for t in sorted(times):
        if not out or t - out[-1] >= ttl:
            out.append(t)
    return out


@pytest.mark.parametrize("span", [1, 2, 64])
def test_ttl_equals_the_fold(spark, span):
    rng = random.Random(span)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(0, 5000)) for _ in range(1500)]
    rows += [("gaps", t + d) for t in range(-3000, 3000, 700) for d in (0, 9, 10, 11, 30)] + [("dense", t) for t in range(800)] + [("one", 5), ("none", None)]
    found = chains.ttl_taken(spark.createDataFrame(rows, "k string, t int").repartition(4), ["k"], F.col("t"), 10, span).collect()
    for key in {r[0] for r in rows}:
        assert sorted(r["at"] for r in found if r.k == key) == _accepted([t for k, t in rows if k == key and t is not None], 10), key


def test_ttl_of_one_key_with_very_many_events(spark):
    rows = spark.range(1_000_000).select(F.lit(1).alias("k"), F.pmod(F.xxhash64("id"), F.lit(3_000_000)).alias("t"))
    found = sorted(r["at"] for r in chains.ttl_taken(rows, ["k"], F.col("t"), 600).collect())
    times = [r.t for r in rows.select("t").distinct().collect()]
    assert found == _accepted(times, 600)


def test_ttl_of_nothing(spark):
    assert chains.ttl_taken(spark.createDataFrame([], "k string, t int"), ["k"], F.col("t"), 10).count() == 0


def _buckets(rows):
    """The rule as it is worded: in order, into the first bucket that fits."""
    found = []
    for year, item in rows:
        for bucket in found:
            if bucket[0] is None or year is None or bucket[0] == year:
                bucket[0] = year if bucket[0] is None else bucket[0]
                bucket[1].append(item)
                break
        else:
            found.append([year, [item]])
    return {(year, tuple(items)) for year, items in found}


@pytest.mark.parametrize("seed", range(4))
def test_years_merge_as_worded(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", "c", None]), n, rng.choice([None, None, 1999, 2001, 2005][: 2 + seed]), n) for n in range(60)] + [("none", 1, None, 7), ("none", 2, None, 8)]
    table = spark.createDataFrame(rows, "k string, o int, y int, item long").repartition(3)
    found = folds.merged_by_year(table, ["k"], "o", "y", "item").collect()
    for key in {r[0] for r in rows}:
        assert {(r.year, tuple(r["items"])) for r in found if r.k == key} == _buckets([(y, item) for k, _, y, item in rows if k == key])
