"""Places in one order and neighbours within keys, over more rows than a range's sample."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.operators import logs


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_places_are_gapless_and_ordered(spark, coalesce):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        rows = spark.range(400_000).select(
            "id", F.when(F.col("id") % 3 > 0, F.pmod(F.xxhash64("id"), F.lit(1000))).alias("a"), F.when(F.col("id") % 5 > 0, F.hash("id")).alias("b")
        )
        found = logs.placed(rows, ["a", F.col("b"), "id"], "place")
        assert found.columns == ["id", "a", "b", "place"]
        got = sorted(((r.a is None, r.a or 0, r.b is None, r.b or 0, r.id), r.place) for r in found.collect())
        assert [p for _, p in got] == list(range(1, 400_001))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)


def test_places_of_equal_keys_and_of_nothing(spark):
    same = spark.range(5000).select((F.col("id") % 7).alias("v"), F.lit(1).alias("k"))
    assert sorted(r.place for r in logs.placed(same, ["k"], "place").collect()) == list(range(1, 5001))
    assert logs.placed(same.where("v > 9"), ["k"], "place").count() == 0


def test_previous_keeps_rows_of_null_keys_and_orders(spark):
    rows = [("a", 1, "x"), ("a", 40_000, "x"), ("a", None, "y"), (None, 5, "p"), (None, 6, None), ("a", 40_000, None), ("b", None, None), ("a", 90_000, "w")]
    table = spark.createDataFrame(rows, "k string, o long, v string")
    found = Counter(tuple(r) for r in logs.with_previous(table, "k", "o", "v").collect())
    expected = Counter()
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is None, r[1] or 0, r[2] is not None, r[2] or ""))
        expected.update((*r, own[n - 1][2] if n else None) for n, r in enumerate(own))
    assert found == expected
