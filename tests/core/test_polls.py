"""Polls over a growing source: each row once, late rows too, and nothing lost by a poll that failed."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import polls

ITEMS = "id int, added long, title string"


def _ids(rows):
    return sorted(r.id for r in rows.collect())


def test_each_row_once(spark, tmp_path):
    at = str(tmp_path / "claims")
    table = lambda *rows: spark.createDataFrame([(i, t, f"t{i}") for i, t in rows], ITEMS)
    first = [(1, 5), (2, 100), (3, 120), (None, 110), (4, None)]
    assert _ids(polls.poll(table(*first), at, "id", "added", 50, since=50)) == [2, 3]
    assert _ids(polls.poll(table(*first), at, "id", "added", 50)) == []
    late = first + [(5, 70), (6, 69), (7, 200), (7, 200), (7, 210)]
    found = polls.poll(table(*late), at, "id", "added", 50)
    assert sorted((r.id, r.added, r.title) for r in found.collect()) == [(5, 70, "t5"), (7, 200, "t7")]
    assert _ids(polls.poll(table(*late, (8, 151)), at, "id", "added", 50)) == [8]
    claims = polls.claimed(spark, at, "key int, at long, run int").collect()
    assert sorted((r.key, r.run) for r in claims) == [(7, 3), (8, 4)]


def test_a_failed_poll_claims_nothing(spark, tmp_path):
    at = str(tmp_path / "claims")
    rows = spark.range(20).select(F.col("id").cast("int").alias("id"), F.col("id").alias("added"), F.lit("t").alias("title"))
    assert _ids(polls.poll(rows.where("id < 10"), at, "id", "added", 5)) == list(range(10))
    bad = rows.withColumn("added", F.when(F.col("id") == 15, F.raise_error(F.lit("gone")).cast("long")).otherwise(F.col("added")))
    with pytest.raises(Exception, match="gone"):
        polls.poll(bad, at, "id", "added", 5)
    assert _ids(polls.poll(rows, at, "id", "added", 5)) == list(range(10, 20))


def test_nothing_to_poll(spark, tmp_path):
    empty = spark.createDataFrame([], ITEMS)
    for _ in range(2):
        assert polls.poll(empty, str(tmp_path / "claims"), "id", "added", 5).count() == 0
    assert polls.poll(spark.createDataFrame([(1, 3, "a")], ITEMS), str(tmp_path / "claims"), "id", "added", 5).count() == 1
