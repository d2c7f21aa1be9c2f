"""Incremental polls of a source by time, each row handed out once: a stored high-water mark, an overlap, and claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources import published


def poll(items: DataFrame, path: str, key: str, at: str, overlap: int, since: int | None = None) -> DataFrame:
    """The items that no poll before has handed out, all columns, one for each key.

    Items are asked for from the latest time that has been claimed less ``overlap`` on, so those that turn up late by no
    more than that are found; the first poll asks from ``since`` on, or for all. The filter on ``at`` goes to the source. What
    is handed out is claimed in a table below ``path`` that is published as one version; a poll that fails before that has
    claimed nothing, and ``claimed`` gives what a poll handed out again. Claims older than the overlap are dropped, as
    nothing as old is asked for again. Of rows of one key the earliest is taken, then the first in the order of their
    other columns. Rows of a null key or time are never handed out.
    """
    spark = items.sparkSession
    schema = f"key {items.schema[key].dataType.simpleString()}, at long, run int"
    before = published.published(spark, path, schema)
    mark = before.agg(F.max("at")).first()[0]
    known = published.versions(path)
    run = (known[-1]["version"] if known else 0) + 1
    start = since if mark is None else mark - overlap
    rows = items if start is None else items.where(F.col(at) >= start)
    rows = rows.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    first = F.min_by(F.struct(*items.columns), F.struct(at, F.xxhash64(*items.columns))).alias("row")
    fresh = rows.groupBy(F.col(key).alias("key")).agg(first).join(before.select("key"), "key", "left_anti")
    new = fresh.select("key", F.col(f"row.{at}").cast("long").alias("at"), F.lit(run).alias("run"))
    kept = before if start is None else before.where(F.col("at") >= start)
    published.publish(kept.unionByName(new), path, keep=2)
    mine = claimed(spark, path, schema, run)
    return rows.groupBy(F.col(key).alias("key")).agg(first).join(mine.select("key"), "key", "left_semi").select("row.*")


def claimed(spark, path: str, schema: str, run: int | None = None) -> DataFrame:
    """key, at, run of the claims that are kept, or those of one poll."""
    rows = published.published(spark, path, schema)
    return rows if run is None else rows.where(F.col("run") == run)
