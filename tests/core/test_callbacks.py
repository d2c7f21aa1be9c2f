"""Callbacks of streams and of sources that fail."""

import time

import pytest
from pyspark.sql import functions as F

from quarry.operators import search
from quarry.streaming.webhooks import Progress


def _run(spark, folder, name, callback, checkpoint):
    listener = Progress(callback, name)
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).json(str(folder))
        query = stream.writeStream.format("noop").queryName(name).option("checkpointLocation", str(checkpoint)).trigger(processingTime="0 seconds").start()
        deadline = time.time() + 90
        while query.isActive and time.time() < deadline and not listener.done():
            time.sleep(0.2)
        query.stop()
    finally:
        spark.streams.removeListener(listener)


def test_progress_and_cancel(spark, tmp_path):
    for k in range(4):
        spark.range(k + 1).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    seen = []
    Progress.done = lambda self: sum(x["rows"] for x in seen) == 10
    _run(spark, tmp_path / "in", "all", lambda x: seen.append(x), tmp_path / "cp1")
    assert sum(x["rows"] for x in seen) == 10 and {x["query"] for x in seen} == {"all"}
    some = []
    Progress.done = lambda self: bool(self.ended)
    _run(spark, tmp_path / "in", "some", lambda x: some.append(x) or False, tmp_path / "cp2")
    assert some and sum(x["rows"] for x in some) < 10
    del Progress.done


def test_failing_sources_are_named_and_mistakes_raise(spark):
    hit = spark.range(1).select(F.lit("s").alias("server"), F.lit(1).cast("long").alias("rank"), F.lit("show").alias("kind"), F.lit("t").alias("title"),
                                F.lit(None).cast("int").alias("year"), F.array(F.lit("/p")).alias("paths"), F.lit(None).cast("int").alias("child_count"))

    def down():
        raise OSError("no route")

    failed = []
    assert search.gathered(spark, [("down", down), ("up", lambda: hit)], failed).count() == 1 and failed == [("down", "OSError: no route")]
    with pytest.raises(Exception, match="title"):
        search.gathered(spark, [("wrong", lambda: hit.drop("title"))], failed)
