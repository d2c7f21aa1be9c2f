"""What the corpus operators share: reading tables and cutting lineage with written tables."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Rows of whole texts that go to a Python task at once: Spark's own 10,000 would be held several times over.
ROWS_AT_ONCE = 1_000
_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Makes Arrow batches small in this session, unless their size has been set."""
    if spark.conf.get(_ROWS_SETTING, None) is None:
        spark.conf.set(_ROWS_SETTING, str(ROWS_AT_ONCE))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where that is unset on one machine, as in tests, is it set to a new local folder; a cluster has to name it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not found:
        found = Path(tempfile.mkdtemp(prefix="quarry-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_place(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/tables/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: later stages start from the files.

    A lost executor then costs no more than the tasks it ran, and a table with several readers is made once.
    """
    spark = df.sparkSession
    path = new_place(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
