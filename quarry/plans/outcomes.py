"""Outcome counts over the event log (survey ids A1, A2)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.tables import table

STATUSES = ("click", "view", "purchase", "signup", "error")


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: one count per known status, zero where none was seen, and the total."""
    counts = [F.count_if(F.col("event_type") == s).alias(f"n_{s}") for s in STATUSES]
    return table(spark, sf_dir, "events").agg(*counts, F.count("*").alias("n_total"))


QUERIES = {"a1_status_counts": status_counts}
ORACLES = {
    "a1_status_counts": "SELECT "
    + ", ".join(f"count(*) FILTER (event_type = '{s}') AS n_{s}" for s in STATUSES)
    + ", count(*) AS n_total FROM events",
}
