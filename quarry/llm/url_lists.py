"""URL filtering against lists that change over time.

Dated list events become validity intervals, one row per entry and period. A capture is looked up under each key its
URL can be listed by (the host and its parent domains, and the host with each leading part of its path), an equi-join
that Spark can split where one host holds much of the crawl, and each match is judged as of the capture's fetch time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import written


def intervals(events: DataFrame) -> DataFrame:
    """list_name, key, valid_from, valid_to from events (list_name, key, action, effective_on).

    ``add`` opens an entry and ``remove`` closes it; of several events of one entry on a day, a removal counts last. An
    entry that is open stays open on a second ``add``. ``valid_to`` is exclusive, null while the entry stands. Keys
    compare in lower case. Events with a null key, action or date are void.
    """
    entry = Window.partitionBy("list_name", "key").orderBy("effective_on")
    daily = (
        events.select("list_name", F.lower("key").alias("key"), "action", "effective_on")
        .where("key IS NOT NULL AND action IN ('add', 'remove') AND effective_on IS NOT NULL")
        .groupBy("list_name", "key", "effective_on")
        .agg(F.max("action").alias("action"))
    )
    changes = daily.withColumn("before", F.lag("action").over(entry)).where(
        "action <> coalesce(before, 'remove')"
    )
    return (
        changes.withColumn("valid_to", F.lead("effective_on").over(entry))
        .where("action = 'add'")
        .select("list_name", "key", F.col("effective_on").alias("valid_from"), "valid_to")
    )


def lookup_keys(url: Column) -> Column:
    """Every key a URL can be listed by: host suffixes, and host plus leading path parts.

    Scheme, user, port, query and fragment don't count; an empty or relative URL has no keys.
    """
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)", 1)
    authority = F.lower(F.regexp_extract(rest, r"^([^/]*)", 1))
    host = F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r":[0-9]*$", "")
    path = F.filter(F.split(F.regexp_replace(rest, r"^[^/]*/?", ""), "/"), lambda p: p != "")
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels)))
    )
    prefixes = F.transform(
        F.when(F.size(path) > 0, F.sequence(F.lit(1), F.size(path))).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat_ws("/", host, F.slice(path, F.lit(1), i)),
    )
    return F.when(host != "", F.array_distinct(F.concat(suffixes, prefixes))).otherwise(
        F.array().cast("array<string>")
    )


def judge(captures: DataFrame, events: DataFrame, allow_list: str = "allow") -> DataFrame:
    """One row per capture: page_id, url, fetched_on, active (sorted list:key of the entries active then), verdict.

    ``captures`` has page_id, url and fetched_on; other columns are not read. The verdict is ``allowed`` where an entry
    of ``allow_list`` is active, else ``blocked`` where any other is, else ``clear``. A null or keyless URL, and a null
    fetch date, is ``clear`` with no entries. Rows that repeat all three columns come back as often as they came. An
    empty list clears all.
    """
    pages = captures.select("page_id", "url", "fetched_on")
    spans = written(intervals(events), "list-intervals")
    counted = pages.groupBy("page_id", "url", "fetched_on").agg(F.count("*").alias("copies"))
    keyed = counted.withColumn("key", F.explode_outer(lookup_keys(F.col("url"))))
    active = (
        (F.col("fetched_on") >= F.col("valid_from"))
        & (F.col("valid_to").isNull() | (F.col("fetched_on") < F.col("valid_to")))
    )
    matched = keyed.join(spans.withColumnRenamed("key", "listed"), (F.col("key") == F.col("listed")) & active, "left")
    hits = (
        matched.groupBy("page_id", "url", "fetched_on")
        .agg(
            F.max("copies").alias("copies"),
            F.array_sort(F.collect_set(F.concat_ws(":", "list_name", "listed"))).alias("found"),
        )
        .withColumn("active", F.filter("found", lambda x: x != ""))
    )
    allowed = F.exists("active", lambda x: x.startswith(f"{allow_list}:"))
    verdict = F.when(allowed, "allowed").when(F.size("active") > 0, "blocked").otherwise("clear")
    return hits.select(
        "page_id",
        "url",
        "fetched_on",
        "active",
        verdict.alias("verdict"),
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")
