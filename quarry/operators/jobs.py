"""Rules of a job table: what a restart makes of it, chains and their children, versioned records, who publishes a path."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Prefix of ids of a former kind, which are dropped; seconds after which a chain isn't taken up again;
#: least and greatest age, in minutes, up to which other jobs are.
FORMER_ID, CHAIN_AGE_S, LEAST_AGE_M, MOST_AGE_M = "retry-", 86_400, 5, 1440


def restarted(jobs: DataFrame, now: Column, max_age_minutes: int = 720) -> DataFrame:
    """The jobs with ``state`` and ``action`` after a restart; those of a former id are left out.

    ``jobs`` has id, status (pending, running or anything else), is_chain, is_attempt, started and created (seconds). A chain
    that waits or runs goes on waiting (``chain``), an attempt that does has failed, as its chain makes another
    (``interrupted``). Any other job that waits or runs is taken up again (``revived``) if what it last did, its start or
    else its making, is no older than ``max_age_minutes`` (5 to 1,440); else a running one has failed (``interrupted``)
    and a waiting one stays (``stale``). The rest stays as it is (``kept``). Null flags count as false.
    """
    age = max(LEAST_AGE_M, min(MOST_AGE_M, max_age_minutes)) * 60
    live, running = F.col("status").isin("pending", "running"), F.col("status") == "running"
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    recent = F.coalesce(now - F.coalesce("started", "created") <= age, F.lit(False))
    action = (
        F.when(flag("is_chain") & live, "chain").when(flag("is_attempt") & live, "interrupted").when(live & recent, "revived")
        .when(running, "interrupted").when(live, "stale").otherwise("kept")
    )
    state = F.when(action.isin("chain", "revived"), "pending").when(action == "interrupted", "failed").otherwise(F.col("status"))
    kept = jobs.where(~F.coalesce(F.col("id").startswith(FORMER_ID), F.lit(False)))
    return kept.select("*", state.alias("state"), action.alias("action"))


def resumed(chains: DataFrame, children: DataFrame, now: Column, age: int = CHAIN_AGE_S) -> DataFrame:
    """id, fate of each chain: expired if older than ``age`` seconds, revived if a child waits or runs, else orphaned.

    ``chains`` has id and started (null counts as now), ``children`` parent and status.
    """
    living = children.where(F.col("status").isin("pending", "running")).select(F.col("parent").alias("id")).distinct().withColumn("lives", F.lit(True))
    old = F.coalesce(now - F.col("started") > age, F.lit(False))
    return chains.join(living, "id", "left").select("id", F.when(old, "expired").when(F.col("lives"), "revived").otherwise("orphaned").alias("fate"))


def children_of(jobs: DataFrame) -> DataFrame:
    """parent, child, nth: each chain's attempts once, by either family of flags, in the order of attempt and making.

    ``jobs`` has id, is_retry, parent_job, is_retry_attempt, parent_chain, attempt and created. A job that both families
    make the child of one chain is its child once.
    """
    families = [("is_retry", "parent_job"), ("is_retry_attempt", "parent_chain")]
    found = [jobs.where(F.coalesce(F.col(flag), F.lit(False)) & F.col(parent).isNotNull()).select(F.col(parent).alias("parent"), F.col("id").alias("child"), "attempt", "created")
             for flag, parent in families]
    once = found[0].unionByName(found[1]).groupBy("parent", "child").agg(F.min(F.struct(F.coalesce("attempt", F.lit(0)), F.coalesce(F.col("created").cast("string"), F.lit("")))).alias("turn"))
    return once.select("parent", "child", F.row_number().over(Window.partitionBy("parent").orderBy("turn", "child")).alias("nth"))


def publishers(owners: DataFrame, hints: DataFrame, servers: DataFrame, excluded: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """path, server, adapter, hinted: who publishes a path, of its owners and of the servers that hints name.

    ``owners`` and ``hints`` have path and server; ``servers`` server, enabled and adapter. Unknown and disabled servers, those
    whose own rule excludes the path, and those without an adapter go.
    """
    both = owners.select("path", "server", F.lit(False).alias("hinted")).unionByName(hints.select("path", "server", F.lit(True).alias("hinted")))
    known = servers.where("enabled AND adapter IS NOT NULL").select("server", "adapter")
    rows = both.groupBy("path", "server").agg(F.bool_or("hinted").alias("hinted")).join(F.broadcast(known), "server")
    gone = reduce(lambda a, b: a | b, [(F.col("server") == server) & rule(F.col("path")) for server, rule in excluded.items()], F.lit(False))
    return rows.where(~gone).select("path", "server", "adapter", "hinted")


Step = Callable[[DataFrame], dict[str, Column]]


def migrated(records: DataFrame, version: str, steps: list[Step]) -> DataFrame:
    """Records brought to the last version, each through every step from its own on: step n makes version n + 1 of n.

    A step gives new columns from the record as the step before left it. A record of an unknown version (null, or
    below 1) starts at 1, one from the future stays.
    """
    rows = records.withColumn(version, F.when(F.coalesce(F.col(version), F.lit(0)) < 1, 1).otherwise(F.col(version)))
    for number, step in enumerate(steps, 1):
        due = F.col(version) == number
        new = step(rows)
        for name in new:
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(None))
        held = {name: F.when(due, value).otherwise(F.col(name)) for name, value in new.items()}
        rows = rows.withColumns(held | {version: F.when(due, number + 1).otherwise(F.col(version))})
    return rows


def imported_once(target: DataFrame, lines: DataFrame) -> DataFrame:
    """The target, or where it has no rows what a one-time import of parsed records gives, records that can't be read left out.

    ``lines`` has the target's columns and ``_corrupt``, null for records that were read.
    """
    if not target.isEmpty():
        return target
    return lines.where(F.col("_corrupt").isNull()).select(*target.columns)


def first_reason(lines: Column, rules: list[tuple[str, str | None, Column]]) -> Column:
    """The first rule's reason whose condition holds and whose pattern any of the lines has; null patterns need no line."""
    found = F.lit(None).cast("string")

    def seen(pattern: str) -> Column:
        return F.exists(lines, lambda line: F.coalesce(line.rlike(pattern), F.lit(False)))

    for reason, pattern, condition in reversed(rules):
        hit = F.lit(True) if pattern is None else seen(pattern)
        found = F.when(condition & F.coalesce(hit, F.lit(False)), reason).otherwise(found)
    return found
