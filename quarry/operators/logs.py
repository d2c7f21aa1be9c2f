"""Operators over append-only logs: who wins per key, capped appends, pages and keyed rewrites.

Every policy takes the log's own order as columns, since arrival order is part of the meaning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.tables import written


def _packed(df: DataFrame) -> Column:
    return F.struct(*df.columns)


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key; a combining aggregate, so only one row a key and task is shuffled."""
    return df.groupBy(*keys).agg(F.max_by(_packed(df), F.struct(*order)).alias("row")).select("row.*")


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(_packed(df), F.struct(*order)).alias("row")).select("row.*")


def best_wins(df: DataFrame, keys: list[str], rank: Column, order: list[str]) -> DataFrame:
    """The row of least rank of each key; of equals the first."""
    best = F.min_by(_packed(df), F.struct(rank, *order)).alias("row")
    return df.groupBy(*keys).agg(best).select("row.*")


def rank_of(value: Column, order: list[str]) -> Column:
    """Place in a list of known values; unknown and null come last."""
    chain = reduce(lambda c, v: c.when(value == v[1], v[0]), enumerate(order), F.when(F.lit(False), -1))
    return chain.otherwise(len(order))


def last_wins_keeping_blank(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Last wins per key, but every row whose key is null or empty stays."""
    blank = F.coalesce(F.col(key), F.lit("")) == ""
    return last_wins(df.where(~blank), [key], order).unionByName(df.where(blank))


def capped(df: DataFrame, keys: list[str], order: list[str], cap: int, outcome: str) -> DataFrame:
    """At most ``cap`` rows of each key in order, then one row marked ``truncated:<outcome>``; the rest is dropped."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    marked = df.withColumn("nth", nth).where(F.col("nth") <= cap + 1)
    outcome_now = F.when(F.col("nth") > cap, F.concat(F.lit("truncated:"), F.col(outcome))).otherwise(F.col(outcome))
    return marked.withColumn(outcome, outcome_now)


def tail(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows, oldest first: a top-k, not a sort of everything."""
    newest = df.orderBy(*[F.desc(c) for c in order]).limit(n)
    return newest.orderBy(*order)


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def clamped_page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page by number from 1; beyond the end it is the last page."""
    last = max(1, -(-df.count() // size))
    return page(df, order, (min(max(number, 1), last) - 1) * size, size)


def upsert(table: DataFrame, changes: DataFrame, key: str, keep: str, order: list[str]) -> DataFrame:
    """The last version of each key, except that ``keep`` stays as the key's first version had it."""
    both = table.unionByName(changes)
    rest = [c for c in both.columns if c not in (key, keep)]
    latest = F.max_by(F.struct(*rest), F.struct(*order)).alias("row")
    first = F.min_by(keep, F.struct(*order)).alias(keep)
    return both.groupBy(key).agg(first, latest).select(key, keep, "row.*")


def placed(df: DataFrame, order: list[Column], place: str) -> DataFrame:
    """The rows with their place, from 1, in one order over the whole table; null keys come last.

    Rows are dealt by ranges of the order's keys, equal keys by a hash of the row, numbered in each sorted range, and that
    is written, since ranges are drawn from a sample and another run would draw others. A range begins at the count of
    the rows before it: one number a range, never all rows in one task. The rows are shuffled once.
    """
    keys = {f"_k{i}": c for i, c in enumerate(order)}
    in_order = [F.col(k).asc_nulls_last() for k in keys] + [F.col("_tie")]
    plain = df.select("*", F.xxhash64(*df.columns).alias("_tie"), *[_value(c).alias(k) for k, c in keys.items()])
    # The number holds the range's in its upper bits and the row's within the range in its lower 33.
    dealt = plain.repartitionByRange(*in_order).sortWithinPartitions(*in_order).withColumn("_at", F.monotonically_increasing_id())
    dealt = written(dealt.select(*df.columns, "_at"), "ranges").withColumn("_range", F.shiftright("_at", 33))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_range").agg(F.count("*").alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    both = dealt.join(F.broadcast(counts.select("_range", "_before")), "_range")
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return both.select(*df.columns, (F.col("_before") + within + 1).cast("long").alias(place))


def _value(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def with_previous(df: DataFrame, key: str, order: str, value: str, block: int = 1 << 14) -> DataFrame:
    """key, order, value and ``previous``: the value of the row before in the key's order; every row comes back.

    A null key is a key like any other. Rows of a null order come after the key's others, those of equal order go by
    their values, null first. A key may hold very many rows, so its order is cut into blocks of ``block`` numbers; a
    block's first row looks up the last value of the nearest block before it, which are few.
    """
    last = F.struct(F.col(order).isNull().alias("late"), F.col(order).alias("order"), F.col(value).alias("value"))
    rows = df.select(key, order, value, F.coalesce(F.floor(F.col(order) / block), F.lit((1 << 63) - 1)).alias("_block"))
    in_block = Window.partitionBy(key, "_block").orderBy(F.col(order).asc_nulls_last(), F.col(value).asc_nulls_first())
    edges = rows.groupBy(F.col(key).alias("_key"), F.col("_block").alias("_of")).agg(F.max(last)["value"].alias("_last"))
    edges = edges.select("_key", "_of", F.lag("_last").over(Window.partitionBy("_key").orderBy("_of")).alias("_edge"))
    near = rows.withColumn("_lag", F.lag(value).over(in_block)).withColumn("_first", F.row_number().over(in_block) == 1)
    found = near.join(edges, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_of")))
    return found.select(key, order, value, F.when(F.col("_first"), F.col("_edge")).otherwise(F.col("_lag")).alias("previous"))


def without(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key), key, "left_anti")
