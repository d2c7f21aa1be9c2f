"""Which accesses a cache of bounded size and age would have answered, over logs of any length.

A cache that drops what was used longest ago has, at any time, the entries used last: a list in order of use. What a block of
accesses does to that list is a list again, its own entries in order of use, put before those that were there. So blocks make
their lists apart, lists are put together block by block and group by group, and every block then runs through its
accesses from the list it begins with. No list is longer than the cache.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import chains, logs
from quarry.sources.tables import written

#: Accesses of a block; blocks of a group.
BLOCK, GROUP = 4096, 256
_ENTRY = "array<struct<key:string,size:bigint,version:double>>"


def _used(stack: OrderedDict, key, size, version, entries: int) -> None:
    stack.pop(key, None)
    stack[key] = (size, version)
    if len(stack) > entries:
        stack.popitem(last=False)


def _as_list(stack: OrderedDict) -> list[dict]:
    return [{"key": k, "size": s, "version": v} for k, (s, v) in stack.items()]


def _as_stack(found: list[dict] | None) -> OrderedDict:
    return OrderedDict((e["key"], (e["size"], e["version"])) for e in found or [])


def _lists(entries: int):
    """number, rows -> number, list: what a block's accesses, or a group's lists in order, leave in order of use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rows in batch.column(1):
                stack: OrderedDict = OrderedDict()
                for row in rows.as_py():
                    for e in row["list"] if "list" in row else [row]:
                        _used(stack, e["key"], e["size"], e["version"], entries)
                out.append(_as_list(stack))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _ENTRY_ARROW)], names=["number", "list"])

    return run


_ENTRY_ARROW = pa.list_(pa.struct([("key", pa.string()), ("size", pa.int64()), ("version", pa.float64())]))


def _begins(entries: int):
    """first list, rows (number, list) in order -> number, list: the list that each one begins with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows in zip(batch.column(0), batch.column(1)):
                stack = _as_stack(first.as_py())
                for row in rows.as_py():
                    yield pa.RecordBatch.from_arrays([pa.array([row["number"]], pa.int64()), pa.array([_as_list(stack)], _ENTRY_ARROW)], names=["number", "list"])
                    for e in row["list"]:
                        _used(stack, e["key"], e["size"], e["version"], entries)

    return run


def _started(lists: DataFrame, entries: int, group: int) -> DataFrame:
    """number, list: the list that each of the numbered ones begins with; level by level, ``group`` lists at a time."""
    rows = F.array_sort(F.collect_list(F.struct("number", "list"))).alias("rows")
    groups = written(lists.groupBy(F.floor(F.col("number") / group).cast("long").alias("of")).agg(rows), "cache-groups")
    if groups.count() > 1:
        ends = groups.select(F.col("of").alias("number"), "rows").mapInArrow(_lists(entries), f"number long, list {_ENTRY}")
        firsts = _started(written(ends, "cache-lists"), entries, group).select(F.col("number").alias("of"), F.col("list").alias("first"))
        inside = groups.join(firsts, "of").select("first", "rows")
    else:
        inside = groups.select(F.array().cast(_ENTRY).alias("first"), "rows")
    return inside.mapInArrow(_begins(entries), f"number long, list {_ENTRY}")


def _is_held(stack: OrderedDict, key, version, entries: int, most: int, drift: float) -> bool:
    """Whether the key's entry is there and its source as it was: those used since, with itself, fit the cache."""
    if key not in stack:
        return False
    own, then = stack[key]
    if version is not None and then is not None and abs(version - then) > drift:
        return False
    total = own
    for nth, (other, (size, _)) in enumerate(reversed(stack.items())):
        if other == key:
            return nth == 0 or total <= most
        total += size
        if nth + 1 >= entries or total > most:
            return False
    return False


def _judged(entries: int, most: int, drift: float):
    """list, accesses in order -> place, key, at, held, since: the place of the block's last access of the key that missed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows in zip(batch.column(0), batch.column(1)):
                stack, missed, out = _as_stack(first.as_py()), {}, []
                for row in rows.as_py():
                    key = row["key"]
                    held = _is_held(stack, key, row["version"], entries, most, drift)
                    if not held:
                        missed[key] = row["place"]
                    out.append((row["place"], key, row["at"], held, missed.get(key)))
                    _used(stack, key, row["size"], row["version"], entries)
                place, key, at, held, since = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(place, pa.int64()), pa.array(key, pa.string()), pa.array(at, pa.int64()), pa.array(held), pa.array(since, pa.int64())],
                    names=["place", "key", "at", "held", "since"],
                )

    return run


def accesses(
    df: DataFrame, order: list, key: str, at: str, size: str, version: str | None = None,
    entries: int = 1024, most_bytes: int = 2 << 30, ttl: int = 3600, drift: float = 1.0, block: int = BLOCK, group: int = GROUP,
) -> DataFrame:
    """place, key, at, hit for every access in order: whether the cache answers it.

    It does if the key is among the ``entries`` used last, these with all used since fit ``most_bytes`` (the one used last is
    held however large), the source's ``version`` is within ``drift`` of what the access before saw, and the entry was made
    no more than ``ttl`` ago; else the entry is made anew. An entry weighs what its latest access says. Nulls of size count
    as 0, of version as unchanged; a null key is a key. Tasks hold a block of accesses with one list, or a group's lists.
    """
    rows = df.select(
        F.col(key).cast("string").alias("key"), F.col(at).cast("long").alias("at"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"),
        (F.col(version) if version else F.lit(None)).cast("double").alias("version"), *[logs._value(o).alias(f"_o{i}") for i, o in enumerate(order)],
    )
    turns = [f"_o{i}" for i in range(len(order))]
    dealt = logs.placed(rows, turns, "place").drop(*turns).withColumn("number", F.floor((F.col("place") - 1) / block).cast("long"))
    blocks = written(dealt.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("place", "key", "at", "size", "version"))).alias("rows")), "cache-blocks")
    lists = written(blocks.select("number", "rows").mapInArrow(_lists(entries), f"number long, list {_ENTRY}"), "cache-lists")
    begins = _started(lists, entries, group)
    judged = blocks.join(begins, "number").select("list", "rows").mapInArrow(_judged(entries, most_bytes, drift), "place long, key string, at long, held boolean, since long")
    found = written(judged.withColumn("number", F.floor((F.col("place") - 1) / block).cast("long")), "cache-judged")
    # An entry is made by a miss. Blocks in which a key has none yet look up the nearest before.
    edges = found.groupBy(F.col("key").alias("_key"), F.col("number").alias("_of")).agg(F.max("since").alias("last"))
    before = F.last("last", ignorenulls=True).over(Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1))
    edges = edges.select("_key", "_of", before.alias("before"))
    made = found.join(edges, F.col("key").eqNullSafe(F.col("_key")) & (F.col("number") == F.col("_of"))).select("place", "key", "at", F.coalesce("since", "before").alias("made"))
    made = written(made, "cache-made")
    renewed = chains.ttl_taken(made, ["key", "made"], F.col("at"), ttl + 1).select(F.col("made").alias("_made"), F.col("at").alias("_at"), F.lit(True).alias("new"))
    first = made.groupBy("made", "at").agg(F.min("place").alias("place"))
    misses = first.join(renewed, (F.col("made") == F.col("_made")) & (F.col("at") == F.col("_at"))).select("place", "new")
    return made.join(misses, "place", "left").select("place", "key", "at", F.col("new").isNull().alias("hit"))
