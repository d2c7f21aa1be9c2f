"""Order-dependent merges of keys that may hold very many rows.

What a run of rows does is made into something that can be put together with the next run's: a map from each state that
may come in to the state that goes out. Runs are short and folded apart; only their maps meet, in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.tables import written

#: Rows of a run that is folded at once; blocks of time, in times to live.
RUN, SPAN = 1024, 64


def _composed(maps: Column, states: int) -> Column:
    """Maps from state to state, one after the other."""
    start = F.array(*[F.lit(s) for s in range(states)])
    return F.aggregate(maps, start, lambda done, step: F.transform(done, lambda s: F.element_at(step, s + 1)))


def _in_turn(rows: DataFrame, keys: list[str], nth: str, states: int) -> DataFrame:
    steps = F.transform(F.array_sort(F.collect_list(F.struct(nth, "map"))), lambda x: x["map"])
    return rows.groupBy(*keys).agg(_composed(steps, states).alias("map"), F.sum("n").alias("n"))


def replayed(
    df: DataFrame, key: str, order: list[str], event: str, moves: dict[tuple[str, str], str], start: str, run: int = RUN
) -> DataFrame:
    """key, state, n: a state machine run over each key's n events; moves that aren't listed leave the state as it is.

    Rows are dealt by ranges of key and order, so a key's rows spread over as many tasks as they fill; a run of
    ``run`` rows becomes a map of all states, a range's runs one map, and a key's ranges one. Equal places in the order go
    by event. Null and unknown events move nothing; a null key is a key.
    """
    states = sorted({s for s, _ in moves} | set(moves.values()) | {start})
    number = {s: i for i, s in enumerate(states)}
    events = sorted({e for _, e in moves})
    maps = {e: [number[moves.get((s, e), s)] for s in states] for e in events}
    stay = F.array(*[F.lit(i) for i in range(len(states))])
    table = F.create_map(*[x for e, m in maps.items() for x in (F.lit(e), F.array(*map(F.lit, m)))])
    rows = df.select(F.col(key).alias("key"), F.struct(*order, F.col(event).alias("event")).alias("at"))
    dealt = written(rows.repartitionByRange("key", "at").withColumn("part", F.spark_partition_id()), "events")
    nth = F.row_number().over(Window.partitionBy("key", "part").orderBy("at")) - 1
    step = F.when(F.col("at.event").isNull(), stay).otherwise(F.coalesce(F.try_element_at(table, F.col("at.event")), stay))
    runs = dealt.select("key", "part", nth.alias("nth"), step.alias("map"), F.lit(1).cast("long").alias("n")).withColumn("run", F.floor(F.col("nth") / run))
    found = _in_turn(_in_turn(_in_turn(runs, ["key", "part", "run"], "nth", len(states)), ["key", "part"], "run", len(states)), ["key"], "part", len(states))
    name = F.element_at(F.array(*map(F.lit, states)), F.element_at("map", number[start] + 1) + 1)
    return found.select(F.col("key").alias(key), name.alias("state"), "n")


def _arrays(column: pa.Array) -> Iterator[np.ndarray]:
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return (flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()))


def _exits(times: np.ndarray, begin: int, ttl: int) -> tuple[np.ndarray, np.ndarray]:
    """By the time from which a block may take its first row: when the next may be taken after its last.

    Step function: up to ``upto[i]`` the answer is ``exits[i]``; beyond the last one the block takes no row.
    """
    after = np.searchsorted(times, times + ttl)
    last, ahead = np.arange(len(times)), np.append(after, len(times))
    while True:  # pointers are doubled until every path has reached its end
        step = ahead[ahead[:-1]]
        moved = ahead[:-1] < len(times)
        last = np.where(moved, last[np.minimum(ahead[:-1], len(times) - 1)], last)
        if not (step < len(times)).any():
            break
        ahead = np.append(step, len(times))
    # A row may be the first taken if it lies within one time to live of the block's begin, or is the first behind that.
    most = min(int(np.searchsorted(times, begin + ttl)) + 1, len(times))
    exits = times[last[:most]] + ttl
    keep = np.append(exits[1:] != exits[:-1], True)
    return times[:most][keep], exits[keep]


def _block_maps(ttl: int, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_exits(t, b * span, ttl) for t, b in zip(_arrays(batch.column(2)), batch.column(1).to_pylist())]
            upto, exits = ([x[k] for x in found] for k in (0, 1))
            lists = [pa.array([v.tolist() for v in side], pa.list_(pa.int64())) for side in (upto, exits)]
            first = pa.array([int(t[0]) for t in _arrays(batch.column(2))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), first, *lists], names=["key", "block", "first", "upto", "exits"])

    return run


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a run's blocks in order: the time from which each may take its first row."""
    for batch in batches:
        keys, blocks, begins = [], [], []
        for at, run in enumerate(batch.column(1)):
            free = None
            for one in run.as_py():
                keys.append(at)
                blocks.append(one["block"])
                begins.append(free)
                k = 0 if free is None else int(np.searchsorted(one["upto"], free))
                if k < len(one["upto"]):
                    free = one["exits"][k]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(blocks, pa.int64()), pa.array(begins, pa.int64())], names=["key", "block", "free"])


def _taken(ttl: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for times, free in zip(_arrays(batch.column(1)), batch.column(2).to_pylist()):
                at = 0 if free is None else int(np.searchsorted(times, free))
                own = []
                while at < len(times):
                    own.append(int(times[at]))
                    at = int(np.searchsorted(times, times[at] + ttl))
                out.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["key", "times"])

    return run


def ttl_taken(df: DataFrame, keys: list[str], at: Column, ttl: int, span: int = SPAN) -> DataFrame:
    """keys, at: the times that count, where a time counts if ``ttl`` has passed since the last one of the key that did.

    Equal times count once. Time is cut into blocks of ``span`` times to live. For a block it is found out, by doubling
    pointers to each time's next, what each time that may be its first leads to; blocks without a pause of one time
    to live between them are put together in order, as these answers alone, and every block then takes its own times. A
    task holds the distinct times of one block, or the answers of one run of blocks. Null times never count; a null key
    is a key.
    """
    width = span * ttl
    key = F.struct(*keys).alias("key")
    times = df.select(key, at.cast("long").alias("at")).where("at IS NOT NULL").distinct()
    block = F.floor(F.col("at") / width).cast("long").alias("block")
    blocks = written(times.groupBy("key", block).agg(F.array_sort(F.collect_list("at")).alias("times")), "time-blocks")
    kind = blocks.schema["key"].dataType.simpleString()
    maps = blocks.mapInArrow(_block_maps(ttl, width), f"key {kind}, block long, first long, upto array<bigint>, exits array<bigint>")
    in_order = Window.partitionBy("key").orderBy("block")
    pause = F.coalesce(F.col("first") >= F.lag(F.array_max("exits")).over(in_order), F.lit(True))
    cut = maps.withColumn("pause", pause).withColumn("run", F.sum(F.col("pause").cast("int")).over(in_order))
    runs = cut.groupBy("key", "run").agg(F.array_sort(F.collect_list(F.struct("block", "upto", "exits"))).alias("blocks"))
    free = runs.select("key", "blocks").mapInArrow(_entries, f"key {kind}, block long, free long")
    taken = blocks.join(free, ["key", "block"]).select("key", "times", "free").mapInArrow(_taken(ttl), f"key {kind}, times array<bigint>")
    return taken.select("key.*", F.explode("times").alias("at"))
