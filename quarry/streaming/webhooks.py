"""Streaming forms of the event operators: time-to-live dedup, debounced batches and a live status table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from threading import Thread

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quarry.operators import logs
from quarry.sources.published import Store

#: Groups that the keys of a stream are dealt to.
GROUPS = 1024
_NEVER = np.iinfo(np.int64).min

def _next_free(codes: np.ndarray, times: np.ndarray, ttl: int) -> np.ndarray:
    """For rows in the order of code and time, the place of the first one of the code whose time is ``ttl`` or more later.

    Where there is none it is the place behind the code's rows.
    """
    known = np.unique(times)
    width = len(known) + 1
    return np.searchsorted(codes * width + np.searchsorted(known, times), codes * width + np.searchsorted(known, times + ttl))


def _taken_rows(codes: np.ndarray, times: np.ndarray, last: np.ndarray, ttl: int) -> np.ndarray:
    """Which rows, in the order of code and time, are taken; ``last`` by code is brought up to date, _NEVER if there was none."""
    taken = np.zeros(len(codes), bool)
    after = _next_free(codes, times, ttl)
    at = np.flatnonzero(np.diff(codes, prepend=-1))  # the first row of each code
    ends = np.append(at[1:], len(codes))
    fresh = last[codes[at]] == _NEVER
    for k in np.flatnonzero(~fresh):
        at[k] += np.searchsorted(times[at[k] : ends[k]], last[codes[at[k]]] + ttl)
    while len(at):  # each turn takes one more row of every code that has one
        at, ends = at[at < ends], ends[at < ends]
        taken[at] = True
        last[codes[at]] = times[at]
        at = after[at]
    return taken


def accepted(events: DataFrame, keys: list[str], at: str, ttl_seconds: int, lateness: str = "0 seconds", groups: int = GROUPS) -> DataFrame:
    """Events of which each key takes one per time to live, counted from the last that was taken.

    The state of a key is one time. It is dropped when the watermark, ``lateness`` behind the latest event, has passed
    that time and its time to live: by then any event still to come is taken anyway, however slowly or late the stream
    is read. Events of a key are taken in time order within a micro-batch; a dropped event doesn't extend anything. An
    event without a time is taken where its key has neither a state nor another event.

    Keys are dealt to ``groups`` groups, each of which keeps its keys' times in one state: a call of Python costs far more
    than a key's work. Keys are told apart by their whole values. A checkpoint is bound to the number of groups.
    """
    ttl = ttl_seconds * 1_000_000
    columns = events.columns
    # pandas makes floats of whole numbers among nulls: keys of a group are null alike, other longs go as text.
    longs = [f.name for f in events.schema.fields if isinstance(f.dataType, LongType) and f.name not in keys]
    exact = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}

    def take(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, last = map(list, state.get) if state.exists else ([], [])
        kept = None
        if not state.hasTimedOut:
            rows = pd.concat(list(batches), ignore_index=True)
            codes, found = pd.factorize(np.array(names + rows["_name"].tolist(), object))
            last = np.array(last + [_NEVER] * (len(found) - len(names)), np.int64)
            names, codes = found.tolist(), codes[len(codes) - len(rows) :].astype(np.int64)
            missing = rows[at].isna().to_numpy()
            times = rows[at].astype("datetime64[us]").astype("int64").to_numpy()
            timed, untimed = np.flatnonzero(~missing), np.flatnonzero(missing)
            timed = timed[np.lexsort((times[timed], codes[timed]))]
            keep = timed[_taken_rows(codes[timed], times[timed], last, ttl)]
            _, first = np.unique(codes[untimed], return_index=True)
            first = untimed[first]
            kept = rows.iloc[np.concatenate([keep, first[last[codes[first]] == _NEVER]])][columns]
        last = np.array(last, np.int64)
        ends = last // 1000 + ttl_seconds * 1000
        open_ = np.flatnonzero(ends > state.getCurrentWatermarkMs())
        if len(open_):
            state.update(([names[k] for k in open_.tolist()], last[open_].tolist()))
            state.setTimeoutTimestamp(int(ends[open_].min()))
        elif state.exists:
            state.remove()
        if kept is not None:
            yield kept

    dealt = events.withWatermark(at, lateness).select(
        *(F.col(c).cast("string").alias(c) if c in longs else c for c in columns),
        F.to_json(F.struct(*keys), exact).alias("_name"), F.concat(*(F.col(k).isNull().cast("string") for k in keys)).alias("_nulls"),
    ).withColumn("_group", F.pmod(F.xxhash64("_name"), F.lit(groups)))
    sent = StructType([StructField(f.name, StringType()) if f.name in longs else f for f in events.schema.fields])
    taken = dealt.groupBy("_group", "_nulls").applyInPandasWithState(
        take, sent, "names array<string>, last array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )
    return taken.select(*(F.col(c).cast("long").alias(c) if c in longs else c for c in columns))


def debounced(events: DataFrame, keys: list[str], at: str, item: str, delay: str, lateness: str) -> DataFrame:
    """keys, began, fires, items: batches that each arrival prolongs by ``delay``, their distinct items in order."""
    window = F.session_window(F.col(at), delay).alias("w")
    grouped = events.withWatermark(at, lateness).groupBy(*keys, window)
    return grouped.agg(F.array_sort(F.collect_set(item)).alias("items")).select(
        *keys, F.col("w.start").alias("began"), F.col("w.end").alias("fires"), "items"
    )


def _folders(store: Store, below: int) -> dict[int, list[tuple[int, str]]]:
    """For each bucket its (version, folder) under a version number, oldest first."""
    found: dict[int, list[tuple[int, str]]] = {}
    for name in store.names(""):
        kind, _, version = name.partition("=")
        if kind == "version" and int(version) < below and store.read(f"{name}/_whole.json") is not None:
            for bucket in store.names(name):
                if bucket.startswith("bucket="):
                    found.setdefault(int(bucket[7:]), []).append((int(version), f"{name}/{bucket}"))
    return {bucket: sorted(versions) for bucket, versions in found.items()}


def upserted(spark: SparkSession, path: str) -> DataFrame:
    """The table as ``upserting`` left it: the newest folder of every bucket."""
    return spark.read.parquet(*[f"{path}/{versions[-1][1]}" for versions in _folders(Store(path), 1 << 62).values()])


def upserting(path: str, key: str, keep: str, order: list[str], buckets: int = 64):
    """A ``foreachBatch`` function that folds each micro-batch into a table of last versions.

    The table is dealt into ``buckets`` by a hash of the key. A micro-batch reads and writes only the buckets it
    touches, as folders ``version=<batch>/bucket=<n>``, which count once a small file says that the version is whole. A
    bucket keeps its last two versions, so a batch that is run again starts from what it found the first time and writes
    the same again.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, store = batch.sparkSession, Store(path)
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        dealt = batch.withColumn("bucket", bucket).persist()
        touched = {r.bucket for r in dealt.select("bucket").distinct().collect()}  # buckets numbers at most
        if touched:
            before = _folders(store, number)
            held = [f"{path}/{before[b][-1][1]}" for b in sorted(touched & set(before))]
            table = spark.read.parquet(*held) if held else batch.limit(0)
            rows = logs.upsert(table.select(*batch.columns), batch, key, keep, order)
            target = f"{path}/version={number}"
            rows.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
            store.replace(f"version={number}/_whole.json", {"batch": number})
            for b in touched & set(before):
                for _, folder in before[b][:-1]:
                    store.drop(folder)
        dealt.unpersist()

    return write


class Progress(StreamingQueryListener):
    """Calls back with what each micro-batch has done; a callback that returns False ends the query after that batch.

    Spark gives listeners no right to stop a query from within, so the query is stopped by a thread of its own.
    """

    def __init__(self, callback: Callable[[dict], bool | None], name: str | None = None):
        self.callback, self.name, self.ended = callback, name, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.name is not None and p.name != self.name:
            return
        if self.callback({"query": p.name, "batch": p.batchId, "rows": p.numInputRows}) is False:
            query = next((q for q in SparkSession.active().streams.active if q.id == str(p.id)), None)
            if query is not None:
                Thread(target=query.stop, daemon=True).start()

    def onQueryTerminated(self, event) -> None:
        self.ended.append((str(event.id), event.exception))


def due(batches: DataFrame, now: str, at_once: DataFrame, keys: list[str]) -> DataFrame:
    """The pending batches that fire: those whose time has come, and those of the keys that are asked for at once."""
    asked = at_once.select(*keys).distinct().withColumn("asked", F.lit(True))
    rows = batches.join(asked, keys, "left")
    return rows.where(F.col("asked") | (F.col("fires") <= F.lit(now).cast("timestamp"))).drop("asked")
