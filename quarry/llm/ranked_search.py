"""Ranked lexical search by best-first document intervals over posting lists with range-maximum sparse tables.

The documents' postings of the searched terms are written once. Each task takes them in blocks of bounded size, numbers a
block's documents, and lays a sparse table over each posting list, which gives the largest impact in any interval of
documents by two look-ups. For an item the sum of its terms' largest impacts bounds every score in an interval. The
interval with the largest bound is split at its document of maximum impact, which is scored; intervals of few documents
are scored in full; those whose bound is below the k-th best score so far are never opened. A task keeps k documents an
item over all its blocks, so only those move, and their best are the answer: the search is exact.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import written

#: Documents and postings of a block, intervals that are opened together, documents of an interval that is scored in full.
BLOCK_DOCS, BLOCK_POSTINGS, TOGETHER, LEAF = 1 << 14, 400_000, 64, 32
#: Items and terms of items that go to the tasks together, and so through the corpus in one pass.
PASS_ITEMS, PASS_TERMS = 10_000, 2_000_000
_TERM_BYTES = bytes(c if 48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))
#: Bits of a table's entry below the impact: an arbitrary order among equal impacts, which keeps splits even, and a place.
_TURN_BITS, _PLACE_BITS = 11, 32
_FOUND = "item int, item_id long, doc_id long, score long"


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased."""
    return (text or "").encode().translate(_TERM_BYTES).lower().split()


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


@dataclass
class Items:
    """One pass of items: their ids, their terms as numbers, and the terms' numbers."""

    ids: list
    terms: list[np.ndarray]
    numbers: dict[bytes, int]


def item_passes(items: DataFrame) -> Iterator[Items]:
    ids, rows, numbers, total = [], [], {}, 0
    for item in items.select("item_id", "text").toLocalIterator(prefetchPartitions=True):
        own = np.array([numbers.setdefault(t, len(numbers)) for t in dict.fromkeys(terms(item.text))], np.int64)
        ids.append(item.item_id)
        rows.append(own)
        total += len(own)
        if len(ids) >= PASS_ITEMS or total >= PASS_TERMS:
            yield Items(ids, rows, numbers)
            ids, rows, numbers, total = [], [], {}, 0
    if ids:
        yield Items(ids, rows, numbers)


def postings(docs: DataFrame, sent) -> DataFrame:
    """doc_id, n (terms of the text, with repeats), terms and tfs: the searched terms that it has and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.get
        for batch in batches:
            sizes, found, times = [], [], []
            for text in batch.column(1):
                own = terms(text.as_py())
                counted = Counter(own)
                known = [(k, c) for t, c in counted.items() if (k := number(t)) is not None]
                sizes.append(len(own))
                found.append([k for k, _ in known])
                times.append([c for _, c in known])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))],
                names=["doc_id", "n", "terms", "tfs"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Block:
    """Some documents' posting lists, one after the other, with the sparse tables over their impacts."""

    def __init__(self, ids: np.ndarray, nulls: np.ndarray, m: np.ndarray, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, known: int):
        order = np.lexsort((doc, term))
        self.ids, self.nulls, self.size = ids, nulls, len(ids)
        self.doc = doc[order]
        self.impact = impact(tf[order], m[self.doc])
        self.keys = term[order] * self.size + self.doc
        self.starts = np.searchsorted(term[order], np.arange(known + 1))
        turns = np.random.default_rng(self.size).integers(0, 1 << _TURN_BITS, self.size)
        levels = [((self.impact << _TURN_BITS | turns[self.doc]) << _PLACE_BITS) | np.arange(len(self.doc))]
        longest = int(np.diff(self.starts).max(initial=0))
        while 2 << (len(levels) - 1) <= longest:
            last, step = levels[-1], 1 << (len(levels) - 1)
            grown = last.copy()
            np.maximum(last[:-step], last[step:], out=grown[:-step])
            levels.append(grown)
        self.table = np.array(levels)
        self.logs = np.zeros(longest + 2, np.int64)
        for n in range(2, longest + 2):
            self.logs[n] = self.logs[n >> 1] + 1

    def largest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The greatest entry of each run [low, high) of postings of one list, 0 where it is empty."""
        size = high - low
        level = self.logs[size]
        at = np.where(size > 0, low, 0)
        other = np.where(size > 0, high - (1 << level), 0)
        return np.where(size > 0, np.maximum(self.table[level, at], self.table[level, other]), 0)

    def search(self, own: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Puts the block's best documents for an item's terms into ``best``."""
        own = own[(weights[own] > 0) & (self.starts[own] < self.starts[own + 1])]
        if not len(own):
            return
        w = weights[own]
        low, high = self.starts[own][None, :], self.starts[own + 1][None, :]
        begin, end = np.zeros(1, np.int64), np.full(1, self.size)
        bound, split = self._bounds(low, high, w)
        while True:
            open_ = np.flatnonzero(bound >= max(best.least, 1))
            if not len(open_):
                return
            if len(open_) < len(bound):
                begin, end, low, high, bound, split = (x[open_] for x in (begin, end, low, high, bound, split))
            if len(bound) > TOGETHER:
                order = np.argpartition(-bound, TOGETHER)
                now, later = order[:TOGETHER], order[TOGETHER:]
            else:
                now, later = np.arange(len(bound)), np.arange(0)
            few = end[now] - begin[now] <= LEAF
            self._score_all(low[now[few]], high[now[few]], w, best)
            now = now[~few]
            place = self.doc[split[now]]
            at = np.searchsorted(self.keys, own[None, :] * self.size + place[:, None])
            there = (at < high[now]) & (self.doc[np.minimum(at, len(self.doc) - 1)] == place[:, None])
            scores = (np.where(there, self.impact[np.minimum(at, len(self.doc) - 1)], 0) * w).sum(axis=1)
            best.add(scores, self.ids[place], self.nulls[place])
            new_low = np.concatenate([low[now], at + there])
            new_high = np.concatenate([at, high[now]])
            new_bound, new_split = self._bounds(new_low, new_high, w)
            begin = np.concatenate([begin[later], begin[now], place + 1])
            end = np.concatenate([end[later], place, end[now]])
            low, high = np.concatenate([low[later], new_low]), np.concatenate([high[later], new_high])
            bound, split = np.concatenate([bound[later], new_bound]), np.concatenate([split[later], new_split])

    def _bounds(self, low: np.ndarray, high: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each interval: the bound of its scores, and the posting of greatest impact."""
        entry = self.largest(low, high)
        most = (entry >> (_TURN_BITS + _PLACE_BITS)) * w
        where = most.argmax(axis=1)
        return most.sum(axis=1), entry[np.arange(len(entry)), where] & ((1 << _PLACE_BITS) - 1)

    def _score_all(self, low: np.ndarray, high: np.ndarray, w: np.ndarray, best: Best) -> None:
        """Scores every document of the intervals, which don't overlap, by adding up their postings."""
        size = (high - low).ravel()
        if not size.sum():
            return
        at = np.repeat(low.ravel() - np.cumsum(size) + size, size) + np.arange(size.sum())
        parts = self.impact[at] * np.repeat(np.broadcast_to(w, low.shape).ravel(), size)
        docs, where = np.unique(self.doc[at], return_inverse=True)
        order = np.argsort(where, kind="stable")
        scores = np.add.reduceat(parts[order], np.searchsorted(where[order], np.arange(len(docs))))
        best.add(scores, self.ids[docs], self.nulls[docs])


class Best:
    """The k best documents of one item so far: by score, then by ascending doc_id, null last."""

    def __init__(self, k: int):
        self.k, self.least = k, 0
        self.scores, self.ids, self.nulls = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        good = scores >= max(self.least, 1)
        if not good.any():
            return
        scores, ids, nulls = (np.concatenate([a, b[good]]) for a, b in ((self.scores, scores), (self.ids, ids), (self.nulls, nulls)))
        order = np.lexsort((ids, nulls, -scores))[: self.k]
        self.scores, self.ids, self.nulls = scores[order], ids[order], nulls[order]
        self.least = int(self.scores[-1]) if len(order) == self.k else 0


def _blocks(batches: Iterator[pa.RecordBatch], documents: int, length: int, known: int) -> Iterator[Block]:
    rows, docs, found = [], 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            rows.append(part)
            docs, found = docs + part.num_rows, found + len(part.column(2).flatten())
            if docs >= BLOCK_DOCS or found >= BLOCK_POSTINGS:
                yield _block(rows, documents, length, known)
                rows, docs, found = [], 0, 0
    if rows:
        yield _block(rows, documents, length, known)


def _block(rows: list[pa.RecordBatch], documents: int, length: int, known: int) -> Block:
    table = pa.Table.from_batches(rows).combine_chunks()
    ids, n, owned, times = (table.column(i).combine_chunks() for i in range(4))
    m = 50 + (50 * n.to_numpy(zero_copy_only=False) * documents) // length
    sizes = owned.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return Block(
        ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64),
        ids.is_null().to_numpy(zero_copy_only=False),
        m,
        owned.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
        np.repeat(np.arange(len(ids)), sizes),
        times.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
        known,
    )


def _found(rows: DataFrame, sent, k: int) -> DataFrame:
    """Each task's k best documents of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, owned, weights, documents, length = sent.value
        best = [Best(k) for _ in ids]
        for block in _blocks(batches, documents, length, len(weights)):
            for own, into in zip(owned, best):
                block.search(own, weights, into)
        for at, (item_id, into) in enumerate(zip(ids, best)):
            if size := len(into.scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at] * size, pa.int32()), pa.array([item_id] * size, pa.int64()),
                     pa.array(into.ids, pa.int64(), mask=into.nulls), pa.array(into.scores, pa.int64())],
                    names=["item", "item_id", "doc_id", "score"],
                )

    return rows.where(F.size("terms") > 0).mapInArrow(run, _FOUND)


def _top(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """The k best documents of each item: item_id, rank (from 1), doc_id, score (above 0).

    All documents are ranked and counted in the statistics. Equal scores are ranked by ascending doc_id, null ids last,
    repeated rows each. Null and empty texts have no terms: such a document is never found, such an item finds nothing.
    Each row of ``items`` is an item, repeated rows too; null item ids are carried along. Empty tables: no rows. Columns
    other than doc_id and text, item_id and text, are not read.
    """
    context = docs.sparkSession.sparkContext
    found = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for one in item_passes(items):
        numbers = context.broadcast(one.numbers)
        rows = written(postings(docs, numbers), "postings")
        total = rows.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        df = np.zeros(len(one.numbers), np.int64)
        for row in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toLocalIterator():
            df[row.term] = row.df
        weights = np.array([weight(total.documents, int(x)) for x in df], np.int64)
        sent = context.broadcast((one.ids, one.terms, weights, total.documents, max(total.length, 1)))
        some = _found(rows, sent, k).withColumn("part", F.spark_partition_id() % 64)
        best = written(_top(_top(some, ["item", "part"], k).drop("rank"), ["item"], k).select("item_id", "rank", "doc_id", "score"), "ranked")
        numbers.unpersist()
        found = found.unionByName(best)
    return found
