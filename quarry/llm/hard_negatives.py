"""Hard negatives by spanning-tree bounds over the anchors.

Anchors are taken in blocks of bounded size, one pass over the rows a block. A block's anchors make a least spanning tree by
their distances. A row's score with the root is computed; with any other anchor it can differ from that with the anchor's
parent in the tree by no more than the edge's length times the row's norm, so bounds go down the tree, and are replaced
by the score wherever it is computed. Only rows whose bounds overlap what is looked for are rescored: the range above the
least of the best so far for positives, the windows of the anchor's positives for negatives. Every row is judged for
every anchor; tasks return no more rows than the best they have seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import new_place, written

#: Anchors of a block, rows that go down the tree together, share of rows from which all are rescored at once.
BLOCK, CHUNK, MANY = 1024, 4096, 0.25
#: Whole numbers up to this add up without rounding as doubles.
_EXACT = 1 << 53
_POSITIVES = "anchor int, id long, score long, row long"
_NEGATIVES = "anchor int, nth int, id long, score long, row long"


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """row (a number), vec_id, label, v: floor(scale * x) of each component, for the rows that take part."""
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    return rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        F.monotonically_increasing_id().alias("row"),
        "vec_id",
        "label",
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"),
    )


@dataclass
class Tree:
    """A block of anchors, parents before children: parent's place, edge length and number of children of each."""

    rows: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    parents: np.ndarray
    edges: np.ndarray
    children: np.ndarray


def spanning_tree(rows: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Tree:
    """Prim's tree over at most a block of anchors, in the order in which they are reached."""
    points = vectors.astype(np.float64)
    far = np.full(len(rows), np.inf)
    near = np.zeros(len(rows), np.int64)
    left = np.ones(len(rows), bool)
    order, parents, edges, at = [], [-1], [0.0], 0
    place = np.zeros(len(rows), np.int64)
    while True:
        place[at] = len(order)
        order.append(at)
        left[at] = False
        if not left.any():
            break
        closer = np.sqrt(((points - points[at]) ** 2).sum(axis=1))
        better = left & (closer < far)
        far[better], near[better] = closer[better], at
        at = int(np.where(left, far, np.inf).argmin()) if np.isfinite(far[left]).any() else int(np.flatnonzero(left)[0])
        parents.append(int(place[near[at]]))
        edges.append(float(far[at]))
    parents = np.array(parents)
    return Tree(rows[order], labels[order], vectors[order], parents, np.array(edges), np.bincount(parents[1:], minlength=len(rows)))


class Top:
    """The first few rows by descending score, then ascending id, null last."""

    def __init__(self, size: int):
        self.size, self.least = size, None
        self.scores, self.ids, self.nulls, self.rows = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray, rows: np.ndarray) -> None:
        scores, ids, nulls, rows = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.nulls, nulls), (self.rows, rows)))
        order = np.lexsort((ids, nulls, -scores))[: self.size]
        self.scores, self.ids, self.nulls, self.rows = scores[order], ids[order], nulls[order], rows[order]
        self.least = int(self.scores[-1]) if len(order) == self.size else None


@dataclass
class Chunk:
    rows: np.ndarray
    ids: np.ndarray
    nulls: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray


def _padded(values: pa.Array, width: int, kind) -> np.ndarray:
    """The vectors as rows of one width; components that a vector lacks are 0."""
    sizes = values.value_lengths().to_numpy(zero_copy_only=False)
    flat = values.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width).astype(kind)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out.astype(kind)


def _chunks(batches: Iterator[pa.RecordBatch], width: int, kind) -> Iterator[Chunk]:
    def chunk(parts: list[pa.RecordBatch]) -> Chunk:
        rows, ids, labels, vectors = (pa.Table.from_batches(parts).column(i).combine_chunks() for i in range(4))
        return Chunk(
            rows.to_numpy(zero_copy_only=False),
            ids.fill_null(0).to_numpy(zero_copy_only=False),
            ids.is_null().to_numpy(zero_copy_only=False),
            labels.to_numpy(zero_copy_only=False),
            _padded(vectors, width, kind),
        )

    parts, held = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            parts.append(batch.slice(at, CHUNK))
            held += parts[-1].num_rows
            if held >= CHUNK:
                yield chunk(parts)
                parts, held = [], 0
    if held:
        yield chunk(parts)


def rescored(tree: Tree, chunk: Chunk, wanted) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """anchor, rows of the chunk, their scores: for each anchor those rows that ``wanted(anchor, low, high)`` marks."""
    norms = np.sqrt((chunk.vectors.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
    bounds: dict[int, list] = {}
    for at, parent in enumerate(tree.parents):
        if parent < 0:
            low = high = chunk.vectors @ tree.vectors[at]
            mark = wanted(at, low, high)
            where, scores = np.flatnonzero(mark), low[mark]
        else:
            width = tree.edges[at] * norms * (1 + 1e-9) + 1e-3
            low, high = bounds[parent][0] - width, bounds[parent][1] + width
            where = np.flatnonzero(wanted(at, low, high))
            if len(where) > MANY * len(norms):
                low = high = chunk.vectors @ tree.vectors[at]
                scores = low[where]
            else:
                scores = chunk.vectors[where] @ tree.vectors[at]
                low[where] = high[where] = scores
            bounds[parent][2] -= 1
            if not bounds[parent][2]:
                del bounds[parent]
        if tree.children[at]:
            bounds[at] = [low.astype(np.float64), high.astype(np.float64), int(tree.children[at])]
        if len(where):
            yield at, where, scores.astype(np.int64)


def _out(tops: Iterator[tuple[list[int], Top]], names: list[str]) -> Iterator[pa.RecordBatch]:
    for keys, top in tops:
        if size := len(top.scores):
            columns = [pa.array([k] * size, pa.int32()) for k in keys]
            columns += [pa.array(top.ids, pa.int64(), mask=top.nulls), pa.array(top.scores, pa.int64()), pa.array(top.rows, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _positives(rows: DataFrame, sent, width: int, kind, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = sent.value
        tops = [Top(size) for _ in tree.rows]
        for chunk in _chunks(batches, width, kind):

            def wanted(at: int, low: np.ndarray, high: np.ndarray, chunk=chunk) -> np.ndarray:
                mark = (chunk.labels == tree.labels[at]) & (chunk.rows != tree.rows[at])
                return mark if tops[at].least is None else mark & (high >= tops[at].least)

            for at, where, scores in rescored(tree, chunk, wanted):
                tops[at].add(scores, chunk.ids[where], chunk.nulls[where], chunk.rows[where])
        yield from _out((([at], top) for at, top in enumerate(tops)), ["anchor", "id", "score", "row"])

    return rows.mapInArrow(run, _POSITIVES)


def _negatives(rows: DataFrame, sent, width: int, kind, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, windows = sent.value
        tops = {(at, nth): Top(size) for at, own in windows.items() for nth in range(len(own))}
        spans = {at: (min(low for low, _ in own), max(high for _, high in own)) for at, own in windows.items()}
        for chunk in _chunks(batches, width, kind):

            def wanted(at: int, low: np.ndarray, high: np.ndarray, chunk=chunk) -> np.ndarray:
                if at not in spans:
                    return np.zeros(len(low), bool)
                least, most = spans[at]
                return (chunk.labels != tree.labels[at]) & (high >= least) & (low <= most)

            for at, where, scores in rescored(tree, chunk, wanted):
                for nth, (least, most) in enumerate(windows[at]):
                    top = tops[at, nth]
                    fits = (scores >= (least if top.least is None else max(least, top.least))) & (scores <= most)
                    if fits.any():
                        own = where[fits]
                        top.add(scores[fits], chunk.ids[own], chunk.nulls[own], chunk.rows[own])
        yield from _out((([at, nth], top) for (at, nth), top in tops.items()), ["anchor", "nth", "id", "score", "row"])

    return rows.mapInArrow(run, _NEGATIVES)


def _ranked(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def mine(
    vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5,
    least: int = 80, most: int = 100, scale: int = 256, block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by ``every``. An anchor's positives are its best other rows of its
    label; each positive's negatives are the best rows of another label with a score between ``least`` and ``most``
    hundredths of the positive's. A score is the inner product of floor(scale * x); ties go by ascending vec_id, null
    last. Rows with a null label or vector, or any component that is null or not finite, take no part. Repeated rows
    count each, as anchors too. Components that the shorter of two vectors lacks count as 0. Scores must fit in a long.
    Empty table: no rows. Columns other than vec_id, label and embedding are not read.
    """
    spark = vectors.sparkSession
    rows = written(quantised(vectors, scale), "vectors")
    chosen = rows.where(F.col("vec_id") % every == 0)
    facts = rows.agg(
        F.max(F.size("v")).alias("width"),
        F.max(F.greatest(F.array_max(F.col("v")), -F.array_min(F.col("v")))).alias("largest"),
        F.count_if(F.col("vec_id") % every == 0).alias("anchors"),
    ).first()
    width, blocks = facts.width or 0, -(-facts.anchors // block)
    kind = np.float64 if (facts.largest or 0) ** 2 * max(width, 1) < _EXACT else object
    anchors = written(chosen.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(max(blocks, 1)))).repartition("block").sortWithinPartitions("block"), "anchors")
    # Blocks are added to one table, so that the plan of the result doesn't grow with their number.
    place = new_place(spark, "negatives")
    found = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    found.write.parquet(place)
    for at in range(blocks):
        own = anchors.where(F.col("block") == at).orderBy("row").collect()
        if not own:
            continue
        points = np.zeros((len(own), width), np.int64)
        for k, row in enumerate(own):
            points[k, : len(row.v)] = row.v
        tree = spanning_tree(np.array([r.row for r in own]), np.array([r.label for r in own]), points.astype(kind))
        ids = {r.row: r.vec_id for r in own}
        sent = spark.sparkContext.broadcast(tree)
        best = _ranked(_positives(rows, sent, width, kind, positives), ["anchor"], positives).orderBy("anchor", "rank").collect()
        windows: dict[int, list[tuple[int, int]]] = {}
        pairs = []
        for b in best:
            pairs.append((b.anchor, len(windows.setdefault(b.anchor, [])), ids[int(tree.rows[b.anchor])], b.id, b.score))
            windows[b.anchor].append((-(-least * b.score // 100), most * b.score // 100))
        both = spark.sparkContext.broadcast((tree, windows))
        mined = _ranked(_negatives(rows, both, width, kind, negatives), ["anchor", "nth"], negatives)
        named = spark.createDataFrame(pairs, "anchor int, nth int, anchor_id long, positive_id long, positive_score long")
        some = mined.join(F.broadcast(named), ["anchor", "nth"]).select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        )
        some.write.mode("append").parquet(place)
        sent.unpersist()
        both.unpersist()
    return spark.read.schema(found.schema).parquet(place)
