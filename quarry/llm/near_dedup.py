"""Near-duplicate documents: candidates from SimHash and MinHash bands, links by the exact Jaccard similarity of word runs.

Documents of one set of shingles form a class. SimHash goes first: ball hashing finds the classes whose fingerprints are
within 4 bits of each other. Most pairs of similarity 0.8 differ in more bits than any ball can hold, so each class also has
24 bands of 5 minima; two classes of similarity 0.8 share a band with probability 0.9999. In each band all are compared with
the least member, together with what SimHash found; pairs of a band that this leaves in different components are compared
each. So a group of copies costs a few comparisons a member, and what is linked is what comparing all pairs of all bands and
all near fingerprints would link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written
from quarry.llm.components import connected
from quarry.llm import simhash
from quarry.llm.simhash import SEED, first_of_groups, shingle_hashes

BANDS, ROWS, _BLOCK = 24, 5, 4096
#: Bits in which fingerprints of candidates differ at most; fingerprints of a half-bucket before it takes the plain form.
RADIUS, LARGEST = 4, 2048
_TURNS = np.random.default_rng(11).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) | np.uint64(1)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def band_keys(found: np.ndarray) -> np.ndarray:
    """One key a band for a set of hashes; none for an empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), _BLOCK):
        block = found[at : at + _BLOCK, None]
        np.minimum(least, ((block ^ _TURNS[0]) * _TURNS[1]).min(axis=0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64).view(np.int64)


def classes(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, mark (a hash of the text), node (a hash of the text's set of shingles), n (its size), fp (the set's fingerprint), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, prints, bands = [], [], [], []
            for text in batch.column(2):
                found = shingle_set(text.as_py(), size)
                nodes.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                sizes.append(len(found))
                prints.append(simhash.fingerprint(found))
                bands.append(band_keys(found))
            columns = [
                batch.column(0), batch.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)),
                pa.array(sizes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "node", "n", "fp", "bands"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    return rows.mapInArrow(run, "doc_id long, mark long, node long, n long, fp long, bands array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """node, shingles for one document of each wanted class (mark, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py(), size).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "shingles"])

    texts = docs.select(F.xxhash64("text").alias("mark"), "text").join(wanted, "mark").dropDuplicates(["node"])
    return texts.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have Jaccard similarity 0.8 or more."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    joined = pairs.join(left, "a").join(right, "b")
    return joined.where(9 * both >= 4 * (F.size("x") + F.size("y"))).select("a", "b")  # 5 |x & y| >= 4 |x | y|


def _sized(pairs: DataFrame) -> DataFrame:
    """Distinct pairs a < b from rows (p, n, q, m) of classes and their sizes, where the sizes allow 0.8."""
    rows = pairs.where("p <> q AND 5 * least(n, m) >= 4 * greatest(n, m)")
    return rows.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def near_prints(nodes: DataFrame) -> DataFrame:
    """Pairs (p, n, q, m) of classes and their sizes that connect what fingerprints within RADIUS bits connect."""
    groups = written(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("low"), F.max("node").alias("high")), "fingerprint-groups")
    pairs = simhash.links(groups.select("fp"), RADIUS, LARGEST)
    left = groups.select(F.col("fp").alias("a"), F.col("low").alias("x"))
    right = groups.select(F.col("fp").alias("b"), F.col("low").alias("y"))
    near = pairs.join(left, "a").join(right, "b").selectExpr("x.node AS p", "x.n", "y.node AS q", "y.n AS m")
    alike = nodes.join(groups.where("low.node < high").select("fp", "low"), "fp").selectExpr("node AS p", "n", "low.node AS q", "low.n AS m")
    return near.unionByName(alike)


def rooted(docs: DataFrame, marked: DataFrame, size: int) -> DataFrame:
    """at, root (the least class of its component) for every class that is similar to another."""
    nodes = marked.groupBy("node").agg(*(F.first(c).alias(c) for c in ("mark", "n", "fp", "bands")))
    nodes = written(nodes, "nodes")
    rows = nodes.select("node", "n", "mark", F.explode("bands").alias("key"))
    least = rows.groupBy("key").agg(F.min(F.struct("node", "n")).alias("low"), F.max("node").alias("high")).where("low.node < high")
    shared = written(rows.join(least.select("key", "low"), "key"), "shared-bands")
    prints = near_prints(nodes)
    first = written(_sized(prints.unionByName(shared.selectExpr("node AS p", "n", "low.node AS q", "low.n AS m"))), "first-pairs")
    # Fingerprints may be near where no band is shared.
    wanted = shared.select("node").unionByName(first.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    sets = written(sets_of(docs, nodes.select("mark", "node").join(wanted, "node"), size), "shingle-sets")
    linked = written(similar(first, sets), "first-links")

    roots = written(connected(linked), "first-roots").withColumnRenamed("node", "at")
    placed = shared.join(roots, F.col("node") == F.col("at"), "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    parted = placed.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most")
    placed = written(placed.join(parted.select("key"), "key"), "parted-bands")
    other = placed.selectExpr("key", "node AS q", "n AS m", "root AS other")
    rest = placed.withColumnRenamed("node", "p").join(other, "key").where("root < other")
    rest = written(_sized(rest).join(first, ["a", "b"], "left_anti"), "further-pairs")
    more = written(similar(rest, sets), "further-links")
    if more.isEmpty():
        return roots
    stars = roots.selectExpr("at AS a", "root AS b")
    return written(connected(stars.unionByName(more)), "roots").withColumnRenamed("node", "at")


def grouped(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, mark, root (the least class of its component) for every document."""
    marked = written(classes(docs, size), "classes")
    roots = rooted(docs, marked, size)
    return marked.join(roots, marked["node"] == roots["at"], "left").select("doc_id", "mark", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """The documents, all columns as they were, of which each group linked by similarity 0.8 or more keeps one.

    Which one, and null and repeated rows, are as for ``simhash.keep_one``. Texts without words are one group.
    """
    return first_of_groups(docs, written(grouped(docs, shingle), "grouped"))
