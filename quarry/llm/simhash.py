"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within a radius have a common variant within half of it. The radius is first shared out over the two
halves of the fingerprint: within 4 bits of 64, one half is within 2, so each half emits all variants within half of 2
bits and meets there, 66 rows a fingerprint. Buckets of any half-word that hold more than a stated number of fingerprints
go on in the undivided form, all 2,081 variants within 2 bits of the whole fingerprint, whose buckets cannot exceed
2,081 members. Colliding pairs are verified on all bits, and each bucket reports links enough to connect what it connects.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import written
from quarry.llm.components import connected

BITS, SEED = 64, 42


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words, A-Z lower-cased; of the whole sequence where that is shorter."""
    parts = (text or "").encode().lower().split()  # bytes split at 0x20 and 0x09-0x0D
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    count = max(1, len(parts) - size + 1)
    first, last = starts[:count].tolist(), ends[len(parts) - count :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last)), np.uint64, count)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 where more than half of the hashes have it; zero without hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * counts > len(hashes))))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, mark (a hash of the text), fp: the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_signed(fingerprint(shingle_hashes(t.as_py(), size))) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=["doc_id", "mark", "fp"]
            )

    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    return rows.mapInArrow(run, "doc_id long, mark long, fp long")


def _masks(bits: int, most: int) -> Column:
    found = [sum(1 << i for i in on) for n in range(most + 1) for on in combinations(range(bits), n)]
    return F.split(F.lit(",".join(str(_signed(m)) for m in found)), ",").cast("array<bigint>")


def _links(radius: int):
    """For rows of fps: links of a spanning forest of the pairs within ``radius``, in the bucket's own order."""

    def forest(fps: np.ndarray) -> list[tuple[int, int]]:
        values = fps.astype(np.int64).view(np.uint64)
        left, out = np.arange(len(values)), []
        while len(left) > 1:  # a breadth-first walk: each step compares one fingerprint with those not yet reached
            edge, left = [left[0]], left[1:]
            while edge and len(left):
                at = edge.pop()
                near = np.bitwise_count(values[left] ^ values[at]) <= radius
                out += [(int(fps[at]), int(fps[k])) for k in left[near]]
                edge += left[near].tolist()
                left = left[~near]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [link for fps in batch.column(0) for link in forest(np.array(fps.as_py(), np.int64))]
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _bucket_links(variants: DataFrame, radius: int) -> DataFrame:
    """Links from rows (key, fp) of which no key has more than a bounded number."""
    buckets = variants.groupBy("key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return buckets.select("fps").mapInArrow(_links(radius), "a long, b long")


def whole_variants(fps: DataFrame, radius: int) -> DataFrame:
    """(key, fp) for every variant within half the radius: at most 2,081 fingerprints share one, at radius 4."""
    flipped = fps.select("fp", F.explode(_masks(BITS, (radius + 1) // 2)).alias("mask"))
    return flipped.select(F.col("fp").bitwiseXOR(F.col("mask")).alias("key"), "fp")


def half_variants(fps: DataFrame, radius: int) -> DataFrame:
    """(key, fp) for the variants of each half within half of its share of the radius."""
    low = F.col("fp").bitwiseAND(F.lit((1 << 32) - 1))
    high = F.shiftrightunsigned("fp", 32)
    masks = _masks(32, (radius // 2 + 1) // 2)
    rows = [
        fps.select("fp", half.alias("half"), F.explode(masks).alias("mask")).select(
            F.col("half").bitwiseXOR(F.col("mask")).bitwiseOR(F.lit(k << 32)).alias("key"), "fp"
        )
        for k, half in enumerate((low, high))
    ]
    return rows[0].unionByName(rows[1])


def links(fps: DataFrame, radius: int, largest: int = 2048) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints within ``radius`` that connect all that are connected.

    Buckets of more than ``largest`` fingerprints are left to the undivided form, for all fingerprints in them.
    """
    variants = half_variants(fps, radius)
    crowded = written(
        variants.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > largest).select("key"), "crowded"
    )
    if crowded.isEmpty():
        return _bucket_links(variants, radius)
    few = _bucket_links(variants.join(crowded, "key", "left_anti"), radius)
    many = variants.join(crowded, "key", "left_semi").select("fp").distinct()
    return few.unionByName(_bucket_links(whole_variants(many, radius), radius))


def grouped(docs: DataFrame, shingle: int, radius: int, largest: int) -> DataFrame:
    """doc_id, mark, fp, component_id for every document."""
    marked = written(fingerprints(docs, shingle), "fingerprints")
    groups = written(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "fingerprint-groups")
    roots = written(connected(links(groups.select("fp"), radius, largest)), "roots")
    rooted = groups.join(roots, groups["fp"] == roots["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = written(rooted.join(least, "root").select("fp", "root", "component_id"), "components")
    # A fingerprint that very many documents share is a skewed join, which Spark splits.
    return marked.join(named, "fp")


def components(docs: DataFrame, shingle: int = 4, radius: int = 4, largest: int = 2048) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the least doc_id it is linked to).

    Documents of one fingerprint are linked, those without words (fingerprint zero) like any other. Null text counts as
    empty; a null doc_id is never a component_id unless its component has no other. Repeated rows come back each. Empty
    table: no rows. Columns other than doc_id and text are not read.
    """
    return grouped(docs, shingle, radius, largest).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, shingle: int = 5, radius: int = 4, largest: int = 2048) -> DataFrame:
    """The documents, all columns as they were, of which each near-duplicate group keeps one.

    The one with the least doc_id stays (null last), of several rows with that doc_id the one whose text hashes lowest,
    and of rows that repeat it wholly, one. Else as for ``components``.
    """
    return first_of_groups(docs, written(grouped(docs, shingle, radius, largest), "grouped"))


def first_of_groups(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents that ``keep_one`` keeps, from rows (doc_id, mark, root)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")).alias("first")
    keepers = written(
        rows.groupBy("root").agg(first).select("first.doc_id", "first.mark"),
        "keepers",
    )
    same = (F.col("doc.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("own") == F.col("mark"))
    kept = docs.select(F.struct(*docs.columns).alias("doc"), F.xxhash64("text").alias("own")).join(keepers, same)
    alike = Window.partitionBy("doc_id", "mark").orderBy("mark")
    return kept.withColumn("nth", F.row_number().over(alike)).where("nth = 1").select("doc.*")
