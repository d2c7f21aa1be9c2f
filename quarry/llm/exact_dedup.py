"""Exact deduplication by content-defined chunk recipes.

Each text is cut where its own bytes say so. Chunks are deduplicated to identifiers whose contents have been compared,
and a document becomes its ordered list of identifiers. Whole documents are then grouped by comparing these short
lists, so a long text is read where it lies and only its distinct chunks are moved, once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written

#: A boundary's byte window, the mean chunk in bytes as a power of two, and the largest chunk.
WINDOW, MEAN_BITS, LARGEST, BLOCK = 8, 10, 8192, 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def boundaries(data: bytes) -> list[int]:
    """Where the chunks of ``data`` end: after each window whose mixed value is small, and every 8,192 bytes."""
    raw = np.frombuffer(data, np.uint8)
    cuts = [0]
    for at in range(0, max(0, len(raw) - WINDOW + 1), BLOCK):
        part = raw[at : at + BLOCK + WINDOW - 1]
        windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(part, WINDOW)).view("<u8")[:, 0]
        hit = np.flatnonzero((windows * _MIX) >> np.uint64(64 - MEAN_BITS) == 0)
        for end in (hit + at + WINDOW).tolist():
            cuts.extend(range(cuts[-1] + LARGEST, end, LARGEST))
            cuts.append(end)
    cuts.extend(range(cuts[-1] + LARGEST, len(raw), LARGEST))
    if cuts[-1] != len(raw):
        cuts.append(len(raw))
    return cuts


def chunks(data: bytes) -> list[bytes]:
    cuts = boundaries(data)
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def normalised(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased (bytes.lower leaves all else alone); null counts as empty."""
    return (text or "").encode().lower()


def _name(chunk: bytes, hash_bytes: int) -> bytes:
    return xxhash.xxh3_128_digest(chunk)[:hash_bytes]


def _chunk_rows(hash_bytes: int):
    schema = pa.schema([("name", pa.binary()), ("chunk", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, bytes] = {}
            for text in batch.column(0):
                for chunk in chunks(normalised(text.as_py())):
                    found[chunk] = _name(chunk, hash_bytes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.values(), pa.binary()), pa.array(found.keys(), pa.binary())], schema=schema
            )

    return run


def _recipe_rows(hash_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            recipes, digests = [], []
            for text in batch.column(1):
                data = normalised(text.as_py())
                recipes.append([_name(c, hash_bytes) for c in chunks(data)])
                digests.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(recipes, pa.list_(pa.binary())), pa.array(digests, pa.string())],
                names=["doc_id", "recipe", "text_sha256"],
            )

    return run


def _numbered_chunks(hash_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                data = normalised(text.as_py())
                parts = chunks(data)
                yield pa.RecordBatch.from_pydict(
                    {
                        "text_sha256": [hashlib.sha256(data).hexdigest()] * len(parts),
                        "seq": pa.array(range(len(parts)), pa.int32()),
                        "name": pa.array([_name(p, hash_bytes) for p in parts], pa.binary()),
                        "chunk": pa.array(parts, pa.binary()),
                    }
                )

    return run


def verified_recipes(docs: DataFrame, hash_bytes: int) -> DataFrame:
    """doc_id, recipe, text_sha256, where equal recipes mean equal contents.

    A chunk's name is a hash. All contents of a name are compared; where they differ, the name gets the content's
    rank among them as a suffix, and the recipes with such names are rebuilt.
    """
    recipes = written(
        docs.select("doc_id", "text").mapInArrow(
            _recipe_rows(hash_bytes), "doc_id long, recipe array<binary>, text_sha256 string"
        ),
        "recipes",
    )
    named = docs.select("text").mapInArrow(_chunk_rows(hash_bytes), "name binary, chunk binary")
    shared_names = written(
        named.groupBy("name")
        .agg(F.min("chunk").alias("first"), F.max("chunk").alias("last"))
        .where("first <> last")
        .select("name"),
        "colliding-names",
    )
    if shared_names.isEmpty():
        return recipes
    from pyspark.sql import Window

    colliding = named.distinct().join(shared_names, "name")
    ranks = colliding.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy("chunk")))
    placed = docs.select("text").mapInArrow(
        _numbered_chunks(hash_bytes), "text_sha256 string, seq int, name binary, chunk binary"
    )
    suffixes = (
        placed.dropDuplicates(["text_sha256", "seq"])
        .join(ranks, ["name", "chunk"])
        .groupBy("text_sha256")
        .agg(F.map_from_entries(F.collect_list(F.struct("seq", "rank"))).alias("ranks"))
    )
    exact = F.transform(
        "recipe",
        lambda name, i: F.concat(name, F.coalesce(F.col("ranks")[i].cast("string"), F.lit("")).cast("binary")),
    )
    return recipes.join(suffixes, "text_sha256", "left").select("doc_id", exact.alias("recipe"), "text_sha256")


def deduplicate(docs: DataFrame, hash_bytes: int = 16) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; of equal texts the largest doc_id stays. Null text counts as
    empty. Null doc_ids come after all others; a group of nothing else has keep_id null and keeps its rows. Rows that
    repeat doc_id and text count in group_size and are kept or dropped together. Empty table: no rows. Columns other
    than doc_id and text are not read.
    """
    recipes = verified_recipes(docs, hash_bytes)
    groups = written(
        recipes.groupBy("recipe")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1"),
        "groups",
    )
    # Both sides are plain scans, so a group that holds a large part of all rows is a skewed join that Spark splits.
    joined = recipes.join(groups, "recipe", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )
