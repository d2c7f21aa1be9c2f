"""Document fingerprints by a randomised edit embedding.

A walk goes over a text's characters: at time t it puts out the character it stands on, then steps on or stays as a random
bit, shared by all texts, says for that time and character. Two texts that differ by few edits walk apart for a while and
meet again, so the edit distance becomes a Hamming distance between what they put out. A fingerprint samples that: each of its
slots has an order of its own over all times, shared by all texts, and holds four bits of the character at the walk's first
time in that order. Of two texts as many slots agree, on average, as the walks agree in, over the longer one's times.

Texts longer than a segment walk each segment from its own start, so walks of any number of texts go on side by side and a
very long text holds no task. Links: bands of sampled slots bring fingerprints together, whose likeness is then verified.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written
from quarry.llm.components import connected

#: Characters of a segment; slots of a fingerprint, of four bits; characters that are walked over side by side.
SEGMENT, SLOTS, SIDE = 4096, 256, 8_000_000
#: Bands and slots of each; likeness from which fingerprints are linked; fingerprints of a band that meet in one task.
BANDS, WIDTH, LINKED, CROWD = 16, 12, 0.9, 4096
#: Documents of a bucket of successive ids, as long as there are no more buckets than stated.
BUCKET, MOST_BUCKETS = 1024, 4096
_TIMES = 3 * SEGMENT
_SEED = 20_240_601
PRINTS = "doc_id long, n_chars long, edited_sha256 string, fp binary, edited binary, near_edited double, near_next double"


def symbols(text: str) -> np.ndarray:
    """One of 255 symbols for each code point; 0 stands for a segment's end."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return ((points ^ (points >> 8) * 31) % 255 + 1).astype(np.uint8)


@lru_cache(1)
def steps() -> np.ndarray:
    """The shared random bits by time and symbol; a walk stays where its segment ends."""
    bits = np.random.default_rng(_SEED).integers(0, 2, (_TIMES, 256), np.uint8)
    bits[:, 0] = 0
    return bits


@lru_cache(1024)
def firsts(segment: int) -> tuple[np.ndarray, np.ndarray]:
    """For the slots' orders of a segment's times: the times before which none comes in order, and their ranks (0 to 1)."""
    ranks = np.random.default_rng((_SEED, segment)).random((SLOTS, _TIMES), np.float32)
    least = np.minimum.accumulate(ranks, axis=1)
    slot, time = np.nonzero(np.diff(least, axis=1, prepend=np.float32(2)))
    nth = np.arange(len(slot)) - np.searchsorted(slot, slot)
    times = np.full((SLOTS, nth.max() + 1), _TIMES, np.int32)
    found = np.ones(times.shape, np.float32)
    times[slot, nth], found[slot, nth] = time, ranks[slot, time]
    return times, found


def _sampled(out: np.ndarray, lengths: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """For each segment and slot: the rank of its first time in order, and below that four bits of time and symbol."""
    taken = np.empty((len(lengths), SLOTS), np.int64)
    for number in np.unique(numbers):
        own = np.flatnonzero(numbers == number)
        times, ranks = firsts(int(number))
        at = np.zeros((len(own), SLOTS), np.int64)
        for k in range(1, times.shape[1]):
            at += times[:, k][None, :] < lengths[own][:, None]
        slots = np.arange(SLOTS)[None, :]
        time = times[slots, at]
        mixed = out[time, own[:, None]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (time + slots * _TIMES + 1).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        rank = ranks[slots, at].view(np.uint32).astype(np.int64)
        taken[own] = rank << 4 | (mixed >> np.uint64(60)).astype(np.int64)
    return taken


def _walked(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols put out by time and segment, and each walk's number of times; segments come longest first."""
    bits = steps()
    out = np.zeros((3 * int(sizes[0]), len(sizes)), np.uint8)
    place = starts.copy()
    active = len(sizes)
    for time in range(len(out)):
        while 3 * sizes[active - 1] <= time:
            active -= 1
        now = place[:active]
        seen = flat[now]
        out[time, :active] = seen
        now += bits[time][seen]
    return out, np.maximum((out != 0).sum(axis=0), 1)


def fingerprints(texts: list[str]) -> np.ndarray:
    """One row of SLOTS numbers from 0 to 15 for each text; equal texts have equal ones."""
    parts = [symbols(t) for t in texts]
    found = np.full((len(texts), SLOTS), np.iinfo(np.int64).max, np.int64)
    owner, number, pieces, held = [], [], [], 0

    def walk() -> None:
        every = np.array([len(p) for p in pieces])
        kinds = np.frexp(every)[1]
        for kind in np.unique(kinds):  # of two segments side by side none is twice as long
            walk_some(np.flatnonzero(kinds == kind), every)

    def walk_some(some: np.ndarray, every: np.ndarray) -> None:
        order = some[np.argsort(-every[some], kind="stable")]
        sizes = every
        flat = np.zeros(int(sizes[order].sum()) + len(order), np.uint8)
        ends = np.cumsum(sizes[order] + 1)
        starts = ends - sizes[order] - 1
        for at, k in zip(starts, order):
            flat[at : at + sizes[k]] = pieces[k]
        out, lengths = _walked(flat, starts, sizes[order])
        taken = _sampled(out, lengths, np.array(number)[order])
        text = np.array(owner)[order]
        by = np.argsort(text, kind="stable")
        edges = np.flatnonzero(np.diff(text[by], prepend=-1))
        least = np.minimum.reduceat(taken[by], edges, axis=0)
        found[text[by][edges]] = np.minimum(found[text[by][edges]], least)

    for at, own in enumerate(parts):
        for k in range(0, len(own), SEGMENT):
            owner.append(at)
            number.append(k // SEGMENT)
            pieces.append(own[k : k + SEGMENT])
            held += len(pieces[-1])
            if held >= SIDE:
                walk()
                owner, number, pieces, held = [], [], [], 0
    if pieces:
        walk()
    return (found & 15).astype(np.uint8)


def likeness(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The share of slots in which fingerprints agree, less what agrees by chance: 0 to 1."""
    return np.maximum(0.0, ((one == other).mean(axis=-1) - 1 / 16) / (15 / 16))


def packed(prints: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in prints[:, 0::2] << 4 | prints[:, 1::2]]


def unpacked(values: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(values), np.uint8).reshape(-1, SLOTS // 2)
    return np.stack([raw >> 4, raw & 15], axis=2).reshape(-1, SLOTS)


def edited(text: str, following: str) -> str:
    """The text with its last half, rounded down, replaced by as many first characters of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts are moved compressed each by itself: two thirds of what compressing rows together leaves."""
    press = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        packed = pa.array([press(t.as_py().encode()) for t in batch.column(2)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], names=["doc_id", "tie", "packed"])


def in_order(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """bucket, peek, doc_id, packed: the documents in buckets of successive ids, each with the next bucket's first one.

    Bounds are quantiles of the ids, one number a bucket; null ids come last. ``peek`` marks a document that is only there
    to follow the bucket's last one. After the last bucket comes the first. ``packed`` is the compressed text.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select("doc_id", F.xxhash64(text).alias("tie"), text)
    count = rows.count()
    buckets = min(count // bucket + 1, MOST_BUCKETS)
    wanted = [k / buckets for k in range(1, buckets)]
    bounds = rows.agg(F.percentile_approx("doc_id", wanted, 100_000)).first()[0] if wanted else None
    bounds = sorted(set(bounds or []))
    below = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("doc_id"))) if bounds else F.lit(0)
    at = F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(below)
    moved = rows.mapInArrow(_pressed, "doc_id long, tie long, packed binary")
    placed = moved.withColumn("bucket", at.cast("int"))
    heads = rows.withColumn("bucket", at.cast("int")).groupBy("bucket").agg(F.min("doc_id").alias("doc_id")).orderBy("bucket").collect()
    follows = [(heads[k].bucket, heads[k].doc_id, heads[k - 1].bucket) for k in range(len(heads))]
    before = spark.createDataFrame(follows, "bucket int, head long, before int")
    first = F.col("doc_id").eqNullSafe(F.col("head"))
    both = placed.join(F.broadcast(before), "bucket").select(
        "doc_id", "tie", "packed",
        F.explode(F.when(first, F.array(F.struct(F.col("bucket"), F.lit(0).alias("peek")), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("peek"))))
                  .otherwise(F.array(F.struct(F.col("bucket"), F.lit(0).alias("peek"))))).alias("at"),
    )
    dealt = both.select("at.bucket", "at.peek", "doc_id", "tie", "packed").repartition("bucket")
    return dealt.sortWithinPartitions("bucket", "peek", F.col("doc_id").asc_nulls_last(), "tie").drop("tie")


def _prints(bucket: int | None, rows: list[tuple], peek: tuple | None) -> pa.RecordBatch:
    """The fingerprints of rows (doc_id, text) in order, of which ``peek`` is the next."""
    texts = [t for _, t in rows] + [peek[1]]
    edits = [edited(a, b) for a, b in zip(texts, texts[1:])]
    found = fingerprints(texts + edits)
    own, after, other = found[: len(rows)], found[1 : len(rows) + 1], found[len(texts) :]
    columns = [
        pa.array([i for i, _ in rows], pa.int64()),
        pa.array([len(t) for t in texts[:-1]], pa.int64()),
        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits]),
        pa.array(packed(own), pa.binary()),
        pa.array(packed(other), pa.binary()),
        pa.array(likeness(own, other)),
        pa.array(likeness(own, after)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fp", "edited", "near_edited", "near_next"])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, rows, held = None, [], 0
    unpress = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for bucket, peek, doc_id, packed_text in zip(*(c.to_pylist() for c in batch.columns)):
            text = unpress(packed_text).decode()
            if bucket != now:
                now, rows, held = bucket, [], 0
            if peek and not rows:
                continue  # a repeated row of the one that has followed already
            if rows and (peek or held >= SIDE // 2):
                yield _prints(bucket, rows, (doc_id, text))
                rows, held = [], 0
            if not peek:
                rows.append((doc_id, text))
                held += len(text)


def prints(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp and edited (fingerprints, half a byte a slot), near_edited, near_next."""
    return in_order(docs, bucket).mapInArrow(_run, PRINTS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    taken = [np.random.default_rng((_SEED, 7, k)).choice(SLOTS, WIDTH, replace=False) for k in range(BANDS)]
    for batch in batches:
        found = unpacked(batch.column(1).to_pylist()).astype(np.int64)
        for k, slots in enumerate(taken):
            key = np.full(len(found), k, np.int64)
            for slot in slots:
                key = key << 4 | found[:, slot]
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0)], names=["key", "node"])


def _verified(bound: float):
    """For rows (nodes, fps): links of a spanning forest of the pairs whose likeness is at least ``bound``."""

    def forest(nodes: np.ndarray, found: np.ndarray) -> list[tuple[int, int]]:
        left, links = np.arange(len(nodes)), []
        while len(left) > 1:
            edge, left = [left[0]], left[1:]
            while edge and len(left):
                at = edge.pop()
                near = likeness(found[left], found[at][None, :]) >= bound
                links += [(int(nodes[at]), int(nodes[k])) for k in left[near]]
                edge += left[near].tolist()
                left = left[~near]
        return links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members in batch.column(0):
                own = members.as_py()
                links = forest(np.array([m["node"] for m in own]), unpacked([m["fp"] for m in own]))
                a, b = zip(*links) if links else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def links(nodes: DataFrame, bound: float = LINKED, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, b) of nodes (node, fp) that share a band and are verified, enough to connect all that are connected.

    A band's key that more than ``crowd`` fingerprints share is dealt out in parts of about half as many, and any two parts
    meet in a group, so every pair of the key is compared where its links so far leave it open; the work on such a key
    grows with the square of its fingerprints.
    """
    rows = nodes.select("node", "fp").mapInArrow(_bands, "key long, node long")
    several = written(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "bands")
    parts = F.when(F.col("n") <= crowd, F.lit(1)).otherwise(F.ceil(F.col("n") * 2 / crowd)).cast("int")
    met = rows.join(several.select("key", parts.alias("parts")), "key").join(nodes.select("node", "fp"), "node")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.struct(F.least(part, other).alias("a"), F.greatest(part, other).alias("b")))
    spread = met.select("key", "node", "fp", F.explode(pairs).alias("parts"))
    groups = spread.groupBy("key", "parts").agg(F.sort_array(F.collect_list(F.struct("node", "fp"))).alias("members"))
    return groups.where(F.size("members") > 1).select("members").mapInArrow(_verified(bound), "a long, b long").distinct()


def classed(found: DataFrame, bound: float = LINKED, crowd: int = CROWD) -> DataFrame:
    """The rows of ``prints`` with class_id: the least doc_id of those linked, by fingerprints alike or equal."""
    nodes = written(
        found.groupBy("fp").agg(F.min("doc_id").alias("low")).select(F.monotonically_increasing_id().alias("node"), "fp", "low"), "prints-apart"
    )
    roots = written(connected(links(nodes, bound, crowd)), "print-roots")
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("low").alias("class_id"))
    named = written(rooted.join(least, "root").select("fp", "class_id"), "print-classes")
    return found.join(named, "fp")


def fingerprint(docs: DataFrame, bound: float = LINKED, bucket: int = BUCKET, crowd: int = CROWD) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id.

    Fingerprints are 256 hex digits. ``near_edited`` is the likeness of a document's to its edited text's, ``near_next``
    to that of the next document by ascending doc_id (after the last comes the first; null ids come last, equal ids in
    an order of their texts' hashes). ``class_id`` is the least doc_id of the documents linked by likeness of ``bound`` or more
    between fingerprints that share a band. Null texts count as empty; all empty texts have one fingerprint. Repeated
    rows come back each. A single document follows itself. Empty table: no rows. Columns other than doc_id and text
    are not read.
    """
    found = classed(written(prints(docs, bucket), "prints"), bound, crowd)
    return found.select(
        "doc_id", "n_chars", "edited_sha256", F.lower(F.hex("fp")).alias("fingerprint"),
        F.lower(F.hex("edited")).alias("edited_fingerprint"), "near_edited", "near_next", "class_id",
    )
