"""Substring deduplication by recompression.

Every text is a row of word names, and rounds over it replace maximal runs and then chosen pairs of neighbours by new
names. A name is a hash of what it stands for and whether two neighbours pair depends on their names alone, so all tasks
name alike, without a dictionary, and two places with the same words get the same interior names wherever they lie.
After the last round a name stands for several words; names seen once anywhere rule out every window around them. The
windows that are left are compared in full, and those found once are taken out again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written

PAIR_ROUNDS = 6
_GROUP_WORDS = 400_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_S = np.uint64(32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _C
    x = (x ^ (x >> _S)) * _C
    return x ^ (x >> _S)


@dataclass
class Level:
    """Names after some rounds, and how the level before maps here.

    ``first`` and ``last``: for a boundary before old symbol j, the new boundary at or after it (at or before it) that
    every place with the same words on the inner side has too, whatever lies outside.
    """

    names: np.ndarray
    ends: np.ndarray  # True where a symbol is the gap between two texts
    first: np.ndarray
    last: np.ndarray


def run_round(names: np.ndarray, gaps: np.ndarray) -> Level:
    n = len(names)
    fresh = np.ones(n, bool)
    fresh[1:] = (names[1:] != names[:-1]) | gaps[1:] | gaps[:-1]
    at = np.flatnonzero(fresh)
    lengths = np.diff(np.append(at, n)).astype(np.uint64)
    new = names[at]
    long = lengths > 1
    new[long] = _mix(new[long] * _A + lengths[long] * _B + np.uint64(1))
    own = np.cumsum(fresh) - 1
    # A run may go on beyond either end of a window, so the outermost run on each side is given up.
    first = np.append(own + 1, len(at))
    last = np.append(0, own)
    first[:n][gaps], last[1:][gaps] = own[gaps], own[gaps] + 1
    return Level(new, gaps[at], first, last)


def pair_round(names: np.ndarray, gaps: np.ndarray, turn: int) -> Level:
    n = len(names)
    right = (_mix(names + np.uint64(turn * int(_B) & (1 << 64) - 1)) & np.uint64(1)).astype(bool)
    left = ~right & ~gaps
    right &= ~gaps
    second = np.zeros(n, bool)
    second[1:] = left[:-1] & right[1:]
    at = np.flatnonzero(~second)
    new = names[at]
    paired = np.zeros(n + 1, bool)
    paired[:n] = second
    joined = paired[at + 1]
    new[joined] = _mix(_mix(names[at[joined]] + np.uint64(2 * turn)) * _A + names[at[joined] + 1])
    own = np.append(np.cumsum(~second) - 1, len(at))
    old = np.arange(n + 1)
    old[:n] += right  # a right half may belong to what lies before it
    first = own[old]
    back = np.arange(n + 1)
    back[1:] -= left  # and a left half to what comes after it
    return Level(new, gaps[at], first, own[back])


def parse(words: np.ndarray, gaps: np.ndarray, rounds: int, bounds: bool) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Names after a run round and ``rounds`` pair rounds, the gaps among them, and the boundary maps from words."""
    at, to = (np.arange(len(words) + 1), np.arange(len(words) + 1)) if bounds else (None, None)
    level = run_round(words, gaps)
    for turn in range(rounds + 1):
        if bounds:
            at, to = level.first[at], level.last[to]
        if turn < rounds:
            level = pair_round(level.names, level.ends, turn + 1)
    return level.names, level.ends, (at, to)


def word_list(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes split at 0x20 and 0x09-0x0D


def laid_out(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word names of several texts in one row with a gap after each; the gaps; where each text starts."""
    sizes = np.array([len(t) + 1 for t in texts])
    starts = np.cumsum(sizes) - sizes
    names, gaps = np.zeros(sizes.sum(), np.uint64), np.zeros(sizes.sum(), bool)
    digest = xxhash.xxh64_intdigest
    for text, at in zip(texts, starts.tolist()):
        names[at : at + len(text)] = np.fromiter(map(digest, text), np.uint64, len(text))
    gaps[starts + sizes - 1] = True
    return names, gaps, starts


def window_hashes(names: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits for the window that starts at each word."""

    def polynomial(values: np.ndarray, base: int) -> np.ndarray:
        n, inverse = len(values), pow(base, -1, 1 << 64)
        up, down = np.full(n + 1, base, np.uint64), np.full(n + 1, inverse, np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up), np.cumprod(down)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * down[:-1])])
        return (sums[width:] - sums[:-width]) * up[: n - width + 1]

    if len(names) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    return (
        _mix(polynomial(names, 0x5851F42D4C957F2D)),
        (_mix(polynomial(_mix(names), 0x2545F4914F6CDD1D)) >> _S).astype(np.uint32),
    )


def _groups(texts: pa.Array, decode=lambda v: v) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(first row, word lists) of consecutive rows with a bounded number of words together."""
    held: list[list[bytes]] = []
    size = begin = 0
    for i in range(len(texts)):
        held.append(word_list(decode(texts[i].as_py())))
        size += len(held[-1]) + 1
        if size > _GROUP_WORDS or i == len(texts) - 1:
            yield begin, held
            held, size, begin = [], 0, i + 1


def _row_key(doc_id: int | None, text: str | None) -> tuple[int, int]:
    """96 bits that name a row: a signed long and an unsigned int. Rows that repeat wholly share them."""
    found = xxhash.xxh3_128_intdigest(f"{doc_id}\n{text or ''}")
    key = found & (1 << 64) - 1
    return key - (1 << 64) if key >> 63 else key, found >> 96


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64), pa.int64())


def _name_counts(rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _groups(batch.column(0)):
                words, gaps, _ = laid_out(texts)
                names, ends, _ = parse(words, gaps, rounds, False)
                found, counts = np.unique(names[~ends], return_counts=True)
                yield pa.RecordBatch.from_arrays([_long(found), pa.array(counts, pa.int64())], names=["name", "n"])

    return run


def _names_of_rows(rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in _groups(batch.column(1)):
                words, gaps, starts = laid_out(texts)
                names, ends, _ = parse(words, gaps, rounds, False)
                owner = np.cumsum(ends) - ends
                keys = np.array(
                    [
                        _row_key(batch.column(0)[begin + i].as_py(), batch.column(1)[begin + i].as_py())[0]
                        for i in range(len(texts))
                    ],
                    np.int64,
                )
                pairs = np.unique(np.stack([owner[~ends].astype(np.uint64), names[~ends]]), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [_long(pairs[1]), pa.array(keys[pairs[0].astype(np.int64)], pa.int64())], names=["name", "key"]
                )

    return run


def _packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows for a join on text that moves: the text is compressed before the shuffle."""
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        keys, marks, packed = [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            key, mark = _row_key(doc_id, text)
            keys.append(key)
            marks.append(mark)
            packed.append(pack.compress((text or "").encode()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(keys, pa.int64()), pa.array(marks, pa.int64()), pa.array(packed, pa.binary())],
            names=["doc_id", "key", "mark", "packed"],
        )


def _unpack(data: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(data).decode()


def _candidates(batch: pa.RecordBatch, begin: int, texts: list[list[bytes]], width: int, rounds: int):
    """Word names laid out, each text's start, and where the windows start whose names were all seen elsewhere."""
    words, gaps, starts = laid_out(texts)
    names, ends, (at, to) = parse(words, gaps, rounds, True)
    shared = np.zeros(len(names), bool)
    edges = np.append(np.flatnonzero(ends), len(names))
    low = 0
    for i, high in zip(range(len(texts)), edges.tolist()):
        known = batch.column("names")[begin + i].values
        if known is not None and len(known):
            shared[low:high] = np.isin(names[low:high], known.to_numpy(zero_copy_only=False).view(np.uint64))
        low = high + 1
    seen = np.concatenate([[0], np.cumsum(shared)])
    inside = np.concatenate([[0], np.cumsum(gaps)])
    n = len(words) - width + 1
    if n <= 0:
        return words, starts, np.zeros(0, np.int64)
    low, high = at[:n], to[width:]
    whole = (high <= low) | (seen[np.maximum(high, low)] - seen[low] == high - low)
    return words, starts, np.flatnonzero(whole & (inside[width:] == inside[:n]))


def _window_rows(width: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in _groups(batch.column("packed"), _unpack):
                words, starts, spots = _candidates(batch, begin, texts, width, rounds)
                wide, more = window_hashes(words, width)
                text = np.searchsorted(starts, spots, "right") - 1
                keys = batch.column("key").to_numpy()[begin:][text]
                marks = batch.column("mark").to_numpy()[begin:][text]
                yield pa.RecordBatch.from_arrays(
                    [
                        _long(wide[spots]),
                        pa.array(more[spots].view(np.int32), pa.int32()),
                        pa.array(keys, pa.int64()),
                        pa.array((marks << 32) | (spots - starts[text]), pa.int64()),
                    ],
                    names=["wide", "more", "key", "spot"],
                )

    return run


def _kept_rows(width: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in _groups(batch.column("packed"), _unpack):
                words, starts, spots = _candidates(batch, begin, texts, width, rounds)
                edge = np.append(starts, len(words))
                rows = []
                for i, text in enumerate(texts):
                    own = spots[np.searchsorted(spots, edge[i]) : np.searchsorted(spots, edge[i + 1])] - edge[i]
                    mark = batch.column("mark")[begin + i].as_py()
                    single = batch.column("singles")[begin + i].as_py() or []
                    single = np.array([s & 0xFFFFFFFF for s in single if s >> 32 & 0xFFFFFFFF == mark], np.int64)
                    own = np.setdiff1d(own, single, assume_unique=True)
                    cover = np.zeros(len(text) + 1, np.int64)
                    np.add.at(cover, own, 1)
                    np.add.at(cover, own + width, -1)
                    keep = np.flatnonzero(np.cumsum(cover[: len(text)]) == 0).tolist()
                    kept = b" ".join([text[k] for k in keep])
                    rows.append((batch.column("doc_id")[begin + i].as_py(), len(text), len(text) - len(keep), kept))
                ids, n, removed, kept = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array(removed, pa.int64()),
                        pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                        pa.array([k.decode() for k in kept], pa.string()),
                    ],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
                )

    return run


def remove_repeats(docs: DataFrame, width: int = 35, rounds: int = PAIR_ROUNDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept_text (kept words joined by one space).

    Words are what lies between ASCII white space. A word goes if a window of ``width`` consecutive words that covers it
    starts at any other place too, in the same document or another; windows are judged on the input. Null and empty
    texts have no words, and texts shorter than the window lose none. Rows that repeat doc_id and text are documents of
    their own, so all their windows repeat. Empty table: no rows. Columns other than doc_id and text are not read.
    """
    rows = docs.select("doc_id", "text")
    shared = written(
        rows.select("text")
        .mapInArrow(_name_counts(rounds), "name long, n long")
        .groupBy("name")
        .agg(F.sum("n").alias("n"))
        .where("n > 1")
        .select("name"),
        "shared-names",
    )
    # A name that very many rows share is a skewed join, which Spark splits.
    named = rows.mapInArrow(_names_of_rows(rounds), "name long, key long").join(shared, "name")
    by_row = written(named.groupBy("key").agg(F.collect_set("name").alias("names")), "names-by-row")
    packed = rows.mapInArrow(_packed_rows, "doc_id long, key long, mark long, packed binary")
    # Rows without shared names too: windows that no name lies wholly inside are compared wherever they are.
    windows = packed.join(by_row, "key", "left").mapInArrow(
        _window_rows(width, rounds), "wide long, more int, key long, spot long"
    )
    singles = (
        windows.groupBy("wide", "more")
        .agg(F.count("*").alias("n"), F.first("key").alias("key"), F.first("spot").alias("spot"))
        .where("n = 1")
    )
    by_single = written(singles.groupBy("key").agg(F.collect_list("spot").alias("singles")), "single-windows")
    return (
        packed.join(by_row, "key", "left")
        .join(by_single, "key", "left")
        .mapInArrow(
            _kept_rows(width, rounds),
            "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string",
        )
    )
