"""Best-two-fit packing of token sequences.

Tokens are counted where the texts lie; only rows of a few numbers per piece move. The pieces are dealt by hash to
groups of bounded size, as many as the pieces need, and each group is packed on its own, which costs at most one partly
filled sequence a group.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = f"{PIECES}, sequence_id long, offset long"
_UNIT = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
#: White space besides the four that units are cut at; a text that has any is encoded whole.
_ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_CACHE_UNITS, _GROUP_CHARS = 500_000, 1_000_000
_encoders: dict[str, TextEncoder] = {}


def tokenizer_path(name: str) -> str:
    """A bare name is a file of the installed public tokenizers; anything else is a path already."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class TextEncoder:
    """Token ids of whole texts as little-endian 32-bit bytes.

    A byte-level vocabulary without normaliser never joins a word to the white space after it, so the ids of a text are
    those of its units (white space, then other characters) put together, and each unit is encoded once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path) as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        self.by_unit = (
            before.get("type") == "ByteLevel"
            and not before.get("add_prefix_space")
            and before.get("use_regex", True)
            and not any(spec.get(k) for k in ("normalizer", "post_processor", "truncation", "padding"))
        )
        self.known: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(x.ids, "<u4").tobytes() for x in found]

    def _encode_units(self, units: list[str]) -> None:
        """Encodes units, those without a line end as lines of one text: a line end before white space stands alone."""
        line_end = self._encode(["\n"])[0]
        lines = [u for u in units if "\n" not in u and u[0] == " " and not u.isspace()]
        if len(line_end) == 4:
            ids = np.frombuffer(self._encode(["\n".join(lines)])[0], "<u4")
            ends = np.append(np.flatnonzero(ids == np.frombuffer(line_end, "<u4")[0]), len(ids)) * 4
            if len(ends) == len(lines):
                data, at = ids.tobytes(), 0
                for unit, end in zip(lines, ends.tolist()):
                    self.known[unit] = data[at:end]
                    at = end + 4
        rest = [u for u in units if u not in self.known]
        self.known.update(zip(rest, self._encode(rest)))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_unit:
            return self._encode(texts)
        units = [None if _ODD_SPACE.search(t) else _UNIT.findall(t) for t in texts]
        if len(self.known) > _CACHE_UNITS:
            self.known.clear()
        known, new = self.known, set()
        for found in units:
            new.update(set(found or ()).difference(known))
        if new:
            self._encode_units(list(new))
        return [
            self._encode([text])[0] if found is None else b"".join(map(known.__getitem__, found))
            for text, found in zip(texts, units)
        ]


def _encoder(name: str) -> TextEncoder:
    if name not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
        _encoders[name] = TextEncoder(tokenizer_path(name))
    return _encoders[name]


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of full capacity, but for the first."""
    first = length % capacity or capacity
    starts = [0, *range(first, length, capacity)] if length > capacity else [0]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], length])]


def _piece_rows(tokenizer: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def rows(doc_ids: list, texts: list[str]) -> Iterator[tuple]:
        for doc_id, ids in zip(doc_ids, _encoder(tokenizer).encode(texts)):
            ids += end
            for k, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                yield doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(0).to_pylist(), 0
            while at < len(ids):
                texts, chars, begin = [], 0, at
                while at < len(ids) and chars < _GROUP_CHARS:
                    texts.append(batch.column(1)[at].as_py() or "")
                    chars += len(texts[-1])
                    at += 1
                found = list(zip(*rows(ids[begin:at], texts)))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, k) for x, k in zip(found, kinds)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )
        _encoder(tokenizer).known.clear()  # Spark keeps the worker for other work, which has use for the memory

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_piece_rows(tokenizer, capacity, end_id), PIECES)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item.

    A bin takes the longest item that fits until none does. If room is left, its smallest item goes back for the two
    unpacked items that fill the room so made best, where they fill it better than that item did.
    """
    order = np.argsort(lengths, kind="stable").tolist()
    waiting: dict[int, list[int]] = {}
    for i in order:
        waiting.setdefault(int(lengths[i]), []).append(i)
    there = sum(1 << n for n in waiting)

    def longest(most: int) -> int:
        return (there & ((2 << most) - 1)).bit_length() - 1 if most > 0 else -1

    def take(n: int) -> int:
        nonlocal there
        item = waiting[n].pop()
        if not waiting[n]:
            there &= ~(1 << n)
        return item

    def two(room: int, over: int) -> tuple[int, int] | None:
        best, found, a = over, None, longest(room - 1)
        while 2 * a > best and best < room:
            b = longest(min(room - a, a))
            if b == a and len(waiting[a]) < 2:
                b = longest(a - 1)
            if b > 0 and a + b > best:
                best, found = a + b, (a, b)
            a = longest(a - 1)
        return found

    bins, offsets, k = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64), 0
    while there:
        held, gap = [], capacity
        while (n := longest(gap)) > 0:
            held.append((n, take(n)))
            gap -= n
        if gap and held:
            smallest, item = held[-1]
            if pair := two(gap + smallest, smallest):
                held.pop()
                held += [(n, take(n)) for n in pair]
                waiting[smallest].append(item)
                there |= 1 << smallest
        at = 0
        for n, item in held:
            bins[item], offsets[item] = k, at
            at += n
        k += 1
    return bins, offsets


def _pack_group(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "ids_crc32"]).reset_index(drop=True)
        bins, offsets = best_two_fit(group["length"].to_numpy(), capacity)
        base = int(group["pack_group"].iloc[0]) << 32
        return group.drop(columns="pack_group").assign(sequence_id=base + bins, offset=offsets)

    return run


def pack(
    docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = 2048, end_id: int = 0, group_rows: int = 50_000
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and ``end_id``; one of more than ``capacity`` ids is cut into pieces of that many, the
    first perhaps shorter. Null and empty texts are ``end_id`` alone. Rows that repeat doc_id or text are documents of
    their own. Empty table: no rows. Columns other than doc_id and text are not read.
    """
    counted = written(pieces(docs, tokenizer, capacity, end_id), "pieces")
    groups = max(1, math.ceil(counted.count() / group_rows))
    # The row's own number in the written table deals out rows that repeat each other.
    keys = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)).alias("pack_group")
    return counted.select("*", keys).groupBy("pack_group").applyInPandas(_pack_group(capacity), _PACKED)
