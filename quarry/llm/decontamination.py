"""Benchmark decontamination by latent semantic retrieval.

Documents are read as overlapping passages. A randomised SVD of TF-IDF passages, its products added up over tasks, gives
a small latent space, scaled so that its directions weigh alike. Every passage of every document is placed in it and
compared with every benchmark item by cosine; what is near enough is checked on the words themselves, by the longest
common subsequence with the item and with its answer, which finds paraphrases with words changed, put in or left out.
Before that, places that can't hold a match are passed over: at most two fifths of an item's words may be missing, so of
any set of its words that is larger, what is over that must be around the passage.
The passages are searched and checked where their document lies, some thousand at a time, so nothing but matches ever
moves and a very long text takes no more memory than its own words do.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from quarry.llm.common import written

#: Hashed features, latent directions; words in half a passage; the answer's words; cosine from which words are checked.
FEATURES, RANK, HALF, ANSWER, NEAR = 1 << 14, 96, 24, 6, 0.2
#: Shares of an item found in order that make a match: alone, or together with the answer's.
WHOLE, PART, ANSWERED = 0.8, 0.6, 0.8
_SLICE, _GROUP_WORDS, _PLACES, ITEM_BLOCK = 1024, 100_000, 8192, 500
#: Passages whose words are added up at once; occurrences from which a feature is added up by a product; features in a row.
_FIT_PLACES, _OFTEN, _FEATURE_BLOCK = 2048, 80, 256
#: Items and words of items that go to the tasks together, and so through the corpus in one pass.
PASS_ITEMS, PASS_WORDS = 10_000, 2_000_000
_PUNCTUATION = bytes(32 if not (48 <= c < 58 or 97 <= c < 123 or c >= 128) else c for c in range(256))
MATCHES = "doc_id long, item_id long, lcs double, answer double, first_word long, n_words long"


def words(text: str | None) -> list[bytes]:
    """Lower-cased words of letters and digits; ASCII punctuation parts words."""
    return (text or "").lower().encode().translate(_PUNCTUATION).split()


def hashes(own: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh32_intdigest, own), np.uint32, len(own))


def features(own: list[bytes]) -> np.ndarray:
    return (hashes(own) % FEATURES).astype(np.int64)


def half_sums(ids: np.ndarray, starts: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``space`` over each half passage, some at a time and word by word."""
    out = np.empty((len(starts), space.shape[1]), np.float32)
    sizes = np.diff(starts, append=len(ids))
    rows = np.empty((_SLICE, space.shape[1]), np.float32)
    for at in range(0, len(starts), _SLICE):
        begin, size, sums = starts[at : at + _SLICE], sizes[at : at + _SLICE], out[at : at + _SLICE]
        np.take(space, ids[begin], axis=0, out=sums, mode="clip")
        for k in range(1, size.max()):
            on = np.flatnonzero(size > k)
            if len(on) == len(sums):
                sums += np.take(space, ids[begin + k], axis=0, out=rows[: len(sums)], mode="clip")
            else:
                sums[on] += space[ids[begin[on] + k]]
    return out


def passages(sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the half passages of texts laid end to end, and the first and last half of each passage."""
    starts, first, last, at, half = [], [], [], 0, 0
    for n in sizes:
        k = -(-n // HALF)
        starts.append(at + HALF * np.arange(k))
        first.append(half + np.arange(max(1, k - 1) if k else 0))
        last.append(half + (np.arange(1, k) if k > 1 else np.arange(k)))
        at, half = at + n, half + k
    return tuple(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (starts, first, last))


def placed(ids: np.ndarray, starts: np.ndarray, first: np.ndarray, last: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Vectors of successive passages, which consist of the halves ``first`` and ``last``."""
    if not len(first):
        return np.zeros((0, space.shape[1]), np.float32)
    low, high = first[0], last[-1] + 1
    end = starts[high] if high < len(starts) else len(ids)
    sums = half_sums(ids[starts[low] : end], starts[low:high] - starts[low], space)
    return sums[first - low] + np.where((last > first)[:, None], sums[last - low], 0)


def _text_groups(column: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    held: list[list[bytes]] = []
    size = begin = 0
    for i in range(len(column)):
        held.append(words(column[i].as_py()))
        size += len(held[-1])
        if size > _GROUP_WORDS or i == len(column) - 1:
            yield begin, held
            held, size, begin = [], 0, i + 1


def feature_rows(docs: DataFrame) -> DataFrame:
    """ids (two bytes for each word's feature) and sizes (words of each text, four bytes) of some texts together, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _text_groups(batch.column(0)):
                ids = features([w for own in texts for w in own]).astype("<u2").tobytes()
                sizes = np.array([len(own) for own in texts], "<i4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([ids], pa.binary()), pa.array([sizes], pa.binary())], names=["ids", "sizes"])

    return written(docs.select("text").mapInArrow(run, "ids binary, sizes binary"), "features")


def _feature_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[int]]]:
    for batch in batches:
        for ids, sizes in zip(batch.column(0), batch.column(1)):
            if len(ids.as_buffer()):
                yield np.frombuffer(ids.as_buffer(), "<u2"), np.frombuffer(sizes.as_buffer(), "<i4").tolist()


def word_weights(rows: DataFrame) -> np.ndarray:
    """Inverse frequency of each feature over all words of ``feature_rows``: FEATURES numbers, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES, np.int64)
        for ids, _ in _feature_texts(batches):
            total += np.bincount(ids, minlength=FEATURES)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int64()), pa.array(total[on], pa.int64())], names=["f", "n"])

    counted = rows.mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(FEATURES)
    for r in counted:
        counts[r.f] = r.n
    return np.log1p(counts.sum() / (1 + counts)).astype(np.float32)


def sampled(docs: DataFrame, sample_docs: int) -> DataFrame:
    """At most so many documents, those whose hashes are lowest."""
    rows = docs.where(F.length("text") > 0).select("text", F.xxhash64("doc_id", "text").alias("h"))
    last = rows.select("h").distinct().orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    return rows.where(F.col("h") <= F.lit(last).cast("long")).dropDuplicates(["h"]).select("text")


def _add_words(total: np.ndarray, ids: np.ndarray, half: np.ndarray, halves: np.ndarray) -> None:
    """Adds to each feature's row the rows of the halves in which its words stand."""
    order = np.argsort(ids, kind="stable")
    ids, half = ids[order].astype(np.int64), half[order]
    first = np.flatnonzero(np.diff(ids, prepend=-1))
    times = np.diff(first, append=len(ids))
    often = np.flatnonzero(times >= _OFTEN)
    if len(often):
        column = np.repeat(np.arange(len(often)), times[often])
        on = np.repeat(times >= _OFTEN, times)
        counts = np.bincount(half[on] * len(often) + column, minlength=len(halves) * len(often)).reshape(len(halves), -1)
        total[ids[first[often]]] += counts.astype(np.float32).T @ halves
    first, times = first[times < _OFTEN], times[times < _OFTEN]
    for k in range(_OFTEN - 1):  # the k-th word of each feature: no feature comes twice
        at = first[times > k] + k
        if not len(at):
            break
        total[ids[at]] += halves[half[at]]


def latent_space(rows: DataFrame, weights: np.ndarray) -> np.ndarray:
    """FEATURES x RANK: the weighted features' directions, each divided by its singular value.

    The space is fitted on all passages of ``feature_rows``. Tasks add up their own; their sums are added by blocks of features.
    """
    context = rows.sparkSession.sparkContext

    def product(basis: np.ndarray, gram: bool) -> np.ndarray | None:
        """The sum over tasks of A'(A basis), or of (A basis)'(A basis), for the passages A; None where there are no words."""
        sent = context.broadcast((basis * weights[:, None]).astype(np.float32))
        rank = basis.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            space, seen = sent.value, False
            total = np.zeros((rank if gram else FEATURES, rank), np.float64 if gram else np.float32)
            for ids, sizes in _feature_texts(batches):
                seen = True
                wide = ids.astype(np.int64)
                starts, first, last = passages(sizes)
                for at in range(0, len(first), _FIT_PLACES):
                    one, two = first[at : at + _FIT_PLACES], last[at : at + _FIT_PLACES]
                    vectors = placed(wide, starts, one, two, space)
                    if gram:
                        total += vectors.T @ vectors
                        continue
                    low, high = one[0], two[-1] + 1
                    halves = np.zeros((high - low, rank), np.float32)
                    halves[one - low] += vectors  # each half is the first of one passage at most, and the last of one
                    halves[two[two > one] - low] += vectors[two > one]
                    ends = np.append(starts[low + 1 : high], starts[high] if high < len(starts) else len(ids))
                    half = np.repeat(np.arange(high - low), ends - starts[low:high])
                    _add_words(total, ids[starts[low] : ends[-1]], half, halves)
            if seen:
                parts = [total[k : k + _FEATURE_BLOCK].astype(np.float32).tobytes() for k in range(0, len(total), _FEATURE_BLOCK)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["block", "part"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for block, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                    part = np.frombuffer(part.as_buffer(), np.float32)
                    sums[block] = sums.get(block, 0) + part.astype(np.float64)
            found = [v.astype(np.float32).tobytes() for v in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(found, pa.binary())], names=["block", "part"])

        schema = "block int, part binary"
        found = {r.block: r.part for r in rows.mapInArrow(run, schema).repartition("block").mapInArrow(add, schema).toLocalIterator()}
        if not found:
            return None
        return np.concatenate([np.frombuffer(found[k], np.float32) for k in sorted(found)]).astype(np.float64).reshape(-1, rank)

    start = np.random.default_rng(7).normal(size=(FEATURES, RANK)).astype(np.float32)
    spread = product(start, False)
    if spread is None:
        return start * weights[:, None]
    basis, _ = np.linalg.qr(spread * weights[:, None])
    squares, turn = np.linalg.eigh(product(basis, True))
    scale = np.sqrt(np.maximum(squares, squares.max() * 1e-6 + 1e-9))
    return ((basis @ turn) / scale * weights[:, None]).astype(np.float32)


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def subsequence(item: list[bytes], text: list[bytes]) -> int:
    """Length of the longest common subsequence, the item's places being bits of one number."""
    where: dict[bytes, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    whole = (1 << len(item)) - 1
    row = whole
    for w in text:
        if m := where.get(w):
            hit = row & m
            row = ((row + hit) | (row - hit)) & whole
    return len(item) - row.bit_count()


@dataclass
class Items:
    """Benchmark items, the unit vectors of their words, and the hashes of the words that ``telling`` picks for each.

    ``rare`` is sorted; the items with word k are ``owner[first[k]:first[k + 1]]``. ``needed`` is how many an item needs.
    """

    ids: list[int]
    words: list[list[bytes]]
    vectors: np.ndarray
    rare: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    needed: np.ndarray
    listed: np.ndarray  # by the low 16 bits of a hash: whether any rare word has them
    counts: list[Counter]  # how often each item has each of its words
    known: list[frozenset[bytes]]  # each item's words
    least: list[int]  # how many of each item's words a match has in order


def least_found(n: int) -> int:
    """How many of an item's n words must be found in order for a match."""
    return next(c for c in range(n + 1) if c / n >= PART)


def telling(item: list[bytes], weights: np.ndarray) -> tuple[np.ndarray, int]:
    """Hashes of the item's rarest words, and how many occurrences of them every match has.

    A match misses at most n - least_found(n) of the n words, so of words that stand m times in the item it has
    m - (n - least_found(n)). Of the sets of rarest words with m above that, the one least often met by chance is taken,
    by the frequencies in ``weights``. The choice is one of speed: each of the sets is a necessary condition.
    """
    found, times = np.unique(hashes(item), return_counts=True)
    own = weights[(found % FEATURES).astype(np.int64)].astype(np.float64)
    order = np.argsort(-own, kind="stable")
    needed = np.cumsum(times[order]) - (len(item) - least_found(len(item)))
    around = (2 * HALF + 2 * len(item)) * np.cumsum(1 / np.maximum(np.expm1(own[order]), 1e-9))  # expected occurrences
    # Chernoff's bound on the chance of so many occurrences
    chance = np.where(needed > around, needed - around - needed * np.log(np.maximum(needed, 1) / np.maximum(around, 1e-12)), 0)
    size = int(np.argmin(np.where(needed > 0, chance, np.inf))) + 1
    return found[order[:size]], int(needed[size - 1])


def made_items(ids: list[int], own: list[list[bytes]], weights: np.ndarray, space: np.ndarray) -> Items:
    vectors = unit(np.array([space[features(w)].sum(axis=0) for w in own], np.float32).reshape(-1, space.shape[1]))
    pairs, needed = [], []
    for k, item in enumerate(own):
        picked, least = telling(item, weights)
        needed.append(least)
        pairs += [(int(h), k) for h in picked]
    pairs.sort()
    rare, first = np.unique(np.array([h for h, _ in pairs], np.uint32), return_index=True)
    listed = np.zeros(1 << 16, bool)
    listed[rare & 0xFFFF] = True
    return Items(
        ids, own, vectors, rare, np.append(first, len(pairs)), np.array([k for _, k in pairs], np.int64),
        np.array(needed, np.int64), listed, [Counter(w) for w in own], [frozenset(w) for w in own],
        [least_found(len(w)) for w in own],
    )


def rare_counts(found: np.ndarray, starts: np.ndarray, items: Items, kind: type = np.int64) -> np.ndarray:
    """Rows of running totals over the half passages: how often rare words of each item came before.

    Totals that ``kind`` can't hold go round. The difference of two rows is right as long as it fits ``kind``.
    """
    shape = (len(starts) + 1, len(items.ids))
    total = np.zeros(shape, kind)
    at = np.flatnonzero(items.listed[found & 0xFFFF])
    k = np.searchsorted(items.rare, found[at])
    k[k == len(items.rare)] = 0
    hit = items.rare[k] == found[at]
    at, k = at[hit], k[hit]
    if len(at):
        half = np.searchsorted(starts, at, "right")
        many = items.first[k + 1] - items.first[k]
        ends = np.cumsum(many)
        owner = items.owner[np.repeat(items.first[k] - ends + many, many) + np.arange(ends[-1])]
        total += np.bincount(np.repeat(half, many) * len(items.ids) + owner, minlength=total.size).reshape(shape).astype(kind)
    return np.cumsum(total, axis=0, dtype=kind, out=total)


def item_passes(benchmark: DataFrame, space: np.ndarray, weights: np.ndarray) -> Iterator[list[Items]]:
    """The items in blocks that are compared together, and the blocks in lists small enough to go to every task."""
    rows: list[Row] = []
    own: list[list[bytes]] = []
    blocks: list[Items] = []
    items = n_words = 0

    def close() -> None:
        if rows:
            blocks.append(made_items([r.item_id for r in rows], list(own), weights, space))
            rows.clear()
            own.clear()

    for row in benchmark.select("item_id", "text").toLocalIterator():
        found = words(row.text)
        if not found:
            continue
        if items and (items == PASS_ITEMS or n_words + len(found) > PASS_WORDS):
            close()
            yield blocks
            blocks, items, n_words = [], 0, 0
        rows.append(row)
        own.append(found)
        items, n_words = items + 1, n_words + len(found)
        if len(rows) == ITEM_BLOCK:
            close()
    close()
    if blocks:
        yield blocks


def found_in(texts: list[list[bytes]], blocks: list[Items], space: np.ndarray) -> list[tuple]:
    """(text, item, lcs share, answer share, first word, words) of each item's best region in each text."""
    found = hashes([w for own in texts for w in own])
    ids = (found % FEATURES).astype(np.int64)
    starts, first, last = passages([len(t) for t in texts])
    begin = np.cumsum([0, *map(len, texts)])
    best: list[dict[tuple[int, int], tuple]] = [{} for _ in blocks]
    for at in range(0, len(first), _PLACES):
        part = slice(at, at + _PLACES)
        own = placed(ids, starts, first[part], last[part], space)
        blind = ~own.any(axis=1)
        own, spots = unit(own), starts[first[part]]
        for items, known in zip(blocks, best):
            _compare(texts, found, begin, starts, first[part], last[part], spots, own, blind, items, known)
    return [(text, items.ids[item], *region) for items, known in zip(blocks, best) for (text, item), region in known.items()]


def _compare(texts, found, begin, starts, first, last, spots, own, blind, items: Items, best: dict) -> None:
    """Compares successive passages with a block of items; ``best`` keeps each text's and item's best region."""
    reach = -(-max(map(len, items.words)) // HALF)
    # Only the halves that the passages can reach are counted.
    base, top = max(int(first[0]) - reach, 0), min(int(last[-1]) + 1 + reach, len(starts))
    end = starts[top] if top < len(starts) else len(found)
    low, high = np.maximum(first - reach, 0) - base, np.minimum(last + 1 + reach, len(starts)) - base
    most = max(int((high - low).max()) * HALF, int(items.needed.max()))  # no passage counts more words, and no item needs more
    kind = np.int16 if most <= np.iinfo(np.int16).max else np.int64
    totals = rare_counts(found[starts[base] : end], starts[base:top] - starts[base], items, kind)
    rare = totals[high] - totals[low] >= items.needed.astype(kind)
    near = np.argwhere(rare)
    lost = ~items.vectors.any(axis=1)  # none of the words has a place in the space
    keep = blind[near[:, 0]] | lost[near[:, 1]]
    for k in range(0, len(near), _PLACES):
        passage, item = near[k : k + _PLACES].T
        keep[k : k + _PLACES] |= np.einsum("ij,ij->i", own[passage], items.vectors[item]) >= NEAR
    near = near[keep]
    where = spots[near[:, 0]]
    owner = np.searchsorted(begin, where, "right") - 1
    for spot, text, item in zip(where.tolist(), owner.tolist(), near[:, 1].tolist()):
        wanted, counts = items.words[item], items.counts[item]
        start = max(0, spot - int(begin[text]) - len(wanted))
        region = texts[text][start : spot - int(begin[text]) + 2 * HALF + len(wanted)]
        absent = items.known[item].difference(region)
        if sum(map(counts.__getitem__, absent)) > len(wanted) - items.least[item]:
            continue
        share = subsequence(wanted, region) / len(wanted)
        if share < PART or share <= best.get((text, item), (0,))[0]:
            continue
        answer = subsequence(wanted[-ANSWER:], region) / min(ANSWER, len(wanted))
        if share >= WHOLE or answer >= ANSWERED:
            best[text, item] = (share, answer, start, len(region))


def _search(sent, emit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, blocks = sent.value
        for batch in batches:
            yield from emit(batch, space, blocks)

    return run


def fitted(docs: DataFrame, benchmark: DataFrame, sample_docs: int | None = None) -> list:
    """The latent space of the documents with the benchmark's item blocks, one broadcast for each pass.

    The space is fitted on all documents, or on ``sample_docs`` of them where a number is given.
    """
    rows = feature_rows(docs)
    weights = word_weights(rows)
    space = latent_space(rows if sample_docs is None else feature_rows(sampled(docs, sample_docs)), weights)
    context = docs.sparkSession.sparkContext
    return [context.broadcast((space, blocks)) for blocks in item_passes(benchmark, space, weights)]


def matches(docs: DataFrame, benchmark: DataFrame, sample_docs: int | None = None) -> DataFrame:
    """One row for each document and item found in it: doc_id, item_id, lcs, answer, first_word, n_words.

    ``lcs`` is the share of the item's words found in order in the region of ``n_words`` words from ``first_word`` on,
    ``answer`` that of its last 6 words; a match has lcs 0.8, or 0.6 with answer 0.8. The benchmark names no answers,
    so an item's end stands for it. An item without words matches nothing, nor does a null or empty text. Repeated rows
    are searched each, and repeated items come back each. Null ids are carried along. Empty tables: no rows. Columns
    other than doc_id and text, item_id and text, are not read.
    """
    rows = docs.select("doc_id", "text")

    def emit(batch: pa.RecordBatch, space: np.ndarray, blocks: list[Items]) -> Iterator[pa.RecordBatch]:
        out = []
        for begin, texts in _text_groups(batch.column(1)):
            out += [(batch.column(0)[begin + t].as_py(), *rest) for t, *rest in found_in(texts, blocks, space)]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
        columns = list(zip(*out)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)],
            names=["doc_id", "item_id", "lcs", "answer", "first_word", "n_words"],
        )

    found = rows.limit(0).mapInArrow(lambda batches: batches, rows.schema).selectExpr(
        "doc_id", "0L AS item_id", "0D AS lcs", "0D AS answer", "0L AS first_word", "0L AS n_words"
    )
    for k, sent in enumerate(fitted(rows, benchmark, sample_docs)):
        part = rows.mapInArrow(_search(sent, emit), MATCHES)
        found = part if k == 0 else found.unionByName(part)
    return found


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns as they were, without those in which a benchmark item is found.

    Null and empty texts stay, as do repeated rows, all or none of which are clean; an item without words finds nothing.
    With an empty benchmark every row stays, of empty documents none is returned.
    """
    at = docs.columns.index("text")

    def emit(batch: pa.RecordBatch, space: np.ndarray, blocks: list[Items]) -> Iterator[pa.RecordBatch]:
        clean = np.ones(batch.num_rows, bool)
        for begin, texts in _text_groups(batch.column(at)):
            for text, *_ in found_in(texts, blocks, space):
                clean[begin + text] = False
        yield batch.filter(pa.array(clean, pa.bool_()))

    for sent in fitted(docs, benchmark):
        docs = docs.mapInArrow(_search(sent, emit), docs.schema)
    return docs
