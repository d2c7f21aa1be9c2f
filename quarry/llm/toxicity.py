"""Toxicity scores from subword bags: averaged character n-gram embeddings under a linear softmax.

Embeddings and softmax are trained jointly in numpy on a bounded sample of labelled rows, by one task. A word is the average of the
vectors of its character n-grams and of itself, so a misspelling never seen shares most of its vectors with the word
that was. Windows of a few words are averaged and scored, and a text is as toxic as its worst window: one insult counts
the same in a short text and in a very long one. After training, each n-gram needs one number only, and an array of
fixed size goes to the tasks.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, DIM, SHORTEST, LONGEST = 1 << 17, 8, 3, 5
WINDOW, STRIDE = 3, 1
_CACHE_WORDS = 300_000
_EDGE = ".,;:!?\"'()[]{}<>|*#%&"


def words(text: str | None) -> list[str]:
    return [w.strip(_EDGE) for w in (text or "").lower().split()]


def grams(word: str) -> list[int]:
    """Buckets of a word's own name and of its n-grams of 3 to 5 characters, with marks at both ends."""
    marked = f"<{word}>"
    own = [marked]
    for n in range(SHORTEST, LONGEST + 1):
        own += [marked[i : i + n] for i in range(len(marked) - n + 1)]
    return [zlib.crc32(g.encode()) % BUCKETS for g in own]


def window_starts(n: int) -> np.ndarray:
    """Starts of the windows of a text of n words; the last one ends with the text."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


def window_means(values: np.ndarray) -> np.ndarray:
    """Mean over each window of the rows of ``values``."""
    starts = window_starts(len(values))
    sums = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
    ends = np.minimum(starts + WINDOW, len(values))
    return (sums[ends] - sums[starts]) / np.maximum(ends - starts, 1).reshape(-1, *[1] * (values.ndim - 1))


@dataclass
class Model:
    """``weights``: each bucket's difference of the two classes' logits; ``bias``: that of an empty bag."""

    weights: np.ndarray
    bias: float


class _Vocabulary:
    """Words as numbers with their n-gram buckets in one flat array."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.flat = array("i")
        self.ends = array("q", [0])

    def number(self, text_words: list[str]) -> np.ndarray:
        out = np.empty(len(text_words), np.int32)
        for i, w in enumerate(text_words):
            k = self.ids.get(w)
            if k is None:
                k = self.ids[w] = len(self.ids)
                self.flat.extend(grams(w))
                self.ends.append(len(self.flat))
            out[i] = k
        return out


def backward(vectors: np.ndarray, softmax: np.ndarray, bias: np.ndarray, words_of: np.ndarray, row: np.ndarray, y: np.ndarray, weight: np.ndarray):
    """The weighted mean loss of a batch of bags, and its gradients by softmax, bias and word vectors.

    Bag r is the mean of the vectors of the words ``words_of[row == r]``; without words it is zero.
    """
    n = len(y)
    per_bag = np.maximum(np.bincount(row, minlength=n), 1)[:, None]
    bags = np.zeros((n, vectors.shape[1]))
    np.add.at(bags, row, vectors[words_of])
    bags /= per_bag
    logits = bags @ softmax.T + bias
    odds = np.exp(logits - logits.max(axis=1, keepdims=True))
    odds /= odds.sum(axis=1, keepdims=True)
    target = np.stack([1 - y, y], axis=1)
    loss = -(weight[:, None] * target * np.log(np.maximum(odds, 1e-300))).sum() / n
    wrong = (odds - target) * weight[:, None] / n
    by_vector = np.zeros_like(vectors, dtype=np.float64)
    np.add.at(by_vector, words_of, ((wrong @ softmax) / per_bag)[row])
    return loss, wrong.T @ bags, wrong.sum(axis=0), by_vector


def train(texts: list[str], toxic: list[int], epochs: int = 8, rate: float = 0.5, seed: int = 1) -> Model:
    """Fits embeddings and softmax together: the first epoch on whole texts, the others on each text's worst window."""
    if not texts or len(set(toxic)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), -20.0)
    vocabulary = _Vocabulary()
    docs = [vocabulary.number(words(t)) for t in texts]
    flat, ends = np.frombuffer(vocabulary.flat, np.int32), np.frombuffer(vocabulary.ends, np.int64)
    vocabulary.ids.clear()
    sizes = np.diff(ends)
    y = np.array(toxic, np.float64)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    softmax, bias = rng.normal(0, 0.5, (2, DIM)), np.zeros(2)
    squares, softmax_squares, bias_squares = np.full(BUCKETS, 1e-3), np.full((2, DIM), 1e-3), np.full(2, 1e-3)
    for epoch in range(epochs):
        turn = rng.permutation(len(docs))
        for at in range(0, len(turn), 128):
            batch = turn[at : at + 128]
            used, inverse = np.unique(np.concatenate([docs[i] for i in batch]), return_inverse=True)
            if not len(used):
                continue
            own = np.concatenate([flat[ends[w] : ends[w + 1]] for w in used])
            first = np.concatenate([[0], np.cumsum(sizes[used])[:-1]])
            vectors = np.add.reduceat(embedding[own], first, axis=0) / sizes[used][:, None]
            lean = vectors @ (softmax[1] - softmax[0])
            chosen, share, at_word = [], [], 0
            for row, i in enumerate(batch):
                mine = inverse[at_word : at_word + len(docs[i])]
                at_word += len(docs[i])
                if epoch and len(mine):
                    start = window_starts(len(mine))[int(np.argmax(window_means(lean[mine])))]
                    mine = mine[start : start + WINDOW]
                chosen.append(mine)
                share.append(np.full(len(mine), row))
            _, by_softmax, by_bias, by_vector = backward(
                vectors, softmax, bias, np.concatenate(chosen), np.concatenate(share), y[batch], weight[batch]
            )
            for value, grad, square in ((softmax, by_softmax, softmax_squares), (bias, by_bias, bias_squares)):
                square += grad**2
                value -= rate * grad / np.sqrt(square)
            # A word's gradient goes to its n-grams in equal parts; these are of the batch's sum, not its mean.
            touched = np.flatnonzero(np.abs(by_vector).sum(axis=1))
            spread = np.repeat(by_vector[touched] * len(batch) / sizes[used][touched][:, None], sizes[used][touched], axis=0)
            if not len(touched):
                continue
            buckets = np.concatenate([flat[ends[w] : ends[w + 1]] for w in used[touched]])
            which, place = np.unique(buckets, return_inverse=True)
            grad = np.zeros((len(which), DIM))
            np.add.at(grad, place, spread)
            squares[which] += (grad**2).mean(axis=1)
            embedding[which] -= (rate * grad / np.sqrt(squares[which])[:, None]).astype(np.float32)
    return Model((embedding @ (softmax[1] - softmax[0])).astype(np.float32), float(bias[1] - bias[0]))


class Scorer:
    """Scores texts with a trained model; remembers a bounded number of words."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, float] = {}

    def score(self, text: str | None) -> float:
        own = words(text)
        known = self.known
        if new := [w for w in set(own) if w not in known]:
            if len(known) > _CACHE_WORDS:
                known.clear()
                new = list(set(own))
            found = [grams(w) for w in new]
            sizes = np.array([len(g) for g in found])
            flat = np.fromiter((g for one in found for g in one), np.int64, sizes.sum())
            sums = np.add.reduceat(self.model.weights[flat].astype(np.float64), np.cumsum(sizes) - sizes)
            known.update(zip(new, (sums / sizes).tolist()))
        logit = self.model.bias
        if own:
            logit += float(window_means(np.fromiter(map(known.__getitem__, own), np.float64, len(own))).max())
        return float(1 / (1 + np.exp(-np.clip(logit, -50, 50))))


def fold(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, mod 3; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 3_000, max_chars: int = 8_000) -> Model:
    """Trains on labelled rows outside the held-out fold.

    At most ``max_rows`` rows of each class, those whose doc_ids hash lowest, and only texts of at most ``max_chars``
    characters: the bound on what the one training task gathers. The driver gets the finished model, BUCKETS numbers.
    Rows with a null doc_id, text or label teach nothing; of texts that share a doc_id the least teaches. Without rows
    of both classes the model scores every text near 0.
    """
    usable = (
        labels.select("doc_id", "toxic")
        .where("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .where(fold(F.col("doc_id")) != 1)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    order = F.xxhash64("doc_id")
    sample = [usable.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(max_rows) for k in (0, 1)]
    ids = F.broadcast(sample[0].unionByName(sample[1]))
    rows = (
        docs.select("doc_id", "text")
        .where(F.length("text") <= max_chars)
        .join(ids, "doc_id")
        .groupBy("doc_id", "toxic")
        .agg(F.min("text").alias("text"))
        .repartition(1)
        .sortWithinPartitions(order, "doc_id")
        .select("text", "toxic")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        toxic: list[int] = []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            toxic += batch.column(1).to_pylist()
        made = train(texts, toxic)
        yield pa.RecordBatch.from_arrays([pa.array([made.weights.tobytes()]), pa.array([made.bias])], names=["weights", "bias"])

    made = rows.mapInArrow(run, "weights binary, bias double").first()
    return Model(np.frombuffer(made.weights, np.float32), made.bias) if made else train([], [])


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from the threshold on).

    Null text counts as empty, and an empty text gets the score of an empty bag. Repeated rows are scored each. Empty
    table: no rows. Columns other than doc_id and text are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            scores = pa.array([scorer.score(t.as_py()) for t in batch.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id")) == 1).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents, all columns as they were, without those that score at the threshold or over.

    Null text counts as empty; repeated rows stay or go alike; empty table: no rows. Extra columns are carried along.
    """
    model = fit(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t.as_py()) < threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
