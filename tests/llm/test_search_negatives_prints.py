"""Operators 11 to 13 against brute force, with nulls, ties, repeated rows, long texts, empty tables and clashing columns."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from quarry.llm import edit_fingerprints, hard_negatives, queries, ranked_search

VECTORS = "vec_id long, label int, embedding array<float>, score long, anchor int, row string"


def _documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, score string, rank int")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = [f"w{k}é" if k % 5 == 0 else f"w{k}" for k in range(150)]
    rows = [(k, " ".join(rng.choices(vocabulary, weights=[1 / (j + 1) for j in range(150)], k=rng.randint(1, 80)))) for k in range(400)]
    rows += [(400, None), (401, ""), (402, "  ..!"), (None, "w1 w2 w3"), (403, "W1-w2,w3"), (404, rows[7][1]), (404, rows[7][1]), (405, "w9 " * 40_000)]
    return rows


def _ranked(rows, items, k):
    split = lambda t: "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in (t or "")).split(" ")
    low = lambda t: [x.translate({c: c + 32 for c in range(65, 91)}) for x in split(t) if x]
    own = [(i, Counter(low(t))) for i, t in rows]
    documents = sum(bool(c) for _, c in own)
    length = sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in own:
            m = 50 + (50 * sum(c.values()) * documents) // length
            s = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(low(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return out


def test_ranked_search_equals_brute_force(spark, texts, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", 100)
    items = [(1, "w1 w2 W3 w77"), (2, "w140 w141é w140é"), (3, None), (4, "..."), (5, "w0é"), (None, "w9 w9 w30é")]
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    found = [tuple(r) for r in ranked_search.search(_documents(spark, texts), asked, k=20).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(found, key=key) == sorted(_ranked(texts, items, 20), key=key)


def test_ranked_search_in_passes_and_small_blocks(spark, texts, monkeypatch):
    items = [(k, f"w{k} w{k + 1} w{k + 2}") for k in range(30)]
    asked = spark.createDataFrame(items, "item_id long, text string")
    once = sorted(map(tuple, ranked_search.search(_documents(spark, texts), asked, k=5).collect()))
    monkeypatch.setattr(ranked_search, "PASS_ITEMS", 12)
    assert sorted(map(tuple, ranked_search.search(_documents(spark, texts), asked, k=5).collect())) == once
    assert once == sorted(_ranked(texts, items, 5))


def test_intervals_are_left_unopened():
    """Of many documents with one term, those below the best are not scored one by one."""
    rng = np.random.default_rng(1)
    size = 8000
    block = ranked_search.Block(np.arange(size), np.zeros(size, bool), np.full(size, 100), np.zeros(size, np.int64), np.arange(size), rng.integers(1, 1000, size), 1)
    seen = []
    score_all = block._score_all
    block._score_all = lambda low, high, w, best: (seen.append(int((high - low).sum())), score_all(low, high, w, best))
    best = ranked_search.Best(10)
    block.search(np.array([0]), np.array([5]), best)
    exact = np.lexsort((np.arange(size), -block.impact * 5))[:10]
    assert best.ids.tolist() == exact.tolist() and sum(seen) < size // 4


def test_equal_impacts_split_evenly():
    size = 20_000
    block = ranked_search.Block(np.arange(size), np.zeros(size, bool), np.full(size, 100), np.zeros(size, np.int64), np.arange(size), np.ones(size, np.int64), 1)
    best = ranked_search.Best(50)
    block.search(np.array([0]), np.array([3]), best)
    assert best.ids.tolist() == list(range(50))


def test_empty_tables(spark):
    no_docs, no_items = _documents(spark, []), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked_search.search(no_docs, one).count() == 0
    assert ranked_search.search(_documents(spark, [(1, "a")]), no_items).count() == 0
    assert ranked_search.search(_documents(spark, [(1, None)]), one).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS)).count() == 0
    assert edit_fingerprints.fingerprint(no_docs).count() == 0


def _mined(rows, every, least=80, most=100):
    use = [(i, k, [math.floor(256 * float(np.float32(x))) for x in v]) for i, k, v in rows
           if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for a, (i, label, v) in enumerate(use):
        if i is None or i % every:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), j, other) for b, (j, other, w) in enumerate(use) if b != a]
        for s, j, _ in sorted((x for x in scored if x[2] == label), key=order)[:5]:
            fits = sorted((x for x in scored if x[2] != label and least * s <= 100 * x[0] <= most * s), key=order)[:5]
            out += [(i, j, r + 1, n, s, t) for r, (t, n, _) in enumerate(fits)]
    return Counter(out)


def _vectors(seed, width=6, size=300, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, width))
    rows = [(k, int(rng.integers(0, 4)), [float(x) for x in np.float32(centres[k % 4] + spread * rng.normal(size=width))]) for k in range(size)]
    rows += [(900, None, [1.0] * width), (910, 1, None), (920, 1, [float("nan")] * width), (930, 1, [float("inf")] + [0.0] * (width - 1)), (940, 1, [None] * width)]
    rows += [(None, 2, rows[3][2]), (950, 1, rows[10][2][:3]), (960, 1, []), (971, 3, rows[20][2]), (971, 3, rows[20][2]), (980, 2, [1e6] * width)]
    return rows


@pytest.mark.parametrize("block,many", [(1024, 0.25), (7, 2.0)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block, many):
    monkeypatch.setattr(hard_negatives, "MANY", many)
    monkeypatch.setattr(hard_negatives, "CHUNK", 64)
    for seed, spread in ((1, 0.3), (2, 0.01)):
        rows = _vectors(seed, spread=spread)
        table = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], VECTORS).repartition(3)
        found = hard_negatives.mine(table, every=10, block=block).collect()
        assert Counter(tuple(r) for r in found) == _mined(rows, 10)


def test_close_anchors_spare_scores():
    """Children of a near parent rescore only what overlaps their window."""
    rng = np.random.default_rng(5)
    points = np.round(np.concatenate([rng.normal(size=(1, 16)) * 100 + rng.normal(size=(50, 16)), rng.normal(size=(3, 16)) * 100]))
    tree = hard_negatives.spanning_tree(np.arange(53), np.zeros(53, np.int64), points)
    own = np.round(rng.normal(size=(2000, 16)) * 60)
    chunk = hard_negatives.Chunk(np.arange(2000) + 100, np.arange(2000), np.zeros(2000, bool), np.ones(2000, np.int64), own)
    exact = own @ tree.vectors.T
    floor = np.sort(exact, axis=0)[-5]
    touched = 0
    for at, where, scores in hard_negatives.rescored(tree, chunk, lambda at, low, high: high >= floor[at]):
        assert set(np.flatnonzero(exact[:, at] >= floor[at])) <= set(where.tolist()) and (scores == exact[where, at]).all()
        touched += len(where)
    assert touched < 0.2 * exact.size


def test_spanning_tree_is_least():
    rng = np.random.default_rng(4)
    points = rng.integers(0, 5, (40, 2)).astype(float)  # with ties and equal points
    tree = hard_negatives.spanning_tree(np.arange(40), np.zeros(40), points)
    gaps = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    edges = sorted((gaps[a, b], a, b) for a in range(40) for b in range(a))
    group, total = list(range(40)), 0.0
    for gap, a, b in edges:
        if group[a] != group[b]:
            total += gap
            group = [group[a] if g == group[b] else g for g in group]
    assert math.isclose(tree.edges.sum(), total) and (tree.parents[1:] < np.arange(1, 40)).all()
    assert sorted(tree.rows.tolist()) == list(range(40)) and tree.children.sum() == 39


def _walk(text):
    """The fingerprint by its definition, one character at a time."""
    best = [None] * edit_fingerprints.SLOTS
    for number in range(-(-len(text) // edit_fingerprints.SEGMENT)):
        part = text[number * edit_fingerprints.SEGMENT : (number + 1) * edit_fingerprints.SEGMENT]
        own = edit_fingerprints.symbols(part)
        ranks = np.random.default_rng((edit_fingerprints._SEED, number)).random((edit_fingerprints.SLOTS, 3 * edit_fingerprints.SEGMENT), np.float32)
        at, out = 0, []
        while at < len(part) and len(out) < 3 * len(part):
            out.append(int(own[at]))
            at += int(edit_fingerprints.steps()[len(out) - 1, own[at]])
        for slot in range(edit_fingerprints.SLOTS):
            time = int(ranks[slot, : len(out)].argmin())
            entry = (float(ranks[slot, time]), number, time, out[time])
            best[slot] = min(best[slot] or entry, entry)
    return best


def test_walks_equal_their_definition():
    rng = random.Random(8)
    texts = ["", "a", "ab", "".join(rng.choices("abcdeé ", k=300)), "".join(rng.choices("abcd漢 ", k=9000))]
    texts.append(texts[3])
    prints = edit_fingerprints.fingerprints(texts)
    best = [_walk(t) for t in texts]
    assert (prints[3] == prints[5]).all()
    for a in range(1, 5):
        for slot in range(edit_fingerprints.SLOTS):
            _, number, time, symbol = best[a][slot]
            out = np.zeros((time + 1, 1), np.uint8)
            out[time, 0] = symbol
            times, _ = edit_fingerprints.firsts(number)
            assert time in times[slot]
    # The same times and symbols give the same slots, and slots rarely agree otherwise.
    changed = texts[3][:150] + "z" + texts[3][150:]
    other, found = _walk(changed), edit_fingerprints.fingerprints([changed])[0]
    alike = np.array([x[1:] == y[1:] for x, y in zip(best[3], other)])
    assert (prints[3][alike] == found[alike]).all() and (prints[3][~alike] == found[~alike]).mean() < 0.3


def test_side_by_side_or_alone(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choices("abc ", k=rng.choice([0, 1, 5, 100, 4096, 4097, 20_000]))) for _ in range(60)]
    together = edit_fingerprints.fingerprints(texts)
    monkeypatch.setattr(edit_fingerprints, "SIDE", 1000)
    assert (edit_fingerprints.fingerprints(texts) == together).all()
    assert all((edit_fingerprints.fingerprints([t])[0] == p).all() for t, p in zip(texts[:10], together))


def test_likeness_falls_with_edits():
    rng = random.Random(6)
    texts = ["".join(rng.choices("abcdefghijklmnop ", k=3000)) for _ in range(40)]

    def mean(k):
        changed = []
        for t in texts:
            own = list(t)
            for _ in range(k):
                own[rng.randrange(len(own))] = rng.choice(["", "x", "yz"])
            changed.append("".join(own))
        return edit_fingerprints.likeness(edit_fingerprints.fingerprints(texts), edit_fingerprints.fingerprints(changed)).mean()

    found = [mean(k) for k in (0, 1, 10, 100, 1000)]
    assert found[0] == 1 and found[1] > 0.9 and sorted(found, reverse=True) == found and found[-1] < 0.3


@pytest.mark.parametrize("bucket,crowd", [(1024, 4096), (16, 3)])
def test_fingerprint_rows_equal_brute_force(spark, texts, bucket, crowd):
    near = [(1000 + k, texts[50][1] + " " + "lorem ipsum " * 20 + "x" * k) for k in range(8)]
    rows = texts + near + [(2000, "long " * 30_000), (2001, "long " * 30_000)]
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    found = edit_fingerprints.fingerprint(_documents(spark, rows).repartition(5), bucket=bucket, crowd=crowd).collect()
    prints = edit_fingerprints.fingerprints([t for _, t in ordered])
    expected = []
    for k, (i, t) in enumerate(ordered):
        other = edit_fingerprints.edited(t, ordered[(k + 1) % len(ordered)][1])
        own = edit_fingerprints.fingerprints([other])[0]
        expected.append((i, len(t), hashlib.sha256(other.encode()).hexdigest(), edit_fingerprints.packed(prints[k : k + 1])[0].hex(), edit_fingerprints.packed(own[None])[0].hex(),
                         float(edit_fingerprints.likeness(prints[k], own)), float(edit_fingerprints.likeness(prints[k], prints[(k + 1) % len(ordered)]))))
    assert Counter(tuple(r)[:7] for r in found) == Counter(expected)
    classes = {}
    for r in found:
        classes.setdefault(r.fingerprint, set()).add(r.class_id)
    assert all(len(c) == 1 for c in classes.values())
    if crowd > 3:
        root = list(range(len(ordered)))
        for a in range(len(ordered)):
            for b in np.flatnonzero(edit_fingerprints.likeness(prints, prints[a][None, :]) >= edit_fingerprints.LINKED):
                x, y = root[a], root[int(b)]
                root = [min(x, y) if r in (x, y) else r for r in root]
        least = {}
        for k, (i, _) in enumerate(ordered):
            least[root[k]] = min([x for x in (least.get(root[k]), i) if x is not None], default=None)
        assert Counter((r.doc_id, r.class_id) for r in found) == Counter((i, least[root[k]]) for k, (i, _) in enumerate(ordered))


def test_one_document_follows_itself(spark):
    found = edit_fingerprints.fingerprint(_documents(spark, [(5, "abcdef")])).first()
    assert found.near_next == 1 and found.n_chars == 6 and found.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and found.class_id == 5


def test_edited_texts_are_told_from_next_ones(spark, sf):
    found = queries.op13_edit_fingerprints(spark, sf).collect()
    assert np.mean([r.near_edited > r.near_next for r in found]) > 0.98


def test_crowded_bands_lose_no_link(spark):
    """Prints near each other share every band with a lower one that is far from them, in keys beyond the crowd."""
    e, rng = edit_fingerprints, np.random.default_rng(3)
    base = rng.integers(0, 16, e.SLOTS)
    near = [base.copy() for _ in range(6)]
    for k, row in enumerate(near):
        row[0] = (row[0] + k) % 16
    far = rng.integers(0, 16, (e.BANDS, e.SLOTS))
    for k in range(e.BANDS):
        slots = np.random.default_rng((e._SEED, 7, k)).choice(e.SLOTS, e.WIDTH, replace=False)
        far[k, slots] = base[slots]
    packed = e.packed(np.array([*far, *near]).astype(np.uint8))
    nodes = spark.createDataFrame([(k, bytearray(fp)) for k, fp in enumerate(packed)], "node long, fp binary")
    found = {frozenset((r.a, r.b)) for r in e.links(nodes, crowd=2).collect()}
    reached = {e.BANDS}
    for _ in near:
        reached |= {n for pair in found if pair & reached for n in pair}
    assert reached == set(range(e.BANDS, e.BANDS + len(near)))
