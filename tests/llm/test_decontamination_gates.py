"""Matches that have none of an item's rarest words, and items that repeat words."""

from collections import Counter

from quarry.llm import decontamination as D


def test_paraphrases_without_the_rarest_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en'").orderBy("doc_id").limit(200).collect()
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").orderBy("item_id").limit(100).collect()
    known = Counter(w for r in docs for w in D.words(r.text))
    rows, want = [(10_000 + i, r.text) for i, r in enumerate(docs)], set()
    for k, item in enumerate(items):
        own = D.words(item.text)
        rarest = sorted(set(own), key=lambda w: (known[w], w))[:8]
        copy = [b"zq%d" % i if w in rarest else w for i, w in enumerate(own)]
        share = D.subsequence(own, copy) / len(own)
        if share >= D.WHOLE or (share >= D.PART and D.subsequence(own[-D.ANSWER :], copy) >= D.ANSWERED * D.ANSWER):
            host = docs[k % len(docs)].text.split()[:300]
            rows.append((k, " ".join(host[:100] + b" ".join(copy).decode().split() + host[100:])))
            want.add((k, item.item_id))
    assert len(want) > 20
    found = D.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items)).collect()
    assert len(want & {(r.doc_id, r.item_id) for r in found}) >= 0.98 * len(want)


def test_an_item_of_repeated_words(spark, sf):
    """Fourteen of twenty words in order, the last six among them, but two of its eight distinct words."""
    item = "one two three four five six " + "go " * 8 + "on on on on on on"
    planted = [(-1, "x y z " + "go " * 8 + "on " * 6 + "u v w"), (-2, "one two three four five six go")]
    docs = spark.createDataFrame(planted, "doc_id long, text string").union(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    found = D.matches(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(-1, 7)]


def test_what_is_asked_for_is_necessary():
    """Of each item any allowed set of missing words leaves as many of the picked ones as are asked for."""
    import numpy as np

    pick = np.random.default_rng(3)
    weights = pick.random(D.FEATURES).astype(np.float32) * 10 + 1
    for n in range(1, 60):
        item = [b"w%d" % i for i in pick.integers(0, max(1, n // 2) + 1, n)]
        picked, needed = D.telling(item, weights)
        inside = np.isin(D.hashes(item), picked).sum()
        assert needed >= 1 and inside - (n - D.least_found(n)) >= needed


def test_recall_with_a_space_of_few_documents(spark):
    """Fitted on a tenth of the documents, the space finds what it finds when fitted on all."""
    from tests.llm.test_decontamination import by_hand

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) < 30000")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    want = by_hand([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    found = {(r.doc_id, r.item_id) for r in D.matches(docs, items, sample_docs=100).collect()}
    assert len(want) > 10 and len(found & want) >= 0.95 * len(want)


def test_a_very_long_text_and_several_passes(spark, monkeypatch):
    """A text of 500,000 words keeps its planted items, at its ends too, however the items are dealt to blocks and passes."""
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").orderBy("item_id").limit(30).collect()
    filler = [f"f{i * i % 9973}" for i in range(500_000)]
    spots = sorted(range(0, 500_001, 500_000 // (len(items) - 1)))[: len(items) - 1] + [500_000]
    own, at = [], 0
    for spot, item in zip(spots, items):
        own += filler[at:spot] + item.text.split()
        at = spot
    docs = spark.createDataFrame([(1, " ".join(own)), (2, "a clean one"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame(items)
    whole = {tuple(r) for r in D.matches(docs, bench).collect()}
    assert {(r[0], r[1]) for r in whole} >= {(1, i.item_id) for i in items if D.words(i.text)}
    monkeypatch.setattr(D, "ITEM_BLOCK", 4)
    monkeypatch.setattr(D, "PASS_ITEMS", 10)
    assert {(r[0], r[1]) for r in D.matches(docs, bench).collect()} == {(r[0], r[1]) for r in whole}
    assert [r.doc_id for r in D.remove_contaminated(docs, bench).orderBy("doc_id").collect()] == [2, 3]


def test_every_document_shapes_the_space(spark, monkeypatch):
    """The sums over tasks are those of the passages of all documents, very long and repeated ones as well."""
    import numpy as np

    texts = [" ".join(f"w{i * k % 911}" for i in range(n)) for k, n in enumerate((0, 5, 30, 100, 9000, 70_000, 100, 700), 3)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts + texts[2:4] + [None])], "doc_id long, text string").repartition(3)
    rows = D.feature_rows(docs)
    weights = D.word_weights(rows)
    passages = []
    for text in texts + texts[2:4]:
        ids = D.features(D.words(text))
        halves = [np.bincount(ids[i : i + D.HALF], minlength=D.FEATURES) for i in range(0, len(ids), D.HALF)]
        passages += halves if len(halves) == 1 else [a + b for a, b in zip(halves, halves[1:])]
    counts = np.array(passages, np.float32)
    total = np.array([np.bincount(D.features(D.words(t)), minlength=D.FEATURES) for t in texts + texts[2:4]]).sum(axis=0)
    assert np.allclose(weights, np.log1p(total.sum() / (1 + total)), rtol=1e-5)
    own = counts * weights
    start = np.random.default_rng(7).normal(size=(D.FEATURES, D.RANK)).astype(np.float32)
    basis, _ = np.linalg.qr((own.T @ (own @ start)).astype(np.float64))
    squares = np.linalg.eigvalsh((own @ basis).T @ (own @ basis))
    space = D.latent_space(rows, weights)
    vectors = counts @ space  # directions of length one, where the singular value isn't negligible
    lengths = np.sort(np.square(vectors).sum(axis=0))
    strong = int((squares > squares.max() * 1e-4).sum())
    assert strong > 10 and np.allclose(lengths[-strong:], 1, atol=0.02)


def test_rare_words_are_counted_in_few_bytes():
    """Running totals over more words than 16 bits count go round; what is around a passage is still right."""
    import numpy as np

    own = [b"tell"] * 70_000 + [w for k in range(9000) for w in (b"other%d" % (k % 50), b"tell", b"tale")]
    weights = np.ones(D.FEATURES, np.float32)
    items = D.made_items([1, 2], [[b"tell", b"tale"] * 3, [b"other7"] * 4], weights, np.ones((D.FEATURES, 2), np.float32))
    found, (starts, _, _) = D.hashes(own), D.passages([len(own)])
    wide, narrow = D.rare_counts(found, starts, items), D.rare_counts(found, starts, items, np.int16)
    assert wide.dtype == np.int64 and narrow.dtype == np.int16 and wide.max() > np.iinfo(np.int16).max
    assert np.array_equal(narrow[9:] - narrow[:-9], wide[9:] - wide[:-9]) and (wide[-1] > 0).all()
