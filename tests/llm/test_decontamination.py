"""Decontamination against subsequences of every region, and planted paraphrases."""

from quarry.llm import decontamination as D
from tests.llm.test_brute import DOCS, HARD, with_clashes


def by_hand(docs, items):
    """Pairs by sliding a region over the whole text word by word, with a quick bound first."""
    out = set()
    for doc_id, text in docs:
        own = D.words(text)
        for item_id, item in items:
            wanted = D.words(item)
            have = set(wanted)
            if not wanted or len(have & set(own)) < D.PART * len(have):
                continue
            for low in range(0, max(1, len(own) - len(wanted)), 4):
                region = own[low : low + 2 * len(wanted)]
                if len(have.intersection(region)) < D.PART * len(have):
                    continue
                share = D.subsequence(wanted, region) / len(wanted)
                answer = D.subsequence(wanted[-D.ANSWER :], region) / min(D.ANSWER, len(wanted))
                if share >= D.WHOLE or (share >= D.PART and answer >= D.ANSWERED):
                    out.add((doc_id, item_id))
                    break
    return out


def test_recall_and_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) < 30000")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in D.matches(docs, items).collect()}
    want = by_hand([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert len(want) > 10
    assert len(found & want) >= 0.95 * len(want)
    assert len(found - want) <= 0.05 * len(want)


def test_paraphrases_and_near_misses(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'").limit(60).collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    rows, want = [], set()
    for k, item in enumerate(items):
        own = item.text.split()
        host = docs[k % len(docs)].text.split()[:300]
        changed = [w if i % 9 else "other" for i, w in enumerate(own)]  # every ninth word replaced
        rows.append((k, " ".join(host[:100] + changed + host[100:])))
        want.add((k, item.item_id))
        rows.append((1000 + k, " ".join(host + own[: len(own) // 3])))  # a third of the item is no leak
    found = D.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items)).collect()
    pairs = {(r.doc_id, r.item_id) for r in found}
    assert len(pairs & want) >= 0.9 * len(want)
    texts, listed = [r for r in rows if r[0] >= 1000], [(r.item_id, r.text) for r in items]
    assert {p for p in pairs if p[0] >= 1000} <= by_hand(texts, listed)


def test_subsequence_length():
    a, b = list(b"ABCBDAB"), list(b"BDCABA")
    assert D.subsequence([bytes([x]) for x in a], [bytes([x]) for x in b]) == 4


def test_hard_and_empty_tables(spark):
    docs = spark.createDataFrame(HARD, DOCS)
    items = spark.createDataFrame([(1, None), (2, ""), (None, "no id here at all"), (3, "word " * 40)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in D.matches(with_clashes(docs, ["lcs", "item_id"]), items).collect()}
    assert {(None, None), (7, 3)} <= found
    clashing = with_clashes(docs, ["space"])
    kept = D.remove_contaminated(clashing, items)
    assert kept.columns == clashing.columns and 7 not in {r.doc_id for r in kept.collect()}
    assert D.matches(docs, items.limit(0)).count() == 0
    assert D.matches(docs.limit(0), items).count() == 0
