"""The pipeline's near-duplicate stage against the Jaccard similarity of all pairs."""

import random

from pyspark.sql import functions as F

import corpus_pipeline


def kept_by_hand(rows):
    sets, root = {}, {d: d for d, _ in rows}
    for d, text in rows:
        own = text.lower().split()
        sets[d] = {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return sorted({find(d) for d in sets})


def changed(own, n, pick):
    out = list(own)
    for i in pick.sample(range(len(out)), n):
        out[i] = f"new{pick.random()}"
    return out


def test_changed_copies_go(spark):
    """Copies with one to six words of 150 changed lie on both sides of 0.8; chains of them link what isn't similar itself."""
    pick, rows = random.Random(5), []
    for k in range(12):
        own = [f"w{pick.randrange(10**6)}" for _ in range(150)]
        rows.append((len(rows), " ".join(own)))
        for n in (1, 2, 3, 4, 5, 6):
            rows.append((len(rows), " ".join(changed(own, n, pick))))
        for _ in range(6):
            own = changed(own, 2, pick)
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + i, t) for i, t in enumerate(["", " ", "a b", "A  b", "a b c"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert found == kept_by_hand(rows)
    assert len(found) < len(rows) // 2


def test_documents_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert found == kept_by_hand([(r.doc_id, r.text) for r in docs.collect()])


def test_simhash_finds_links_where_no_band_is_shared(spark, monkeypatch):
    """Without a band in common, near fingerprints are candidates and the exact similarity decides."""
    from quarry.llm import near_dedup, simhash

    pick, rows = random.Random(8), []
    for _ in range(12):
        own = [f"w{pick.randrange(10**6)}" for _ in range(400)]
        rows += [(len(rows) + i, " ".join(t)) for i, t in enumerate((own, changed(own, 1, pick), own[:150]))]
    fps = [simhash.fingerprint(near_dedup.shingle_set(t, 5)) for _, t in rows]
    near = [k for k in range(0, len(rows), 3) if (fps[k] ^ fps[k + 1]).bit_count() <= 4]
    assert len(near) > 4
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near_dedup, "classes", lambda docs, size, made=near_dedup.classes: made(docs, size).withColumn("bands", F.array().cast("array<long>")))
    found = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert all(k in found and k + 1 not in found and k + 2 in found for k in near)
