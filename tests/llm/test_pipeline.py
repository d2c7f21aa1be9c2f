"""The pipeline's stages, each against brute force on its own input."""

import pytest

import corpus_pipeline
from quarry.llm import decontamination, simhash, toxicity
from quarry.llm.common import table, written
from tests.llm.test_brute import packed_as_it_should, tokenizer  # noqa: F401
from tests.llm.test_decontamination import by_hand as leaks_by_hand
from tests.llm.test_lines import SPACE, word_set

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf):
    """(input rows, output) of each stage, written and read between them as the pipeline does."""
    docs, out = table(spark, sf, "documents"), {}
    for name, function in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = written(function(spark, docs, sf), f"test-{name}")
        out[name] = (before, docs)
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "packing"]
    assert all(df.columns == COLUMNS for name, (_, df) in stages.items() if name != "packing")


def test_toxic_documents_go(spark, sf, stages):
    before, after = stages["toxicity"]
    model = toxicity.fit(table(spark, sf, "documents"), table(spark, sf, "labels"))
    scorer = toxicity.Scorer(model)
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in before if scorer.score(r.text) < 0.7)


def test_similar_lines_go(stages):
    before, after = stages["line_dedup"]
    texts = {r.doc_id: r.text for r in after.collect()}
    assert set(texts) == {r.doc_id for r in before}
    seen = []
    for r in sorted(before, key=lambda r: r.doc_id):
        keep = []
        for line in r.text.split("\n"):
            s = word_set(line)
            if not s or not any(5 * len(s & o) >= 4 * len(s | o) for o in seen if 5 * len(o) >= 4 * len(s) and 5 * len(s) >= 4 * len(o)):
                keep.append(line)
            if s:
                seen.append(s)
        assert texts[r.doc_id] == "\n".join(keep)
    assert SPACE


def test_one_of_each_group_stays(stages):
    """Against all pairs by the Jaccard similarity of their five-word shingles, and the components of these links."""
    before, after = stages["simhash_near_dedup"]
    sets = {r.doc_id: frozenset(simhash.shingle_hashes(r.text, 5).tolist()) for r in before}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    assert sorted(r.doc_id for r in after.collect()) == sorted({find(d) for d in ids})


def test_leaks_go(spark, sf, stages):
    before, after = stages["decontamination"]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    leaking = {d for d, _ in leaks_by_hand([(r.doc_id, r.text) for r in before], items)}
    kept = {r.doc_id for r in after.collect()}
    assert kept == {r.doc_id for r in before} - leaking
    assert decontamination.RANK < decontamination.FEATURES


def test_what_is_left_is_packed(stages, tokenizer):  # noqa: F811
    before, after = stages["packing"]
    packed_as_it_should(after.collect(), [(r.doc_id, r.text) for r in before], tokenizer, 2048)


def test_one_of_wholly_repeated_rows_stays(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "x y z"), (None, "x y z"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS mark", "2 AS doc")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect() if r.doc_id != 3) == [(0, "x y z"), (1, "a b c d e f")]
    assert sum(r.doc_id == 3 for r in kept.collect()) == 1


def test_hard_tables_go_through_every_stage(spark, sf):
    """Nulls, empty and repeated rows, no rows at all, and columns named like the operators' own."""
    hard = [(1, "Alpha beta gamma"), (1, "Alpha beta gamma"), (2, None), (None, "no id"), (None, None), (3, ""), (4, "w " * 5000)]
    docs = spark.createDataFrame(hard, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    for rows in (docs, docs.limit(0), docs.selectExpr("*", "1 AS cls", "2 AS row_key", "3 AS gone", "4 AS fingerprint", "5 AS kept")):
        out = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = written(stage(spark, out, sf), f"hard-{name}")
            assert out.columns == rows.columns
        packed = corpus_pipeline.STAGES[-1][1](spark, out, sf)
        assert (packed.count() > 0) == (rows.count() > 0)


def test_run_equals_its_stages(spark, sf, stages):
    assert corpus_pipeline.run(spark, sf).count() == stages["packing"][1].count()
