"""Line dedup against all pairs of lines."""

import hashlib
from collections import Counter

import pytest

from quarry.llm import line_dedup
from tests.llm.test_brute import DOCS, HARD, with_clashes

SPACE = " \t\n\x0b\x0c\r"


def word_set(line):
    for c in SPACE:
        line = line.replace(c, " ")
    return frozenset(w for w in line.lower().split(" ") if w)


def by_hand(rows):
    lines = [((d is not None, d or 0, i), word_set(l)) for d, t in rows if t is not None for i, l in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[1]]
    sets = {}
    for place, s in lines:
        sets[s] = min(sets.get(s, place), place)
    inverted = {}
    for s in sets:
        for w in s:
            inverted.setdefault(w, []).append(s)
    matched = set()
    for s, place in sets.items():
        shared = Counter(o for w in s for o in inverted[w] if len(o) * 5 >= len(s) * 4 and len(s) * 5 >= len(o) * 4)
        if any(sets[o] < place and 5 * k >= 4 * (len(s) + len(o) - k) for o, k in shared.items()):
            matched.add(s)
    out = Counter()
    for d, t in rows:
        all_lines = t.split("\n") if t is not None else []
        keep = []
        for i, l in enumerate(all_lines):
            s = word_set(l)
            if not s or (s not in matched and (d is not None, d or 0, i) <= sets[s]):
                keep.append(l)
        digest = hashlib.sha256("\n".join(keep).encode()).hexdigest()
        out[(d, len(all_lines), len(all_lines) - len(keep), digest)] += 1
    return out


def found(docs):
    return Counter((r.doc_id, r.n_lines, r.n_removed, r.kept_sha256) for r in line_dedup.report(docs).collect())


def test_lines_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert found(docs) == by_hand([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("rare", [34, 2, 127])
def test_families_of_near_lines(spark, monkeypatch, rare):
    monkeypatch.setattr(line_dedup, "RARE_CODE", rare)
    base = [f"w{i}" for i in range(20)]
    rows = []
    for i in range(60):
        own = list(base)
        for k in range(i % 6):
            own[(i * 7 + k * 3) % 20] = f"x{i % 11}y{k}"
        rows.append((i, " ".join(own) + "\n" + " ".join(own[: 4 + i % 5]) + "\nsame line of words"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs) == by_hand(rows)


@pytest.mark.parametrize("crowd", [False, True])
def test_large_groups_in_turns(spark, monkeypatch, crowd):
    """Families larger than every bound on groups, some members far from the first; one line in very many documents."""
    monkeypatch.setattr(line_dedup, "SMALL", 4)
    monkeypatch.setattr(line_dedup, "LARGE", 8)
    monkeypatch.setattr(line_dedup, "TURN", 2)
    monkeypatch.setattr(line_dedup, "GROWTH", 2)
    monkeypatch.setattr(line_dedup, "LANE", 3)
    if crowd:
        monkeypatch.setattr(line_dedup, "RARE_CODE", 4)
        monkeypatch.setattr(line_dedup.math, "log2", lambda n: 0.0)
    rows = []
    for i in range(90):
        own = [f"w{k}" for k in range(25)]
        for k in range(i % 5 + i // 30):
            own[(i * 11 + k * 5) % 25] = f"x{i % 7}y{k}"
        rows.append((i, " ".join(own) + "\nthe same line in every document\n" + " ".join(own[i % 3 : 9 + i % 5])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs) == by_hand(rows)


def test_hard_texts_and_extra_columns(spark):
    docs = spark.createDataFrame(HARD, DOCS)
    assert found(docs) == by_hand([(d, t) for d, t, *_ in HARD])
    clashing = with_clashes(docs, ["cls", "gone", "ranked", "row_key"])
    rows = line_dedup.deduplicate(clashing)
    assert rows.columns == clashing.columns and rows.count() == len(HARD)
    assert line_dedup.deduplicate(docs.limit(0)).count() == 0


@pytest.mark.parametrize("small", [2, 16, 128])
def test_rare_words_need_no_count_of_their_groups(spark, monkeypatch, small):
    """Lines meet at a word of few lines as they are: such keys don't reach the groups that are numbered and counted."""
    monkeypatch.setattr(line_dedup, "SMALL", small)
    taken, groups = [], line_dedup.keyed_groups
    monkeypatch.setattr(line_dedup, "keyed_groups", lambda sigs: taken.append(sigs) or groups(sigs))
    rows = []
    for i in range(40):
        own = [f"f{i // 4}w{k}" for k in range(15)] + [f"f{i // 20}c{k}" for k in range(5)]
        own[i % 4 * 3] = f"x{i}"
        rows.append((i, " ".join(own[i % 2 :]) + "\n" + " ".join(own[i % 3 : 12])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs) == by_hand(rows)
    left = {r.key for r in taken[0].where("n >= 4").collect()}
    assert all(not 2 < key >> 56 <= line_dedup.small_code() for key in left if key >= 0)
    assert bool(left) == (small == 2)
