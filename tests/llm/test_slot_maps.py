"""The stored slot map over a corpus that grows, and over an empty one."""

from collections import defaultdict

import pytest

from quarry.llm import sharding


def _docs(spark, ids):
    return spark.createDataFrame([(i, "x" * (i % 50)) for i in ids], "doc_id long, text string")


def _gapless(rows):
    places = defaultdict(list)
    for r in rows:
        places[r.shard].append(r.slot)
    return all(sorted(p) == list(range(len(p))) for p in places.values())


def test_a_grown_corpus_keeps_its_shards(spark, tmp_path):
    path = str(tmp_path / "map")
    first = sharding.shard(_docs(spark, range(150)), 6, slots=512, map_path=path).collect()
    grown = sharding.shard(_docs(spark, range(200)), 6, slots=512, map_path=path).collect()
    assert len(first) == 150 and len(grown) == 200 and _gapless(first) and _gapless(grown)
    before = {r.doc_id: r.shard for r in first}
    assert all(r.shard == before[r.doc_id] for r in grown if r.doc_id in before)


def test_the_latest_version_decides(spark, tmp_path):
    path = str(tmp_path / "map")
    sharding.shard(_docs(spark, range(300)), 3, slots=256, map_path=path)
    sharding.rebalance(spark, path, 5)
    rows = sharding.shard(_docs(spark, range(400)), 3, slots=64, map_path=path).collect()
    assert {r.shard for r in rows} == set(range(5)) and _gapless(rows) and max(r.virtual_slot for r in rows) > 64


def test_map_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "map")
    assert sharding.shard(_docs(spark, []), 2, slots=64, map_path=path).count() == 0
    edited = sharding.rebalance(spark, path, 4).collect()
    counts = defaultdict(int)
    for r in edited:
        counts[r.shard] += 1
    assert len(edited) == 64 and set(counts.values()) == {16}
    rows = sharding.shard(_docs(spark, range(100)), 2, map_path=path).collect()
    assert len(rows) == 100 and _gapless(rows)


def test_no_map(spark, tmp_path):
    with pytest.raises(ValueError):
        sharding.rebalance(spark, str(tmp_path / "none"), 4)
