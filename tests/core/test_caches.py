"""Hits of a cache by order of use against a simulated dictionary."""

import random
from collections import OrderedDict

import pytest

from quarry.operators import caches


def _simulated(rows, entries, most, ttl, drift):
    """The cache itself: entries with the time they were made, trimmed after each that is put."""
    cache, seen, out = OrderedDict(), {}, []
    for place, key, at, size, version in rows:
        hit = False
        if key in cache:
            made, _ = cache[key]
            hit = at - made <= ttl and not (version is not None and seen[key] is not None and abs(version - seen[key]) > drift)
        if hit:
            cache[key] = (cache.pop(key)[0], size)
        else:
            cache.pop(key, None)
            cache[key] = (at, size)
            while len(cache) > entries:
                cache.popitem(last=False)
            while sum(s for _, s in cache.values()) > most and len(cache) > 1:
                cache.popitem(last=False)
        seen[key] = version
        out.append((place, hit))
    return out


@pytest.mark.parametrize("entries,most,ttl,block,group", [(5, 10**9, 10**9, 16, 3), (12, 60, 10**9, 7, 2), (20, 90, 40, 64, 4), (3, 5, 25, 4096, 256)])
def test_hits_equal_the_simulated_cache(spark, entries, most, ttl, block, group):
    rng = random.Random(entries)
    sizes = {f"k{k}": rng.randint(1, 12) for k in range(40)}
    rows, at = [], 0
    for place in range(1, 700):
        at += rng.choice([0, 1, 1, 3])
        key = rng.choice(list(sizes)) if rng.random() < 0.5 else f"k{rng.randrange(6)}"
        version = rng.choice([None, 1.0, 1.5, 1.9]) if rng.random() > 0.05 else 9.0
        rows.append((place, key, at, sizes[key], version))
    table = spark.createDataFrame(rows, "n int, k string, t int, s int, v double").repartition(4)
    found = caches.accesses(table, ["n"], "k", "t", "s", "v", entries, most, ttl, 1.0, block, group).collect()
    assert sorted((r.place, r.hit) for r in found) == _simulated(rows, entries, most, ttl, 1.0)


def test_nulls_repeats_and_nothing(spark):
    rows = [(1, None, 5, None), (2, None, 6, 3), (3, "a", 7, 10**9), (3, "a", 7, 10**9), (4, None, 8, 1)]
    table = spark.createDataFrame(rows, "n int, k string, t int, s int")
    found = caches.accesses(table, ["n"], "k", "t", "s", entries=2, most_bytes=50).collect()
    assert [r.hit for r in sorted(found, key=lambda r: r.place)] == [False, True, False, True, False]
    assert caches.accesses(table.where("n > 9"), ["n"], "k", "t", "s").count() == 0
