"""Tiered reverse lookups and hierarchies of any depth, against loops in plain Python."""

import random
import re

import pytest

from quarry.functions import text as T
from quarry.operators import lookups


@pytest.mark.parametrize("path,prefix,episode", [
    ("/tv/The Pokémon Show (1999) [tvdb-1]/Season 01/x.mkv", "Pokemon", True), ("/tv/Bewitched (1964)/Bewitched - S05E17.mkv", "Bewitched", True),
    ("/m/Baki-Dou - Samurai/f.mkv", "Baki-Dou", False), ("/m/An  X/f.mkv", None, False), ("/m/(1787)/f.mkv", None, False), ("f.mkv", None, False),
    ("/m/a The Thing [x] (2011)/2x03.mkv", "The", True), ("\\m\\Up (2009)\\f.mkv", "Up", False), ("Season 1/f.mkv", "Season", False), (None, None, False),
])
def test_folder_prefixes(spark, path, prefix, episode):
    row = spark.createDataFrame([(path,)], "p string").select(T.folder_prefix(T.F.col("p")).alias("f")).first().f
    assert (row.prefix, row.episode) == (prefix, episode)


ROOTS = [("/lib/a", "A"), ("/lib/a/sub", "S"), ("/lib/b", "B")]


def _library(path):
    fits = [(len(r), k) for r, k in ROOTS if path == r or path.startswith(r + "/")]
    return max(fits)[1] if fits else None


def _looked_up(path, items, candidates):
    first = lambda rows: min(((t, i) for i, _, _, t in rows), default=(None, None))[1]
    same = [r for r in items if r[1] == path]
    if same:
        return first(same), "exact"
    library = _library(path)
    if library is None:
        return None, "no_library"
    shelf = [r for r in items if r[1] and _library(r[1]) == library]
    base, tail = path.split("/")[-1], "/".join(path.split("/")[-2:])
    ends = lambda rows: [r for r in rows if r[1].split("/")[-1] == base and r[1].endswith(tail)]
    folder = re.sub(r"\s*\([0-9]{4}\)\s*", " ", path.split("/")[-2]).strip()
    word = re.sub(r"(?i)^(?:the|a|an)\s+", "", folder).split(" ")[0]
    if len(word) >= 2:
        bare = lambda n: re.sub(r"(?i)^(?:the|a|an)\s+", "", n).lower()
        begin = [r for r in shelf if bare(r[2]).startswith(word.lower())]
        hit = first(ends(begin))
        if hit is not None:
            return hit, "prefix"
        if len({r[2].lower() for r in begin}) <= candidates:
            return None, "prefix_miss"
    hit = first(ends([r for r in shelf if r[2].lower() == base.rsplit(".", 1)[0].lower()]))
    if hit is not None:
        return hit, "search"
    hit = first(ends(shelf))
    return (hit, "enumerate") if hit is not None else (None, "miss")


@pytest.mark.parametrize("candidates", [2, 25])
def test_tiers_equal_the_loop(spark, candidates):
    rng = random.Random(candidates)
    words = ["Alpha One", "alphabet", "The Beta", "Gamma", "X", "ALPHA two", "Alp"]
    paths = lambda: rng.choice(["/lib/a", "/lib/a/sub", "/lib/b", "/other"]) + rng.choice(["", "/deep"]) + f"/{rng.choice(words)}{rng.choice(['', ' (1999)'])}/{rng.randrange(4)}.mkv"
    items = [(k, paths(), rng.choice(words + ["1", "2", "0"]), rng.randrange(1000)) for k in range(150)] + [(999, None, "x", 0), (998, "/lib/a/hot/h.mkv", "hot", 1), (997, "/lib/a/hot/h.mkv", "hot", 0)]
    wanted = [paths() for _ in range(250)] + ["/lib/a/z/hot/h.mkv", "/lib/a/xhot/h.mkv", "/lib/b/X/9.mkv"]
    found = lookups.tiered(
        spark.createDataFrame([(w,) for w in [*wanted, None, ""]], "path string"), spark.createDataFrame(items, "item int, path string, name string, turn int"),
        spark.createDataFrame(ROOTS, "root string, library string"), candidates,
    ).collect()
    assert {r.path: (r.item, r.tier) for r in found} == {w: _looked_up(w, items, candidates) for w in wanted} and len(found) == len(set(wanted))
    tiers = {r.tier for r in found}
    assert {"exact", "no_library", "prefix", "prefix_miss", "enumerate", "miss"} <= tiers


def test_hierarchies(spark):
    rows = [(1, None, "show"), (2, 1, "season"), (3, 2, "episode"), (4, 2, "episode"), (5, 1, "season"), (6, 5, "part"), (7, 6, "episode"), (8, None, "movie"),
            (10, 11, "loop"), (11, 10, "loop"), (12, 11, "episode"), (20, 21, "loop"), (21, 20, "loop"), (30, 30, "self"), (3, 5, "episode")]
    items = spark.createDataFrame(rows, "id int, parent int, kind string")
    asked = spark.createDataFrame([(i,) for i in (1, 2, 5, 3, 8, 10, 20, 30, 77, None, 1)], "id int")
    found = sorted(((r.asked, r.leaf) for r in lookups.leaves(items, asked).collect()), key=str)
    expected = [(1, 3), (1, 4), (1, 7), (2, 3), (2, 4), (5, 3), (5, 7), (3, 3), (8, 8), (10, 12), (20, 20), (30, 30), (77, 77), (None, None)]
    assert found == sorted(expected, key=str)
    chain = spark.createDataFrame([(k, k - 1, "c") for k in range(1, 12)], "id int, parent int, kind string")
    assert [r.leaf for r in lookups.leaves(chain, spark.createDataFrame([(0,)], "id int")).collect()] == [11]
    with pytest.raises(ValueError):
        lookups.leaves(chain, spark.createDataFrame([(0,)], "id int"), most=5)
