"""Mapping rules in any normal form and job rules, by literal cases."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from quarry.operators import jobs, paths

CAFE = "/mnt/café"
MAPPINGS = [("/data", CAFE, ("/hook", "/incoming/")), ("/data2/", "/", ()), ("", "/never", ("/x",))]


def _one(spark, text, column):
    return spark.createDataFrame([(text,)], "p string").select(column(F.col("p")).alias("v")).first().v


@pytest.mark.parametrize("path,local", [
    ("/data/a.mkv", CAFE + "/a.mkv"), ("/data", CAFE), ("/datax/a", "/datax/a"), ("\\hook\\s\\e.mkv ", CAFE + "/s/e.mkv"), ("/incoming//e.mkv", CAFE + "/e.mkv"),
    ("/data2/f", "/f"), ("/data2", "/"), ("/x/y", "/never/y"), ("/other", "/other"), (None, None), ("", ""),
])
def test_canonical(spark, path, local):
    assert _one(spark, path, lambda p: paths.canonical(p, MAPPINGS)) == local


def test_normal_forms_meet(spark):
    apart = unicodedata.normalize("NFD", CAFE)
    assert apart != CAFE
    assert _one(spark, apart + "/x", lambda p: paths.composed_under(p, CAFE)) and _one(spark, CAFE + "/x", lambda p: paths.composed_under(p, apart + "/"))
    assert not _one(spark, apart + "xx", lambda p: paths.composed_under(p, CAFE)) and not _one(spark, "/x", lambda p: paths.composed_under(p, ""))
    forms = _one(spark, apart + "/x", lambda p: paths.expanded(p, MAPPINGS))
    assert forms == [apart + "/x", "/data/x", "/hook/x", "/incoming/x"]
    assert _one(spark, "/hook/x", lambda p: paths.expanded(p, MAPPINGS)) == ["/hook/x", CAFE + "/x", "/data/x"]
    assert _one(spark, None, lambda p: paths.expanded(p, MAPPINGS)) == [] and _one(spark, " ", lambda p: paths.expanded(p, MAPPINGS)) == []
    assert _one(spark, "/a", lambda p: paths.expanded(p, [])) == ["/a"]


def test_owners_of_decomposed_paths(spark):
    roots = spark.createDataFrame([("s1", 1, unicodedata.normalize("NFD", CAFE))], "server string, ord int, root string").withColumn("root", paths.nfc(F.col("root")))
    table = spark.createDataFrame([(CAFE + "/x",), (unicodedata.normalize("NFD", CAFE) + "/y",)], "path string").select(paths.nfc(F.col("path")).alias("path"))
    assert {r.path for r in paths.owners(table, "path", roots, "server", ["ord"]).collect()} == {CAFE + "/x", CAFE + "/y"}


def test_scan_targets(spark):
    roots = spark.createDataFrame([("/data", "A"), ("/data/tv", "B"), (CAFE, "C")], "root string, library string")
    asked = spark.createDataFrame([("/hook/tv/Show/S1/e.mkv",), ("/data/film.mkv",), ("/nowhere/x",)], "path string")
    found = {(r.path, r.library, r.target) for r in paths.scan_targets(asked, "path", roots, MAPPINGS[:1]).collect()}
    assert found == {("/hook/tv/Show/S1/e.mkv", "C", CAFE + "/tv"), ("/hook/tv/Show/S1/e.mkv", "B", "/data/tv/Show"), ("/data/film.mkv", "A", "/data"), ("/data/film.mkv", "C", CAFE)}


def test_restarts(spark):
    rows = [("retry-1", "running", None, None, 90, 90), ("c", "running", True, None, None, 0), ("d", "completed", True, None, 0, 0), ("e", "pending", None, True, 99, 99), ("f", "running", None, None, None, 9_900),
            ("g", "running", None, None, 1, 9_900), ("h", "pending", None, None, None, 1), ("i", "pending", False, False, 9_990, 1), ("j", "failed", None, None, 1, 1), ("k", "running", None, None, None, None)]
    table = spark.createDataFrame(rows, "id string, status string, is_chain boolean, is_attempt boolean, started long, created long")
    found = {r.id: (r.state, r.action) for r in jobs.restarted(table, F.lit(10_000), 1).collect()}  # an age of a minute counts as five
    assert found == {"c": ("pending", "chain"), "d": ("completed", "kept"), "e": ("failed", "interrupted"), "f": ("pending", "revived"), "g": ("failed", "interrupted"),
                     "h": ("pending", "stale"), "i": ("pending", "revived"), "j": ("failed", "kept"), "k": ("failed", "interrupted")}


def test_chains_and_children(spark):
    chains = spark.createDataFrame([("a", 0), ("b", 90_000), ("c", None), ("d", 99_000)], "id string, started long")
    children = spark.createDataFrame([("a", "running"), ("b", "pending"), ("b", "running"), ("d", "failed")], "parent string, status string")
    assert {r.id: r.fate for r in jobs.resumed(chains, children, F.lit(100_000)).collect()} == {"a": "expired", "b": "revived", "c": "orphaned", "d": "orphaned"}
    rows = [("x", True, "p", True, "p", 2, 5), ("y", None, "p", True, "p", 1, 9), ("z", True, "p", None, "q", None, 1), ("w", True, None, False, "p", 1, 1), ("v", True, "p", True, "q", 1, 8)]
    table = spark.createDataFrame(rows, "id string, is_retry boolean, parent_job string, is_retry_attempt boolean, parent_chain string, attempt int, created long")
    found = sorted((r.parent, r.nth, r.child) for r in jobs.children_of(table).collect())
    assert found == [("p", 1, "z"), ("p", 2, "v"), ("p", 3, "y"), ("p", 4, "x"), ("q", 1, "v")]


def test_migrations_run_in_order(spark):
    table = spark.createDataFrame([(1, None, "a"), (2, 2, "b"), (3, 9, "c")], "id int, version int, name string")
    steps = [lambda r: {"name": F.upper("name")}, lambda r: {"label": F.concat("name", F.lit("!"))}, lambda r: {"name": F.col("label"), "label": F.lit("x")}]
    found = {r.id: (r.version, r.name, r.label) for r in jobs.migrated(table, "version", steps).collect()}
    assert found == {1: (4, "A!", "x"), 2: (4, "b!", "x"), 3: (9, "c", None)}


def test_reasons_and_imports(spark):
    rows = spark.createDataFrame([(["b", "a"],), (["x"],), ([],), (None,), (["b", None],)], "l array<string>")
    rules = [("first", "^a", F.lit(True)), ("never", None, F.lit(False)), ("second", "^b", F.lit(True)), ("empty", None, F.size("l") == 0)]
    assert [r.v for r in rows.select(jobs.first_reason(F.col("l"), rules).alias("v")).collect()] == ["first", None, "empty", None, "second"]
    target = spark.createDataFrame([(5,)], "id int")
    lines = spark.createDataFrame([(1, None), (2, "bad")], "id int, _corrupt string")
    assert [r.id for r in jobs.imported_once(target.limit(0), lines).collect()] == [1] and [r.id for r in jobs.imported_once(target, lines).collect()] == [5]


def test_folder_files(spark):
    files = spark.createDataFrame([("/m/a/x.MKV",), ("/m/a/b/y.mp4",), ("/m/a/n.txt",), ("/m/empty/n.txt",), ("/m/a/x.MKV",), (None,)], "file string")
    asked = spark.createDataFrame([("/m/a",), ("/m/empty",), ("/m/a/x.MKV",), ("/none",), ("/m",), (None,), ("",), ("/m/a",)], "asked string")
    found = sorted((r.asked, r.file) for r in paths.folder_files(asked, files, ("mkv", "mp4")).collect())
    assert found == [("/m", "/m/a/b/y.mp4"), ("/m", "/m/a/x.MKV"), ("/m/a", "/m/a/b/y.mp4"), ("/m/a", "/m/a/x.MKV"), ("/m/a/x.MKV", "/m/a/x.MKV"), ("/m/empty", "/m/empty"), ("/none", "/none")]
