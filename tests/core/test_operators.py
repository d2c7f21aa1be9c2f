"""Reference-shaped operators on hand-made rows, and every query against its SQL on the small tables."""

import datetime as dt
import json
import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quarry.functions import text as T
from quarry.operators import chains, folds, logs, paths, scopes, search
from quarry.plans import registry
from quarry.sources import frame_index
from quarry.sources.paged import PagedSource
from quarry.streaming import webhooks


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for file in Path(sf).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    result = duck.sql(registry.oracle_sql()[name])
    assert sorted(result.columns) == columns
    places = [result.columns.index(c) for c in columns]
    assert rows == sorted(repr(tuple(plain(r[i]) for i in places)) for r in result.fetchall())


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(registry.queries()) <= set(__spark_entry__.queries())


def test_ttl_counts_from_the_last_accepted(spark):
    rows = spark.createDataFrame([(1, t) for t in (0, 50, 99, 100, 150, 199, 230)], "k int, t long")
    assert sorted(r["at"] for r in chains.ttl_taken(rows, ["k"], F.col("t"), 100).collect()) == [0, 100, 230]


def test_overlap_dedup_is_not_transitive(spark):
    rows = spark.createDataFrame(
        [(1, 1, "a", ["x"]), (1, 2, "b", ["x", "y"]), (1, 3, "c", ["y"]), (1, 4, "d", ["z"])], "g int, o int, item string, places array<string>"
    )
    assert folds.disjoint_first(rows, "g", "item", "o", "places").first().kept == ["a", "c", "d"]


def test_years_merge_in_order_and_fill_late(spark):
    rows = spark.createDataFrame([("k", 1, None, 1), ("k", 2, 1999, 2), ("k", 3, 2001, 3), ("k", 4, None, 4)], "k string, o int, year int, item long")
    found = {(r.year, tuple(r["items"])) for r in folds.merged_by_year(rows, ["k"], "o", "year", "item").collect()}
    assert found == {(1999, (1, 2, 4)), (2001, (3,))}


def test_three_policies_over_one_log(spark):
    rows = spark.createDataFrame([("p", 1, "exists"), ("p", 2, "failed"), ("p", 3, "published"), ("q", 4, "odd")], "path string, seq int, status string")
    order = ["published", "exists", "failed"]
    one = lambda df: {r.path: r.status for r in df.collect()}
    assert one(logs.last_wins(rows, ["path"], ["seq"])) == {"p": "published", "q": "odd"}
    assert one(logs.first_wins(rows, ["path"], ["seq"])) == {"p": "exists", "q": "odd"}
    assert one(logs.best_wins(rows.where("seq < 3"), ["path"], logs.rank_of(F.col("status"), order), ["seq"])) == {"p": "exists"}


@pytest.mark.parametrize(
    "raw, title, season, episode",
    [
        ("Some.Show.S02E05.1080p.WEB", "some show", 2, 5),
        ("some show 3x07", "some show", 3, 7),
        ("other_show.s001e0010.HDTV.x264-GRP", "other show", 1, 10),
        ("show s01e02 the return 720p", "show the return", 1, 2),
        ("The Thing (1982)", "the thing (1982)", None, None),
        ("Thing (1982) [1080p]", "thing (1982)", None, None),
        ("Web Therapy", "web therapy", None, None),
        ("A Film 2160p x265", "a film", None, None),
        ("Spider-Man 5.1", "spider man 5 1", None, None),
        ("tv2x07b", "tv2x07b", None, None),
        ("Film extended yify", "film", None, None),
        ("WALLE", "", None, None),
        ("   ", "", None, None),
        ("", "", None, None),
        (None, "", None, None),
    ],
)
def test_search_strings(spark, raw, title, season, episode):
    q = spark.createDataFrame([(raw,)], "raw string").select(T.parsed_query(F.col("raw")).alias("q")).first().q
    assert (q.title, q.season, q.episode) == (title, season, episode)
    assert q.tokens == title.lower().split()


@pytest.mark.parametrize(
    "path, title",
    [
        ("/tv/A Show (2001) - S01E02 - Pilot [x264].mkv", "A Show S01E02"),
        ("/tv/Show.Name.S01E02.720p.mkv", "Show.Name S01E02"),
        ("/films/A Film (1999) [1080p].mkv", "A Film (1999)"),
        ("/films/Plain Name.mkv", "Plain Name"),
        ("noextension", "noextension"),
    ],
)
def test_clean_titles(spark, path, title):
    assert spark.range(1).select(T.clean_title(F.lit(path)).alias("t")).first().t == title


@pytest.mark.parametrize(
    "text, parts",
    [("2.0.0", (2, 0, 0)), ("v2.1.2", (2, 1, 2)), ("2.1.1.post14", (2, 1, 1)), ("2.3.1.dev5+g12ab", (2, 3, 1)), ("0.0.0+unknown", (0, 0, 0)),
     ("1.2.3-rc.1", (1, 2, 3)), ("v1.2", None), ("2", None), ("dev", None), ("1.2.3.4", None), (None, None)],
)
def test_versions(spark, text, parts):
    found = spark.createDataFrame([(text,)], "v string").select(T.version(F.col("v")).alias("v")).first().v
    assert (found and tuple(found)) == parts


def test_priorities_and_short_titles(spark):
    rows = spark.createDataFrame([("HIGH", None), ("low", None), (" high ", None), ("1", None), (None, 3), (None, 7), ("x", None)], "label string, number int")
    assert [r.p for r in rows.select(T.priority(F.col("label"), F.col("number")).alias("p")).collect()] == [1, 3, 2, 2, 3, 2, 2]
    short = lambda t, w, kind: spark.range(1).select(T.shortened(F.lit(t), w, F.lit(kind)).alias("s")).first().s
    assert short("A Long Show Name S01E02", 16, "episode") == "A Long ...S01E02"
    assert short("A Long Show Name S01E02", 8, "episode") == "...S01E02"
    assert short("A Film With A Long Name", 12, "movie") == "A Film Wi..."
    assert short("Short", 8, "movie") == "Short   "


def test_normal_forms(spark):
    row = spark.range(1).select(
        (T.composed(F.lit("/m/Cafe\u0301")) == F.lit("/m/Caf\u00e9")).alias("same"), T.title_prefix(F.lit("The \u00c9tude (1990) [x]")).alias("prefix"),
        paths.under(paths.nfc(F.lit("/m/Cafe\u0301/x.mkv")), "/m/Caf\u00e9").alias("below"),
    ).first()
    assert row.same and row.prefix == "Etude" and row.below


def test_progress_line(spark):
    line = "frame= 120 fps= 30 q=-1.0 size= 2048kB time=00:01:02.50 bitrate= 268.4kbits/s dup=1 drop=2 speed=2.5x elapsed=0:00:25"
    p = spark.range(1).select(T.progress(F.lit(line)).alias("p"), T.percent(F.lit(62.5), F.lit(125.0)).alias("percent")).first()
    assert (p.p.frame, p.p.fps, p.p.q, p.p.size_kb, p.p.seconds, p.p.bitrate, p.p.dup, p.p["drop"], p.p.speed) == (120, 30.0, -1.0, 2048, 62.5, 268.4, 1, 2, 2.5)
    assert p.percent == 50.0
    assert spark.range(1).select(T.progress(F.lit("nothing")).alias("p")).first().p.speed is None


def test_quiet_windows(spark):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 5, 23, 0),), (dt.datetime(2024, 1, 6, 5, 0),), (dt.datetime(2024, 1, 7, 5, 0),), (dt.datetime(2024, 1, 8, 12, 30),)], "at timestamp")
    windows = [("22:30", "06:30", ("fri", "sat")), ("12:00", "13:00", ("odd",)), ("5:00", "5:00", ())]
    assert [r.q for r in rows.select(T.in_any_window(F.col("at"), windows).alias("q")).collect()] == [True, True, False, True]


@pytest.mark.parametrize(
    "parts, wanted",
    [
        ([("aa", "/v/4k/D/D.mkv"), ("bb", "/v/hd/D/D.mkv")], "bb"),
        ([("", "/v/hd/D/D.mkv"), ("bb", "/v/4k/D/D.mkv")], None),
        ([("aa", "/x/D.mkv"), ("bb", "/y/D.mkv"), ("cc", "/z/E.mkv")], "aa"),
        ([("a", "/x/E.mkv"), ("cc", "/y/F.mkv")], "cc"),
        ([("", "/x/E.mkv")], None),
    ],
)
def test_part_hashes(spark, parts, wanted):
    rows = spark.createDataFrame([(1, i, d, p, "/mnt/hd/D/D.mkv") for i, (d, p) in enumerate(parts)], "item int, ord int, digest string, path string, target string")
    assert scopes.part_hash(rows, "item", "ord", "digest", "path", "target").first().digest == wanted


def test_mismatches(spark):
    roots = [("a", "/media/tv"), ("b", "/films")]
    maps = {"a": [("/media", "/local", ("/data/media",))], "b": [("/media", "/x", ("/other/media",))]}
    rows = spark.createDataFrame([(p,) for p in ("/data/media/tv/x.mkv", "/other/Media/TV/x", "/away/media/tv/x", "/data/media/tv2/x", "/media/tv/x")], "p string")
    found = rows.select(scopes.mismatch_class(F.col("p"), roots, maps).alias("c"), scopes.inferred_prefixes(F.col("p"), [r for _, r in roots]).alias("i")).collect()
    assert [r.c for r in found] == ["covered", "elsewhere", "mismatch", "unknown", "unknown"]
    assert (found[0].i.sender, found[0].i.server) == ("/data/media", "/media")


def test_scatter_gather_merges_and_orders(spark):
    schema = "server string, rank long, kind string, title string, year int, paths array<string>, child_count int"
    one = lambda: spark.createDataFrame([("a", 1, "episode", "Ben 10 S01E01", None, ["/e"], None), ("a", 2, "show", "Ben 10", 2005, ["/p"], None), ("a", 3, "movie", "It", 1990, ["/i"], None)], schema)
    two = lambda: spark.createDataFrame([("b", 1, "show", "ben-10", None, ["/q", "/p"], 12), ("b", 2, "movie", "It", 2017, ["/j"], None), ("b", 3, "movie", "None", None, [], None)], schema)

    def down():
        raise ConnectionError

    rows = search.merged(search.gathered(spark, [("a", one), ("x", down), ("b", two)]))
    plain_rows = [(r.kind, r.title, r.year, r.paths, r.child_count, r.servers) for r in search.answer(rows, "ben 10").collect()]
    assert plain_rows == [("show", "Ben 10", 2005, ["/p", "/q"], 12, ["a", "b"]), ("movie", "It", 1990, ["/i"], None, ["a"]), ("movie", "It", 2017, ["/j"], None, ["b"])]
    assert [r.kind for r in search.answer(rows, "ben 10 s01e01").collect()] == ["show", "movie", "movie", "episode"]
    assert search.gathered(spark, [("x", down)]).count() == 0


def test_places_over_the_whole_table(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), "id").repartition(5)
    found = {r.id: r.place for r in logs.placed(rows, [F.when(F.col("k") > 10, F.col("k")), F.col("id")], "place").collect()}
    wanted = sorted(range(1000), key=lambda i: ((i * 7919) % 1000 <= 10, (i * 7919) % 1000 if (i * 7919) % 1000 > 10 else 0, i))
    assert found == {i: n + 1 for n, i in enumerate(wanted)}


def test_previous_over_block_edges(spark):
    rows = spark.createDataFrame([("k", i, str(i * i)) for i in (1, 5, 9, 40, 41, 100)] + [("j", 7, "x")], "key string, at long, v string")
    found = {(r.key, r["at"]): r.previous for r in logs.with_previous(rows, "key", "at", "v", block=10).collect()}
    assert found == {("k", 1): None, ("k", 5): "1", ("k", 9): "25", ("k", 40): "81", ("k", 41): "1600", ("k", 100): "1681", ("j", 7): None}


def test_rank_tiers(spark):
    def score(name, raw, halved=False):
        q = T.parsed_query(F.lit(raw))
        return spark.range(1).select(T.rank_score(F.lit(name), q.title, q.tokens, F.lit(halved)).alias("s")).first().s

    assert [score(n, "blue moon") for n in ("Blue Moon", "Blue Moon Rising", "Moon, so blue", "Blue sky", "Red")] == [1.0, 0.8, 0.5, 0.2, 0.0]
    assert score("Moon, so blue", "blue moon", True) == 0.25


def test_small_functions(spark):
    row = spark.range(1).select(
        T.in_window(F.lit(60), F.lit(1320), F.lit(360)).alias("inside"),
        T.in_window(F.lit(60), F.lit(60), F.lit(60)).alias("off"),
        T.minutes(F.lit("25:00")).alias("no_time"),
        T.backoff(F.lit(9), F.lit(1)).alias("wait"),
        T.eta(F.lit(3700)).alias("eta"),
    ).first()
    assert row.inside and not row.off and row.no_time is None and row.wait == 3600 and row.eta == "1h 1m"


def test_paths(spark):
    c = F.lit
    row = spark.range(1).select(
        paths.normalised(c("\\\\media\\\\films\\\\")).alias("n"),
        paths.collapsed(c("/a/./b/../../c/d")).alias("c"),
        paths.under(c("/media/films-old/x"), "/media/films").alias("sibling"),
        paths.rewritten(c("/data/x.mkv"), [("/data", "/mnt"), ("/", "/root")]).alias("r"),
        paths.candidates(c("/mnt/x"), [("/data", "/mnt")]).alias("both"),
        paths.excluded(c("/a/b"), [("([", "regex"), ("/a/", "path")]).alias("gone"),
        paths.common_suffix(c("/x/b/c.mkv"), c("/y/a/b/c.mkv")).alias("suffix"),
    ).first()
    assert (row.n, row.c, row.sibling, row.r, row.both, row.gone, row.suffix) == (
        "/media/films", "/c/d", False, "/mnt/x.mkv", ["/mnt/x", "/data/x"], True, 2,
    )


def test_one_owner_per_server(spark):
    roots = spark.createDataFrame(
        [("s1", 1, "/m"), ("s1", 2, "/m/films"), ("s2", 1, "/m/films"), ("s3", 1, "/m/film")], "server string, ord int, root string"
    )
    found = paths.owners(spark.createDataFrame([("/m/films/x.mkv",)], "path string"), "path", roots, "server", ["ord"]).collect()
    assert {(r.server, r.root) for r in found} == {("s1", "/m"), ("s2", "/m/films")}


def test_frame_container_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2, bytearray(b"yy")), ("a", 1, bytearray(b"x")), ("b", 1, bytearray(b""))], "key string, n int, body binary")
    files = frame_index.written_files(rows, "key", "n", "body", 5000)
    for r in files.collect():
        (tmp_path / f"{r.key}.bin").write_bytes(r.content)
    (tmp_path / "bad.bin").write_bytes(b"no container" * 20)
    (tmp_path / "short.bin").write_bytes(b"\x89BIF\r\n\x1a\n")
    read = spark.read.format("binaryFile").load(str(tmp_path / "*.bin")).select("path", "content")
    indexed = frame_index.read_index(read)
    assert {r.interval_ms for r in indexed.collect()} == {5000} and indexed.count() == 2
    found = {(r.path[-5], r.frame, bytes(r.body)) for r in frame_index.frames(indexed, ["path"]).collect()}
    assert found == {("a", 0, b"x"), ("a", 1, b"yy"), ("b", 0, b"")}


def test_paged_source(spark, tmp_path):
    spark.dataSource.register(PagedSource)
    read = lambda: spark.read.format("quarry_pages").option("path", str(tmp_path)).load()
    assert read().count() == 0
    for n in range(3):
        (tmp_path / f"page-{n}.json").write_text("\n".join(json.dumps({"id": 10 * n + i, "title": f"t{i}"}) for i in range(4)))
    assert sorted(r.id for r in read().collect()) == [10 * n + i for n in range(3) for i in range(4)]


def _stream(spark, folder, rows):
    rows.write.mode("append").json(str(folder))
    return spark.readStream.schema(rows.schema).json(str(folder))


def test_streamed_ttl_equals_the_batch_fold(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("k", day + dt.timedelta(seconds=s), s) for s in (0, 50, 99, 100, 150, 230)], "key string, at timestamp, n int").coalesce(1)
    taken = webhooks.accepted(_stream(spark, tmp_path / "in", rows), ["key"], "at", 100)
    run = taken.writeStream.format("memory").queryName("taken").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(r.n for r in spark.table("taken").collect()) == [0, 100, 230]


def test_streamed_ttl_over_micro_batches(spark, tmp_path):
    """A slow stream of one file a micro-batch takes the same events as the fold over all of them."""
    day, times = dt.datetime(2024, 1, 1), [0, 50, 99, 100, 150, 199, 230, 1000, 1050, 1101]
    for i, s in enumerate(times):
        row = spark.createDataFrame([("k", day + dt.timedelta(seconds=s), s)], "key string, at timestamp, n int").coalesce(1)
        row.write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(row.schema).option("maxFilesPerTrigger", 3).json(str(tmp_path / "in"))
    taken = webhooks.accepted(stream, ["key"], "at", 100, "1 hour")
    run = taken.writeStream.format("memory").queryName("slow").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(180)
    rows = spark.read.schema(row.schema).json(str(tmp_path / "in"))
    fold = sorted(r["at"] for r in chains.ttl_taken(rows, ["key"], F.col("n"), 100).collect())
    assert sorted(r.n for r in spark.table("slow").collect()) == fold == [0, 100, 230, 1000, 1101]


def test_streamed_ttl_keeps_its_keys_in_few_states(spark, tmp_path):
    """Keys with nulls, numbers beyond 2^53, and equal texts of different columns; the states don't grow with the keys."""
    day, pick, events = dt.datetime(2024, 1, 1), random.Random(3), []
    names = [(None if i % 7 == 0 else 2**60 + i, [None, "", "a", "null"][i % 4]) for i in range(200)]
    for name in names:
        events += [(*name, day + dt.timedelta(seconds=pick.randrange(2000)), pick.choice([None, 2**61 + i])) for i in range(pick.randrange(1, 12))]
    # the second batch lies behind the first, so nothing is late
    cut = day + dt.timedelta(seconds=1000)
    schema = "k long, name string, at timestamp, n long"
    for part in ([e for e in events if e[2] < cut], [e for e in events if e[2] >= cut]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    taken = webhooks.accepted(stream, ["k", "name"], "at", 100, "1 hour", groups=4)
    run = taken.writeStream.format("memory").queryName("few_states").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(180)
    last, want = {}, []
    for e in sorted(events, key=lambda e: e[2]):
        if e[:2] not in last or (e[2] - last[e[:2]]).total_seconds() >= 100:
            last[e[:2]] = e[2]
            want.append(e[:3])
    found = [tuple(r) for r in spark.table("few_states").collect()]
    assert sorted(map(str, (r[:3] for r in found))) == sorted(map(str, want))
    assert set(found) <= set(events)
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]) <= 4 * 4


def test_streamed_batches(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    times = [(0, "b"), (40, "a"), (90, "b"), (300, "c"), (9000, "z")]
    rows = spark.createDataFrame([("k", day + dt.timedelta(seconds=s), p) for s, p in times], "key string, at timestamp, path string").coalesce(1)
    made = webhooks.debounced(_stream(spark, tmp_path / "in", rows), ["key"], "at", "path", "60 seconds", "10 seconds")
    run = made.writeStream.format("memory").queryName("made").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(r["items"] for r in spark.table("made").collect()) == [["a", "b"], ["c"]]


def test_streamed_upserts(spark, tmp_path):
    rows = spark.createDataFrame([(1, "t1", "new", 1), (1, "t2", "done", 2), (2, "t1", "new", 1)], "id int, created string, status string, seq int").coalesce(1)
    write = webhooks.upserting(str(tmp_path / "table"), "id", "created", ["seq"])
    run = _stream(spark, tmp_path / "in", rows).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    read = lambda: {(r.id, r.created, r.status) for r in webhooks.upserted(spark, str(tmp_path / "table")).collect()}
    assert read() == {(1, "t1", "done"), (2, "t1", "new")}
    for n in (1, 1, 2):  # a micro-batch that runs again changes nothing
        write(spark.createDataFrame([(2, f"t{n}", f"s{n}", 10 + n)], rows.schema), n)
    assert read() == {(1, "t1", "done"), (2, "t1", "s2")}
