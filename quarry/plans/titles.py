"""Queries over titles, search strings, times, journals and the frame container.

Release names are made from part names, so the SQL knows the title that has to come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import folds, logs, paths, search
from quarry.plans.catalogue import PATHS_SQL, page_paths
from quarry.sources import frame_index
from quarry.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def register(function):
        QUERIES[name], ORACLES[name] = function, sql
        return function

    return register


def releases(spark, sf_dir) -> DataFrame:
    """p_partkey, p_name, raw: a dotted release name, with an episode code for two in three."""
    key = F.col("p_partkey")
    s, e = (key % 9 + 1).cast("int"), (key % 20 + 1).cast("int")
    code = F.when(key % 3 == 0, T.episode_code(s, e)).when(key % 3 == 1, F.format_string("%dx%02d", s, e))
    raw = F.concat_ws(".", F.replace("p_name", F.lit(" "), F.lit(".")), code, F.lit("1080p.WEB"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", raw.alias("raw"))


@query("x1_search_query", """SELECT p_partkey, lower(p_name) AS title, CASE WHEN p_partkey % 3 <> 2 THEN (p_partkey % 9 + 1)::INT END AS season,
    CASE WHEN p_partkey % 3 <> 2 THEN (p_partkey % 20 + 1)::INT END AS episode, string_split(lower(p_name), ' ') AS tokens FROM part""")
def search_query(spark, sf_dir):
    """X1 and X2."""
    q = T.parsed_query(F.col("raw"))
    return releases(spark, sf_dir).select("p_partkey", q.alias("q")).select("p_partkey", "q.*")


@query("x3_rank_score", """SELECT p_partkey, (CASE WHEN lower(p_name) = 'th in' THEN 1.0 WHEN starts_with(lower(p_name), 'th in') THEN 0.8
    WHEN contains(lower(p_name), 'th') AND contains(lower(p_name), 'in') THEN 0.5 WHEN contains(lower(p_name), 'th') OR contains(lower(p_name), 'in') THEN 0.2 ELSE 0.0 END
    * CASE WHEN p_size > 25 THEN 0.5 ELSE 1.0 END)::DOUBLE AS score FROM part""")
def rank_score(spark, sf_dir):
    q = search.parsed(spark, "th in")
    score = T.rank_score(F.col("p_name"), F.lit(q.title), list(q.tokens), F.col("p_size") > 25)
    return table(spark, sf_dir, "part").select("p_partkey", score.alias("score"))


@query("x4_clean_title", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || printf(' S%02dE%02d', p_partkey % 9 + 1, p_partkey % 20 + 1) WHEN p_partkey % 3 = 1 THEN p_name || ' (1999)' ELSE p_name END AS title FROM part""")
def clean_title(spark, sf_dir):
    """An episode with its year before the mark, a film with tags after its year, and a name with neither."""
    key = F.col("p_partkey")
    mark = T.episode_code((key % 9 + 1).cast("int"), (key % 20 + 1).cast("int"))
    rest = F.when(key % 3 == 0, F.concat(F.lit(" (2001) - "), mark, F.lit(" - Pilot [x264]"))).when(key % 3 == 1, " (1999) [1080p]").otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", T.clean_title(F.concat(F.lit("/tv/x/"), "p_name", rest, F.lit(".mkv"))).alias("title"))


@query("x6_title_prefix", r"""SELECT p_partkey, CASE WHEN len(w) >= 2 THEN w END AS prefix FROM (
    SELECT p_partkey, regexp_extract(strip_accents(regexp_replace(f, '(?i)^(the|a|an)\s+', '')), '^(\S+)', 1) AS w FROM (
    SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'The ' ELSE '' END || CASE WHEN p_partkey % 7 = 0 THEN 'É ' WHEN p_partkey % 5 = 0 THEN 'É-' ELSE '' END || p_name AS f FROM part))""")
def title_prefix(spark, sf_dir):
    """The first word of the folder that names a file, without years, tags, article and accents."""
    article = F.when(F.col("p_partkey") % 2 == 0, "The ").otherwise("")
    accent = F.when(F.col("p_partkey") % 7 == 0, "É ").when(F.col("p_partkey") % 5 == 0, "É-").otherwise("")
    folder = F.concat(F.lit("/tv/"), article, accent, F.col("p_name"), F.lit(" (1787) [tag]"))
    path = F.concat(folder, F.when(F.col("p_partkey") % 3 == 0, "/Season 01/e.mkv").otherwise("/e.mkv"))
    return table(spark, sf_dir, "part").select("p_partkey", T.folder_prefix(path)["prefix"].alias("prefix"))


@query("x8_season_only", "SELECT p_partkey, (p_partkey % 12)::INT AS season FROM part WHERE p_partkey % 2 = 0")
def season_only(spark, sf_dir):
    """A season without an episode counts too."""
    raw = F.when(F.col("p_partkey") % 2 == 0, F.format_string("Show S%02d", F.col("p_partkey") % 12)).otherwise("Show")
    found = F.nullif(F.regexp_extract(raw, r"(?i)\bs(\d{1,2})(?:e\d+)?\b", 1), F.lit("")).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("season")).where("season IS NOT NULL")


@query("x9_collapsed_path", f"WITH {PATHS_SQL} SELECT page_id, path || '/x' AS path FROM p")
def collapsed_path(spark, sf_dir):
    """``.`` and ``..`` go; the SQL knows the path they were put into."""
    messy = F.concat("path", F.lit("/./a/../x/y/.."))
    return page_paths(spark, sf_dir).select("page_id", paths.collapsed(messy).alias("path"))


@query("x10_slash_normalise", f"WITH {PATHS_SQL} SELECT page_id, path FROM p")
def slash_normalise(spark, sf_dir):
    windows = F.concat(F.replace("path", F.lit("/"), F.lit("\\")), F.lit("\\"))
    return page_paths(spark, sf_dir).select("page_id", paths.normalised(windows).alias("path"))


@query("x12_short_title", """SELECT p_partkey, rpad(CASE WHEN len(p_name) <= 12 THEN p_name WHEN p_partkey % 2 = 0 THEN trim(p_name[:len(p_name) - 6])[1:3] || '...' || right(p_name, 6) ELSE p_name[1:9] || '...' END,
    12, ' ') AS title FROM part""")
def short_title(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.shortened(F.col("p_name"), 12, F.when(F.col("p_partkey") % 2 == 0, "episode").otherwise("movie")).alias("title"))


@query("x13_versions", """SELECT p_partkey FROM part WHERE p_partkey % 7 <> 0 AND (p_partkey % 3, p_partkey % 15, 4) >= (1, 9, 0)""")
def versions(spark, sf_dir):
    """Versions compare by their parts, not as text; what isn't one never passes."""
    raw = F.when(F.col("p_partkey") % 7 == 0, "9.9").otherwise(F.format_string("v%d.%d.4.post7+local", F.col("p_partkey") % 3, F.col("p_partkey") % 15))
    least = F.struct(F.lit(1).alias("major"), F.lit(9).alias("minor"), F.lit(0).alias("patch"))
    return table(spark, sf_dir, "part").where(T.version(raw) >= least).select("p_partkey")


@query("x14_progress_line", """SELECT event_id, event_id AS frame, round(value, 2) AS speed, CASE WHEN round(value, 2) > 0 THEN round((1000 - event_id % 1000) / round(value, 2), 3) END AS remaining FROM events""")
def progress_line(spark, sf_dir):
    """Numbers out of a progress line, and the time that is left."""
    shown = F.format_string("%.2f", F.abs("value"))
    line = F.concat(F.lit("frame= "), "event_id", F.lit(" fps=1 speed="), F.when(F.col("value") < 0, "-").otherwise(""), shown, F.lit("x"))
    rows = table(spark, sf_dir, "events").select("event_id", line.alias("line"))
    frame = F.regexp_extract("line", r"frame=\s*(\d+)", 1).cast("long")
    speed = F.regexp_extract("line", r"speed=\s*(-?[0-9.]+)x", 1).cast("double")
    left = F.when(speed > 0, F.round((1000 - F.col("event_id") % 1000) / speed, 3))
    return rows.select("event_id", frame.alias("frame"), speed.alias("speed"), left.alias("remaining"))


@query("x15_eta", """SELECT doc_id, CASE WHEN n_chars < 60 THEN n_chars || 's' WHEN n_chars < 3600 THEN n_chars // 60 || 'm ' || n_chars % 60 || 's'
    ELSE n_chars // 3600 || 'h ' || n_chars % 3600 // 60 || 'm' END AS eta FROM documents""")
def eta(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.eta(F.col("n_chars")).alias("eta"))


@query("x16_utc", "SELECT event_id, ts - INTERVAL 2 HOUR AS utc FROM events")
def utc(spark, sf_dir):
    """A local time with its offset, as UTC."""
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+02:00"))
    return table(spark, sf_dir, "events").select("event_id", F.to_utc_timestamp(F.to_timestamp(text), "UTC").cast("timestamp_ntz").alias("utc"))


@query("j6_common_suffix", f"""WITH {PATHS_SQL} SELECT page_id, CASE WHEN page_id % 2 = 0 THEN len(string_split(path, '/')) - 2 ELSE 0 END AS depth FROM p""")
def common_suffix_depth(spark, sf_dir):
    """Shared trailing segments with a copy under another mount, or with another file."""
    other = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/mnt"), F.regexp_replace("path", "^/[^/]+", ""))).otherwise("/mnt/other.bin")
    return page_paths(spark, sf_dir).select("page_id", paths.common_suffix(F.col("path"), other).cast("long").alias("depth"))


@query("k8_journal_stamp", """SELECT o_custkey AS output, max(o_orderkey) AS stamp FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1""")
def journal_stamp(spark, sf_dir):
    """One entry an output, stamped last; entries of outputs that went are cleared."""
    stamps = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("output")).agg(F.max("o_orderkey").alias("stamp"))
    gone = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("output"))
    return logs.without(stamps, gone, "output")


@query("k9_output_paths", """SELECT doc_id, '/out/' || md5(text)[1:1] || '/' || md5(text)[2:] || '.bundle/index.bif' AS bundle, source || '/' || doc_id || '-320-10.bif' AS sidecar FROM documents""")
def output_paths(spark, sf_dir):
    digest = F.md5("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("/out/"), F.left(digest, F.lit(1)), F.lit("/"), F.substring(digest, 2, 31), F.lit(".bundle/index.bif")).alias("bundle"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("-320-10.bif")).alias("sidecar"),
    )


@query("s13_directory_expansion", f"""WITH {PATHS_SQL}, wanted(folder) AS (VALUES ('/ththhe.example.com'), ('/ththon.example.com/en'), ('/nowhere')),
    hits AS (SELECT folder, path FROM wanted JOIN p ON starts_with(path, folder || '/')) SELECT DISTINCT w.folder, coalesce(h.path, w.folder) AS path FROM wanted w LEFT JOIN hits h USING (folder)""")
def directory_expansion(spark, sf_dir):
    """Folders become the files below them; a folder without any stays as it is."""
    wanted = spark.createDataFrame([("/ththhe.example.com",), ("/ththon.example.com/en",), ("/nowhere",)], "folder string")
    below = page_paths(spark, sf_dir).select("path", F.explode(paths.ancestors(F.col("path"))).alias("folder")).where("path <> folder")
    return wanted.join(below, "folder", "left").select("folder", F.coalesce("path", "folder").alias("path")).distinct()


@query("s14_frame_index", """SELECT source, block, CAST(n AS INT) - 1 AS frame, (n - 1) AS time, md5(text) AS body FROM (
    SELECT source, CAST(doc_id // 64 AS BIGINT) AS block, text, row_number() OVER (PARTITION BY source, doc_id // 64 ORDER BY doc_id) AS n FROM documents)""")
def frame_container(spark, sf_dir):
    """Frames written to containers, their index read back and the frames cut out again.

    A container holds the documents of one source and 64 numbers, so no source's frames all meet in one row.
    """
    place = F.struct("source", F.floor(F.col("doc_id") / 64).alias("block"))
    rows = table(spark, sf_dir, "documents").select(place.alias("file"), "doc_id", F.col("text").cast("binary").alias("body"))
    indexed = frame_index.read_index(frame_index.written_files(rows, "file", "doc_id", "body", 10_000))
    return frame_index.frames(indexed, ["file"]).select("file.source", "file.block", "frame", "time", F.md5("body").alias("body"))


@query("t4_pending_snapshot", """WITH g AS (SELECT *, ts - lag(ts) OVER w >= INTERVAL 1 HOUR OR lag(ts) OVER w IS NULL AS fresh FROM events WHERE ts < TIMESTAMP '2024-01-15' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g), b AS (SELECT user_id, max(ts) + INTERVAL 1 HOUR AS fires FROM s GROUP BY user_id, session)
    SELECT user_id, (floor(epoch(fires)) - epoch(TIMESTAMP '2024-01-15'))::BIGINT AS seconds_left FROM b WHERE fires > TIMESTAMP '2024-01-15'""")
def pending_snapshot(spark, sf_dir):
    """Batches that haven't fired at a given time (T3 takes these early), and how long they still wait."""
    now = F.lit("2024-01-15").cast("timestamp")
    rows = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp")).where(F.col("at") < now)
    batches = rows.groupBy("user_id", F.session_window("at", "1 hour").alias("w")).count().where(F.col("w.end") > now)
    return batches.select("user_id", (F.unix_timestamp("w.end") - F.unix_timestamp(now)).alias("seconds_left"))


@query("t13_recent_poll", """SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-20' + INTERVAL 24 HOUR""")
def recent_poll(spark, sf_dir):
    start = F.lit("2024-01-20").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").where((F.col("ts") >= start) & (F.col("ts") < start + F.expr("INTERVAL 24 HOURS"))).select("event_id")


@query("qs6_preview_search", f"""WITH {PATHS_SQL} SELECT page_id FROM p WHERE contains(path, 'th') AND NOT starts_with(path, '/ththhe.example.com/') ORDER BY page_id LIMIT 80""")
def preview_search(spark, sf_dir):
    """Search hits without those below disabled roots."""
    rows = page_paths(spark, sf_dir).where(F.col("path").contains("th") & ~paths.under(F.col("path"), "/ththhe.example.com"))
    return rows.orderBy("page_id").limit(80).select("page_id")
