"""Queries over scopes, quiet hours, part hashes, prefix hints, webhook paths, retries, caches and merged searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import caches, folds, logs, paths, scopes, search
from quarry.plans.catalogue import PATHS_SQL, ROOTS, page_paths, roots
from quarry.sources.tables import table
from quarry.streaming import webhooks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


@query("f3_library_scope", """SELECT 'ids' AS scope, c_custkey FROM customer WHERE c_nationkey IN (3, 5)
    UNION ALL SELECT 'titles', c_custkey FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery') UNION ALL SELECT 'all', c_custkey FROM customer""")
def library_scope(spark, sf_dir):
    """Three scans: ids and titles given (ids decide), titles only, neither."""
    rows = table(spark, sf_dir, "customer")
    arms = {"ids": (["3", "5"], ["building"]), "titles": ([], ["building", "machinery"]), "all": ([], [])}
    made = [
        rows.where(scopes.in_scope(F.col("c_nationkey"), F.col("c_mktsegment"), *arm)).select(F.lit(k).alias("scope"), "c_custkey")
        for k, arm in arms.items()
    ]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query("f4_recent_scope", """SELECT 'explicit' AS scope, c_custkey FROM customer WHERE c_nationkey = 7
    UNION ALL SELECT 'either', c_custkey FROM customer WHERE c_nationkey = 3 OR lower(c_mktsegment) = 'building' UNION ALL SELECT 'all', c_custkey FROM customer""")
def recent_scope(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    arms = {"explicit": (["7"], ["building"], ["3"]), "either": ([], ["building"], ["3"]), "all": ([], [], [])}
    made = [
        rows.where(scopes.in_recent_scope(F.col("c_nationkey"), F.col("c_mktsegment"), *arm)).select(F.lit(k).alias("scope"), "c_custkey")
        for k, arm in arms.items()
    ]
    return made[0].unionByName(made[1]).unionByName(made[2])


QUIET = [("22:30", "06:30", ("fri", "sat")), ("12:00", "13:00", ()), ("09:00", "09:00", ("mon",)), ("later", "10:00", ())]


@query("x18_quiet_windows", """WITH e AS (SELECT event_id, isodow(ts) AS d, hour(ts) * 60 + minute(ts) AS m FROM events)
    SELECT event_id FROM e WHERE (d IN (5, 6) AND (m >= 1350 OR m < 390)) OR hour(to_seconds(m * 60)::INTERVAL) = 12""".replace("hour(to_seconds(m * 60)::INTERVAL) = 12", "(m >= 720 AND m < 780)"))
def quiet_windows(spark, sf_dir):
    """Any of several windows, each with its days; the day is the one of the moment itself."""
    return table(spark, sf_dir, "events").where(T.in_any_window(F.col("ts"), QUIET)).select("event_id")


def film_parts(spark, sf_dir) -> DataFrame:
    """item, ord, digest, path, target: pages as parts of items, three an item; every seventh isn't analysed yet."""
    rows = page_paths(spark, sf_dir).select("page_id", "path", F.floor(F.col("page_id") / 3).alias("item"))
    target = F.concat(F.lit("/mnt"), F.regexp_replace(F.min_by("path", "page_id").over(Window.partitionBy("item")), "^/[^/]+", ""))
    same = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/v"), F.col("page_id").cast("string"), F.regexp_replace("path", "^/[^/]+", ""))).otherwise(F.lit("/x/y.bin"))
    digest = F.when(F.col("page_id") % 7 == 0, "").otherwise(F.md5("path"))
    return rows.select("item", F.col("page_id").alias("ord"), digest.alias("digest"), same.alias("path"), target.alias("target"))


@query("j6_part_hash", f"""WITH {PATHS_SQL}, r AS (SELECT page_id AS ord, path AS p0, page_id // 3 AS item FROM p), t AS (
    SELECT item, ord, CASE WHEN ord % 7 = 0 THEN '' ELSE md5(p0) END AS digest,
        CASE WHEN ord % 2 = 0 THEN '/v' || ord || regexp_replace(p0, '^/[^/]+', '') ELSE '/x/y.bin' END AS path,
        '/mnt' || regexp_replace(first_value(p0) OVER (PARTITION BY item ORDER BY ord), '^/[^/]+', '') AS target FROM r),
    s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS a, list_filter(string_split(target, '/'), lambda x: x <> '') AS b FROM t),
    d AS (SELECT *, coalesce(list_position(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[-i] = b[-i]), false) - 1, least(len(a), len(b))) AS depth,
        a[-1] = b[-1] AS named FROM s),
    g AS (SELECT *, max(depth) OVER (PARTITION BY item) AS best FROM d),
    f AS (SELECT item, count(*) FILTER (depth = best AND depth > 0) AS tied, count(*) FILTER (named) AS names, min(digest) FILTER (depth = best AND depth > 0) AS only_deep,
        min(digest) FILTER (named) AS only_named, arg_min(digest, ord) FILTER (depth = best AND depth > 0) AS first_tied, arg_min(digest, ord) FILTER (len(digest) >= 2) AS first_usable FROM g GROUP BY 1)
    SELECT CAST(item AS BIGINT) AS item, CASE WHEN tied = 1 THEN nullif(only_deep, '') WHEN names = 1 THEN nullif(only_named, '')
        ELSE coalesce(CASE WHEN tied > 1 THEN nullif(first_tied, '') END, first_usable) END AS digest FROM f""")
def part_hash(spark, sf_dir):
    return scopes.part_hash(film_parts(spark, sf_dir), "item", "ord", "digest", "path", "target")


#: Roots that stand inside page paths, and mapping rows (remote, local, sender prefixes) of two servers.
INNER = [("s1", "/en/a"), ("s1", "/fr"), ("s2", "/de"), ("s2", "/en")]
MAPS = {"s1": [("/fr", "/mnt/fr", ("/ththhe.example.com/fr",))], "s2": [("/fr", "/mnt/other", ("/ththon.example.com/fr",)), ("/de", "/x", ())]}
_HINT_SQL = f"""WITH {PATHS_SQL}, roots(root) AS (VALUES ('/en/a'), ('/fr'), ('/de'), ('/en')),
    c AS (SELECT page_id, path, root, instr(lower(path), root) AS pos FROM p, roots),
    f AS (SELECT page_id, path, arg_max(root, len(root) * 1000 - ascii(root[2])) AS root, arg_max(pos, len(root) * 1000 - ascii(root[2])) AS pos FROM c
        WHERE pos > 1 AND path[pos + len(root):pos + len(root)] IN ('', '/') GROUP BY 1, 2),
    h AS (SELECT page_id, path[:pos - 1] || CASE WHEN root = '/en/a' THEN '/en' ELSE root END AS sender, CASE WHEN root = '/en/a' THEN '/en' ELSE root END AS server FROM f)"""


@query("j12_inferred_prefixes", f"{_HINT_SQL} SELECT DISTINCT sender, server FROM h")
def inferred_prefixes(spark, sf_dir):
    pair = scopes.inferred_prefixes(F.col("path"), [r for _, r in INNER])
    return page_paths(spark, sf_dir).select(pair.alias("p")).where("p IS NOT NULL").select("p.sender", "p.server").distinct()


@query("j13_mismatch_class", f"""{_HINT_SQL} SELECT p.page_id, CASE WHEN server IS NULL THEN 'unknown' WHEN server = '/fr' AND sender = '/ththhe.example.com/fr' THEN 'covered'
    WHEN server = '/fr' AND sender = '/ththon.example.com/fr' THEN 'elsewhere' ELSE 'mismatch' END AS class FROM p LEFT JOIN h USING (page_id)""")
def mismatch_class(spark, sf_dir):
    return page_paths(spark, sf_dir).select("page_id", scopes.mismatch_class(F.col("path"), INNER, MAPS).alias("class"))


HOOKS = {"s1": [("/ththhe.example.com/en", "/ththhe.example.com/fr", ("/blog", "/ththon.example.com"))], "s2": [("/thther.example.org", "/ththon.example.com", ())]}


def _form(a: str, b: str) -> str:
    return f"CASE WHEN path = '{a}' OR starts_with(path, '{a}/') THEN '{b}' || path[{len(a) + 1}:] END"


_FORMS = ", ".join([_form("/blog", "/ththhe.example.com/fr"), _form("/ththon.example.com", "/ththhe.example.com/fr"),
                    _form("/ththhe.example.com/en", "/ththhe.example.com/fr"), _form("/thther.example.org", "/ththon.example.com")])


@query("p9_webhook_resolution", f"""WITH {PATHS_SQL}, roots(server, library, ord, root) AS (VALUES {", ".join(str(r) for r in ROOTS)}),
    t AS (SELECT page_id, path, unnest([path, {_FORMS}]) AS form, unnest(range(5)) AS place FROM p),
    m AS (SELECT t.page_id, form, place, server, form NOT IN (SELECT path FROM p WHERE page_id % 4 <> 0) AS missing FROM t JOIN roots ON form = root OR starts_with(form, root || '/')),
    c AS (SELECT page_id, arg_min(form, missing::INT * 100 + place) AS canonical, list_sort(list_distinct(list(server))) AS owners FROM m GROUP BY 1)
    SELECT p.page_id, coalesce(canonical, path) AS canonical, coalesce(owners, []) AS owners FROM p LEFT JOIN c USING (page_id)""")
def webhook_resolution(spark, sf_dir):
    """Forms by sender and remote prefixes, the owners of all of them, the one that exists."""
    rows = page_paths(spark, sf_dir)
    return scopes.resolved(rows, "page_id", "path", HOOKS, roots(spark), rows.where("page_id % 4 <> 0"))


def job_results(spark, sf_dir) -> DataFrame:
    """job, path, outcome, at: the latest result of each file of a job; the payload's number stands for the file."""
    path = F.concat(F.lit("p"), (F.get_json_object("props", "$.k").cast("long") % 10).cast("string"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), path.alias("path"), F.col("event_type").alias("outcome"), "ts", "event_id")
    return rows.where("path IS NOT NULL")


@query("t6_retry_decision", """WITH r AS (SELECT user_id AS job, 'p' || (CAST(props->>'$.k' AS BIGINT) % 10) AS path, event_type AS outcome, ts, event_id FROM events WHERE props->>'$.k' IS NOT NULL),
    l AS (SELECT job, path, arg_max(outcome, (ts, event_id)) AS outcome FROM r GROUP BY 1, 2),
    g AS (SELECT job, coalesce(list(path ORDER BY path) FILTER (outcome = 'error'), []) AS unresolved, coalesce(list(path ORDER BY path) FILTER (outcome = 'click'), []) AS pending,
        bool_or(outcome = 'signup') AS lost, list(path ORDER BY path DESC) AS original FROM l GROUP BY 1),
    c AS (SELECT job, unresolved || CASE WHEN lost THEN original ELSE [] END || pending AS again FROM g)
    SELECT job, list_filter(again, lambda x, i: list_position(again, x) = i) AS again FROM c WHERE len(again) > 0 AND job % 4 < 3""")
def retry_decision(spark, sf_dir):
    """Unresolved paths, then the job's own paths if any file was lost, then those a server has yet to register.

    Only jobs with an attempt left are retried (here three, of which job % 4 have been made).
    """
    last = logs.last_wins(job_results(spark, sf_dir), ["job", "path"], ["ts", "event_id"])
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("outcome") == kind, F.col("path"))))
    jobs = last.groupBy("job").agg(
        of("error").alias("unresolved"), of("click").alias("pending"), F.bool_or(F.col("outcome") == "signup").alias("lost"),
        F.sort_array(F.collect_list("path"), False).alias("original"),
    )
    again = F.array_distinct(F.concat("unresolved", F.when(F.col("lost"), F.col("original")).otherwise(F.array().cast("array<string>")), "pending"))
    return jobs.select("job", again.alias("again")).where((F.size("again") > 0) & (F.col("job") % 4 < 3))


@query("t7_frame_cache", """WITH v AS (SELECT source, doc_id, n_chars FROM documents WHERE (SELECT max(doc_id) FROM documents) - doc_id <= 3600 AND CASE WHEN doc_id % 5 = 0 THEN 1.5 ELSE 0.5 END <= 1.0),
    k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS nth FROM v),
    s AS (SELECT *, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC) AS held FROM k WHERE nth <= 8) SELECT source, doc_id FROM s WHERE nth = 1 OR held <= 20000""")
def frame_cache(spark, sf_dir):
    """Entries that are neither too old nor of a changed source, then the newest that fit by number and bytes.

    The newest always stays. The number is cut first, so no more than that of a source is ever summed in one task.
    """
    drift = F.when(F.col("doc_id") % 5 == 0, 1.5).otherwise(0.5)
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    now = F.broadcast(rows.agg(F.max("doc_id").alias("now")))
    valid = rows.join(now, (F.col("now") - F.col("doc_id") <= 3600) & (drift <= 1.0))
    newest = Window.partitionBy("source").orderBy(F.desc("doc_id"))
    few = valid.withColumn("nth", F.row_number().over(newest)).where("nth <= 8")
    held = F.sum("n_chars").over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return few.withColumn("held", held).where("nth = 1 OR held <= 20000").select("source", "doc_id")


@query("t7_cache_by_use", """WITH RECURSIVE a AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS place, user_id || '/' || event_type AS key, CAST(floor(epoch(ts)) AS BIGINT) AS tm, user_id % 50 + 1 AS size FROM events),
    p AS (SELECT *, coalesce(lag(place) OVER (PARTITION BY key ORDER BY place), 0) AS prev FROM a),
    d AS (SELECT i.place, count(j.place) AS others, coalesce(sum(j.size), 0) AS bytes FROM p i LEFT JOIN p j ON j.place > i.prev AND j.place < i.place AND j.prev <= i.prev WHERE i.prev > 0 GROUP BY 1),
    h AS (SELECT p.*, coalesce(others < 200 AND (others = 0 OR bytes + size <= 4500), false) AS held FROM p LEFT JOIN d USING (place)),
    r AS (SELECT *, sum((NOT held)::INT) OVER (PARTITION BY key ORDER BY place) AS run FROM h),
    n AS (SELECT *, row_number() OVER (PARTITION BY key, run ORDER BY place) AS i FROM r),
    f(key, run, i, place, made, hit) AS (SELECT key, run, i, place, tm, false FROM n WHERE i = 1 UNION ALL
        SELECT n.key, n.run, n.i, n.place, CASE WHEN n.tm - f.made > 86400 THEN n.tm ELSE f.made END, n.tm - f.made <= 86400 FROM f JOIN n ON n.key = f.key AND n.run = f.run AND n.i = f.i + 1)
    SELECT place, key, hit FROM f""")
def cache_by_use(spark, sf_dir):
    """T7 in access order: the cache drops what was used longest ago, by number and bytes, and what is too old."""
    rows = table(spark, sf_dir, "events").select(
        "ts", "event_id", F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), (F.col("user_id") % 50 + 1).alias("size"),
    )
    found = caches.accesses(rows, ["ts", "event_id"], "key", "at", "size", entries=200, most_bytes=4500, ttl=86_400)
    return found.select("place", "key", "hit")


@query("t3_fire_now", """WITH g AS (SELECT *, ts - lag(ts) OVER w >= INTERVAL 1 HOUR OR lag(ts) OVER w IS NULL AS fresh FROM events WHERE ts < TIMESTAMP '2024-01-15' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g), b AS (SELECT user_id, max(ts) + INTERVAL 1 HOUR AS fires, count(*) AS n FROM s GROUP BY user_id, session)
    SELECT user_id, n FROM b WHERE fires <= TIMESTAMP '2024-01-15' OR user_id % 3 = 0""")
def fire_now(spark, sf_dir):
    """Batches whose hour has passed, and those of the users that are asked for at once."""
    rows = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp")).where(F.col("at") < F.lit("2024-01-15").cast("timestamp"))
    batches = rows.groupBy("user_id", F.session_window("at", "1 hour").alias("w")).agg(F.count("*").alias("n")).withColumn("fires", F.col("w.end"))
    asked = rows.where("user_id % 3 = 0").select("user_id")
    return webhooks.due(batches, "2024-01-15", asked, ["user_id"]).select("user_id", "n")


@query("d7_year_merge", """WITH RECURSIVE r AS (SELECT p_brand AS b, CASE WHEN p_partkey % 3 <> 0 THEN 1990 + p_size % 3 END AS y, p_partkey AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part),
    f(b, i, years, sums) AS (SELECT DISTINCT b, CAST(0 AS BIGINT), CAST([] AS INTEGER[]), CAST([] AS BIGINT[]) FROM r UNION ALL
        SELECT b, i, CASE WHEN pos IS NULL OR pos = 0 THEN years || [y] ELSE list_transform(years, lambda x, j: CASE WHEN j = pos THEN coalesce(x, y) ELSE x END) END,
            CASE WHEN pos IS NULL OR pos = 0 THEN sums || [k] ELSE list_transform(sums, lambda x, j: CASE WHEN j = pos THEN x + k ELSE x END) END
        FROM (SELECT f.b, r.i, f.years, f.sums, CAST(r.y AS INTEGER) AS y, CAST(r.k AS BIGINT) AS k, list_position(list_transform(f.years, lambda x: coalesce(x = r.y, true)), true) AS pos FROM f JOIN r ON r.b = f.b AND r.i = f.i + 1)),
    l AS (SELECT b, arg_max(years, i) AS years, arg_max(sums, i) AS sums FROM f GROUP BY 1) SELECT b AS p_brand, unnest(years) AS year, unnest(sums) AS keys FROM l""")
def year_merge(spark, sf_dir):
    """Compatible years merge; every bucket with its year and the sum of its keys."""
    year = F.when(F.col("p_partkey") % 3 != 0, 1990 + F.col("p_size") % 3)
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", year.alias("year"), F.col("p_partkey").alias("seq"))
    merged = folds.merged_by_year(rows, ["p_brand"], "seq", "year", "p_partkey")
    return merged.select("p_brand", "year", F.aggregate("items", F.lit(0).cast("long"), lambda s, x: s + x).alias("keys"))


def _episodes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("show_id"), (F.col("l_suppkey") % 3).cast("int").alias("season"), F.col("l_linenumber").alias("episode"), F.col("l_orderkey").alias("id")
    )


@query("qs1_two_pass_search", """WITH s AS (SELECT p_partkey AS show_id, p_name AS name, lower(p_name) AS low FROM part), h AS (SELECT show_id, name, CASE WHEN low = 'b' THEN 1.0 ELSE 0.8 END::DOUBLE AS score FROM s WHERE starts_with(low, 'b')),
    o AS (SELECT show_id, name, 0.5::DOUBLE AS score FROM s WHERE contains(low, 'b') AND NOT EXISTS (SELECT 1 FROM h)), k AS (SELECT * FROM (SELECT * FROM h UNION ALL SELECT * FROM o) ORDER BY score DESC, show_id LIMIT 50)
    SELECT k.show_id, name, score, (l_suppkey % 3)::INT AS season, l_linenumber AS episode, l_orderkey AS id FROM lineitem JOIN k ON l_partkey = k.show_id WHERE l_suppkey % 3 = 1 AND l_linenumber = 2""")
def two_pass_search(spark, sf_dir):
    """Shows are found, scored and cut, then opened to the episode asked for."""
    shows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("show_id"), F.col("p_name").alias("name"))
    return search.two_pass(shows, _episodes(spark, sf_dir), "B.s01e02", 50)


def _catalogue(spark, sf_dir) -> DataFrame:
    """A third of the parts are films, the others shows; line items are episodes of their part, named after it."""
    part, items = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    n, none = F.col("p_partkey"), F.lit(None).cast("int")
    film = n % 3 == 0
    titles = part.select(
        n.alias("id"), F.when(film, "movie").otherwise("show").alias("kind"), F.col("p_name").alias("name"), n.alias("turn"),
        F.when(film & (n % 2 == 0), F.concat(F.lit("/f/"), n.cast("string"))).alias("path"), F.lit(None).cast("long").alias("show_id"), none.alias("season"), none.alias("episode"),
    )
    season, number = (F.col("l_suppkey") % 3).cast("int"), F.col("l_linenumber").cast("int")
    own = (F.col("l_orderkey") * 10 + F.col("l_linenumber") + 1_000_000).alias("id")
    name = F.concat("p_name", F.lit(" S0"), season.cast("string"), F.lit("E0"), number.cast("string"))
    joined = items.join(part, F.col("l_partkey") == n).where(~film)
    episodes = joined.select(own, F.lit("episode").alias("kind"), name.alias("name"), own.alias("turn"), F.concat(F.lit("/e/"), own.cast("string")).alias("path"),
                             n.alias("show_id"), season.alias("season"), number.alias("episode"))
    return titles.unionByName(episodes.groupBy("id").agg(F.min_by(F.struct(*episodes.columns), "show_id").alias("row")).select("row.*"))


_CATALOGUE_SQL = """WITH t AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'movie' ELSE 'show' END AS kind, p_name AS name, p_partkey AS turn, CASE WHEN p_partkey % 6 = 0 THEN '/f/' || p_partkey END AS path,
        NULL::BIGINT AS show_id, NULL::INT AS season, NULL::INT AS episode FROM part),
    e AS (SELECT l_orderkey * 10 + l_linenumber + 1000000 AS id, 'episode' AS kind, p_name || ' S0' || l_suppkey % 3 || 'E0' || l_linenumber AS name, l_orderkey * 10 + l_linenumber + 1000000 AS turn,
        '/e/' || (l_orderkey * 10 + l_linenumber + 1000000) AS path, p_partkey AS show_id, (l_suppkey % 3)::INT AS season, l_linenumber::INT AS episode FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_partkey % 3 <> 0
        QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY p_partkey, l_suppkey % 3) = 1),
    c AS (SELECT * FROM t UNION ALL SELECT * FROM e),"""


@query("qs1_series_first", _CATALOGUE_SQL + """
    s AS (SELECT id AS show_id, turn AS rank FROM c WHERE kind = 'show' AND starts_with(lower(name), 'b') ORDER BY turn LIMIT 10),
    x AS (SELECT rank, e.* FROM e JOIN s USING (show_id) WHERE season = 1 AND episode = 2)
    SELECT (row_number() OVER (ORDER BY season, episode, turn))::INT AS place, id, name, path FROM x WHERE rank = (SELECT min(rank) FROM x) ORDER BY place LIMIT 50""")
def series_first(spark, sf_dir):
    """Q-S1: the first show that has the episode answers."""
    return search.series_first(_catalogue(spark, sf_dir), "B.S01E02")


@query("qs1_ranked_fallback", _CATALOGUE_SQL + """
    h AS (SELECT *, CASE WHEN lower(name) = 'ue' THEN 1.0 WHEN starts_with(lower(name), 'ue') THEN 0.8 ELSE 0.5 END AS score FROM (SELECT * FROM c WHERE contains(lower(name), 'ue') ORDER BY turn LIMIT 160)),
    r AS (SELECT *, row_number() OVER (ORDER BY score DESC, turn) AS rank FROM h QUALIFY rank <= 80),
    x AS (SELECT r.rank, e.id, e.name, e.path, e.season, e.episode, e.turn FROM r JOIN e ON e.show_id = r.id WHERE r.kind = 'show'),
    f AS (SELECT coalesce(min(rank), 2147483647) AS first FROM x),
    b AS (SELECT rank, id, name, path, season, episode, turn FROM r WHERE kind <> 'show' AND path IS NOT NULL UNION ALL SELECT * FROM x),
    o AS (SELECT b.* FROM b, f WHERE rank <= first QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, season NULLS FIRST, episode NULLS FIRST, turn) = 1)
    SELECT (row_number() OVER w)::INT AS place, id, name, path FROM o WINDOW w AS (ORDER BY rank, season NULLS FIRST, episode NULLS FIRST, turn) QUALIFY row_number() OVER w <= 40""")
def ranked_fallback(spark, sf_dir):
    """Q-S1: no show's name begins so; the best hits, up to the first show with episodes."""
    return search.series_first(_catalogue(spark, sf_dir), "ue", 40)


@query("qs2_hub_search", _CATALOGUE_SQL + """
    h AS (SELECT * FROM c WHERE contains(lower(name), 'b') QUALIFY row_number() OVER (PARTITION BY kind ORDER BY turn) <= 30),
    r AS (SELECT *, CASE WHEN lower(name) = 'b' THEN 1.0 WHEN starts_with(lower(name), 'b') THEN 0.8 ELSE 0.5 END * CASE WHEN kind = 'movie' THEN 0.5 ELSE 1 END AS score FROM h),
    k AS (SELECT *, row_number() OVER (ORDER BY score DESC, turn) AS rank FROM r WHERE score >= 0.3 QUALIFY rank <= 60),
    b AS (SELECT rank, id, name, path, season, episode, turn FROM k WHERE kind <> 'show' AND path IS NOT NULL
        UNION ALL SELECT k.rank, e.id, e.name, e.path, e.season, e.episode, e.turn FROM k JOIN e ON e.show_id = k.id WHERE k.kind = 'show' AND e.season = 2 AND e.episode = 1)
    SELECT (row_number() OVER w)::INT AS place, id, name, path FROM b WINDOW w AS (ORDER BY rank, season NULLS FIRST, episode NULLS FIRST, turn) QUALIFY row_number() OVER w <= 30""")
def hub_search(spark, sf_dir):
    """Q-S2: hits of every kind, scored together, shows opened to the episode where they stand."""
    return search.hub_search(_catalogue(spark, sf_dir), "b s02e01", 30)


@query("qs5_legacy_preview_search", _CATALOGUE_SQL + """
    s AS (SELECT id AS show_id, turn AS rank FROM c WHERE kind = 'show' AND contains(lower(name), 'ue')),
    b AS (SELECT 0 AS phase, rank, id, name, path, season, episode, turn FROM e JOIN s USING (show_id) UNION ALL
        SELECT 1, turn, id, name, path, 0, 0, turn FROM c WHERE kind <> 'show' AND contains(lower(name), 'ue')),
    o AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY id ORDER BY phase, rank, season, episode, turn) = 1)
    SELECT (row_number() OVER w)::INT AS place, id, name, path FROM o WINDOW w AS (ORDER BY phase, rank, season, episode, turn) QUALIFY row_number() OVER w <= 15""")
def legacy_preview_search(spark, sf_dir):
    """Q-S5: shows' episodes first, then direct hits, each key once."""
    return search.preview_search(_catalogue(spark, sf_dir), "ue")


@query("qs3_suggestions", """SELECT p_partkey AS show_id, p_name AS name, CASE WHEN lower(p_name) = 'b' THEN 1.0 WHEN starts_with(lower(p_name), 'b') THEN 0.8 ELSE 0.5 END::DOUBLE AS score
    FROM part WHERE contains(lower(p_name), 'b') ORDER BY score DESC, show_id LIMIT 25""")
def suggestions(spark, sf_dir):
    """Q-S3: the shows themselves, not opened to episodes."""
    q = search.parsed(spark, "b")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("show_id"), F.col("p_name").alias("name"))
    scored = rows.withColumn("score", q.score(F.col("name")))
    return scored.where("score >= 0.3").orderBy(F.desc("score"), "show_id").limit(25)


@query("qs4_scatter_gather", """WITH a AS (SELECT min(c_custkey) AS rank, c_mktsegment AS title FROM customer GROUP BY 2), b AS (SELECT min(p_partkey) AS rank, split_part(p_type, ' ', 1) AS title FROM part GROUP BY 2),
    h AS (SELECT 0 AS ord, rank, 'show' AS kind, title, title AS path, 's0' AS server FROM a UNION ALL SELECT 2, rank, 'show', upper(title), title, 's2' FROM a UNION ALL
        SELECT 2, rank, 'movie', title, title, 's2' FROM b UNION ALL SELECT 0, rank, 'episode', title || ' S01E02', title, 's0' FROM a UNION ALL SELECT 2, rank, 'episode', title || ' S02E01', title || '!', 's2' FROM b),
    m AS (SELECT kind, regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') AS key, arg_min(title, (ord, rank)) AS title, list_distinct(list(path)) AS paths, list_sort(list_distinct(list(server))) AS servers, min((ord, rank)) AS place FROM h GROUP BY 1, 2)
    SELECT kind, title, len(paths) AS n_paths, servers FROM (SELECT * FROM m WHERE NOT (kind = 'episode' AND regexp_replace(lower(regexp_replace(title, ' S[0-9]+E[0-9]+.*$', '')), '[^a-z0-9]+', '', 'g') IN (SELECT key FROM m WHERE kind = 'show'))
        ORDER BY CASE kind WHEN 'show' THEN 1 WHEN 'movie' THEN 2 ELSE 3 END, place, key LIMIT 25)""")
def scatter_gather(spark, sf_dir):
    """Q-S4: three servers, one of them down; hits merged (D7), covered episodes gone (D11), shows first."""
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("title")).agg(F.min("c_custkey").alias("rank"))
    b = table(spark, sf_dir, "part").groupBy(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("title")).agg(F.min("p_partkey").alias("rank"))

    def hits(rows: DataFrame, server: str, kind: str, title, path) -> DataFrame:
        return rows.select(
            F.lit(server).alias("server"), "rank", F.lit(kind).alias("kind"), title.alias("title"), F.lit(None).cast("int").alias("year"),
            F.array(path).alias("paths"), F.lit(None).cast("int").alias("child_count"),
        )

    title = F.col("title")

    def first() -> DataFrame:
        return hits(a, "s0", "show", title, title).unionByName(hits(a, "s0", "episode", F.concat(title, F.lit(" S01E02")), title))

    def down() -> DataFrame:
        raise ConnectionError("no answer")

    def third() -> DataFrame:
        shows = hits(a, "s2", "show", F.upper("title"), title).unionByName(hits(b, "s2", "movie", title, title))
        return shows.unionByName(hits(b, "s2", "episode", F.concat(title, F.lit(" S02E01")), F.concat(title, F.lit("!"))))

    merged = search.merged(search.gathered(spark, [("s0", first), ("s1", down), ("s2", third)]))
    found = search.answer(merged, "any")
    return found.select("kind", "title", F.size("paths").cast("long").alias("n_paths"), F.array_sort("servers").alias("servers"))


@query("r1_reconcile_workers", """WITH want AS (SELECT n_nationkey AS k, n_nationkey % 4 AS wanted FROM nation), have AS (SELECT s_nationkey AS k, s_suppkey AS worker, s_acctbal > 5000 AS busy FROM supplier),
    n AS (SELECT k, count(*) AS held FROM have GROUP BY 1), o AS (SELECT have.*, coalesce(held, 0) - coalesce(wanted, 0) AS extra, row_number() OVER (PARTITION BY k ORDER BY busy, worker) AS nth FROM have JOIN n USING (k) LEFT JOIN want USING (k))
    SELECT k, worker, CASE WHEN busy THEN 'defer' ELSE 'remove' END AS action FROM o WHERE nth <= extra
    UNION ALL SELECT want.k, NULL, 'add' FROM want LEFT JOIN n USING (k), range(4) t(i) WHERE i < wanted - coalesce(held, 0)""")
def reconcile_workers(spark, sf_dir):
    """Workers that are missing are added, those too many removed, idle ones first; busy ones go when they are done."""
    want = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") % 4).cast("int").alias("wanted"))
    have = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("worker"), (F.col("s_acctbal") > 5000).alias("busy"))
    counts = have.groupBy("k").agg(F.count("*").alias("held"))
    gap = want.join(counts, "k", "full").select("k", (F.coalesce("held", F.lit(0)) - F.coalesce("wanted", F.lit(0))).alias("extra"))
    nth = F.row_number().over(Window.partitionBy("k").orderBy("busy", "worker"))
    out = have.withColumn("nth", nth).join(gap, "k").where("nth <= extra")
    gone = out.select("k", "worker", F.when(F.col("busy"), "defer").otherwise("remove").alias("action"))
    new = gap.where("extra < 0").select("k", F.explode(F.sequence(F.lit(1), -F.col("extra"))).alias("i"))
    return gone.unionByName(new.select("k", F.lit(None).cast("long").alias("worker"), F.lit("add").alias("action")))


@query("p8_sibling_rebind", f"""WITH {PATHS_SQL}, live AS (SELECT path FROM p WHERE page_id % 2 = 0 UNION SELECT regexp_replace(path, '^/[^/]+', '/thther.example.org') FROM p WHERE page_id % 3 = 0), m(m) AS (VALUES ('/blog.tionsh.example.net'), ('/blog.tionsh.example.net/en'), ('/thther.example.org')),
    own AS (SELECT page_id, path, arg_max(m, len(m)) AS own FROM p JOIN m ON path = m OR starts_with(path, m || '/') GROUP BY 1, 2),
    c AS (SELECT page_id, m || path[len(own) + 1:] AS candidate, len(m) AS n FROM own, m WHERE m <> own)
    SELECT page_id, arg_max(candidate, n * 1000 - ascii(candidate[6])) AS found FROM c WHERE candidate IN (SELECT path FROM live) GROUP BY 1""")
def sibling_rebind(spark, sf_dir):
    """The path under another mount, of those, longest first, where it exists; its own mount is the longest it lies under."""
    mounts = sorted(("/blog.tionsh.example.net", "/blog.tionsh.example.net/en", "/thther.example.org"), key=lambda m: (-len(m), m))
    rows, path = page_paths(spark, sf_dir), F.col("path")
    own = F.coalesce(*[F.when(paths.under(path, m), F.lit(m)) for m in mounts])
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("m")) for i, m in enumerate(mounts)])
    tried = rows.select("page_id", "path", own.alias("own"), F.explode(each).alias("mount")).where("own IS NOT NULL AND mount.m <> own")
    tried = tried.select("page_id", "mount.i", F.concat("mount.m", F.substring(path, F.length("own") + 1, F.length(path))).alias("candidate"))
    moved = F.regexp_replace("path", "^/[^/]+", "/thther.example.org")
    live = rows.where("page_id % 2 = 0").select(path.alias("candidate")).union(rows.where("page_id % 3 = 0").select(moved)).distinct()
    return tried.join(live, "candidate", "left_semi").groupBy("page_id").agg(F.min_by("candidate", "i").alias("found"))
