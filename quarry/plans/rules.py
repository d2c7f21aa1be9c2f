"""Queries over mapping rules in any normal form, job rules, output places and record migrations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import jobs, logs, paths
from quarry.plans.catalogue import PATHS_SQL, ROOTS, _roots_sql, page_paths, roots
from quarry.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Server prefix, local prefix, senders' prefixes; the local names have a letter that can be written in two forms.
MAPPINGS = [
    ("/ththhe.example.com", "/mnt/café", ("/hook/a", "/hook")), ("/ththon.example.com/en", "/mnt/b/", ()), ("/blog", "/mnt/d", ("/mnt/café/blog",)),
]
#: The two lists of video extensions, which differ.
EXTENSIONS = ("mkv", "mp4", "m4v", "mov", "avi", "ts", "m2ts", "wmv", "webm", "mpg", "mpeg")
FOLDER_EXTENSIONS = ("mkv", "mp4", "avi", "m4v", "ts", "wmv", "mov", "flv", "webm")
_TRIED = ("mkv", "FLV", "m2ts", "Mpeg", "txt", "webm", "")


def query(name: str, sql: str):
    def register(function):
        QUERIES[name], ORACLES[name] = function, sql
        return function

    return register


def sent_paths(spark, sf_dir) -> DataFrame:
    """Page paths as senders, decomposed local names and servers write them."""
    path, way = F.col("path"), F.col("page_id") % 4
    raw = F.when(way == 0, F.concat(F.lit("\\hook\\a"), path)).when(way == 1, F.concat(F.lit(" /mnt/cafe\u0301"), path)).otherwise(path)
    return page_paths(spark, sf_dir).select("page_id", raw.alias("raw"))


_SENT_SQL = PATHS_SQL + """, sent AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/hook/a' || path WHEN 1 THEN '/mnt/cafe\u0301' || path ELSE path END AS raw FROM p),
    s AS (SELECT page_id, raw, nfc_normalize(raw) AS n FROM sent)"""


def _mapped_sql(a: str, b: str) -> str:
    a, b = a.rstrip("/"), b.rstrip("/")
    rest = f"ltrim(substr(n, {len(a) + 1}), '/')"
    return f"CASE WHEN n = '{a}' OR starts_with(n, '{a}/') THEN CASE WHEN {rest} = '' THEN '{b}' ELSE '{b}/' || {rest} END END"


_CANONICAL_SQL = ", ".join(_mapped_sql(a, local) for remote, local, senders in MAPPINGS for a in (remote, *senders))
_FORMS_SQL = ", ".join(
    _mapped_sql(a, b) for remote, local, senders in MAPPINGS
    for a, b in ((remote, local), (local, remote), *(x for w in senders for x in ((w, local), (w, remote), (local, w), (remote, w))))
)


@query("p1_sender_prefixes", f"WITH {_SENT_SQL} SELECT page_id, coalesce({_CANONICAL_SQL}, raw) AS local FROM s")
def sender_prefixes(spark, sf_dir):
    """By server, then sender prefixes, in any normal form."""
    return sent_paths(spark, sf_dir).select("page_id", paths.canonical(F.col("raw"), MAPPINGS).alias("local"))


@query("p2_sender_candidates", f"""WITH {_SENT_SQL}, c AS (SELECT page_id, list_filter([raw, {_FORMS_SQL}], lambda x: x IS NOT NULL) AS forms FROM s)
    SELECT page_id, list_filter(forms, lambda x, i: list_position(forms, x) = i) AS candidates FROM c""")
def sender_candidates(spark, sf_dir):
    """Every form in order, senders' too."""
    return sent_paths(spark, sf_dir).select("page_id", paths.expanded(F.col("raw"), MAPPINGS).alias("candidates"))


@query("p7_normal_forms", f"WITH {_SENT_SQL} SELECT page_id, n = '/mnt/café/ththhe.example.com' OR starts_with(n, '/mnt/café/ththhe.example.com/') AS below FROM s")
def normal_forms(spark, sf_dir):
    """A composed prefix covers a decomposed path."""
    return sent_paths(spark, sf_dir).select("page_id", paths.composed_under(F.col("raw"), "/mnt/café/ththhe.example.com/").alias("below"))


@query("j1_composed_ownership", f"""WITH {_SENT_SQL}, {_roots_sql}, r AS (SELECT server, library, ord, '/mnt/café' || root AS root FROM roots)
    SELECT n AS path, server, arg_min(root, (ord, root)) AS root, arg_min(library, (ord, root)) AS library FROM s JOIN r ON n = root OR starts_with(n, root || '/') GROUP BY 1, 2""")
def composed_ownership(spark, sf_dir):
    """Paths and roots meet in normal form C, whatever form either is written in."""
    own = roots(spark).withColumn("root", paths.nfc(F.concat(F.lit("/mnt/café"), "root")))
    all_paths = sent_paths(spark, sf_dir).select(paths.nfc(paths.cleaned(F.col("raw"))).alias("path")).distinct()
    return paths.owners(all_paths, "path", own, "server", ["ord"]).select("path", "server", "root", "library")


@query("j17_scan_targets", f"""WITH {_SENT_SQL}, {_roots_sql}, c AS (SELECT DISTINCT raw, unnest(list_filter([raw, {_FORMS_SQL}], lambda x: x IS NOT NULL)) AS form FROM s),
    m AS (SELECT raw, form, arg_max(root, len(root)) AS root, arg_max(library, len(root)) AS library FROM c JOIN roots ON form = root OR starts_with(form, root || '/') GROUP BY 1, 2),
    t AS (SELECT *, list_filter(string_split(substr(form, len(root) + 1), '/'), lambda x: x <> '') AS parts FROM m)
    SELECT DISTINCT raw AS path, library, CASE WHEN len(parts) >= 2 THEN root || '/' || parts[1] ELSE root END AS target FROM t""")
def scan_targets(spark, sf_dir):
    """The folder to scan, by every form of an unknown path."""
    sent = sent_paths(spark, sf_dir).select(paths.cleaned(F.col("raw")).alias("path")).distinct()
    return paths.scan_targets(sent, "path", roots(spark), MAPPINGS)


@query("j2_publishers", f"""WITH {PATHS_SQL}, {_roots_sql}, own AS (SELECT DISTINCT path, server, false AS hinted FROM p JOIN roots ON path = root OR starts_with(path, root || '/')),
    hint AS (SELECT DISTINCT path, 's' || (page_id % 6) AS server, true AS hinted FROM p WHERE page_id % 7 = 0),
    config(server, adapter) AS (VALUES ('s1', 'bundle'), ('s3', 'sheets'), ('s4', 'sidecar')),
    b AS (SELECT path, server, bool_or(hinted) AS hinted FROM (SELECT * FROM own UNION ALL SELECT * FROM hint) GROUP BY 1, 2)
    SELECT path, server, adapter, hinted FROM b JOIN config USING (server) WHERE NOT (server = 's1' AND (path = '/ththhe.example.com/de' OR starts_with(path, '/ththhe.example.com/de/')))""")
def publishers(spark, sf_dir):
    """J2 with the adapter gate: s2 is disabled, s5 has no adapter, s0 isn't known."""
    rows = page_paths(spark, sf_dir)
    own = paths.owners(rows.select("path").distinct(), "path", roots(spark), "server", ["ord"])
    hints = rows.where("page_id % 7 = 0").select("path", F.concat(F.lit("s"), (F.col("page_id") % 6).cast("string")).alias("server"))
    config = [("s1", True, "bundle"), ("s2", False, "sidecar"), ("s3", True, "sheets"), ("s4", True, "sidecar"), ("s5", True, None)]
    servers = spark.createDataFrame(config, "server string, enabled boolean, adapter string")
    return jobs.publishers(own, hints, servers, {"s1": lambda path: paths.excluded(path, [("/ththhe.example.com/de", "path")])})


def job_table(spark, sf_dir) -> DataFrame:
    """Orders as jobs: some of a former kind, some chains, some attempts of others by either family of flags."""
    n = F.col("o_orderkey")
    second = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return table(spark, sf_dir, "orders").select(
        n.alias("key"), F.concat(F.when(n % 10 == 0, "retry-").otherwise("job-"), n.cast("string")).alias("id"),
        F.when(F.col("o_orderstatus") == "P", "running").when(F.col("o_orderstatus") == "O", "pending").otherwise("completed").alias("status"),
        (n % 4 == 1).alias("is_chain"), (n % 4 == 2).alias("is_attempt"), F.when(n % 3 > 0, second + 300).alias("started"), second.alias("created"),
        F.when(n % 2 == 0, True).alias("is_retry"), F.when(n % 5 > 0, F.floor(n / 8)).alias("parent_job"),
        F.when(n % 3 == 0, True).alias("is_retry_attempt"), F.floor(n / 8).alias("parent_chain"), F.when(n % 7 > 0, n % 7).alias("attempt"),
    )


_JOBS_SQL = """jobs AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 10 = 0 THEN 'retry-' ELSE 'job-' END || o_orderkey AS id,
    CASE o_orderstatus WHEN 'P' THEN 'running' WHEN 'O' THEN 'pending' ELSE 'completed' END AS status, CAST(epoch(o_orderdate) AS BIGINT) AS created,
    CASE WHEN o_orderkey % 3 > 0 THEN CAST(epoch(o_orderdate) AS BIGINT) + 300 END AS started FROM orders)"""
#: The moment of the restart.
NOW = 893_980_800


@query("t9_restart_rules", f"""WITH {_JOBS_SQL}, a AS (SELECT *, CASE WHEN key % 4 = 1 AND status <> 'completed' THEN 'chain' WHEN key % 4 = 2 AND status <> 'completed' THEN 'interrupted'
        WHEN status <> 'completed' AND {NOW} - coalesce(started, created) <= 86400 THEN 'revived' WHEN status = 'running' THEN 'interrupted' WHEN status = 'pending' THEN 'stale' ELSE 'kept' END AS action FROM jobs WHERE key % 10 <> 0)
    SELECT id, status, action, CASE WHEN action IN ('chain', 'revived') THEN 'pending' WHEN action = 'interrupted' THEN 'failed' ELSE status END AS state FROM a""")
def restart_rules(spark, sf_dir):
    """Former ids go, chains wait on, attempts fail, others are taken up again within the age limit, which is clamped."""
    return jobs.restarted(job_table(spark, sf_dir), F.lit(NOW), 5000).select("id", "status", "action", "state")


@query("j8_resumed_chains", f"""WITH {_JOBS_SQL}, living AS (SELECT DISTINCT l_orderkey AS key FROM lineitem WHERE l_linestatus = 'O')
    SELECT id, CASE WHEN {NOW} - coalesce(started, {NOW}) > 86400 * 365 THEN 'expired' WHEN key IN (SELECT key FROM living) THEN 'revived' ELSE 'orphaned' END AS fate FROM jobs""")
def resumed_chains(spark, sf_dir):
    """J8 with the age cap, here of a year: a chain that is too old isn't taken up, whatever lives of it."""
    own = job_table(spark, sf_dir)
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.when(F.col("l_linestatus") == "O", "running").otherwise("completed").alias("status"))
    children = items.join(own.select("key", F.col("id").alias("parent")), "key").select("parent", "status")
    return jobs.resumed(own.select("id", "started"), children, F.lit(NOW), 86_400 * 365)


@query("j9_two_families", """WITH j AS (SELECT o_orderkey AS n, CAST(floor(o_orderkey / 8) AS BIGINT) AS parent, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 7 ELSE 0 END AS attempt, CAST(epoch(o_orderdate) AS BIGINT) AS created FROM orders),
    c AS (SELECT * FROM j WHERE (n % 2 = 0 AND n % 5 > 0) OR n % 3 = 0)
    SELECT parent, CASE WHEN n % 10 = 0 THEN 'retry-' ELSE 'job-' END || n AS child, (row_number() OVER (PARTITION BY parent ORDER BY attempt, CAST(created AS VARCHAR), CASE WHEN n % 10 = 0 THEN 'retry-' ELSE 'job-' END || n))::INT AS nth FROM c""")
def two_families(spark, sf_dir):
    """Attempts by either family of flags, each once, in order."""
    return jobs.children_of(job_table(spark, sf_dir))


@query("i3_source_server", """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 AND EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey % 30) THEN c_custkey % 30
    ELSE (SELECT CASE WHEN count(*) = 1 THEN min(s_suppkey) END FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal > 5000) END AS server FROM customer""")
def source_server(spark, sf_dir):
    """The pin of the query string if such a server is configured, else the only server of the identity, else none."""
    servers = table(spark, sf_dir, "supplier")
    pins = servers.select(F.col("s_suppkey").alias("pin"), F.col("s_suppkey").alias("pinned"))
    known = servers.where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.when(F.count("*") == 1, F.min("s_suppkey")).alias("only"))
    rows = table(spark, sf_dir, "customer").withColumn("pin", F.when(F.col("c_custkey") % 5 == 0, F.col("c_custkey") % 30))
    return rows.join(pins, "pin", "left").join(known, "c_nationkey", "left").select("c_custkey", F.coalesce("pinned", "only").alias("server"))


_EXT_SQL = "CASE page_id % 7 " + " ".join(f"WHEN {i} THEN '{'.' * bool(x)}{x}'" for i, x in enumerate(_TRIED)) + " END"


@query("f12_two_extension_sets", f"""WITH {PATHS_SQL}, e AS (SELECT page_id, lower(ltrim({_EXT_SQL}, '.')) AS ext FROM p)
    SELECT page_id, ext IN {EXTENSIONS} AS video, ext IN {FOLDER_EXTENSIONS} AS in_folder FROM e""")
def two_extension_sets(spark, sf_dir):
    """a path by itself and a file in a folder are held to different lists."""
    ext = F.element_at(F.array(*map(F.lit, _TRIED)), (F.col("page_id") % 7 + 1).cast("int"))
    file = F.concat(F.lit("/v/f"), F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(""))
    found = F.lower(F.regexp_extract(file, r"\.([^./]+)$", 1))
    return page_paths(spark, sf_dir).select("page_id", found.isin(*EXTENSIONS).alias("video"), found.isin(*FOLDER_EXTENSIONS).alias("in_folder"))


@query("k9_sheet_folders", """SELECT doc_id, source || '/' || doc_id || '.trickplay/320 - 10x10' AS beside,
    '/config/trickplay/' || md5(text)[1:2] || '/' || md5(text) || '/320 - 10x10' AS apart FROM documents""")
def sheet_folders(spark, sf_dir):
    """K9: the tile-sheet folder beside a file, and the one by its id, which is written with hyphens and capitals."""
    digest = F.upper(F.md5("text"))
    written_id = F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.substring(digest, 13, 20))
    guid = F.lower(F.replace(written_id, F.lit("-"), F.lit("")))
    file = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".mkv"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.regexp_replace(file, r"\.[^./]*$", ""), F.lit(".trickplay/320 - 10x10")).alias("beside"),
        F.concat_ws("/", F.lit("/config/trickplay"), F.left(guid, F.lit(2)), guid, F.lit("320 - 10x10")).alias("apart"),
    )


@query("x26_ordered_reasons", """WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
    SELECT doc_id, CASE WHEN len(list_filter(lines, lambda x: regexp_matches(x, '(?i)password'))) > 0 THEN 'parse' WHEN len(list_filter(lines, lambda x: regexp_matches(x, '[|]'))) > 0 THEN 'colour'
        WHEN doc_id % 2 = 0 THEN 'tone' WHEN len(list_filter(lines, lambda x: regexp_matches(x, '^[A-Z]'))) > 0 AND doc_id % 3 = 0 THEN 'codec' END AS reason FROM l""")
def ordered_reasons(spark, sf_dir):
    """The first rule that fits, over all lines of what was said; one rule needs a flag and no line."""
    lines, n = F.split(F.coalesce("text", F.lit("")), "\n"), F.col("doc_id")
    rules = [("parse", "(?i)password", F.lit(True)), ("colour", "[|]", F.lit(True)), ("tone", None, n % 2 == 0), ("codec", "^[A-Z]", n % 3 == 0)]
    return table(spark, sf_dir, "documents").select("doc_id", jobs.first_reason(lines, rules).alias("reason"))


@query("r4_sequential_migrations", """WITH r AS (SELECT c_custkey, greatest(c_custkey % 5, 1) AS v FROM customer)
    SELECT c_custkey, CASE WHEN v = 1 THEN c_mktsegment || ';' || c_nationkey ELSE NULL END AS libraries, 4::BIGINT AS version,
        CASE WHEN v = 1 THEN [lower(c_mktsegment), CAST(c_nationkey AS VARCHAR)] WHEN v = 2 THEN ['kept'] WHEN v = 3 THEN ['own'] WHEN v = 4 THEN ['own'] END AS ids,
        CASE WHEN v = 4 THEN c_nationkey ELSE 2 + len(CASE WHEN v = 1 THEN [1, 2] ELSE [1] END) END AS workers FROM r JOIN customer USING (c_custkey)""")
def sequential_migrations(spark, sf_dir):
    """A list split out of a text, its members rewritten, a default that depends on them; each record from its own version on."""
    v = F.greatest(F.col("c_custkey") % 5, F.lit(1))
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", (F.col("c_custkey") % 5).alias("version"), F.when(v == 1, F.concat("c_mktsegment", F.lit(";"), F.col("c_nationkey").cast("string"))).alias("libraries"),
        F.when(v == 2, F.array(F.lit("KEPT"))).when(v >= 3, F.array(F.lit("own"))).alias("ids"), F.when(v == 4, F.col("c_nationkey")).alias("workers"),
    )
    steps = [
        lambda r: {"ids": F.split("libraries", ";")},
        lambda r: {"ids": F.transform("ids", F.lower)},
        lambda r: {"workers": (F.lit(2) + F.size("ids")).cast("long")},
    ]
    return jobs.migrated(rows, "version", steps).select("c_custkey", "libraries", "version", "ids", "workers")


@query("s4_import_once", """SELECT 'empty' AS target, count(*) AS n, max(event_id) AS latest FROM events WHERE event_id % 11 > 0
    UNION ALL SELECT 'filled', count(*), max(event_id) FROM events WHERE event_type = 'error'""")
def import_once(spark, sf_dir):
    """Records are imported where the target has none, those that can't be read left out; a filled target stays."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    line = F.when(F.col("event_id") % 11 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("event_id", "user_id", "event_type")))
    parsed = events.select(F.from_json(line, "event_id long, user_id long, event_type string, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("r.*")
    filled = events.where("event_type = 'error'")
    found = [jobs.imported_once(target, parsed).agg(F.count("*").alias("n"), F.max("event_id").alias("latest")).select(F.lit(name).alias("target"), "n", "latest")
             for name, target in (("empty", events.limit(0)), ("filled", filled))]
    return found[0].unionByName(found[1])


@query("o8_longest_first", f"""WITH {PATHS_SQL}, f AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM p)
    SELECT folder, row_number() OVER (ORDER BY len(folder) DESC, folder) AS place FROM f""")
def longest_first(spark, sf_dir):
    """The pages' folders, longest first, in one order without one task for all."""
    folders = page_paths(spark, sf_dir).select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).distinct()
    return logs.placed(folders, [-F.length("folder"), "folder"], "place").select("folder", "place")


#: Fixed values of this query: kinds of file systems that don't belong below a mount.
_ODD_KINDS = ("overlay", "tmpfs")
_KINDS = {root: ("overlay", "ext4", "tmpfs", "nfs")[i % 4] for i, root in enumerate(sorted({r[3] for r in ROOTS}))}


@query("h4_mount_classes", f"""WITH {PATHS_SQL}, k(root, kind) AS (VALUES {", ".join(f"('{r}', '{k}')" for r, k in _KINDS.items())}),
    n AS (SELECT root, kind, count(path) AS n FROM k LEFT JOIN p ON path = root OR starts_with(path, root || '/') GROUP BY 1, 2)
    SELECT root, CASE WHEN n = 0 THEN 'missing' WHEN n < 3 THEN 'empty' WHEN kind IN {_ODD_KINDS} THEN 'suspicious' ELSE 'ok' END AS health FROM n""")
def mount_classes(spark, sf_dir):
    """H4: roots that nothing lies under, that hold next to nothing, or whose file system is of an odd kind."""
    kinds = spark.createDataFrame(list(_KINDS.items()), "root string, kind string")
    held = page_paths(spark, sf_dir).select(F.explode(paths.ancestors(F.col("path"))).alias("root")).join(F.broadcast(kinds.select("root")), "root", "left_semi").groupBy("root").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    health = F.when(n == 0, "missing").when(n < 3, "empty").when(F.col("kind").isin(*_ODD_KINDS), "suspicious").otherwise("ok")
    return kinds.join(held, "root", "left").select("root", health.alias("health"))


@query("s13_folder_files", f"""WITH {PATHS_SQL}, f AS (SELECT DISTINCT path || '.' || CASE page_id % 3 WHEN 0 THEN 'mkv' WHEN 1 THEN 'FLV' ELSE 'txt' END AS file FROM p),
    asked AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS asked FROM p UNION SELECT DISTINCT path || '.txt' FROM p),
    hit AS (SELECT asked, file FROM asked JOIN f ON starts_with(file, asked || '/') WHERE regexp_matches(file, '[.](mkv|FLV)$'))
    SELECT asked, file FROM hit UNION ALL SELECT asked, asked FROM asked WHERE asked NOT IN (SELECT asked FROM hit)""")
def folder_files(spark, sf_dir):
    """Folders become the videos anywhere below them; files, and folders without any, stay as they are."""
    ending = F.when(F.col("page_id") % 3 == 0, ".mkv").when(F.col("page_id") % 3 == 1, ".FLV").otherwise(".txt")
    rows = page_paths(spark, sf_dir)
    files = rows.select(F.concat("path", ending).alias("file")).distinct()
    asked = rows.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("asked")).union(rows.select(F.concat("path", F.lit(".txt"))))
    return paths.folder_files(asked, files, FOLDER_EXTENSIONS)
