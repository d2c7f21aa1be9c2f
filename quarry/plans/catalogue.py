"""Queries over paths, owners, titles and merges of several sources.

Page URLs stand for media paths, part names for titles, suppliers for servers; rules and roots are small fixed lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chains, folds, logs, paths, search
from quarry.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Ordered rewrite rules, server roots (server, library, ord, root) and exclusions of the queries below.
RULES = [("/ththhe.example.com", "/mnt/a"), ("/ththon.example.com/en", "/mnt/b"), ("/ththon.example.com", "/mnt/c"), ("/blog", "/mnt/d")]
ROOTS = [("s1", "l1", 1, "/ththhe.example.com"), ("s1", "l2", 2, "/ththhe.example.com/en"), ("s2", "l3", 1, "/ththhe.example.com/fr"),
         ("s2", "l4", 2, "/ththon.example.com"), ("s3", "l5", 1, "/thther.example.org/en"), ("s3", "l6", 2, "/thther.example.org")]
EXCLUDES = [("/ththhe.example.com/de", "path"), ("/en/[0-9]*7", "regex"), ("([", "regex")]

PATHS_SQL = """p AS (SELECT page_id, regexp_replace('/' || regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '(.)/$', '\\1') AS path FROM pages)"""
_roots_sql = "roots(server, library, ord, root) AS (VALUES " + ", ".join(str(r) for r in ROOTS) + ")"


def _moved_sql(a: str, b: str) -> str:
    return f"CASE WHEN path = '{a}' OR starts_with(path, '{a}/') THEN '{b}' || path[{len(a) + 1}:] END"


def query(name: str, sql: str):
    def register(function):
        QUERIES[name], ORACLES[name] = function, sql
        return function

    return register


def page_paths(spark, sf_dir) -> DataFrame:
    path = F.concat(F.lit("/"), F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1))
    return table(spark, sf_dir, "pages").select("page_id", paths.normalised(path).alias("path"))


def roots(spark) -> DataFrame:
    return spark.createDataFrame(ROOTS, "server string, library string, ord int, root string")


@query("p1_canonical_path", f"WITH {PATHS_SQL} SELECT page_id, coalesce({', '.join(_moved_sql(a, b) for a, b in RULES)}, path) AS local FROM p")
def canonical_path(spark, sf_dir):
    return page_paths(spark, sf_dir).select("page_id", paths.rewritten(F.col("path"), RULES).alias("local"))


_BOTH = ", ".join(x for a, b in RULES for x in (_moved_sql(a, b), _moved_sql(b, a)))


@query("p2_candidates", f"""WITH {PATHS_SQL}, c AS (SELECT page_id, list_filter([path, {_BOTH}], lambda x: x IS NOT NULL) AS all_c FROM p)
    SELECT page_id, list_filter(all_c, lambda x, i: list_position(all_c, x) = i) AS candidates FROM c""")
def path_candidates(spark, sf_dir):
    return page_paths(spark, sf_dir).select("page_id", paths.candidates(F.col("path"), RULES).alias("candidates"))


_ONE = ", ".join(_moved_sql(a, b) for a, b in RULES)


@query("p3_server_to_local", f"""WITH {PATHS_SQL}, c AS (SELECT page_id, path, list_filter([{_ONE}], lambda x: x IS NOT NULL) AS found FROM p)
    SELECT page_id, CASE WHEN len(found) = 0 THEN [path] ELSE found END AS local FROM c""")
def server_to_local(spark, sf_dir):
    return page_paths(spark, sf_dir).select("page_id", paths.one_way(F.col("path"), RULES).alias("local"))


_INV = ", ".join(_moved_sql(b, a).replace("path", "local") for a, b in RULES)


@query("p4_local_to_server", f"""WITH {PATHS_SQL}, l AS (SELECT page_id, coalesce({_ONE}, path) AS local FROM p),
    c AS (SELECT page_id, local, list_filter([{_INV}], lambda x: x IS NOT NULL) AS found FROM l)
    SELECT page_id, CASE WHEN len(found) = 0 THEN [local] ELSE found END AS remote FROM c""")
def local_to_server(spark, sf_dir):
    local = paths.rewritten(F.col("path"), RULES)
    back = [(b, a) for a, b in RULES]
    rows = page_paths(spark, sf_dir).select("page_id", local.alias("local"))
    return rows.select("page_id", paths.one_way(F.col("local"), back).alias("remote"))


@query("p6_webhook_aliases", f"WITH {PATHS_SQL} SELECT page_id, list_filter([{_ONE}], lambda x: x IS NOT NULL AND x <> path) AS aliases FROM p")
def webhook_aliases(spark, sf_dir):
    path = F.col("path")
    found = F.array_compact(F.array(*[paths.moved(path, a, b) for a, b in RULES]))
    return page_paths(spark, sf_dir).select("page_id", F.filter(found, lambda x: x != path).alias("aliases"))


@query("p7_prefix_test", f"WITH {PATHS_SQL} SELECT page_id, path = '/ththhe.example.com' OR starts_with(path, '/ththhe.example.com/') AS below FROM p")
def prefix_test(spark, sf_dir):
    return page_paths(spark, sf_dir).select("page_id", paths.under(F.col("path"), "/ththhe.example.com").alias("below"))


@query("p10_items_to_rows", f"""WITH {PATHS_SQL}, c AS (SELECT page_id, path, list_filter([{_ONE}], lambda x: x IS NOT NULL) AS found FROM p)
    SELECT page_id, unnest(CASE WHEN len(found) = 0 THEN [path] ELSE found END) AS local FROM c""")
def items_to_rows(spark, sf_dir):
    return page_paths(spark, sf_dir).select("page_id", F.explode(paths.one_way(F.col("path"), RULES)).alias("local"))


@query("p11_publisher_rows", """SELECT o_orderkey, l_suppkey, s_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0""")
def publisher_rows(spark, sf_dir):
    """Nested publishers, one row each, with names by id where known."""
    nested = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("publishers"))
    rows = table(spark, sf_dir, "orders").join(nested, F.col("o_orderkey") == F.col("l_orderkey"))
    known = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return rows.select("o_orderkey", F.explode("publishers").alias("l_suppkey")).join(known, "l_suppkey", "left")


@query("p12_status_outcome", """SELECT event_id, CASE event_type WHEN 'purchase' THEN 'generated' WHEN 'signup' THEN 'exists' WHEN 'view' THEN 'skipped'
    WHEN 'click' THEN 'pending' ELSE 'failed' END AS outcome FROM events""")
def status_outcome(spark, sf_dir):
    known = {"purchase": "generated", "signup": "exists", "view": "skipped", "click": "pending"}
    lookup = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    outcome = F.coalesce(F.try_element_at(lookup, F.col("event_type")), F.lit("failed"))
    return table(spark, sf_dir, "events").select("event_id", outcome.alias("outcome"))


@query("p13_kind_classify", """SELECT p_partkey, CASE WHEN contains(lower(p_type), 'promo') THEN 'sports' WHEN contains(lower(p_type), 'small') THEN 'show'
    WHEN contains(lower(p_type), 'large') THEN 'other' ELSE 'movie' END AS kind FROM part""")
def kind_classify(spark, sf_dir):
    low = F.lower("p_type")
    kind = F.when(low.contains("promo"), "sports").when(low.contains("small"), "show").when(low.contains("large"), "other").otherwise("movie")
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"))


_PAYLOAD_SQL = """CASE WHEN event_id % 4 = 0 THEN '{"NotificationType":"ItemAdded"}' WHEN event_id % 4 = 1 THEN '{"eventType":"Download","movie":{}}'
    WHEN event_id % 4 = 2 THEN '{"eventType":"Download","series":{}}' ELSE props END"""


def payloads(spark, sf_dir) -> DataFrame:
    n = F.col("event_id") % 4
    payload = (
        F.when(n == 0, '{"NotificationType":"ItemAdded"}').when(n == 1, '{"eventType":"Download","movie":{}}')
        .when(n == 2, '{"eventType":"Download","series":{}}').otherwise(F.col("props"))
    )
    return table(spark, sf_dir, "events").select("event_id", payload.alias("payload"))


@query("p14_payload_classify", f"""SELECT event_id, CASE WHEN json_exists(j, '$.NotificationType') THEN 'server' WHEN json_exists(j, '$.movie') THEN 'movie'
    WHEN json_exists(j, '$.series') THEN 'series' WHEN json_exists(j, '$.path') THEN 'path' ELSE 'unknown' END AS kind FROM (SELECT event_id, {_PAYLOAD_SQL} AS j FROM events)""")
def payload_classify(spark, sf_dir):
    """By the keys that are there, in a fixed order."""
    has = lambda key: F.array_contains(F.json_object_keys("payload"), key)
    kind = F.when(has("NotificationType"), "server").when(has("movie"), "movie").when(has("series"), "series").when(has("path"), "path").otherwise("unknown")
    return payloads(spark, sf_dir).select("event_id", kind.alias("kind"))


@query("p15_item_pin", "SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_partkey % 3 = 0 THEN l_suppkey END, CASE WHEN l_returnflag <> 'N' THEN l_partkey END) AS pin FROM lineitem")
def item_pin(spark, sf_dir):
    pin = F.coalesce(F.when(F.col("l_partkey") % 3 == 0, F.col("l_suppkey")), F.when(F.col("l_returnflag") != "N", F.col("l_partkey")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", pin.alias("pin"))


@query("f1_exclude_rules", f"""WITH {PATHS_SQL} SELECT page_id FROM p WHERE NOT (path = '/ththhe.example.com/de' OR starts_with(path, '/ththhe.example.com/de/')
    OR regexp_matches(path, '/en/[0-9]*7'))""")
def exclude_rules(spark, sf_dir):
    return page_paths(spark, sf_dir).where(~paths.excluded(F.col("path"), EXCLUDES)).select("page_id")


@query("f2_exclude_first_location", f"""WITH {PATHS_SQL} SELECT page_id FROM p WHERE page_id % 5 = 0 OR NOT (path = '/ththhe.example.com/de'
    OR starts_with(path, '/ththhe.example.com/de/') OR regexp_matches(path, '/en/[0-9]*7'))""")
def exclude_first_location(spark, sf_dir):
    """Only the first location is tested; items without any stay."""
    places = F.when(F.col("page_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("path", F.lit("/en/7")))
    first = F.try_element_at(places, F.lit(1))
    return page_paths(spark, sf_dir).where(~F.coalesce(paths.excluded(first, EXCLUDES), F.lit(False))).select("page_id")


@query("f5_selector_split", """SELECT list(s ORDER BY i) FILTER (regexp_full_match(s, '[0-9]+|[0-9a-f]{32}')) AS ids, list(s ORDER BY i) FILTER (NOT regexp_full_match(s, '[0-9]+|[0-9a-f]{32}')) AS titles
    FROM (SELECT min(r_regionkey) AS i, s FROM (SELECT r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN CAST(r_regionkey * 11 AS VARCHAR) ELSE r_name END AS s FROM region) GROUP BY s)""")
def selector_split(spark, sf_dir):
    s = F.when(F.col("r_regionkey") % 2 == 0, (F.col("r_regionkey") * 11).cast("string")).otherwise(F.col("r_name"))
    rows = table(spark, sf_dir, "region").groupBy(s.alias("s")).agg(F.min("r_regionkey").alias("i"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x.s)
    is_id = lambda x: x.rlike("^([0-9]+|[0-9a-f]{32})$")
    return rows.agg(whole.alias("w")).select(F.filter("w", is_id).alias("ids"), F.filter("w", lambda x: ~is_id(x)).alias("titles"))


@query("f12_extensions", f"WITH {PATHS_SQL} SELECT page_id, coalesce(lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) IN ('html', 'htm'), false) AS known FROM p")
def extensions(spark, sf_dir):
    return page_paths(spark, sf_dir).select("page_id", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin("html", "htm").alias("known"))


@query("j1_ownership", f"""WITH {PATHS_SQL}, {_roots_sql} SELECT path, server, arg_min(root, (ord, root)) AS root, arg_min(library, (ord, root)) AS library
    FROM p JOIN roots ON path = root OR starts_with(path, root || '/') GROUP BY 1, 2""")
def ownership(spark, sf_dir):
    all_paths = page_paths(spark, sf_dir).select("path").distinct()
    return paths.owners(all_paths, "path", roots(spark), "server", ["ord"]).select("path", "server", "root", "library")


@query("j2_owners_and_hints", f"""WITH {PATHS_SQL}, {_roots_sql}, found AS (SELECT path, server FROM p JOIN roots ON path = root OR starts_with(path, root || '/')
    UNION SELECT path, 's' || (page_id % 4) AS server FROM p WHERE page_id % 7 = 0)
    SELECT DISTINCT path, server FROM found WHERE server <> 's2' AND NOT (path = '/ththhe.example.com/de' OR starts_with(path, '/ththhe.example.com/de/') OR regexp_matches(path, '/en/[0-9]*7'))""")
def owners_and_hints(spark, sf_dir):
    rows = page_paths(spark, sf_dir)
    own = paths.owners(rows.select("path").distinct(), "path", roots(spark), "server", ["ord"]).select("path", "server")
    hints = rows.where("page_id % 7 = 0").select("path", F.concat(F.lit("s"), F.col("page_id") % 4).alias("server"))
    both = own.unionByName(hints).distinct()
    return both.where((F.col("server") != "s2") & ~paths.excluded(F.col("path"), EXCLUDES))


@query("j3_basename_then_path", f"""WITH {PATHS_SQL}, a AS (SELECT page_id, path, regexp_extract(path, '[^/]*$') AS base FROM p),
    b AS (SELECT page_id AS other, path AS other_path, regexp_extract(path, '[^/]*$') AS base FROM p)
    SELECT page_id, other FROM a JOIN b USING (base) WHERE path = other_path OR regexp_replace(path, '^/[^/]+', '') = regexp_replace(other_path, '^/[^/]+', '')""")
def basename_then_path(spark, sf_dir):
    """By alias: a hot file name in many folders makes no pairs, only the same alias does."""
    rows = page_paths(spark, sf_dir)
    alias = F.explode(F.array_union(F.array("path"), F.array(F.regexp_replace("path", "^/[^/]+", "")))).alias("alias")
    right = rows.select(F.col("page_id").alias("other"), alias)
    return rows.select("page_id", alias).join(right, "alias").select("page_id", "other").distinct()


@query("j5_first_candidate", f"""WITH {PATHS_SQL}, c AS (SELECT page_id, unnest([path, regexp_replace(path, '^/[^/]+', '/ththon.example.com')]) AS candidate, unnest([1, 2]) AS i FROM p),
    live AS (SELECT path, min(page_id) AS hit FROM p WHERE page_id % 3 = 0 GROUP BY 1) SELECT page_id, arg_min(hit, i) AS hit FROM c JOIN live ON candidate = path GROUP BY 1""")
def first_candidate(spark, sf_dir):
    """Of several candidates, tried in order, the first that is known."""
    rows = page_paths(spark, sf_dir)
    tried = rows.select(
        "page_id", F.posexplode(F.array("path", F.regexp_replace("path", "^/[^/]+", "/ththon.example.com"))).alias("i", "candidate")
    )
    live = rows.where("page_id % 3 = 0").groupBy(F.col("path").alias("candidate")).agg(F.min("page_id").alias("hit"))
    return tried.join(live, "candidate").groupBy("page_id").agg(F.min_by("hit", "i").alias("hit"))


@query("j7_identity_match", """SELECT c_custkey, CASE WHEN count(s_suppkey) = 1 THEN any_value(s_suppkey) END AS server FROM customer LEFT JOIN supplier ON s_nationkey = c_nationkey AND s_acctbal > 5000 GROUP BY 1""")
def identity_match(spark, sf_dir):
    """Exactly one match or none; ambiguity is refused."""
    servers = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy("s_nationkey").agg(
        F.when(F.count("*") == 1, F.first("s_suppkey")).alias("server")
    )
    rows = table(spark, sf_dir, "customer")
    return rows.join(servers, rows["c_nationkey"] == servers["s_nationkey"], "left").select("c_custkey", "server")


@query("j8_living_child", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O')")
def living_child(spark, sf_dir):
    living = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(living, "o_orderkey", "left_semi").select("o_orderkey")


@query("j9_parent_children", """SELECT a.conv_id, a.turn AS parent, b.turn AS child FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def parent_children(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    parents = rows.select("conv_id", F.col("turn").alias("parent"), (F.col("turn") + 1).alias("child"))
    return parents.join(rows.select("conv_id", F.col("turn").alias("child")), ["conv_id", "child"]).select("conv_id", "parent", "child")


@query("j10_orphan_artefacts", """SELECT l_orderkey, l_linenumber FROM lineitem l WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)
    AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def orphan_artefacts(spark, sf_dir):
    """What nothing live stands for, in folders that have anything live at all."""
    live = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    folders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    rows = table(spark, sf_dir, "lineitem").join(live, "l_suppkey", "left_anti").join(folders, "l_orderkey", "left_semi")
    return rows.select("l_orderkey", "l_linenumber")


@query("j11_orphan_logs", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_logs(spark, sf_dir):
    return logs.without(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("j12_contained_prefix", f"""WITH {PATHS_SQL}, v(needle) AS (VALUES ('/en'), ('/example.com/en'), ('/fr'), ('/de'))
    SELECT DISTINCT path, arg_max(needle, len(needle)) AS inside FROM p JOIN v ON contains(path, needle || '/') AND NOT starts_with(path, needle || '/') GROUP BY path, page_id""")
def contained_prefix(spark, sf_dir):
    """A known prefix inside a path but not at its start, the longest one; the list is a few literals."""
    needles = sorted(("/en", "/example.com/en", "/fr", "/de"), key=lambda n: (-len(n), n))
    path = F.col("path")
    inside = F.coalesce(*[F.when(path.contains(n + "/") & ~path.startswith(n + "/"), F.lit(n)) for n in needles])
    return page_paths(spark, sf_dir).select("path", inside.alias("inside")).where("inside IS NOT NULL").distinct()


@query("j14_freshness", """SELECT o_orderkey, count(l_orderkey) FILTER (l_quantity <= 5) = 0 AND (coalesce(bool_or(l_shipdate >= o_orderdate + INTERVAL 30 DAY), false)
    OR NOT coalesce(bool_or(l_discount > 0.05), false)) AS fresh FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def freshness(spark, sf_dir):
    """Fresh if all outputs exist and any journal entry matches, or none is usable."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    matches = F.col("l_shipdate") >= F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")
    fresh = (F.count_if(F.col("l_quantity") <= 5) == 0) & (
        F.coalesce(F.bool_or(matches), F.lit(False)) | ~F.coalesce(F.bool_or(F.col("l_discount") > 0.05), F.lit(False))
    )
    return rows.groupBy("o_orderkey").agg(fresh.alias("fresh"))


@query("j15_all_parts", "SELECT o_orderkey, count(l_orderkey) > 0 AND coalesce(bool_and(l_quantity > 3), false) AS complete FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def all_parts(spark, sf_dir):
    parts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_quantity") > 3).alias("all"))
    rows = table(spark, sf_dir, "orders").join(parts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select("o_orderkey", F.coalesce("all", F.lit(False)).alias("complete"))


@query("j17_longest_prefix", f"""WITH {PATHS_SQL}, {_roots_sql} SELECT path, arg_max(root, len(root)) AS root, arg_max(library, len(root)) AS library
    FROM (SELECT DISTINCT path FROM p) JOIN roots ON path = root OR starts_with(path, root || '/') GROUP BY 1""")
def longest_prefix(spark, sf_dir):
    return paths.longest_prefix(page_paths(spark, sf_dir).select("path").distinct(), "path", roots(spark)).select("path", "root", "library")


@query("d4_overlap_dedup", """WITH RECURSIVE b AS (SELECT l_orderkey AS o, l_linenumber AS n, [l_partkey % 7, l_suppkey % 7] AS places FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY n, places) AS i FROM b),
    f(o, i, seen, kept) AS (SELECT o, i, places, [n] FROM r WHERE i = 1 UNION ALL
        SELECT f.o, r.i, CASE WHEN list_has_any(f.seen, r.places) THEN f.seen ELSE f.seen || r.places END,
               CASE WHEN list_has_any(f.seen, r.places) THEN f.kept ELSE f.kept || [r.n] END FROM f JOIN r ON r.o = f.o AND r.i = f.i + 1)
    SELECT o, arg_max(kept, i) AS kept FROM f GROUP BY o""")
def overlap_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.array(F.col("l_partkey") % 7, F.col("l_suppkey") % 7).alias("places")
    )
    return folds.disjoint_first(rows, "o", "n", "n", "places")


@query("d5_enumeration_merge", """WITH e AS (SELECT user_id AS path, event_type AS server, event_id AS item, CASE WHEN event_id % 3 = 0 THEN '' ELSE 't' || event_id END AS title FROM events),
    s AS (SELECT path, server, max(item) AS item FROM e GROUP BY 1, 2)
    SELECT path, (SELECT arg_min(server, item) FROM e x WHERE x.path = s.path) AS server, map(list(server ORDER BY server), list(item ORDER BY server)) AS items,
           (SELECT arg_min(title, item) FROM e x WHERE x.path = s.path AND title <> '') AS title FROM s GROUP BY path""")
def enumeration_merge(spark, sf_dir):
    title = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("t"), "event_id"))
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("path"), F.col("event_type").alias("server"), F.col("event_id").alias("item"), title.alias("title"), F.col("event_id").alias("seq")
    )
    return folds.enumerated_once(rows, "path", "seq", "server", "item", "title")


_TTL = """WITH RECURSIVE e AS (SELECT user_id, event_type, epoch_us(ts) // 1000000 AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events),
    f(user_id, event_type, i, last, n) AS (SELECT user_id, event_type, i, t, 1 FROM e WHERE i = 1 UNION ALL
        SELECT f.user_id, f.event_type, e.i, CASE WHEN e.t - f.last >= 86400 THEN e.t ELSE f.last END, f.n + CASE WHEN e.t - f.last >= 86400 THEN 1 ELSE 0 END
        FROM f JOIN e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.i = f.i + 1)"""


@query("d6_ttl_dedup", f"{_TTL} SELECT user_id, event_type, CAST(max(n) AS BIGINT) AS accepted FROM f GROUP BY 1, 2")
def ttl_dedup(spark, sf_dir):
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    kept = chains.ttl_taken(table(spark, sf_dir, "events"), ["user_id", "event_type"], at, 86400)
    return kept.groupBy("user_id", "event_type").agg(F.count("*").alias("accepted"))


@query("d11_covered_episodes", """SELECT p_partkey FROM part WHERE NOT (p_size % 2 = 1 AND p_brand IN (SELECT p_brand FROM part WHERE p_size % 2 = 0 AND p_retailprice > 1500))""")
def covered_episodes(spark, sf_dir):
    """Episodes go where their show is there itself."""
    rows = table(spark, sf_dir, "part")
    shows = rows.where("p_size % 2 = 0 AND p_retailprice > 1500").select("p_brand").distinct()
    episodes = rows.where("p_size % 2 = 1").join(shows, "p_brand", "left_anti")
    return rows.where("p_size % 2 <> 1").select("p_partkey").unionByName(episodes.select("p_partkey"))


@query("a18_owners_per_server", f"""WITH {PATHS_SQL}, {_roots_sql}, o AS (SELECT DISTINCT path, server FROM p JOIN roots ON path = root OR starts_with(path, root || '/'))
    SELECT coalesce(server, 'none') AS server, count(*) AS n FROM (SELECT DISTINCT path FROM p) LEFT JOIN o USING (path) GROUP BY 1""")
def owners_per_server(spark, sf_dir):
    all_paths = page_paths(spark, sf_dir).select("path").distinct()
    own = paths.owners(all_paths, "path", roots(spark), "server", ["ord"]).select("path", "server")
    return all_paths.join(own, "path", "left").groupBy(F.coalesce("server", F.lit("none")).alias("server")).agg(F.count("*").alias("n"))


@query("o4_ranked_search", """SELECT p_partkey, score FROM (SELECT p_partkey, CASE WHEN lower(p_name) = 'blue' THEN 1.0 WHEN starts_with(lower(p_name), 'blue') THEN 0.8
    WHEN contains(lower(p_name), 'blue') THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM part) WHERE score >= 0.3 ORDER BY score DESC, p_partkey LIMIT 50""")
def ranked_search(spark, sf_dir):
    """Scored, floored, the best 50 with ties in input order."""
    score = search.parsed(spark, "blue").score(F.col("p_name"))
    rows = table(spark, sf_dir, "part").select("p_partkey", score.alias("score")).where("score >= 0.3")
    return rows.orderBy(F.desc("score"), "p_partkey").limit(50)


@query("o9_kind_order", """SELECT p_partkey FROM part ORDER BY CASE WHEN p_size < 10 THEN 0 WHEN p_size < 20 THEN 1 ELSE 2 END, p_partkey LIMIT 25""")
def kind_order(spark, sf_dir):
    rank = F.when(F.col("p_size") < 10, 0).when(F.col("p_size") < 20, 1).otherwise(2)
    return table(spark, sf_dir, "part").orderBy(rank, "p_partkey").limit(25).select("p_partkey")


@query("o10_listing_order", "SELECT p_partkey FROM part ORDER BY p_size >= 25, lower(p_name), p_partkey")
def listing_order(spark, sf_dir):
    return table(spark, sf_dir, "part").orderBy(F.col("p_size") >= 25, F.lower("p_name"), "p_partkey").select("p_partkey")


@query("u1_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    return a.union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("u2_intersect", "SELECT l_partkey AS k FROM lineitem INTERSECT SELECT p_partkey FROM part WHERE p_size > 25")
def intersect(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")).intersect(table(spark, sf_dir, "part").where("p_size > 25").select("p_partkey"))


@query("u3_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def difference(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf_dir, "orders").where("o_totalprice > 300000").select("o_custkey"))


@query("u4_multi_source", """SELECT 'c' AS source, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 's', s_suppkey, s_name FROM supplier""")
def multi_source(spark, sf_dir):
    """U4 and Q-L1."""
    a = table(spark, sf_dir, "customer").select(F.lit("c").alias("source"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    b = table(spark, sf_dir, "supplier").select(F.lit("s").alias("source"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return a.unionByName(b)


@query("x7_plain_key", "SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS key FROM part")
def plain_key(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.plain_key(F.col("p_name")).alias("key"))


@query("x5_episode_codes", "SELECT l_orderkey, l_linenumber, printf('S%02dE%02d', l_suppkey % 20, l_linenumber) AS code FROM lineitem")
def episode_codes(spark, sf_dir):
    code = T.episode_code((F.col("l_suppkey") % 20).cast("int"), F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", code.alias("code"))


@query("x11_priority", "SELECT o_orderkey, CASE WHEN o_orderpriority ILIKE '2-HIGH' THEN 1 WHEN o_orderpriority ILIKE '5-LOW' THEN 3 ELSE 2 END AS priority FROM orders")
def priority(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.priority(F.split_part("o_orderpriority", F.lit("-"), F.lit(2))).alias("priority"))


@query("x17_quiet_hours", "SELECT event_id FROM events WHERE hour(ts) * 60 + minute(ts) >= 1350 OR hour(ts) * 60 + minute(ts) < 390")
def quiet_hours(spark, sf_dir):
    """Within a window that goes past midnight."""
    now = F.hour("ts") * 60 + F.minute("ts")
    return table(spark, sf_dir, "events").where(T.in_window(now, T.minutes(F.lit("22:30")), T.minutes(F.lit("06:30")))).select("event_id")


@query("x19_backoff", """SELECT l_orderkey, l_linenumber, greatest(1, floor([60, 300, 900, 3600, 7200][least(l_linenumber, 5)] * greatest(0.5, l_quantity / 30))::BIGINT) AS wait FROM lineitem""")
def backoff(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.backoff(F.col("l_linenumber"), F.col("l_quantity")).alias("wait"))


@query("x20_clamps", "SELECT event_id, least(greatest(value, 10.0), 60.0) AS value FROM events")
def clamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.clamped(F.col("value"), 10.0, 60.0).alias("value"))


@query("x21_hash_keys", "SELECT doc_id, sha256(source || '/' || doc_id)[1:16] AS key, md5(text) AS frame FROM documents")
def hash_keys(spark, sf_dir):
    key = F.left(F.sha2(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).cast("binary"), 256), F.lit(16))
    return table(spark, sf_dir, "documents").select("doc_id", key.alias("key"), F.md5("text").alias("frame"))


@query("x22_guid_shard", "SELECT doc_id, md5(text)[1:1] || '/' || md5(text)[2:] AS place FROM documents")
def guid_shard(spark, sf_dir):
    """A path from a digest, its first digit a folder."""
    digest = F.md5("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", F.left(digest, F.lit(1)), F.substring(digest, 2, 31)).alias("place"))


@query("x24_json_fallbacks", f"""SELECT event_id, coalesce(j->>'$.NotificationType', j->>'$.eventType', j->>'$.k', 'none') AS first FROM (SELECT event_id, {_PAYLOAD_SQL} AS j FROM events)""")
def json_fallbacks(spark, sf_dir):
    path = lambda p: F.get_json_object("payload", p)
    first = F.coalesce(path("$.NotificationType"), path("$.eventType"), path("$.k"), F.lit("none"))
    return payloads(spark, sf_dir).select("event_id", first.alias("first"))


@query("x26_error_class", "SELECT doc_id, CASE WHEN regexp_matches(text, 'password|token') THEN 'secret' WHEN contains(text, '|') THEN 'table' WHEN regexp_matches(text, '[%&#$]{3}') THEN 'noise' ELSE 'plain' END AS class FROM documents")
def error_class(spark, sf_dir):
    """The first pattern of an ordered list decides."""
    text = F.col("text")
    kind = F.when(text.rlike("password|token"), "secret").when(text.contains("|"), "table").when(text.rlike("[%&#$]{3}"), "noise").otherwise("plain")
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("class"))


@query("x27_outcome_summary", """SELECT user_id, array_to_string(list_filter([CASE WHEN c > 0 THEN c || ' click' END, CASE WHEN e > 0 THEN e || ' error' END, CASE WHEN p > 0 THEN p || ' purchase' END], lambda x: x IS NOT NULL), ', ') AS summary
    FROM (SELECT user_id, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type = 'purchase') AS p FROM events GROUP BY 1)""")
def outcome_summary(spark, sf_dir):
    counted = lambda kind: F.count_if(F.col("event_type") == kind)
    part = lambda kind: F.when(counted(kind) > 0, F.concat(counted(kind), F.lit(f" {kind}")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.concat_ws(", ", part("click"), part("error"), part("purchase")).alias("summary"))


@query("t1_debounce", """WITH g AS (SELECT *, ts - lag(ts) OVER w >= INTERVAL 1 HOUR OR lag(ts) OVER w IS NULL AS fresh FROM events WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS session FROM g)
    SELECT event_type, user_id, min(ts) AS began, max(ts) + INTERVAL 1 HOUR AS fires, count(*) AS n FROM s GROUP BY event_type, user_id, session""")
def debounce(spark, sf_dir):
    """Each arrival restarts the clock of its key; a batch fires an hour after its last one."""
    rows = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    batches = rows.groupBy("event_type", "user_id", F.session_window("at", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return batches.select("event_type", "user_id", F.col("w.start").cast("timestamp_ntz").alias("began"), F.col("w.end").cast("timestamp_ntz").alias("fires"), "n")


@query("t5_chain_replay", """WITH RECURSIVE e AS (SELECT user_id, event_type AS ev, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    f(user_id, i, s) AS (SELECT user_id, CAST(0 AS BIGINT), 'scheduled' FROM (SELECT DISTINCT user_id FROM e) UNION ALL
        SELECT f.user_id, e.i, CASE WHEN f.s = 'scheduled' AND e.ev = 'view' THEN 'queued' WHEN f.s = 'queued' AND e.ev = 'click' THEN 'running'
            WHEN f.s = 'running' AND e.ev = 'purchase' THEN 'completed' WHEN f.s = 'running' AND e.ev = 'error' THEN 'scheduled' WHEN f.s = 'queued' AND e.ev = 'signup' THEN 'cancelled' ELSE f.s END
        FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
    SELECT user_id, arg_max(s, i) AS state FROM f GROUP BY 1""")
def chain_replay(spark, sf_dir):
    moves = {
        ("scheduled", "view"): "queued", ("queued", "click"): "running", ("running", "purchase"): "completed",
        ("running", "error"): "scheduled", ("queued", "signup"): "cancelled",
    }
    return chains.replayed(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", moves, "scheduled").drop("n")


#: Attempts of a retry chain until it is exhausted.
ATTEMPTS = 3


def chain_moves(attempts: int) -> dict[tuple[str, str], str]:
    """A retry chain with its attempts: waiting for a slot, running, tried again until exhausted; cancelled stays."""
    moves = {}
    for n in range(1, attempts + 1):
        again = f"scheduled {n + 1}" if n < attempts else "exhausted"
        moves |= {(f"scheduled {n}", "signup"): f"queued_for_slot {n}", (f"queued_for_slot {n}", "click"): f"running {n}", (f"scheduled {n}", "click"): f"running {n}"}
        moves |= {(f"running {n}", "error"): again, (f"running {n}", "view"): "completed"}
        moves |= {(f"{state} {n}", "purchase"): "cancelled" for state in ("scheduled", "queued_for_slot")}
    return moves | {("completed", "error"): "scheduled 1"}


@query("t5_retry_chain", f"""WITH RECURSIVE e AS (SELECT user_id, event_type AS ev, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    f(user_id, i, s, n) AS (SELECT user_id, CAST(0 AS BIGINT), 'scheduled', 1 FROM (SELECT DISTINCT user_id FROM e) UNION ALL
        SELECT f.user_id, e.i,
            CASE WHEN f.s = 'scheduled' AND e.ev = 'signup' THEN 'queued_for_slot' WHEN f.s IN ('scheduled', 'queued_for_slot') AND e.ev = 'click' THEN 'running'
                WHEN f.s IN ('scheduled', 'queued_for_slot') AND e.ev = 'purchase' THEN 'cancelled' WHEN f.s = 'running' AND e.ev = 'view' THEN 'completed'
                WHEN f.s = 'running' AND e.ev = 'error' THEN CASE WHEN f.n < {ATTEMPTS} THEN 'scheduled' ELSE 'exhausted' END
                WHEN f.s = 'completed' AND e.ev = 'error' THEN 'scheduled' ELSE f.s END,
            CASE WHEN f.s = 'running' AND e.ev = 'error' THEN f.n + 1 WHEN f.s = 'completed' AND e.ev = 'error' THEN 1 ELSE f.n END
        FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
    SELECT user_id, arg_max(s, i) AS state, CAST(CASE WHEN arg_max(s, i) IN ('scheduled', 'queued_for_slot', 'running') THEN arg_max(n, i) END AS INT) AS attempt, max(i) AS n FROM f GROUP BY 1""")
def retry_chain(spark, sf_dir):
    """T5 with slots, attempts and exhaustion; no key's events are ever in one place."""
    found = chains.replayed(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", chain_moves(ATTEMPTS), "scheduled 1")
    parts = F.split("state", " ")
    return found.select("user_id", parts[0].alias("state"), F.try_element_at(parts, F.lit(2)).cast("int").alias("attempt"), "n")


@query("h1_rule_audit", """SELECT n_nationkey, rule, wanted FROM nation, (VALUES ('region', 1), ('even', 0)) r(rule, wanted)
    WHERE (rule = 'region' AND n_regionkey <> wanted) OR (rule = 'even' AND n_nationkey % 2 <> wanted)""")
def rule_audit(spark, sf_dir):
    """One row per flag that isn't as recommended: the few rules are an array on each row."""
    rules = F.array(
        F.struct(F.lit("region").alias("rule"), F.col("n_regionkey").cast("int").alias("is_now"), F.lit(1).alias("wanted")),
        F.struct(F.lit("even").alias("rule"), (F.col("n_nationkey") % 2).cast("int").alias("is_now"), F.lit(0).alias("wanted")),
    )
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(rules).alias("r"))
    return rows.where("r.is_now <> r.wanted").select("n_nationkey", "r.rule", "r.wanted")


@query("h2_audit_counts", """SELECT count(*) FILTER (stopped) AS stopped, count(*) FILTER (NOT stopped) AS extracting, count(*) AS total FROM (
    SELECT l_suppkey, bool_and(l_quantity > 1) AS stopped FROM lineitem GROUP BY 1)""")
def audit_counts(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.bool_and(F.col("l_quantity") > 1).alias("stopped"))
    return per.agg(F.count_if("stopped").alias("stopped"), F.count_if(~F.col("stopped")).alias("extracting"), F.count("*").alias("total"))


@query("h4_mount_health", f"""WITH {PATHS_SQL}, {_roots_sql} SELECT root, CASE WHEN count(path) = 0 THEN 'missing' WHEN count(path) < 3 THEN 'empty' ELSE 'ok' END AS health
    FROM roots LEFT JOIN p ON path = root OR starts_with(path, root || '/') GROUP BY 1""")
def mount_health(spark, sf_dir):
    held = page_paths(spark, sf_dir).select(F.explode(paths.ancestors(F.col("path"))).alias("root")).groupBy("root").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return roots(spark).select("root").join(held, "root", "left").select("root", F.when(n == 0, "missing").when(n < 3, "empty").otherwise("ok").alias("health"))


@query("n1_hierarchy_leaves", """SELECT o_orderkey AS id, coalesce(l_linenumber, 0) AS leaf FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND o_orderstatus <> 'P'""")
def hierarchy_leaves(spark, sf_dir):
    """Parents become their leaves; those that aren't expanded stand for themselves."""
    rows, leaves = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    expanded = rows.join(leaves, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("o_orderstatus") != "P"), "left")
    return expanded.select(F.col("o_orderkey").alias("id"), F.coalesce("l_linenumber", F.lit(0)).alias("leaf"))


@query("n2_multi_version", """SELECT o_orderkey AS id, coalesce(l_suppkey, -1) AS version FROM orders LEFT JOIN (SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_quantity > 40) ON l_orderkey = o_orderkey""")
def multi_version(spark, sf_dir):
    sources = table(spark, sf_dir, "lineitem").where("l_quantity > 40").groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("sources"))
    rows = table(spark, sf_dir, "orders").join(sources, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select(F.col("o_orderkey").alias("id"), F.explode_outer("sources").alias("v")).select("id", F.coalesce("v", F.lit(-1)).alias("version"))


@query("n3_event_gate", """SELECT event_id, CASE WHEN event_type = 'signup' THEN 'test' WHEN user_id % 5 = 0 THEN 'disabled' WHEN event_type <> 'purchase' THEN 'ignored' ELSE 'process' END AS gate FROM events""")
def event_gate(spark, sf_dir):
    kind = F.col("event_type")
    gate = F.when(kind == "signup", "test").when(F.col("user_id") % 5 == 0, "disabled").when(kind != "purchase", "ignored").otherwise("process")
    return table(spark, sf_dir, "events").select("event_id", gate.alias("gate"))


@query("i2_ids_agree", """SELECT l_orderkey, CASE WHEN count(DISTINCT s_nationkey) = 1 AND count(*) = count(s_nationkey) THEN min(s_nationkey) END AS server
    FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 9 <> 0) ON s_suppkey = l_suppkey GROUP BY 1""")
def ids_agree(spark, sf_dir):
    """All ids known and of one server, else none. Least equals greatest, which needs no distinct count."""
    known = table(spark, sf_dir, "supplier").where("s_suppkey % 9 <> 0")
    rows = table(spark, sf_dir, "lineitem").join(known, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    agree = F.bool_and(F.col("s_nationkey").isNotNull()) & (F.min("s_nationkey") == F.max("s_nationkey"))
    return rows.groupBy("l_orderkey").agg(F.when(agree, F.min("s_nationkey")).alias("server"))


@query("r1_reconcile", """WITH want AS (SELECT n_nationkey AS k, CAST(n_nationkey % 4 AS BIGINT) AS wanted FROM nation), have AS (SELECT s_nationkey AS k, count(*) AS held FROM supplier GROUP BY 1)
    SELECT coalesce(w.k, h.k) AS k, greatest(coalesce(wanted, 0) - coalesce(held, 0), 0) AS to_add, greatest(coalesce(held, 0) - coalesce(wanted, 0), 0) AS to_drop FROM want w FULL JOIN have h ON w.k = h.k""")
def reconcile(spark, sf_dir):
    want = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") % 4).cast("long").alias("wanted"))
    have = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("held"))
    gap = F.coalesce("wanted", F.lit(0)) - F.coalesce("held", F.lit(0))
    return want.join(have, "k", "full").select("k", F.greatest(gap, F.lit(0)).alias("to_add"), F.greatest(-gap, F.lit(0)).alias("to_drop"))


@query("r2_tracker_cleanup", """SELECT c_custkey FROM customer WHERE c_acctbal < 5000 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def tracker_cleanup(spark, sf_dir):
    used = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return logs.without(table(spark, sf_dir, "customer").where("c_acctbal < 5000"), used, "c_custkey").select("c_custkey")


@query("r3_retry_budget", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 4 = 0 THEN 7 END, CASE WHEN c_mktsegment = 'BUILDING' THEN 5 END, 3) AS budget FROM customer")
def retry_budget(spark, sf_dir):
    budget = F.coalesce(F.when(F.col("c_custkey") % 4 == 0, 7), F.when(F.col("c_mktsegment") == "BUILDING", 5), F.lit(3))
    return table(spark, sf_dir, "customer").select("c_custkey", budget.alias("budget"))


@query("r4_record_migration", """SELECT s_suppkey, s_name AS name, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE s_acctbal END AS balance, 13 AS version FROM supplier""")
def record_migration(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").withColumnRenamed("s_name", "name")
    return rows.select("s_suppkey", "name", F.when(F.col("s_acctbal") < 0, 0.0).otherwise(F.col("s_acctbal")).alias("balance"), F.lit(13).alias("version"))
