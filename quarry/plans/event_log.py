"""Queries over the event log: outcome policies, counts, pages, caps and windows.

An event stands for one entry of a result log: (user_id, event_type) is its key, ``event_type`` its outcome,
(ts, event_id) its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators import logs
from quarry.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Outcomes from best to worst.
PRECEDENCE = ["purchase", "signup", "click", "view", "error"]
RANK_SQL = "CASE event_type " + " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(PRECEDENCE)) + " ELSE 5 END"
ORDER = ["ts", "event_id"]


def query(name: str, sql: str):
    def register(function):
        QUERIES[name], ORACLES[name] = function, sql
        return function

    return register


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("s1_job_scan", "SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders ORDER BY o_orderdate, o_orderkey")
def job_scan(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus").orderBy("o_orderdate", "o_orderkey")


@query("s2_row_decode", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k FROM events")
def row_decode(spark, sf_dir):
    decoded = F.from_json("props", "k long", {"mode": "PERMISSIVE"})
    return events(spark, sf_dir).select("event_id", F.coalesce(decoded["k"], F.lit(-1)).alias("k"))


@query("s3_row_count", "SELECT count(*) AS n FROM orders")
def row_count(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("n"))


_LINES_SQL = """
    lines AS (SELECT event_id, ts, CASE WHEN event_id % 11 = 0 THEN '{"broken' ELSE
                json_object('user', user_id, 'outcome', event_type)::VARCHAR END AS line FROM events),
    parsed AS (SELECT event_id, ts, CAST(line->>'$.user' AS BIGINT) AS user_id, line->>'$.outcome' AS outcome
               FROM lines WHERE json_valid(line))
"""


def parsed_lines(spark, sf_dir) -> DataFrame:
    """The log as JSON lines, one in eleven broken; broken lines are skipped, not fatal."""
    whole = F.to_json(F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("outcome")))
    line = F.when(F.col("event_id") % 11 == 0, '{"broken').otherwise(whole)
    record = F.from_json(line, "user long, outcome string, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    return (
        events(spark, sf_dir)
        .select("event_id", "ts", record.alias("r"))
        .where("r IS NOT NULL AND r._corrupt_record IS NULL")
        .select("event_id", "ts", F.col("r.user").alias("user_id"), "r.outcome")
    )


@query("s4_json_import", f"WITH {_LINES_SQL} SELECT user_id, count(*) AS n FROM parsed GROUP BY 1")
def json_import(spark, sf_dir):
    return parsed_lines(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))


@query("s5_filter_then_dedup", f"""WITH {_LINES_SQL} SELECT user_id, max(event_id) AS event_id FROM (
    SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM parsed WHERE outcome <> 'error' GROUP BY user_id)
    GROUP BY user_id""")
def filter_then_dedup(spark, sf_dir):
    rows = parsed_lines(spark, sf_dir).where("outcome <> 'error'")
    return logs.last_wins(rows, ["user_id"], ORDER).select("user_id", "event_id")


@query("s5_dedup_then_filter", f"""WITH {_LINES_SQL}, last AS (
    SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(outcome, (ts, event_id)) AS outcome
    FROM parsed GROUP BY user_id) SELECT user_id, event_id FROM last WHERE outcome <> 'error'""")
def dedup_then_filter(spark, sf_dir):
    return logs.last_wins(parsed_lines(spark, sf_dir), ["user_id"], ORDER).where("outcome <> 'error'").select("user_id", "event_id")


@query("s6_tail_scan", "SELECT event_id, ts FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 64) ORDER BY ts, event_id")
def tail_scan(spark, sf_dir):
    return logs.tail(events(spark, sf_dir).select("event_id", "ts"), ORDER, 64)


@query("s7_log_page", "SELECT event_id, event_type FROM events ORDER BY ts, event_id LIMIT 25 OFFSET 100")
def log_page(spark, sf_dir):
    return logs.page(events(spark, sf_dir), [F.col(c) for c in ORDER], 100, 25).select("event_id", "event_type")


@query("s17_keyframe_lines", """SELECT event_id, CAST(split_part(line, ',', 1) AS DOUBLE) AS pts, split_part(line, ',', 2) LIKE 'K%' AS key_frame
    FROM (SELECT event_id, CAST(event_id AS VARCHAR) || '.5,' || CASE WHEN event_id % 3 = 0 THEN 'K__' ELSE '___' END AS line FROM events)""")
def keyframe_lines(spark, sf_dir):
    flags = F.when(F.col("event_id") % 3 == 0, "K__").otherwise("___")
    line = F.concat(F.col("event_id").cast("string"), F.lit(".5,"), flags)
    record = F.from_csv(line, "pts double, flags string")
    return events(spark, sf_dir).select("event_id", record["pts"].alias("pts"), record["flags"].startswith("K").alias("key_frame"))


@query("s19_layered_setting", """SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE '' END, ''),
    nullif(CASE WHEN c_custkey % 5 = 0 THEN 'env' ELSE '' END, ''), 'default') AS setting FROM customer""")
def layered_setting(spark, sf_dir):
    """A setting, else the environment's, else a default; an empty string counts as missing."""
    setting = F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise("")
    environment = F.when(F.col("c_custkey") % 5 == 0, "env").otherwise("")
    first = F.coalesce(F.nullif(setting, F.lit("")), F.nullif(environment, F.lit("")), F.lit("default"))
    return table(spark, sf_dir, "customer").select("c_custkey", first.alias("setting"))


@query("k1_upsert", """SELECT o_custkey AS id, arg_min(o_orderdate, (o_orderdate, o_orderkey)) AS created_at,
    arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS seq
    FROM orders GROUP BY 1""")
def upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderkey").alias("seq"), F.col("o_orderdate").alias("at"),
    )
    old, new = rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1")
    return logs.upsert(old, new, "id", "created_at", ["at", "seq"]).drop("at")


@query("k2_delete_terminal", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def delete_terminal(spark, sf_dir):
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return logs.without(table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'"), returned, "o_orderkey").select("o_orderkey")


@query("k3_bulk_rewrite", "SELECT o_orderkey, CASE WHEN o_custkey % 10 = 3 THEN 7 ELSE o_custkey END AS owner FROM orders")
def bulk_rewrite(spark, sf_dir):
    owner = F.when(F.col("o_custkey") % 10 == 3, 7).otherwise(F.col("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", owner.cast("long").alias("owner"))


@query("k4_capped_append", """SELECT user_id, event_id, CASE WHEN nth > 3 THEN 'truncated:' || event_type ELSE event_type END AS event_type
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nth FROM events) WHERE nth <= 4""")
def capped_append(spark, sf_dir):
    rows = logs.capped(events(spark, sf_dir), ["user_id", "event_type"], ORDER, 3, "event_type")
    return rows.select("user_id", "event_id", "event_type")


@query("k5_backup_retention", """SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth
    FROM events) WHERE nth <= 5 AND ts >= TIMESTAMP '2024-01-20'""")
def backup_retention(spark, sf_dir):
    """The newest five copies of each, of which none is older than the limit."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = events(spark, sf_dir).withColumn("nth", F.row_number().over(newest))
    return rows.where("nth <= 5 AND ts >= TIMESTAMP_NTZ '2024-01-20 00:00:00'").select("user_id", "event_id")


@query("k7_tile_sheets", "SELECT event_id, event_id // 100 AS sheet, (event_id % 100) // 10 AS tile_row, event_id % 10 AS tile_col FROM events")
def tile_sheets(spark, sf_dir):
    """Frame to sheet, row and column."""
    return events(spark, sf_dir).selectExpr("event_id", "event_id div 100 AS sheet", "event_id % 100 div 10 AS tile_row", "event_id % 10 AS tile_col")


@query("k11_history_ring", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def history_ring(spark, sf_dir):
    return events(spark, sf_dir).orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "ts", "event_type")


@query("d1_last_wins", """SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2""")
def last_wins(spark, sf_dir):
    return logs.last_wins(events(spark, sf_dir), ["user_id", "event_type"], ORDER).select("user_id", "event_type", "event_id")


@query("d1_blank_rows_stay", """SELECT path, event_id FROM (SELECT CASE WHEN user_id % 4 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS path, event_id, ts FROM events)
    QUALIFY path = '' OR row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) = 1""")
def blank_rows_stay(spark, sf_dir):
    path = F.when(F.col("user_id") % 4 == 0, "").otherwise(F.col("user_id").cast("string"))
    rows = events(spark, sf_dir).select(path.alias("path"), "event_id", "ts")
    return logs.last_wins_keeping_blank(rows, "path", ORDER).select("path", "event_id")


@query("d2_best_wins", f"SELECT user_id, arg_min(event_id, ({RANK_SQL}, ts, event_id)) AS event_id, arg_min(event_type, ({RANK_SQL}, ts, event_id)) AS event_type FROM events GROUP BY 1")
def best_wins(spark, sf_dir):
    rank = logs.rank_of(F.col("event_type"), PRECEDENCE)
    return logs.best_wins(events(spark, sf_dir), ["user_id"], rank, ORDER).select("user_id", "event_id", "event_type")


@query("d3_first_wins", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def first_wins(spark, sf_dir):
    return logs.first_wins(events(spark, sf_dir), ["user_id"], ORDER).select("user_id", "event_id")


@query("d8_ordered_distinct", """SELECT user_id, list(event_type ORDER BY first_at, first_id) AS kinds FROM (
    SELECT user_id, event_type, min(ts) AS first_at, arg_min(event_id, (ts, event_id)) AS first_id FROM events GROUP BY 1, 2) GROUP BY 1""")
def ordered_distinct(spark, sf_dir):
    """Each value once, at its first place: values first meet their earliest place, so the arrays stay small."""
    firsts = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "event_type")))
    return firsts.groupBy("user_id").agg(F.transform(ordered, lambda x: x.event_type).alias("kinds"))


@query("d9_claim_once", "SELECT user_id, event_type, count(*) > 0 AS claimed FROM events GROUP BY 1, 2")
def claim_once(spark, sf_dir):
    return events(spark, sf_dir).select("user_id", "event_type").distinct().withColumn("claimed", F.lit(True))


@query("d10_late_fill", """SELECT user_id, arg_min(event_type, (ts, event_id)) FILTER (WHERE event_type <> 'view') AS first_name FROM events GROUP BY 1""")
def late_fill(spark, sf_dir):
    """The first non-empty value in log order."""
    name = F.when(F.col("event_type") != "view", F.col("event_type"))
    first = F.min_by(name, F.when(name.isNotNull(), F.struct(*ORDER)))
    return events(spark, sf_dir).groupBy("user_id").agg(first.alias("first_name"))


@query("a2_counts_per_key", """SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'view') AS views,
    count(*) FILTER (event_type IN ('click', 'view', 'purchase') AND value > 50) AS gated FROM events GROUP BY 1""")
def counts_per_key(spark, sf_dir):
    kind = F.col("event_type")
    return events(spark, sf_dir).groupBy("user_id").agg(
        F.count_if(kind == "click").alias("clicks"), F.count_if(kind == "view").alias("views"),
        F.count_if(kind.isin("click", "view", "purchase") & (F.col("value") > 50)).alias("gated"),
    )


@query("a3_chain_merge", f"""WITH best AS (SELECT user_id, CAST(ts AS DATE) AS day, arg_min(event_type, ({RANK_SQL}, ts, event_id)) AS outcome
    FROM events GROUP BY 1, 2) SELECT user_id, outcome, count(*) AS n FROM best GROUP BY 1, 2""")
def chain_merge(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    best = logs.best_wins(rows, ["user_id", "day"], logs.rank_of(F.col("event_type"), PRECEDENCE), ORDER)
    return best.groupBy("user_id", F.col("event_type").alias("outcome")).agg(F.count("*").alias("n"))


@query("a4_map_fan_in", "SELECT event_type AS outcome, count(*) AS n FROM events GROUP BY 1")
def map_fan_in(spark, sf_dir):
    """Maps of counts, one a user, added up by key."""
    kinds = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = kinds.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("counts"))
    return maps.select(F.explode("counts").alias("outcome", "c")).groupBy("outcome").agg(F.sum("c").alias("n"))


@query("a5_pending_from_map", "SELECT user_id, CAST(count(*) FILTER (event_type IN ('view', 'click')) AS BIGINT) AS pending FROM events GROUP BY 1")
def pending_from_map(spark, sf_dir):
    kinds = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    counts = F.map_from_entries(F.collect_list(F.struct("event_type", "n")))
    waiting = F.map_values(F.map_filter(counts, lambda k, v: k.isin("view", "click")))
    return kinds.groupBy("user_id").agg(F.aggregate(waiting, F.lit(0).cast("long"), lambda s, x: s + x).alias("pending"))


@query("a6_pending_last_wins", """SELECT event_type, count(*) AS n FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1) GROUP BY 1""")
def pending_last_wins(spark, sf_dir):
    return logs.last_wins(events(spark, sf_dir), ["user_id"], ORDER).groupBy("event_type").agg(F.count("*").alias("n"))


@query("a7_status_cascade", """SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'published' WHEN bool_and(event_type = 'error') THEN 'failed'
    WHEN bool_and(event_type IN ('view', 'click')) THEN 'not_indexed' ELSE 'skipped' END AS status FROM events GROUP BY 1""")
def status_cascade(spark, sf_dir):
    kind = F.col("event_type")
    status = (
        F.when(F.bool_or(kind == "purchase"), "published")
        .when(F.bool_and(kind == "error"), "failed")
        .when(F.bool_and(kind.isin("view", "click")), "not_indexed")
        .otherwise("skipped")
    )
    return events(spark, sf_dir).groupBy("user_id").agg(status.alias("status"))


@query("a8_class_counts", """SELECT user_id, count(*) FILTER (event_type IN ('purchase', 'signup')) AS good, count(*) FILTER (event_type = 'error') AS bad,
    count(*) FILTER (event_type IN ('view', 'click')) AS other FROM events GROUP BY 1""")
def class_counts(spark, sf_dir):
    kind = F.col("event_type")
    return events(spark, sf_dir).groupBy("user_id").agg(
        F.count_if(kind.isin("purchase", "signup")).alias("good"), F.count_if(kind == "error").alias("bad"),
        F.count_if(kind.isin("view", "click")).alias("other"),
    )


@query("a9_completion_class", """SELECT user_id, CASE WHEN bad > 0 AND good = 0 THEN 'error' WHEN bad > 0 THEN 'warning' ELSE 'ok' END AS class FROM (
    SELECT user_id, count(*) FILTER (event_type = 'error') AS bad, count(*) FILTER (event_type IN ('purchase', 'signup')) AS good FROM events GROUP BY 1)""")
def completion_class(spark, sf_dir):
    kind = F.col("event_type")
    sums = events(spark, sf_dir).groupBy("user_id").agg(
        F.count_if(kind == "error").alias("bad"), F.count_if(kind.isin("purchase", "signup")).alias("good")
    )
    result = F.when((F.col("bad") > 0) & (F.col("good") == 0), "error").when(F.col("bad") > 0, "warning").otherwise("ok")
    return sums.select("user_id", result.alias("class"))


@query("a10_size_stats", "SELECT source, min(n_chars) AS least, max(n_chars) AS most, CAST(round_even(avg(n_chars), 0) AS BIGINT) AS mean FROM documents GROUP BY 1")
def size_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.bround(F.avg("n_chars"), 0).cast("long").alias("mean")
    )


@query("a11_largest_gap", """SELECT user_id, max(gap) AS gap FROM (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap
    FROM events) GROUP BY 1""")
def largest_gap(spark, sf_dir):
    in_order = Window.partitionBy("user_id").orderBy(*ORDER)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return events(spark, sf_dir).withColumn("gap", at - F.lag(at).over(in_order)).groupBy("user_id").agg(F.max("gap").alias("gap"))


@query("a12_adjacent_duplicates", """SELECT source, count(*) FILTER (same) AS same, count(*) AS pairs, count(*) FILTER (same) * 20 > count(*) AS over FROM (
    SELECT source, md5(text) = lag(md5(text)) OVER (PARTITION BY source ORDER BY doc_id) AS same FROM documents) WHERE same IS NOT NULL GROUP BY 1""")
def adjacent_duplicates(spark, sf_dir):
    """How many rows repeat the one before, and whether they are over a twentieth."""
    rows = logs.with_previous(table(spark, sf_dir, "documents").select("source", "doc_id", F.md5("text").alias("digest")), "source", "doc_id", "digest")
    rows = rows.select("source", (F.col("digest") == F.col("previous")).alias("same")).where("same IS NOT NULL")
    return rows.groupBy("source").agg(
        F.count_if("same").alias("same"), F.count("*").alias("pairs"), (F.count_if("same") * 20 > F.count("*")).alias("over")
    )


@query("a13_duration_check", "SELECT o_orderkey, abs(count(*) - any_value(o_orderkey) % 7) > 2 AS off FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def duration_check(spark, sf_dir):
    """Counted items against what was expected, off by more than two."""
    counted = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    joined = table(spark, sf_dir, "orders").join(counted, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select("o_orderkey", (F.abs(F.col("n") - F.col("o_orderkey") % 7) > 2).alias("off"))


@query("a14_in_flight", "SELECT event_type, round(sum(CASE WHEN user_id % 2 = 0 THEN least(greatest(value, 0), 100) / 100 ELSE 0 END), 4) AS fraction FROM events GROUP BY 1")
def in_flight(spark, sf_dir):
    share = F.when(F.col("user_id") % 2 == 0, F.least(F.greatest("value", F.lit(0.0)), F.lit(100.0)) / 100).otherwise(0.0)
    return events(spark, sf_dir).groupBy("event_type").agg(F.round(F.sum(share), 4).alias("fraction"))


@query("a15_progress", "SELECT user_id, CASE WHEN count(*) FILTER (value > 20) = 0 THEN 0.0 ELSE round(100.0 * count(*) FILTER (event_type = 'view' AND value > 20) / count(*) FILTER (value > 20), 3) END AS percent FROM events GROUP BY 1")
def progress(spark, sf_dir):
    total = F.count_if(F.col("value") > 20)
    done = F.count_if((F.col("event_type") == "view") & (F.col("value") > 20))
    share = F.when(total == 0, F.lit(0.0)).otherwise(F.round(F.lit(100.0) * done / F.nullif(total, F.lit(0)), 3))
    return events(spark, sf_dir).groupBy("user_id").agg(share.alias("percent"))


@query("a16_having", "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) > 2 AND max(value) > 10")
def having(spark, sf_dir):
    grouped = events(spark, sf_dir).where("event_type = 'error'").groupBy("user_id")
    return grouped.agg(F.count("*").alias("n"), F.max("value").alias("top")).where("n > 2 AND top > 10").select("user_id", "n")


@query("a17_worker_totals", "SELECT CAST(sum(CASE WHEN p_size > 10 THEN p_size ELSE 0 END) AS BIGINT) AS enabled, max(p_size) AS most FROM part")
def worker_totals(spark, sf_dir):
    return table(spark, sf_dir, "part").agg(
        F.sum(F.when(F.col("p_size") > 10, F.col("p_size")).otherwise(0)).alias("enabled"), F.max("p_size").alias("most")
    )


@query("a19_duration_clamped", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE greatest(0, epoch(s) - epoch(o_orderdate) - 864000)::BIGINT END AS seconds
    FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE s IS NOT NULL""")
def duration_clamped(spark, sf_dir):
    shipped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("s"))
    seconds = F.unix_timestamp(F.col("s").cast("timestamp")) - F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) - 864000
    joined = table(spark, sf_dir, "orders").join(shipped, F.col("o_orderkey") == F.col("l_orderkey"))
    clamped = F.when(F.col("o_orderstatus") != "O", F.greatest(F.lit(0), seconds))
    return joined.select("o_orderkey", clamped.cast("long").alias("seconds"))


@query("o1_job_list_order", """SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END,
    CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END, CASE WHEN o_orderstatus = 'O' THEN o_orderdate END,
    CASE WHEN o_orderstatus = 'F' THEN -epoch_us(o_orderdate) END, o_orderkey) AS place FROM orders""")
def job_list_order(spark, sf_dir):
    """Running first, then waiting by priority and age, then ended by time, newest first."""
    status = F.col("o_orderstatus")
    waiting, ended = status == "O", status == "F"
    keys = [
        F.when(status == "P", 0).when(waiting, 1).otherwise(2),
        F.when(waiting, F.col("o_orderpriority")),
        F.when(waiting, F.col("o_orderdate")),
        F.when(ended, -F.unix_micros(F.col("o_orderdate").cast("timestamp"))),
        F.col("o_orderkey"),
    ]
    return logs.placed(table(spark, sf_dir, "orders").select("*"), keys, "place").select("o_orderkey", "place")


@query("o2_attempt_order", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate) AS attempt FROM lineitem")
def attempt_order(spark, sf_dir):
    chain = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_shipdate")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(chain).cast("long").alias("attempt"))


@query("o3_page_beyond_end", "SELECT event_id FROM events ORDER BY event_id LIMIT 50 OFFSET 100000000")
def page_beyond_end(spark, sf_dir):
    return logs.page(events(spark, sf_dir), [F.col("event_id")], 100_000_000, 50).select("event_id")


@query("o3_page_clamped", "SELECT event_id FROM events ORDER BY event_id LIMIT 60 OFFSET (SELECT ((count(*) + 59) // 60 - 1) * 60 FROM events)")
def page_clamped(spark, sf_dir):
    return logs.clamped_page(events(spark, sf_dir), [F.col("event_id")], 100_000_000, 60).select("event_id")


@query("o5_priority_pick", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 1")
def priority_pick(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(1).select("o_orderkey")


@query("o6_admission_gate", """SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS nth,
    count(*) FILTER (o_orderstatus = 'P') OVER (PARTITION BY o_custkey) AS active FROM orders WHERE o_orderstatus <> 'F' ORDER BY 1) WHERE o_orderstatus = 'O'
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) <= 3 - active""")
def admission_gate(spark, sf_dir):
    """As many waiting jobs per gate as its cap leaves beside the active ones."""
    rows = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    active = F.count_if(F.col("o_orderstatus") == "P").over(Window.partitionBy("o_custkey"))
    waiting = rows.withColumn("active", active).where("o_orderstatus = 'O'")
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderkey"))
    return waiting.withColumn("nth", nth).where("nth <= 3 - active").select("o_custkey", "o_orderkey")


@query("o7_newest_first", "SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id")
def newest_first(spark, sf_dir):
    return table(spark, sf_dir, "documents").orderBy(F.desc("n_chars"), "doc_id").select("doc_id")


@query("f6_visible_jobs", """SELECT event_id FROM events WHERE NOT (event_type = 'error' AND CAST(props->>'$.k' AS BIGINT) % 2 = 0) OR event_id % 10 = 0""")
def visible_jobs(spark, sf_dir):
    """Retries are hidden unless they head their chain."""
    retry = (F.col("event_type") == "error") & (F.get_json_object("props", "$.k").cast("long") % 2 == 0)
    return events(spark, sf_dir).where(~retry | (F.col("event_id") % 10 == 0)).select("event_id")


@query("f7_recency_window", """SELECT event_id FROM (SELECT event_id, TRY_CAST(CASE WHEN event_id % 6 = 0 THEN 'never' ELSE CAST(ts AS VARCHAR) END AS TIMESTAMP) AS made FROM events)
    WHERE coalesce(made >= TIMESTAMP '2024-01-30' - INTERVAL 72 HOUR, false)""")
def recency_window(spark, sf_dir):
    """Rows whose time can't be read are not recent."""
    text = F.when(F.col("event_id") % 6 == 0, "never").otherwise(F.col("ts").cast("string"))
    made = F.try_to_timestamp(text).cast("timestamp_ntz")
    recent = F.coalesce(made >= F.expr("TIMESTAMP_NTZ '2024-01-30 00:00:00' - INTERVAL 72 HOURS"), F.lit(False))
    return events(spark, sf_dir).where(recent).select("event_id")


@query("f8_recent_or_undated", """SELECT event_id FROM events WHERE event_id % 6 = 0 OR ts >= TIMESTAMP '2024-01-25'""")
def recent_or_undated(spark, sf_dir):
    """Here rows without a time pass."""
    made = F.when(F.col("event_id") % 6 != 0, F.col("ts"))
    return events(spark, sf_dir).where(made.isNull() | (made >= F.expr("TIMESTAMP_NTZ '2024-01-25 00:00:00'"))).select("event_id")


@query("f9_level_and_cursor", """SELECT event_id FROM events WHERE CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END >= 2
    AND strftime(ts, '%Y-%m-%d %H:%M:%S') < '2024-01-10 12:00:00'""")
def level_and_cursor(spark, sf_dir):
    """Levels compare by rank, cursors as text."""
    rank = logs.rank_of(F.col("event_type"), ["view", "click", "signup", "purchase"])
    before = F.date_format("ts", "yyyy-MM-dd HH:mm:ss") < "2024-01-10 12:00:00"
    return events(spark, sf_dir).where((rank >= 2) & before).select("event_id")


@query("f10_filter_search_page", """SELECT doc_id FROM documents WHERE lang = 'en' AND contains(lower(text), 'erth') ORDER BY doc_id LIMIT 20 OFFSET 20""")
def filter_search_page(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where((F.col("lang") == "en") & F.lower("text").contains("erth"))
    return logs.page(rows, [F.col("doc_id")], 20, 20).select("doc_id")


@query("f11_suppressed", """SELECT event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
    AND user_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)""")
def suppressed(spark, sf_dir):
    """Drops what either of two sets lists (also H5)."""
    lasting = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    session = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("user_id"))
    return logs.without(events(spark, sf_dir), lasting.unionByName(session), "user_id").select("event_id")


@query("f13_unknown_kept", "SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS kind FROM events) WHERE kind IS NULL OR kind NOT IN ('view', 'error')")
def unknown_kept(spark, sf_dir):
    kind = F.when(F.col("event_id") % 5 != 0, F.col("event_type"))
    return events(spark, sf_dir).where(kind.isNull() | ~kind.isin("view", "error")).select("event_id")


@query("f14_suspect_frames", """SELECT source, list(doc_id ORDER BY doc_id)[1:50] AS small FROM documents WHERE n_chars < 500 GROUP BY 1""")
def suspect_frames(spark, sf_dir):
    """The first 50 ids of what is too small: cut by rank, so no long list is ever gathered."""
    nth = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    rows = table(spark, sf_dir, "documents").where("n_chars < 500").withColumn("nth", nth).where("nth <= 50")
    return rows.groupBy("source").agg(F.array_sort(F.collect_list("doc_id")).alias("small"))


@query("t8_retention", """SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND strftime(o_orderdate, '%Y-%m-%d') < '1996-01-01')""")
def retention(spark, sf_dir):
    """Ended jobs older than the limit go; times compare as text."""
    old = F.date_format("o_orderdate", "yyyy-MM-dd") < "1996-01-01"
    return table(spark, sf_dir, "orders").where(~((F.col("o_orderstatus") == "F") & old)).select("o_orderkey")


@query("t9_restart_recovery", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'failed' WHEN o_orderstatus = 'O' AND o_orderkey % 4 = 0 THEN 'dropped'
    WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'kept' END AS state FROM orders""")
def restart_recovery(spark, sf_dir):
    status = F.col("o_orderstatus")
    state = (
        F.when(status == "P", "failed").when((status == "O") & (F.col("o_orderkey") % 4 == 0), "dropped")
        .when(status == "O", "pending").otherwise("kept")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", state.alias("state"))
