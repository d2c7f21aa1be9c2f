"""The named queries of the corpus operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontamination, edit_fingerprints, exact_dedup, hard_negatives, line_dedup, packing, ranked_search, secret_scan, sharding, simhash, substring_dedup, toxicity, url_lists
from quarry.llm.common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"), shingle=4, radius=4)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", capacity=2048)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=24)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), width=35).drop("kept_text")


#: The dated list events of the URL query: list, key (host suffix, or host and leading path), action, day.
LIST_EVENTS = (
    ("spam", "example.net", "add", "2024-02-01"),
    ("spam", "example.net", "remove", "2024-05-15"),
    ("spam", "example.net", "add", "2024-09-01"),
    ("spam", "ththon.example.com", "add", "2024-01-20"),
    ("spam", "ththhe.example.com/de", "add", "2024-03-10"),
    ("spam", "ththhe.example.com/de", "remove", "2024-11-01"),
    ("adult", "blog.tionble.example.com", "add", "2024-04-01"),
    ("adult", "blog.tionble.example.com", "add", "2024-05-01"),
    ("adult", "blog.tionble.example.com", "remove", "2024-08-01"),
    ("adult", "blog.ththth.example.org", "add", "2024-01-01"),
    ("adult", "blog.ththth.example.org", "remove", "2024-01-01"),
    ("allow", "tionsh.example.net", "add", "2024-03-01"),
    ("allow", "tionsh.example.net/fr", "add", "2024-02-10"),
    ("allow", "m.ththed.example.net", "add", "2024-10-01"),
    ("allow", "m.ththed.example.net", "remove", "2024-12-01"),
)


def op9_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages carry no fetch time: page n counts as fetched on day 37 n mod 366 of 2024."""
    events = spark.createDataFrame(list(LIST_EVENTS), "list_name string, key string, action string, day string")
    day = F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")
    captures = table(spark, sf_dir, "pages").select(
        "page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), day).alias("fetched_on")
    )
    return url_lists.judge(captures, events.select("list_name", "key", "action", F.to_date("day").alias("effective_on")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seventh of the rows counts under the next label, so that near rows of other labels are there to be mined."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.select("vec_id", label.alias("label"), "embedding"))


def op13_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprints.fingerprint(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_simhash": op4_simhash,
    "op5_packing": op5_packing,
    "op6_sharding": op6_sharding,
    "op7_decontamination": op7_decontamination,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_url_lists": op9_url_lists,
    "op10_line_dedup": op10_line_dedup,
    "op11_ranked_search": op11_ranked_search,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_edit_fingerprints": op13_edit_fingerprints,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"

ORACLES: dict[str, str] = {
    "op2_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256({_LOWER}) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY {_LOWER})
    """,
    "op8_substring_dedup": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id,
                   list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
            FROM documents),
        windows AS (
            SELECT r, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h
            FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
        repeated AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY h) > 1),
        gone AS (SELECT r, list(DISTINCT p) AS ps FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM repeated) GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed,
               sha256(array_to_string(list_filter(w, lambda x, i: ps IS NULL OR NOT list_contains(ps, i)), ' ')) AS kept_sha256
        FROM d LEFT JOIN gone USING (r)
    """,
    "op9_url_lists": f"""
        WITH events(list_name, key, action, day) AS (VALUES {", ".join(str(e) for e in LIST_EVENTS)}),
        daily AS (
            SELECT list_name, lower(key) AS key, CAST(day AS DATE) AS day, max(action) AS action
            FROM events GROUP BY ALL),
        captures AS (
            SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INT) AS fetched_on,
                   regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)', 1) AS rest
            FROM pages),
        hosts AS (
            SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/]*)', 1)), '^.*@', ''),
                                     ':[0-9]*$', '') AS host,
                   list_filter(string_split(regexp_replace(rest, '^[^/]*/?', ''), '/'), lambda p: p <> '') AS path
            FROM captures),
        keyed AS (
            SELECT DISTINCT page_id, url, fetched_on, unnest(
                list_transform(range(1, len(string_split(host, '.')) + 1),
                               lambda i: array_to_string(string_split(host, '.')[i:], '.'))
                || list_transform(range(1, len(path) + 1), lambda i: host || '/' || array_to_string(path[1:i], '/'))
            ) AS key
            FROM hosts WHERE host <> ''),
        names AS (SELECT DISTINCT list_name FROM events),
        latest AS (
            SELECT k.page_id, k.url, k.fetched_on, k.list_name || ':' || k.key AS entry, d.action
            FROM (SELECT * FROM keyed, names) k
            ASOF JOIN daily d ON k.key = d.key AND k.list_name = d.list_name AND k.fetched_on >= d.day),
        found AS (
            SELECT page_id, url, fetched_on, list_sort(list(entry)) AS active
            FROM latest WHERE action = 'add' GROUP BY ALL)
        SELECT h.page_id, h.url, h.fetched_on, coalesce(f.active, []) AS active,
               CASE WHEN len(list_filter(coalesce(f.active, []), lambda x: starts_with(x, 'allow:'))) > 0 THEN 'allowed'
                    WHEN len(coalesce(f.active, [])) > 0 THEN 'blocked' ELSE 'clear' END AS verdict
        FROM hosts h LEFT JOIN found f
          ON h.page_id IS NOT DISTINCT FROM f.page_id AND h.url IS NOT DISTINCT FROM f.url
         AND h.fetched_on IS NOT DISTINCT FROM f.fetched_on
    """,
    "op11_ranked_search": rf"""
        WITH docs AS (
            SELECT doc_id, regexp_extract_all({_LOWER}, {_TERM}) AS terms FROM documents),
        found AS (SELECT doc_id, terms, len(terms) AS n FROM docs WHERE len(terms) > 0),
        total AS (SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS length FROM found),
        counted AS (
            SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM found) GROUP BY ALL),
        weights AS (
            SELECT term, CAST(floor(1000 * ln((2 * any_value(documents) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
            FROM counted, total GROUP BY term),
        asked AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, {_TERM})) AS term FROM benchmark),
        scored AS (
            SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * documents) // length)))) AS BIGINT) AS score
            FROM asked JOIN weights USING (term) JOIN counted USING (term), total GROUP BY ALL)
        SELECT item_id, CAST(row_number() OVER w AS INT) AS rank, doc_id, score FROM scored WHERE score > 0
        WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 50
    """,
    "op12_hard_negatives": """
        WITH rows AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike,
                   CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
            FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, vec_id AS negative_id, positive_score,
               score AS negative_score
        FROM positives JOIN scored USING (anchor_id)
        WHERE NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
    """,
}
