"""Secret scans with multipart credential linking, in DataFrame operations only.

Strong spans are found by pattern alone: assignments to secret names, access identifiers, long hexadecimal runs. Weaker
candidates (account names, bare keys, endpoints) mean little by themselves. They are linked with complementary parts by
an interval join within their scope, the same document and at most ``reach`` code points between the two, and only
those with such a part are reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written

#: The kinds in the order in which ties are listed, and their patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ACCOUNT = r"""(?i:(access_?key_?id|client_?id|user_?name|user|login|account))["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
BARE_KEY = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}"
ENDPOINT = r"""(?i:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3|ssh|ftp)://[^\x20\x09-\x0D"'<>]+"""
KINDS = ("assign", "access", "hex", "account", "bare_key", "endpoint")
#: Which roles complete a weak kind: an account needs a secret, a bare key an identifier, an endpoint either.
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "account": "identifier", "bare_key": "secret", "endpoint": "endpoint"}
COMPLETES = {"account": ("secret",), "bare_key": ("identifier",), "endpoint": ("secret", "identifier")}
_BLOCK = 64


def found(text: Column, pattern: str, kind: str) -> Column:
    """Spans (start, stop, kind_no, kind, hit) of a pattern's matches in code points, leftmost, not overlapping.

    What lies between the matches gives their places: start is the sum of all that comes before. Sums are taken by
    blocks, so that a text with very many matches doesn't add up from the beginning for each.
    """
    quoted = F.lit(pattern)
    between = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, quoted, F.lit(0))
    steps = F.zip_with(between, hits, lambda b, h: F.length(b) + F.coalesce(F.length(h), F.lit(0)))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(hits) / _BLOCK).cast("int")),
        lambda b: total(F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK))),
    )

    def span(hit: Column, i: Column) -> Column:
        block = F.floor(i / _BLOCK).cast("int")
        before = total(F.slice(blocks, F.lit(1), block)) + total(F.slice(steps, block * _BLOCK + 1, i % _BLOCK))
        start = (before + F.length(F.element_at(between, i + 1))).cast("long")
        return F.struct(
            start.alias("start"),
            (start + F.length(hit)).alias("stop"),
            F.lit(KINDS.index(kind)).alias("kind_no"),
            F.lit(kind).alias("kind"),
            hit.alias("hit"),
        )

    none = F.array().cast("array<struct<start:bigint,stop:bigint,kind_no:int,kind:string,hit:string>>")
    return F.when(text.rlike(pattern), F.transform(hits, span)).otherwise(none)


def listed(spans: Column) -> Column:
    """kind:start:stop by start, then kind as listed, joined by commas."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s.start, s.kind_no, s.stop, s.kind)))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s.kind, s.start, s.stop)), ",")


def parts(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text), base spans and weak spans that no base span overlaps; without the texts."""
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    assigned = F.filter(found(text, ASSIGN, "assign"), lambda s: F.length(F.regexp_extract(s.hit, ASSIGN, 2)) >= 6)
    base = F.concat(assigned, found(text, ACCESS, "access"), found(text, HEX, "hex"))
    weak = F.concat(
        found(text, ACCOUNT, "account"), found(text, BARE_KEY, "bare_key"), found(text, ENDPOINT, "endpoint")
    )
    slim = lambda spans: F.transform(spans, lambda s: s.dropFields("hit"))
    return (
        rows.select("doc_id", F.xxhash64("text").alias("mark"), slim(base).alias("base"), slim(weak).alias("weak"))
        .withColumn("weak", F.filter("weak", lambda w: ~F.exists("base", lambda b: (w.start < b.stop) & (b.start < w.stop))))
    )


def linked(scanned: DataFrame, reach: int) -> DataFrame:
    """doc_id, mark, weak: the weak spans that a complementary part is within ``reach`` of.

    Spans meet in the blocks of ``reach`` code points that they touch, widened by one block for the weak side.
    """
    own = scanned.where("size(weak) > 0").select("doc_id", "mark", "base", "weak").distinct()
    role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    span = own.select("doc_id", "mark", F.explode(F.concat("base", "weak")).alias("s"))
    first, last = F.floor(F.col("s.start") / reach), F.floor(F.col("s.stop") / reach)
    others = span.select(
        "doc_id", "mark", F.col("s").alias("other"), F.element_at(role, F.col("s.kind")).alias("role"),
        F.explode(F.sequence(first, last)).alias("block"),
    )
    wanted = F.create_map(*[x for k, v in COMPLETES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    weak = span.where(F.col("s.kind").isin(*COMPLETES)).select(
        "doc_id", "mark", "s", F.explode(F.sequence(F.greatest(first - 1, F.lit(0)), last + 1)).alias("block")
    )
    near = (F.col("other.start") - F.col("s.stop") <= reach) & (F.col("s.start") - F.col("other.stop") <= reach)
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.mark") == F.col("r.mark"))
    return (
        weak.alias("l")
        .join(
            others.alias("r"),
            same & (F.col("l.block") == F.col("r.block")) & near
            & F.array_contains(F.element_at(wanted, F.col("s.kind")), F.col("role")),
            "left_semi",
        )
        .groupBy("doc_id", "mark")
        .agg(F.collect_set("s").alias("reported"))
    )


def scan(docs: DataFrame, reach: int = 256) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    The base kinds count and are digested alone; ``spans`` lists them with the weak ones that were linked. Null text
    counts as empty, which has no spans and the digest of the empty string. Null doc_ids are carried along; rows that
    repeat doc_id and text come back alike. Empty table: no rows. Columns other than doc_id and text are not read.
    """
    scanned = written(parts(docs), "secret-parts")
    extra = written(linked(scanned, reach), "linked-parts")
    same = scanned["doc_id"].eqNullSafe(extra["doc_id"]) & (scanned["mark"] == extra["mark"])
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    reported = F.coalesce("reported", F.slice("base", 1, 0))
    return scanned.join(extra, same, "left").select(
        scanned["doc_id"],
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.concat("base", reported)).alias("spans"),
        F.size(reported).cast("long").alias("n_linked"),
    )
