"""Queries over paged services, sinks and streams: the given tables are published, written or streamed first.

A line item stands for an item of a library (its return flag): titled by its order, placed by its part and supplier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import hooks, logs, lookups, polls, scans
from quarry.sources import inbox, paged, published
from quarry.sources.tables import new_place, table, written
from quarry.streaming import webhooks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
ITEMS = "library string, position long, id long, title string, show string, code string, added long, locations array<string>, path string"
#: The libraries: id, title, kind, enabled.
LIBRARIES = (("A", "Films", "movie", True), ("N", "Series", "episode", True), ("R", "Pictures", "photo", False))
EXCLUDED = [("/lib/N/3", "path"), ("/p5$", "regex")]
MAPPED = [("/lib/A", "/mnt/films"), ("/lib", "/srv/lib"), ("/lib/N", "/mnt/series")]


def query(name: str, sql: str | None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


def service(spark: SparkSession, sf_dir: str) -> str:
    """A service over the line items, newest first in each library, published in the shared folder; its path.

    The table's own numbers are placed and moved; the items' texts are made from them where a page is written.
    """
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("library"),
        F.col("l_orderkey").alias("o"),
        F.col("l_linenumber").alias("n"),
        (F.col("l_partkey") % 7).alias("p"),
        (F.col("l_suppkey") % 7).alias("s"),
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("added"),
    )
    number = F.col("o") * 10 + F.col("n")
    order = F.col("o").cast("string")
    base = F.concat(F.lit("/lib/"), F.col("library"), F.lit("/"), order)
    place = lambda letter: F.concat(base, F.lit(f"/{letter}"), F.col(letter).cast("string"))
    shape = [
        number.alias("id"),
        F.concat(F.lit("t"), order).alias("title"),
        F.concat(F.lit("Show "), order).alias("show"),
        F.concat(F.lit("s01e0"), F.col("n").cast("string")).alias("code"),
        F.col("added"),
        F.array(place("p"), place("s")).alias("locations"),
        F.when(F.col("n") % 5 > 0, base).alias("path"),
    ]
    at = new_place(spark, "service")
    known = spark.createDataFrame(LIBRARIES, "library string, title string, kind string, enabled boolean")
    paged.publish(logs.placed(rows, ["library", -F.col("added"), number], "place"), known, at, shape=shape, compression="gzip")
    return at


_ITEMS_SQL = """items AS (SELECT l_returnflag AS library, l_orderkey * 10 + l_linenumber AS id, l_orderkey AS o, 't' || l_orderkey AS title,
    'Show ' || l_orderkey || ' S01E0' || l_linenumber AS episode, CAST(epoch(l_shipdate) AS BIGINT) AS added,
    '/lib/' || l_returnflag || '/' || l_orderkey AS base, l_partkey % 7 AS p, l_suppkey % 7 AS s, l_linenumber AS n FROM lineitem)"""


@query("s11_library_scan", f"""WITH RECURSIVE {_ITEMS_SQL},
    open AS (SELECT * FROM items WHERE library <> 'R' AND NOT (base = '/lib/N/3' OR p = 5)),
    e AS (SELECT *, ['p' || p, 's' || s] AS places, row_number() OVER (PARTITION BY o ORDER BY added DESC, id) AS i FROM open WHERE library = 'N'),
    f(o, i, seen, kept) AS (SELECT o, i, places, [i] FROM e WHERE i = 1 UNION ALL
        SELECT f.o, e.i, CASE WHEN list_has_any(f.seen, e.places) THEN f.seen ELSE f.seen || e.places END,
               CASE WHEN list_has_any(f.seen, e.places) THEN f.kept ELSE f.kept || [e.i] END FROM f JOIN e ON e.o = f.o AND e.i = f.i + 1),
    kept AS (SELECT o, unnest(kept) AS i FROM (SELECT o, arg_max(kept, i) AS kept FROM f GROUP BY o))
    SELECT library, 'Series' AS library_title, id, episode AS title, 'episode' AS kind FROM e JOIN kept USING (o, i)
    UNION ALL SELECT library, 'Films', id, title, 'movie' FROM open WHERE library = 'A'""")
def library_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two libraries in scope, newest first, excluded by first location, episodes deduplicated by location."""
    at = service(spark, sf_dir)
    found = scans.library_scan(paged.items(spark, at, ITEMS), paged.libraries(spark, at), ids=["A", "N", "R"], sort="newest", rules=EXCLUDED)
    return found.drop("place_key")


@query("s12_canonical_rows", f"""WITH {_ITEMS_SQL}
    SELECT unnest(CASE WHEN library = 'A' THEN [replace(base, '/lib/A', '/mnt/films'), '/srv' || base] ELSE ['/srv' || base, replace(base, '/lib/N', '/mnt/series')] END) AS canonical_path,
           's1' AS server_id, id AS item_id, title, library AS library_id FROM items WHERE library <> 'R' AND n % 5 > 0""")
def canonical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enabled libraries, one row an item and mapped path."""
    at = service(spark, sf_dir)
    return scans.canonical_rows(paged.items(spark, at, ITEMS), paged.libraries(spark, at), "s1", MAPPED)


@query("s9_parameterised_items", f"""WITH {_ITEMS_SQL} SELECT id, title, added FROM items WHERE library = 'A' AND added >= 880000000""")
def parameterised_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query by parameters, library and least time, that the source answers with the pages that can hold them."""
    return scans.recent(paged.items(spark, service(spark, sf_dir), ITEMS), 880_000_000, ["A"]).select("id", "title", "added")


@query("s10_section_locations", f"""WITH {_ITEMS_SQL} SELECT id, unnest([base || '/p' || p, base || '/s' || s]) AS location FROM items WHERE library = 'N'""")
def section_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section's items, one row a location."""
    section = paged.items(spark, service(spark, sf_dir), ITEMS).where("library = 'N'")
    return scans.located(section).select("id", "location")


@query("d4_overlap_rounds", """WITH RECURSIVE b AS (SELECT l_orderkey AS o, l_linenumber AS n, [l_partkey % 7, l_suppkey % 7] AS places FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY n, places) AS i FROM b),
    f(o, i, seen, kept) AS (SELECT o, i, places, [n] FROM r WHERE i = 1 UNION ALL
        SELECT f.o, r.i, CASE WHEN list_has_any(f.seen, r.places) THEN f.seen ELSE f.seen || r.places END,
               CASE WHEN list_has_any(f.seen, r.places) THEN f.kept ELSE f.kept || [r.n] END FROM f JOIN r ON r.o = f.o AND r.i = f.i + 1)
    SELECT o, unnest(arg_max(kept, i)) AS n FROM f GROUP BY o""")
def overlap_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D4 without a group in one place: rounds of joins."""
    from quarry.operators import folds

    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.array(F.col("l_partkey") % 7, F.col("l_suppkey") % 7).alias("places")
    )
    return folds.disjoint_rows(rows.withColumn("turn", F.struct("n", "places")), "o", "turn", "places").select("o", "n")


@query("e3_published_table", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority FROM orders")
def published_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table published twice through the sink; what is read is the second version, whole."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    at = new_place(spark, "published")
    published.publish(orders.where("o_orderstatus <> 'F'"), at)
    published.publish(orders, at)
    return published.published(spark, at, orders.schema)


@query("k5_rotated_versions", """SELECT r_regionkey + 1 AS version, CAST((SELECT count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <= r_regionkey) AS BIGINT) AS n,
    (SELECT max(s_suppkey) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <= r_regionkey) AS latest FROM region WHERE r_regionkey >= 2""")
def rotated_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: five versions saved, of which three are kept and can be read."""
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
    at = new_place(spark, "rotated")
    for region in range(5):
        published.publish(rows.where(F.col("n_regionkey") <= region), at, keep=3)
    kept = [published.published(spark, at, rows.schema, v["version"]).withColumn("version", F.lit(v["version"])) for v in published.versions(at)]
    all_rows = kept[0]
    for other in kept[1:]:
        all_rows = all_rows.unionByName(other)
    return all_rows.groupBy(F.col("version").cast("int").alias("version")).agg(F.count("*").alias("n"), F.max("s_suppkey").alias("latest"))


@query("k10_pushed_events", "SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('error', 'purchase')")
def pushed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over the event log pushes what ended or failed into an outbox, then runs again and adds nothing."""
    at = new_place(spark, "outbox")
    spark.dataSource.register(published.OutboxSource)
    schema, folder = table(spark, sf_dir, "events").schema, _folder_of(spark, sf_dir, "events")
    for _ in range(2):
        stream = spark.readStream.schema(schema).parquet(folder)
        ended = stream.where("event_type IN ('error', 'purchase')").select("event_id", "user_id", "event_type")
        run = ended.writeStream.format("quarry_outbox").option("path", at).option("checkpointLocation", f"{at}/_checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
    return published.pushed(spark, at, ended.schema)


def _folder_of(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A stream reads folders: the table is written into one of its own."""
    at = new_place(spark, f"{name}-folder")
    table(spark, sf_dir, name).write.parquet(at)
    return at


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each event, in order: seven routes by number, the event's type as that of the payload."""
    n, user, kind = F.col("event_id"), F.col("user_id").cast("string"), F.col("event_type")
    arr = F.when(kind == "view", "Test").when(kind == "click", "Grab").otherwise("Download")
    body = lambda **fields: F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    part = lambda **fields: F.struct(*[v.alias(k) for k, v in fields.items()])
    number = n.cast("string")
    file = lambda a, b="": F.concat(F.lit(a), number, F.lit(b))
    old = F.array(part(path=file("/old/", ".mkv"), relativePath=F.lit(None).cast("string")), part(path=F.lit(None).cast("string"), relativePath=F.lit("../b.mkv")))
    bodies = [
        body(eventType=arr, movie=part(title=F.concat(F.lit("M"), user), folderPath=F.lit("/m/x")), movieFile=part(relativePath=file("y/../f", ".mkv")), deletedFiles=old),
        body(eventType=arr, series=part(title=F.concat(F.lit("S"), user), path=F.lit("/tv")), episodeFile=part(path=file(" /tv/e")), episodes=F.array(part(seasonNumber=n % 30, episodeNumber=n % 120))),
        body(eventType=arr, eventTitle=F.concat(F.lit("Cup "), user), filePath=F.when(kind == "error", "").otherwise(file("/sp/"))),
        body(event=F.when(kind == "view", "media.play").otherwise("library.new"), Server=part(uuid=user), Metadata=part(type=F.lit("movie"), title=F.lit("T"), year=n % 3, ratingKey=number)),
        body(eventType=F.when(kind == "view", "Test").otherwise("Any"), file_paths=F.array(file("/c//"), file("/c/"), F.lit(" "))),
        F.when(kind == "view", F.lit("no json")).otherwise(body(NotificationType=F.when(kind == "click", "Play").otherwise("ItemAdded"), ItemId=number, ServerId=user)),
        body(path=F.when(kind == "error", "").otherwise(file("/p/"))),
    ]
    routes = ["radarr", "sonarr", "sportarr", "plex", "custom", "incoming", None]
    at = n % 7
    chosen = F.coalesce(*[F.when(at == k, b) for k, b in enumerate(bodies)])
    route = F.coalesce(*[F.when(at == k, r) for k, r in enumerate(routes) if r], F.concat(F.lit("server/s"), (n % 3).cast("string")))
    nothing = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "events").select(
        n.alias("event_id"), route.alias("route"), F.when(at == 0, user).alias("pin"), F.when(at == 3, chosen).otherwise(nothing).alias("form"), F.when(at != 3, chosen).alias("body")
    )
    return logs.placed(rows, ["event_id"], "place")


@query("s18_webhook_stream", """WITH e AS (SELECT event_id AS n, user_id AS u, event_type AS k, event_id % 7 AS way FROM events),
    o AS (SELECT *, CASE way WHEN 0 THEN CASE k WHEN 'view' THEN 'test' WHEN 'click' THEN 'ignored' ELSE 'queued' END
        WHEN 1 THEN CASE k WHEN 'view' THEN 'test' WHEN 'click' THEN 'ignored' ELSE 'queued' END
        WHEN 2 THEN CASE k WHEN 'view' THEN 'test' WHEN 'click' THEN 'ignored' WHEN 'error' THEN 'ignored_no_path' ELSE 'queued' END
        WHEN 3 THEN CASE k WHEN 'view' THEN 'ignored' ELSE 'resolve' END
        WHEN 4 THEN CASE k WHEN 'view' THEN 'test' ELSE 'queued' END
        WHEN 5 THEN CASE k WHEN 'view' THEN 'invalid' WHEN 'click' THEN 'ignored' ELSE 'resolve' END
        ELSE CASE n % 3 WHEN 2 THEN 'not_configured' WHEN 1 THEN 'server_disabled' ELSE CASE k WHEN 'error' THEN 'ignored_no_path' ELSE 'queued' END END END AS outcome FROM e)
    SELECT CASE way WHEN 0 THEN 'radarr' WHEN 1 THEN 'sonarr' WHEN 2 THEN 'sportarr' WHEN 3 THEN 'plex' WHEN 4 THEN 'custom' WHEN 5 THEN 'incoming' ELSE 'server/s' || n % 3 END AS route,
        CASE way WHEN 0 THEN 'radarr' WHEN 1 THEN 'sonarr' WHEN 2 THEN 'sportarr' WHEN 3 THEN 'plex' WHEN 4 THEN 'custom' WHEN 5 THEN CASE k WHEN 'view' THEN 'unknown' ELSE 'jellyfin' END ELSE 'path' END AS kind,
        outcome,
        CASE WHEN outcome IN ('queued', 'resolve', 'ignored_no_path') THEN CASE way WHEN 0 THEN 'M' || u
            WHEN 1 THEN 'S' || u || ' S' || lpad(CAST(n % 30 AS VARCHAR), 2, '0') || 'E' || CASE WHEN n % 120 < 10 THEN '0' ELSE '' END || n % 120
            WHEN 2 THEN 'Cup ' || u WHEN 3 THEN CASE WHEN n % 3 = 0 THEN 'T' ELSE 'T (' || n % 3 || ')' END WHEN 4 THEN CAST(n AS VARCHAR) END END AS title,
        CASE WHEN outcome = 'queued' THEN CASE way WHEN 0 THEN '/m/x/f' || n || '.mkv' WHEN 1 THEN '/tv/e' || n WHEN 2 THEN '/sp/' || n WHEN 4 THEN '/c/' || n ELSE '/p/' || n END ELSE '' END AS paths,
        CASE WHEN outcome = 'queued' AND way = 0 THEN '/old/' || n || '.mkv,/m/b.mkv' ELSE '' END AS deleted,
        CASE way WHEN 0 THEN CAST(u AS VARCHAR) WHEN 6 THEN 's' || n % 3 END AS server, CASE WHEN way = 3 OR (way = 5 AND k <> 'view') THEN CAST(u AS VARCHAR) END AS identity,
        CASE WHEN way = 3 OR (way = 5 AND k <> 'view') THEN CAST(n AS VARCHAR) END AS item_id FROM o""")
def webhook_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests arrive in segments; the stream is started, stopped and started again, and pushes typed rows once."""
    box, out = new_place(spark, "inbox"), new_place(spark, "hooks")
    spark.dataSource.register(published.OutboxSource)
    rows = requests(spark, sf_dir).drop("event_id")
    half = rows.agg(F.coalesce(F.floor(F.max("place") / 2000) * 1000, F.lit(0))).first()[0]
    parts = (rows.where(F.col("place") <= half), rows.where(F.col("place") > half).withColumn("place", F.col("place") - half))
    join = lambda name: F.array_join(name, ",")
    for k, part in enumerate(parts):
        inbox.fill(part, box, first=k * half // 1000)
        typed = hooks.routed(inbox.stream(spark, box), servers={"s0": True, "s1": False}).select(
            "route", "kind", "outcome", "title", join("paths").alias("paths"), join("deleted_paths").alias("deleted"), "server", "identity", "item_id"
        )
        run = typed.writeStream.format("quarry_outbox").option("path", out).option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
    return published.pushed(spark, out, typed.schema)


#: What the lookup asks for is cut from the parts' own paths by their number: as it is, deeper, elsewhere, by another name.
_LOOKUP_SQL = r"""WITH items AS (SELECT p_partkey AS item, '/lib/' || p_brand AS root, CASE WHEN p_partkey % 12 = 0 THEN CAST(p_partkey % 50 AS VARCHAR) ELSE p_name END AS name,
        CASE WHEN p_partkey % 6 = 0 THEN 'X' ELSE split_part(p_name, ' ', 1) || ' (1999)' END AS folder, CAST(p_partkey % 50 AS VARCHAR) AS stem, p_name, p_brand FROM part),
    i AS (SELECT *, root || '/' || folder || '/' || stem || '.mkv' AS path FROM items),
    asked AS (SELECT DISTINCT root, folder, stem, split_part(folder, ' ', 1) AS word, CASE item % 5 WHEN 0 THEN root || '/' || folder WHEN 1 THEN root || '/deep/' || folder WHEN 2 THEN '/other/' || folder WHEN 3 THEN root || '/Zzz' ELSE root || '/deep/The ' || folder END
        || '/' || stem || '.mkv' AS path, CASE item % 5 WHEN 3 THEN 'Zzz' WHEN 4 THEN 'The ' || folder ELSE folder END AS tail FROM i),
    exact AS (SELECT path, min(item) AS item, 'exact' AS tier FROM (SELECT DISTINCT path FROM asked) JOIN i USING (path) GROUP BY 1),
    l AS (SELECT DISTINCT root, stem, tail, path, CASE WHEN len(regexp_extract(regexp_replace(tail, '^The ', ''), '^(\S+)', 1)) >= 2 THEN lower(regexp_extract(regexp_replace(tail, '^The ', ''), '^(\S+)', 1)) END AS prefix
        FROM asked ANTI JOIN exact USING (path) WHERE NOT starts_with(path, '/other/')),
    m AS (SELECT l.path, prefix, i.item, i.name, l.stem FROM l JOIN i ON i.root = l.root AND i.stem = l.stem AND ends_with(i.path, l.tail || '/' || l.stem || '.mkv')),
    p AS (SELECT path, min(item) AS item, 'prefix' AS tier FROM m WHERE starts_with(lower(name), prefix) GROUP BY 1),
    s AS (SELECT path, min(item) AS item, 'search' AS tier FROM m WHERE prefix IS NULL AND name = stem GROUP BY 1),
    e AS (SELECT path, min(item) AS item, 'enumerate' AS tier FROM m ANTI JOIN s USING (path) WHERE prefix IS NULL GROUP BY 1),
    found AS (SELECT * FROM exact UNION ALL SELECT * FROM p UNION ALL SELECT * FROM s UNION ALL SELECT * FROM e)
    SELECT path, item, tier FROM found UNION ALL
    SELECT DISTINCT path, NULL, CASE WHEN starts_with(path, '/other/') THEN 'no_library' ELSE (SELECT CASE WHEN max(prefix) IS NULL THEN 'miss' ELSE 'prefix_miss' END FROM l WHERE l.path = a.path) END
    FROM asked a ANTI JOIN found USING (path)"""


@query("j19_tiered_lookup", _LOOKUP_SQL)
def tiered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact path, library, name prefix, search and enumeration, each for what is left."""
    n, root = F.col("p_partkey"), F.concat(F.lit("/lib/"), F.col("p_brand"))
    stem = (n % 50).cast("string")
    folder = F.when(n % 6 == 0, "X").otherwise(F.concat(F.split("p_name", " ")[0], F.lit(" (1999)")))
    file = lambda *parts: F.concat(*parts, F.lit("/"), stem, F.lit(".mkv"))
    rows = table(spark, sf_dir, "part")
    items = rows.select(n.alias("item"), file(root, F.lit("/"), folder).alias("path"), F.when(n % 12 == 0, stem).otherwise(F.col("p_name")).alias("name"), n.alias("turn"))
    asked = (
        F.when(n % 5 == 0, file(root, F.lit("/"), folder)).when(n % 5 == 1, file(root, F.lit("/deep/"), folder)).when(n % 5 == 2, file(F.lit("/other/"), folder))
        .when(n % 5 == 3, file(root, F.lit("/Zzz"))).otherwise(file(root, F.lit("/deep/The "), folder))
    )
    roots = rows.select(root.alias("root"), F.col("p_brand").alias("library")).distinct()
    return lookups.tiered(rows.select(asked.alias("path")), items, roots)


@query("n1_hierarchy_any_depth", """WITH RECURSIVE items AS (SELECT 'r' || r_regionkey AS id, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
    UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders),
    f(asked, way) AS (SELECT id, id FROM items WHERE id[1] IN ('r', 'c') UNION ALL SELECT f.asked, i.id FROM f JOIN items i ON i.parent = f.way)
    SELECT DISTINCT asked, way AS leaf FROM f WHERE way NOT IN (SELECT parent FROM items WHERE parent IS NOT NULL)""")
def hierarchy_any_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N1 at any depth: regions and customers become the orders below them; a customer without orders stands for itself."""
    level = lambda name, kind, key, above, parent: table(spark, sf_dir, name).select(
        F.concat(F.lit(kind), F.col(key).cast("string")).alias("id"), F.concat(F.lit(above), F.col(parent).cast("string")).alias("parent") if parent else F.lit(None).cast("string").alias("parent"), F.lit(name).alias("kind"))
    items = level("region", "r", "r_regionkey", "", None)
    for one in (("nation", "n", "n_nationkey", "r", "n_regionkey"), ("customer", "c", "c_custkey", "n", "c_nationkey"), ("orders", "o", "o_orderkey", "c", "o_custkey")):
        items = items.unionByName(level(*one))
    return lookups.leaves(items, items.where("kind IN ('region', 'customer')").select("id"))


@query("t13_incremental_poll", """WITH o AS (SELECT o_orderkey AS id, CAST(epoch(o_orderdate) AS BIGINT) AS added, o_orderkey % 10 < 8 AND o_orderdate < TIMESTAMP '1997-01-01' AS early FROM orders),
    mark AS (SELECT max(added) AS m FROM o WHERE early AND added >= 700000000)
    SELECT 1 AS run, id, added FROM o WHERE early AND added >= 700000000
    UNION ALL SELECT 2, id, added FROM o, mark WHERE NOT (early AND added >= 700000000) AND added >= m - 2592000""")
def incremental_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first poll, then one that also finds rows that are late by up to thirty days, none twice."""
    orders = table(spark, sf_dir, "orders")
    items = orders.select(F.col("o_orderkey").alias("id"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("added"), (F.col("o_orderkey") % 10 < 8).alias("there"), "o_orderdate")
    at = new_place(spark, "claims")
    first = polls.poll(items.where("there AND o_orderdate < TIMESTAMP_NTZ '1997-01-01'"), at, "id", "added", 2_592_000, since=700_000_000)
    first = written(first.select(F.lit(1).alias("run"), "id", "added"), "poll")
    second = polls.poll(items, at, "id", "added", 2_592_000)
    third = polls.poll(items, at, "id", "added", 2_592_000)
    parts = [found.select(F.lit(k).alias("run"), "id", "added") for k, found in ((2, second), (3, third))]
    return first.unionByName(parts[0]).unionByName(parts[1])


@query("t2_streamed_ttl", """WITH RECURSIVE e AS (SELECT user_id, event_type, epoch_us(ts) AS tm, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS i FROM events),
    f(user_id, event_type, i, kept, n) AS (SELECT user_id, event_type, i, tm, 1 FROM e WHERE i = 1 UNION ALL
        SELECT e.user_id, e.event_type, e.i, CASE WHEN e.tm - f.kept >= 86400000000 THEN e.tm ELSE f.kept END, f.n + (e.tm - f.kept >= 86400000000)::INT
        FROM f JOIN e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.i = f.i + 1)
    SELECT user_id, event_type, CAST(max(n) AS BIGINT) AS taken FROM f GROUP BY 1, 2""")
def streamed_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as a stream, of which each key takes one event a day; what is taken is pushed to an outbox."""
    out = new_place(spark, "taken")
    spark.dataSource.register(published.OutboxSource)
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    folder = new_place(spark, "events-folder")
    rows.write.parquet(folder)
    taken = webhooks.accepted(spark.readStream.schema(rows.schema).parquet(folder), ["user_id", "event_type"], "ts", 86_400)
    run = taken.writeStream.format("quarry_outbox").option("path", out).option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return published.pushed(spark, out, rows.schema).groupBy("user_id", "event_type").agg(F.count("*").alias("taken"))
