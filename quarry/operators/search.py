"""Search over several servers: each one's own two passes, then one merged, ordered answer."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T

HIT = ["server", "ord", "rank", "kind", "title", "year", "paths", "child_count"]
_ORDER = ("show", "movie", "episode")
#: The least score of a hit; hits of the preview search.
FLOOR, PREVIEWS = 0.3, 15


@dataclass(frozen=True)
class Query:
    """A search string's parts, read once: they are constants of the plans that use them."""

    raw: str
    title: str
    tokens: tuple[str, ...]
    season: int | None
    episode: int | None

    @property
    def one_episode(self) -> bool:
        return self.season is not None and self.episode is not None

    def whole(self) -> Query:
        """Without a season or an episode alone, which narrow nothing."""
        return self if self.one_episode else Query(self.raw, self.title, self.tokens, None, None)

    def score(self, name: Column, kind: Column | None = None) -> Column:
        """How well a name answers; films count half where an episode is asked for."""
        film = kind.isin("movie", "film") if kind is not None and self.one_episode else F.lit(False)
        return T.rank_score(name, F.lit(self.title), list(self.tokens), film)

    def asks_for(self, season: Column, episode: Column) -> Column:
        wanted = lambda part, own: F.lit(True) if part is None else F.coalesce(own == part, F.lit(False))
        return wanted(self.season, season) & wanted(self.episode, episode)


def parsed(spark: SparkSession, raw: str) -> Query:
    q = spark.range(1).select(T.parsed_query(F.lit(raw)).alias("q")).first().q
    return Query(raw, q.title, tuple(q.tokens), q.season, q.episode)


def _best(rows: DataFrame, q: Query, floor: float, limit: int) -> DataFrame:
    """Scored, floored, the best few; ties by turn."""
    scored = rows.withColumn("score", q.score(F.col("name"), F.col("kind"))).where(F.col("score") >= floor)
    return scored.orderBy(F.desc("score"), "turn").limit(limit)


def two_pass(shows: DataFrame, episodes: DataFrame, raw: str, limit: int, most: int | None = None) -> DataFrame:
    """Episodes of the shows whose name begins with the search's title, else of those that contain all of its words.

    ``shows`` has show_id and name, ``episodes`` show_id, season, episode and id. The first pass with any hit counts. Hits are
    scored, floored at 0.3 and cut to the best ``limit`` shows; a season and an episode in the search narrow them. With
    ``most`` an id comes once, with its best show, and no more than ``most`` rows come in all.
    """
    q = parsed(shows.sparkSession, raw)
    low = F.lower("name")
    words = F.lit(True)
    for token in q.tokens:
        words = words & F.contains(low, F.lit(token))
    tier = F.when(low.startswith(q.title), 1).when(words, 2)
    scored = shows.select("show_id", "name", tier.alias("tier"), q.score(F.col("name")).alias("score"))
    hits = scored.where(F.lit(bool(q.tokens)) & F.col("tier").isNotNull() & (F.col("score") >= FLOOR))
    first = hits.agg(F.min("tier").alias("first"))
    hits = hits.join(F.broadcast(first), F.col("tier") == F.col("first")).orderBy(F.desc("score"), "show_id").limit(limit)
    found = episodes.join(F.broadcast(hits.select("show_id", "name", "score")), "show_id").where(q.asks_for(F.col("season"), F.col("episode")))
    columns = ["show_id", "name", "score", "season", "episode", "id"]
    if most is None:
        return found.select(*columns)
    once = found.groupBy("id").agg(F.min_by(F.struct(*columns), F.struct(-F.col("score"), "show_id", "season", "episode")).alias("row")).select("row.*")
    return once.orderBy(F.desc("score"), "show_id", "season", "episode", "id").limit(most)


def _expanded(catalogue: DataFrame, shows: DataFrame, q: Query) -> DataFrame:
    """The episodes, of those asked for, of a few shows (id, rank): rank, id, name, path, season, episode, turn."""
    few = F.broadcast(shows.select(F.col("id").alias("show_id"), "rank"))
    own = catalogue.where((F.col("kind") == "episode") & (F.coalesce(F.col("path"), F.lit("")) != "") & q.asks_for(F.col("season"), F.col("episode")))
    return own.join(few, "show_id").select("rank", "id", "name", "path", "season", "episode", "turn")


def _placed(rows: DataFrame, limit: int, once: bool) -> DataFrame:
    """place, id, name, path of at most ``limit`` rows by rank, season, episode and turn, an id once where asked."""
    order = F.struct("rank", "season", "episode", "turn")
    if once:
        rows = rows.groupBy("id").agg(F.min_by(F.struct(*rows.columns), order).alias("row")).select("row.*")
    best = rows.orderBy("rank", "season", "episode", "turn").limit(limit)
    # No more rows than the answer's limit are numbered.
    nth = F.row_number().over(Window.orderBy("rank", "season", "episode", "turn"))
    return best.select(nth.alias("place"), "id", "name", "path")


def series_first(catalogue: DataFrame, raw: str, limit: int = 50) -> DataFrame:
    """place, id, name, path: the episodes of the first show whose name begins with the title, else the best hits.

    ``catalogue`` has id, kind (show, movie, episode), name, turn, path, show_id, season and episode. Of the first ten
    shows by turn whose name begins with the search's title, the first with any episode asked for answers alone. Else the
    items whose name holds the title, no more than four times the limit or 200, are scored, and the best, floored at 0.3,
    taken in order: films and episodes as they are (where an episode is asked for, only that), up to the first show
    that has episodes, which closes the answer. An id comes once; items without a path don't come.
    """
    q = parsed(catalogue.sparkSession, raw).whole()
    nothing = catalogue.sparkSession.createDataFrame([], f"place int, id {catalogue.schema['id'].dataType.simpleString()}, name string, path string")
    if not q.tokens:
        return nothing
    low = F.lower("name")
    begun = catalogue.where((F.col("kind") == "show") & low.startswith(q.title)).orderBy("turn").limit(10).select("id", F.col("turn").alias("rank"))
    found = _expanded(catalogue, begun, q)
    first = found.agg(F.min("rank").alias("first"))
    series = _placed(found.join(F.broadcast(first), F.col("rank") == F.col("first")).drop("first"), limit, True)
    if not series.isEmpty():
        return series
    holding = catalogue.where(F.contains(low, F.lit(q.title))).orderBy("turn").limit(min(limit * 4, 200))
    # As many rows as the limit allows are ranked in one task.
    ranked = _best(holding, q, FLOOR, limit * 2).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "turn")))
    opened = _expanded(catalogue, ranked.where("kind = 'show'"), q)
    first = opened.agg(F.coalesce(F.min("rank"), F.lit((1 << 31) - 1)).alias("first"))
    plain = ranked.where((F.col("kind") != "show") & (F.coalesce(F.col("path"), F.lit("")) != ""))
    if q.one_episode:
        plain = plain.where((F.col("kind") == "episode") & q.asks_for(F.col("season"), F.col("episode")))
    both = plain.select(*opened.columns).unionByName(opened).join(F.broadcast(first), F.col("rank") <= F.col("first")).drop("first")
    return _placed(both, limit, True)


def hub_search(catalogue: DataFrame, raw: str, limit: int = 50) -> DataFrame:
    """place, id, name, path: each kind's first hits, scored together, shows opened where they stand.

    A show becomes the episode asked for, or all of its episodes; what has no path goes. Columns as in ``series_first``.
    """
    q = parsed(catalogue.sparkSession, raw)
    low = F.lower("name")
    hubs = [catalogue.where((F.col("kind") == kind) & F.contains(low, F.lit(q.title))).orderBy("turn").limit(limit) for kind in _ORDER]
    hits = hubs[0].unionByName(hubs[1]).unionByName(hubs[2]).where(F.lit(bool(q.tokens)))
    ranked = _best(hits, q, FLOOR, limit * 2).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "turn")))
    shows = ranked.where("kind = 'show'")
    opened = _expanded(catalogue, shows, q.whole())
    plain = ranked.where((F.col("kind") != "show") & (F.coalesce(F.col("path"), F.lit("")) != ""))
    return _placed(plain.select(*opened.columns).unionByName(opened), limit, False)


def preview_search(catalogue: DataFrame, raw: str, most: int = PREVIEWS) -> DataFrame:
    """place, id, name, path: episodes of all shows that hold the title, in their order, then films and episodes that do.

    A season or an episode in the search narrows the shows' episodes; a season leaves the direct hits out. An id comes once.
    A search of fewer than two characters finds nothing.
    """
    q = parsed(catalogue.sparkSession, raw)
    hit = F.contains(F.lower("name"), F.lit(q.title)) & F.lit(bool(q.tokens) and len(raw.strip()) > 1)
    shows = catalogue.where((F.col("kind") == "show") & hit).select(F.col("id").alias("show_id"), F.col("turn").alias("rank"))
    own = catalogue.where((F.col("kind") == "episode") & q.asks_for(F.col("season"), F.col("episode")))
    first = own.join(shows, "show_id").select(F.lit(0).alias("phase"), "rank", "id", "name", "path", "season", "episode", "turn")
    direct = catalogue.where(F.col("kind").isin("movie", "episode") & hit & F.lit(q.season is None))
    zero = F.lit(0)
    second = direct.select(F.lit(1).alias("phase"), F.col("turn").alias("rank"), "id", "name", "path", zero.alias("season"), zero.alias("episode"), "turn")
    both = first.unionByName(second).withColumn("rank", F.struct("phase", "rank")).drop("phase")
    return _placed(both, most, True)


def gathered(spark: SparkSession, sources: list[tuple[str, Callable[[], DataFrame]]], failures: list[tuple[str, str]] | None = None) -> DataFrame:
    """The hits of all sources by their order; a source that can't be opened is left out, the others still answer.

    ``failures`` gets the name of each such source and its error. A source that opens but lacks a column is a mistake
    and raises. One that fails while it is read fails the query, as Spark has begun to give out rows by then; sources
    that may do so are written to a table of their own first.
    """
    found = None
    for place, (name, source) in enumerate(sources):
        try:
            opened = source()
        except Exception as e:  # noqa: BLE001 - any source may fail in any way of its own
            if failures is not None:
                failures.append((name, f"{type(e).__name__}: {e}"))
            continue
        rows = opened.withColumn("ord", F.lit(place)).select(*HIT)
        found = rows if found is None else found.unionByName(rows)
    kinds = "server string, ord int, rank long, kind string, title string, year int, paths array<string>, child_count int"
    return spark.createDataFrame([], kinds) if found is None else found


def merged(hits: DataFrame) -> DataFrame:
    """kind, key, place, title, year, paths, child_count, servers: hits of one item from several servers in one row.

    Hits of a kind and plain title join the first row whose year is the same or unknown on either side; what one lacks
    is filled in by another. ``place`` is the first hit's. Hits without paths don't count. A title has few hits (each
    server's limit), so they are folded in a row.
    """
    hit = F.struct("ord", "rank", "server", "title", F.col("year").cast("int").alias("year"), "paths", F.col("child_count").cast("int").alias("child_count"))
    kind = "struct<ord:int,rank:bigint,title:string,year:int,paths:array<string>,child_count:int,servers:array<string>>"

    def joined(rows: Column, h: Column) -> Column:
        fits = F.transform(rows, lambda r: r.year.isNull() | h.year.isNull() | (r.year == h.year))
        at = F.array_position(fits, F.lit(True))

        def row(old: Column | None) -> Column:
            first = h if old is None else old
            return F.struct(
                first.ord.cast("int").alias("ord"), first.rank.cast("long").alias("rank"), first.title.alias("title"),
                F.coalesce(first.year, h.year).alias("year"),
                (h.paths if old is None else F.array_union(old.paths, h.paths)).alias("paths"),
                F.coalesce(first.child_count, h.child_count).alias("child_count"),
                (F.array(h.server) if old is None else F.array_union(old.servers, F.array(h.server))).alias("servers"),
            ).cast(kind)

        return F.when(at > 0, F.transform(rows, lambda r, i: F.when(i + 1 == at, row(r)).otherwise(r))).otherwise(
            F.concat(rows, F.array(row(None)))
        )

    keyed = hits.where(F.size("paths") > 0).groupBy("kind", T.plain_key(F.col("title")).alias("key"))
    folded = keyed.agg(F.aggregate(F.array_sort(F.collect_list(hit)), F.from_json(F.lit("[]"), f"array<{kind}>"), joined).alias("rows"))
    rows = folded.select("kind", "key", F.explode("rows").alias("r"))
    return rows.select("kind", "key", F.struct("r.ord", "r.rank").alias("place"), "r.title", "r.year", "r.paths", "r.child_count", "r.servers")


def answer(rows: DataFrame, raw: str, limit: int = 25) -> DataFrame:
    """The merged rows without episodes that a show among them covers, shows first, then films, then episodes.

    A search that names an episode keeps them all. Within a kind rows are in the order their first hit came in.
    """
    typed = F.lit(bool(re.search(r"(?i)\bS\d{1,2}E\d{1,3}\b", raw)))
    shows = rows.where("kind = 'show'").select(F.col("key").alias("show_key")).distinct()
    own = T.plain_key(F.regexp_replace("title", r"(?i)\s+S\d{1,2}E\d{1,3}\b.*$", ""))
    marked = rows.withColumn("show_key", F.when((F.col("kind") == "episode") & ~typed, own))
    kind = F.array_position(F.array(*map(F.lit, _ORDER)), F.col("kind"))
    ranked = marked.join(shows, "show_key", "left_anti").orderBy(F.when(kind == 0, 10).otherwise(kind), "place", "key").limit(limit)
    return ranked.select("kind", "title", "year", "paths", "child_count", "servers")
