"""Scans of a paged service: libraries in scope, sort, exclusion and dedup, composed over the paged source.

What is known before the scan goes into filters on ``library`` and ``added``, which the source answers by not opening
pages; the list of libraries is small and passes the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import folds, paths

#: Kinds that are scanned.
KINDS = ("episode", "movie")


def scope(libraries: DataFrame, ids: list[str] | None = None, titles: list[str] | None = None, kinds: tuple = KINDS) -> list[str]:
    """Ids of the libraries in scope: by id where ids are given, else by lower-cased title, else all of a scanned kind."""
    rows = libraries.where(F.col("kind").isin(*kinds))
    if ids:
        rows = rows.where(F.col("library").isin(*ids))
    elif titles:
        rows = rows.where(F.lower("title").isin(*titles))
    return sorted(r.library for r in rows.select("library").distinct().collect())


def library_scan(
    items: DataFrame, libraries: DataFrame, ids: list[str] | None = None, titles: list[str] | None = None,
    sort: str | None = None, rules: list[tuple[str, str]] = (),
) -> DataFrame:
    """library, library_title, id, title, kind, place_key of what is to be worked on.

    ``items`` has library, position, id, title, show, code, added and locations. Libraries out of scope are never
    opened. ``sort`` is newest, oldest or none (as listed); ``place_key`` orders a library's rows by it. An item goes if
    a rule covers its first location; an episode also if any of its locations is one of an earlier episode of the
    library that stays. Episodes are titled by show and code. Items without locations stay.
    """
    wanted = scope(libraries, ids, titles)
    rows = items.where(F.col("library").isin(*wanted)) if wanted else items.where("false")
    turn = {"newest": -F.col("added").cast("long"), "oldest": F.col("added").cast("long")}.get(sort, F.lit(0).cast("long"))
    first = F.try_element_at("locations", F.lit(1))
    rows = rows.where(~F.coalesce(paths.excluded(first, list(rules)), F.lit(False))).withColumn(
        "place_key", F.struct(F.coalesce(turn, F.lit((1 << 63) - 1)).alias("turn"), F.col("position"))
    )
    known = rows.join(F.broadcast(libraries.where(F.col("library").isin(*wanted)).select("library", F.col("title").alias("library_title"), "kind")), "library")
    shaped = ["library", "library_title", "id", "kind", "place_key"]
    episodes = known.where("kind = 'episode'")
    title = F.concat_ws(" ", "show", F.upper("code"))
    kept = folds.disjoint_rows(episodes.select(*shaped, title.alias("title"), "locations"), "library", "place_key", "locations")
    movies = known.where("kind = 'movie'").select(*shaped, "title")
    columns = ["library", "library_title", "id", "title", "kind", "place_key"]
    return kept.select(*columns).unionByName(movies.select(*columns))


def canonical_rows(items: DataFrame, libraries: DataFrame, server: str, rules: list[tuple[str, str]], ids: list[str] | None = None) -> DataFrame:
    """canonical_path, server_id, item_id, title, library_id: one row an item and candidate path of enabled libraries.

    Items without a path give no row; an item without a title is titled by its path.
    """
    wanted = scope(libraries.where("enabled"), ids, kinds=tuple(r.kind for r in libraries.select("kind").distinct().collect()))
    rows = items.where(F.col("library").isin(*wanted)) if wanted else items.where("false")
    path = F.col("path")
    return rows.where(F.coalesce(path, F.lit("")) != "").select(
        F.explode(F.array_distinct(paths.one_way(path, list(rules)))).alias("canonical_path"),
        F.lit(server).alias("server_id"),
        F.col("id").alias("item_id"),
        F.coalesce(F.nullif(F.col("title"), F.lit("")), path).alias("title"),
        F.col("library").alias("library_id"),
    )


def recent(items: DataFrame, since: int, libraries: list[str] | None = None) -> DataFrame:
    """Items added at ``since`` or later: pages that are older as a whole are never opened."""
    rows = items if libraries is None else items.where(F.col("library").isin(*libraries))
    return rows.where(F.col("added") >= since)


def located(items: DataFrame) -> DataFrame:
    """One row an item and location; items without locations give none."""
    return items.select(*[c for c in items.columns if c != "locations"], F.explode("locations").alias("location"))
