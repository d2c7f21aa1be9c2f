"""Reverse lookups from paths to items, from the cheapest tier to the dearest, each seeing what the tiers before left over.

Tails are matched on keys, never path by path: a file name with a folder name's endings, made for wanted names only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import paths
from quarry.sources.tables import written

#: Fixed value: names of one prefix up to which a miss is final.
CANDIDATES = 500


def _parent(path: Column) -> Column:
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))


def tail_matches(wanted: DataFrame, items: DataFrame, keys: list[str], extra: list[str] = ()) -> DataFrame:
    """path, keys, item, turn, extra: items of the same file name whose path ends with the wanted path's last two parts.

    ``wanted`` has path and keys, ``items`` item, path, turn, keys and extra. Of items that share keys, file name, folder name
    and extra, the first by turn. Only the endings of folder names that go with a wanted file name are made, once each.
    """
    asked = wanted.select("path", *keys, paths.basename(F.col("path")).alias("_base"), _parent(F.col("path")).alias("_tail"))
    named = items.select("item", "turn", *keys, *extra, paths.basename(F.col("path")).alias("_base"), _parent(F.col("path")).alias("_folder"))
    first = named.groupBy(*keys, *extra, "_base", "_folder").agg(F.min(F.struct("turn", "item")).alias("first"))
    known = first.join(asked.select(*keys, "_base").distinct(), [*keys, "_base"], "left_semi")
    ends = F.transform(F.sequence(F.lit(0), F.length("_folder")), lambda n: F.right(F.col("_folder"), n))
    spread = known.select(*keys, *extra, "_base", F.explode(ends).alias("_tail"), "first")
    best = spread.groupBy(*keys, *extra, "_base", "_tail").agg(F.min("first").alias("first"))
    return asked.join(best, [*keys, "_base", "_tail"]).select("path", *keys, *extra, "first.item", "first.turn")


def _first(found: DataFrame, tier: str) -> DataFrame:
    return found.groupBy("path").agg(F.min(F.struct("turn", "item")).alias("f")).select("path", F.col("f.item").alias("item"), F.lit(tier).alias("tier"))


def tiered(wanted: DataFrame, items: DataFrame, roots: DataFrame, candidates: int = CANDIDATES) -> DataFrame:
    """path, item, tier for each wanted path once: how it was found, or why it wasn't (item null).

    ``items`` has item, path, name and turn (their order), ``roots`` has root and library. Tiers: ``exact``, an item of that
    path; ``no_library``, the path lies under no root, so nothing dearer is asked; ``prefix``, an item of the library whose
    name begins with the folder's first word and whose path ends alike; ``prefix_miss``, there is none, which is final
    unless more than ``candidates`` names begin so; for these and for folders that give no word ``search``, an item named
    like the file whose path ends alike, then ``enumerate``, any item whose path does, else ``miss``. Case doesn't count
    in names. Null paths aren't looked up; of several items the first by turn is taken.
    """
    nobody = F.lit(None).cast(items.schema["item"].dataType).alias("item")
    asked = written(wanted.select("path").where(F.coalesce(F.col("path"), F.lit("")) != "").distinct(), "wanted")
    exact = written(_first(asked.join(items.select("path", "item", "turn"), "path"), "exact"), "exact")
    left = asked.join(exact, "path", "left_anti")
    owned = written(paths.longest_prefix(left, "path", roots).select("path", "library"), "owned")
    homeless = left.join(owned, "path", "left_anti").select("path", nobody, F.lit("no_library").alias("tier"))

    of_path = paths.longest_prefix(items.select("path").where("path IS NOT NULL").distinct(), "path", roots).select("path", "library")
    low = F.lower(T.without_accents(F.regexp_replace("name", T.ARTICLE, "")))
    shelved = written(
        items.join(of_path, "path").select("item", "path", "turn", "library", F.lower("name").alias("name"), F.regexp_extract(low, r"^(\S*)", 1).alias("word")), "shelved"
    )
    begun = owned.withColumn("prefix", F.lower(T.folder_prefix(F.col("path"))["prefix"]))
    # A prefix holds no blank, so it begins a name if it begins the name's first word.
    names = shelved.select("library", "word", "name").distinct()
    starts = F.transform(F.sequence(F.lit(1), F.greatest(F.length("word"), F.lit(1))), lambda n: F.left(F.col("word"), n))
    begins = names.join(begun.select("library").distinct(), "library", "left_semi").select("library", F.explode(starts).alias("prefix")).groupBy("library", "prefix").count()
    counted = written(begun.join(begins, ["library", "prefix"], "left").select("path", "library", "prefix", F.coalesce("count", F.lit(0)).alias("names")), "counted")
    hits = tail_matches(counted.where("names > 0"), shelved, ["library"], ["word"]).join(counted.select("path", "prefix"), "path")
    by_prefix = written(_first(hits.where(F.col("word").startswith(F.col("prefix"))), "prefix"), "by-prefix")
    rest = counted.join(by_prefix, "path", "left_anti")
    final = F.col("prefix").isNotNull() & (F.col("names") <= candidates)
    missed = rest.where(final).select("path", nobody, F.lit("prefix_miss").alias("tier"))
    open_ = rest.where(~final).select("path", "library", F.lower(F.regexp_replace(paths.basename(F.col("path")), r"\.[^.]*$", "")).alias("name"))
    searched = written(_first(tail_matches(open_, shelved, ["library", "name"]), "search"), "searched")
    dear = open_.join(searched, "path", "left_anti")
    listed = written(_first(tail_matches(dear, shelved, ["library"]), "enumerate"), "listed")
    nothing = dear.join(listed, "path", "left_anti").select("path", nobody, F.lit("miss").alias("tier"))
    found = exact
    for more in (homeless, by_prefix, missed, searched, listed, nothing):
        found = found.unionByName(more)
    return found


def leaves(items: DataFrame, asked: DataFrame, most: int = 32) -> DataFrame:
    """asked, leaf for each asked item: the leaves below it, or itself where it has none, is unknown or is one.

    ``items`` has id, parent and kind. Descends by joins of what is still open with its children, at any depth; a
    parent is entered once for each asked item, so a cycle ends, and what lies on it alone has no leaves. More than
    ``most`` levels are an error. Null ids are leaves of themselves.
    """
    children = items.select(F.col("parent").alias("_at"), F.col("id").alias("_child")).where("_at IS NOT NULL AND _child IS NOT NULL AND _at <> _child").distinct()
    inner = children.select("_at").distinct()
    start = asked.select(F.col("id").alias("asked")).distinct()
    edge = written(start.select("asked", F.col("asked").alias("_at")), "edge")
    seen, found = edge, edge.join(inner, "_at", "left_anti").select("asked", F.col("_at").alias("leaf"))
    for _ in range(most):
        below = edge.join(children, "_at").select("asked", F.col("_child").alias("_at")).distinct()
        edge = written(below.join(seen, ["asked", "_at"], "left_anti"), "edge")
        if edge.isEmpty():
            break
        seen = seen.unionByName(edge)
        found = found.unionByName(edge.join(inner, "_at", "left_anti").select("asked", F.col("_at").alias("leaf")))
    else:
        raise ValueError(f"the hierarchy is more than {most} levels deep")
    found = written(found.distinct(), "leaves")
    none = start.join(found, "asked", "left_anti")
    return found.where("asked IS NOT NULL").unionByName(none.select("asked", F.col("asked").alias("leaf")))
