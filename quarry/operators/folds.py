"""Order-dependent merges, where a row's fate depends on what was kept before it.

Small groups are gathered in order and folded by built-in higher-order functions. Where a group may hold very many rows,
the rule is put another way: in rounds of joins, or as groupings with the same outcome. See also ``chains``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from quarry.sources.tables import written


def disjoint_first(df: DataFrame, group: str, item: str, order: str, places: str) -> DataFrame:
    """group, kept (items): in order, an item goes if any of its places is one of an item that was kept."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(item).alias("item"), F.col(places).alias("places"))))
    kind = f"struct<seen:{df.schema[places].dataType.simpleString()},kept:array<{df.schema[item].dataType.simpleString()}>>"
    start = F.from_json(F.lit('{"seen":[],"kept":[]}'), kind)
    fold = F.aggregate(
        rows,
        F.struct(start.seen.alias("seen"), start.kept.alias("kept")),
        lambda s, r: F.when(F.coalesce(F.arrays_overlap(s.seen, r.places), F.lit(False)), s).otherwise(
            F.struct(F.concat(s.seen, r.places).alias("seen"), F.concat(s.kept, F.array(r.item)).alias("kept"))
        ),
    )
    return df.groupBy(group).agg(fold.kept.alias("kept"))


def _folded_rows(rows: DataFrame, group: str, order: str, places: str) -> DataFrame:
    """As ``disjoint_rows``, group by group: for rows with ``_id`` of which no group has very many."""
    own = rows.schema
    place_list, row_list = own[places].dataType, ArrayType(own)
    gathered = rows.groupBy(F.col(group).alias("_group")).agg(F.collect_list(F.struct(*rows.columns)).alias("rows"))
    in_turn = F.array_sort(F.transform("rows", lambda r: F.struct(r[order].alias("order"), r["_id"].alias("id"), r.alias("row"))))
    start = F.struct(F.array().cast(place_list).alias("seen"), F.array().cast(row_list).alias("kept"))

    def step(state: Column, turn: Column) -> Column:
        its = F.coalesce(turn["row"][places], F.array().cast(place_list))
        more = F.struct(F.concat(state["seen"], its).alias("seen"), F.concat(state["kept"], F.array(turn["row"])).alias("kept"))
        return F.when(F.coalesce(F.arrays_overlap(state["seen"], its), F.lit(False)), state).otherwise(more)

    return gathered.select(F.inline(F.aggregate(in_turn, start, step)["kept"]))


def disjoint_rows(df: DataFrame, group: str, order: str, places: str, rounds: int = 24, small: int = 1024) -> DataFrame:
    """The rows that stay: in order, a row goes if any of its places is one of an earlier row of its group that stays.

    Groups of at most ``small`` rows are gathered and folded, which moves their rows once. What is in larger ones is done in
    rounds, none of which holds a group: a row that is the first of those left at all of its places stays, and
    all rows with one of its places go. Rows of equal order are taken in the order in which they are written first. Rows
    without places stay; a null group is a group. Rows in no order in particular need few rounds; what long chains of
    rows leave after ``rounds`` is folded group by group, with all places of the rows that stayed as seen.
    """
    rows = written(df.withColumn("_id", F.monotonically_increasing_id()), "items")
    sizes = rows.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("n"))
    crowded = written(sizes.where(F.col("n") > small).select("_group"), "crowded")
    if crowded.isEmpty():
        return _folded_rows(rows, group, order, places).select(*df.columns)
    same = F.col(group).eqNullSafe(F.col("_group"))
    few = _folded_rows(rows.join(crowded, same, "left_anti"), group, order, places)
    many = _rows_in_rounds(rows.join(crowded, same, "left_semi"), group, order, places, rounds)
    return few.unionByName(many).select(*df.columns)


def _rows_in_rounds(rows: DataFrame, group: str, order: str, places: str, rounds: int) -> DataFrame:
    turn = F.struct(F.col(order).alias("order"), F.col("_id").alias("id")).alias("turn")
    pairs = rows.select("_id", turn, F.explode(F.array_distinct(F.col(places))).alias("place"), F.col(group).alias("group"))
    left = written(pairs.select("_id", "turn", F.struct("group", "place").alias("at")), "places")
    stayed = rows.where((F.size(F.coalesce(F.col(places), F.array().cast(rows.schema[places].dataType))) == 0)).select("_id")
    for _ in range(rounds):
        first = left.groupBy("at").agg(F.min("turn").alias("first"))
        firsts = left.join(first, "at").groupBy("_id").agg(F.bool_and(F.col("turn") == F.col("first")).alias("stays")).where("stays")
        stay = written(firsts.select("_id"), "stay")
        stayed = stayed.unionByName(stay)
        taken = left.join(stay, "_id", "left_semi").select("at").distinct()
        gone = left.join(taken, "at", "left_semi").select("_id").distinct()
        left = written(left.join(gone, "_id", "left_anti"), "places")
        if left.isEmpty():
            break
    else:
        rest = left.groupBy("_id", "turn", F.col("at.group").alias("group")).agg(F.collect_list("at.place").alias("places"))
        folded = disjoint_first(rest.select("group", "_id", "turn", "places"), "group", "_id", "turn", "places")
        stayed = stayed.unionByName(folded.select(F.explode("kept").alias("_id")))
    return rows.join(stayed, "_id", "left_semi")


def merged_by_year(df: DataFrame, keys: list[str], order: str, year: str, item: str) -> DataFrame:
    """keys, year, items: rows of a key join the first bucket whose year is the same or unknown on either side.

    A bucket without a year takes the first one it meets. So only a key's first bucket is ever without one, and what has
    no year joins that: rows without a year go with the first year that the key has, every other year is by itself.
    That takes two groupings, the first of which combines, where the rule's wording asks for a fold over a key's rows.
    """
    rows = df.select(*keys, F.col(order).alias("o"), F.col(year).cast("int").alias("_year"), F.col(item).cast("long").alias("item"))
    turn = F.struct("o", "_year", "item")
    first = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by("_year", F.when(F.col("_year").isNotNull(), turn)).alias("_first"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    placed = rows.join(first, same).withColumn("year", F.coalesce("_year", "_first"))
    items = F.transform(F.array_sort(F.collect_list(turn)), lambda x: x["item"])
    return placed.groupBy(*keys, "year").agg(items.alias("items"))


def enumerated_once(df: DataFrame, path: str, order: str, server: str, item: str, title: str) -> DataFrame:
    """One row a path: the first row's server, every server's item (the last one wins), the first non-empty title."""
    latest = df.groupBy(path, server).agg(F.max_by(item, order).alias("item"), F.min(order).alias("first"),
                                          F.min_by(F.nullif(F.col(title), F.lit("")), F.when(F.col(title) != "", F.col(order))).alias("title"),
                                          F.min(F.when(F.col(title) != "", F.col(order))).alias("titled"))
    return latest.groupBy(path).agg(
        F.min_by(server, "first").alias("server"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(server, "item")))).alias("items"),
        F.min_by("title", "titled").alias("title"),
    )
