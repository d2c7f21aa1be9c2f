"""Sharding over fixed virtual slots with a versioned slot-to-shard map.

Records hash into a fixed number of slots. Bytes and rows are added up per slot, the slots are dealt to shards so
that shards get near equal bytes, and that map is a small table with a version. Growing the cluster edits the map:
a few slots move into the new shards and nothing else does, so only their records are copied.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import shared_dir

ROW_BYTES = 8
MAP_SCHEMA = "version int, virtual_slot int, shard int, slot_bytes long, slot_rows long, first_position long"


def with_slots(docs: DataFrame, slots: int) -> DataFrame:
    """Narrow rows (doc_id, size, text_crc32, virtual_slot): the texts themselves never move.

    A null text has size 8 and the checksum of the empty text. Null doc_ids spread by their text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id", text), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_totals(placed: DataFrame, slots: int) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows) of every slot in order, those without rows too: as many as there are slots, however large the corpus."""
    totals = placed.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    found = {r.virtual_slot: (r.b, r.n) for r in totals.collect()}
    return [(slot, *found.get(slot, (0, 0))) for slot in range(slots)]


def balanced(totals: list[tuple[int, int, int]], shards: int) -> dict[int, int]:
    """Slot to shard: the heaviest slot first, each to the lightest shard, of equal ones to that of fewest slots."""
    heap = [(0, 0, shard) for shard in range(shards)]
    dealt = {}
    for slot, size, _ in sorted(totals, key=lambda t: (-t[1], t[0])):
        load, owned, shard = heapq.heappop(heap)
        dealt[slot] = shard
        heapq.heappush(heap, (load + size, owned + 1, shard))
    return dealt


def rebalanced(totals: list[tuple[int, int, int]], dealt: dict[int, int], shards: int) -> dict[int, int]:
    """The map edited for more shards: slots move only into shards that the old map doesn't use.

    Each move takes the largest slot of the heaviest old shard that the lightest new one can hold without becoming
    heavier than its giver is then; without such a slot the editing ends. A slot without rows weighs a byte, so those
    are shared out as well.
    """
    sizes = {slot: max(size, 1) for slot, size, _ in totals}
    load = dict.fromkeys(range(shards), 0)
    owned: dict[int, list[int]] = {shard: [] for shard in range(shards)}
    for slot, shard in sorted(dealt.items(), key=lambda d: (-sizes[d[0]], d[0])):
        load[shard] += sizes[slot]
        owned[shard].append(slot)
    old = sorted(set(dealt.values()))
    new = sorted(set(range(shards)) - set(old))
    edited = dict(dealt)
    while new and old:
        giver = max(old, key=lambda s: (load[s], s))
        target = min(new, key=lambda s: (load[s], s))
        room = load[giver] - load[target]
        slot = next((s for s in owned[giver] if 2 * sizes[s] <= room), None)
        if slot is None:
            break
        owned[giver].remove(slot)
        edited[slot] = target
        load[giver] -= sizes[slot]
        load[target] += sizes[slot]
    return edited


def first_positions(totals: list[tuple[int, int, int]], dealt: dict[int, int]) -> dict[int, int]:
    """Where each slot's rows begin within its shard, in slot order."""
    filled: dict[int, int] = {}
    found = {}
    for slot, _, n in totals:
        found[slot] = filled.get(dealt[slot], 0)
        filled[dealt[slot]] = found[slot] + n
    return found


def store_map(
    spark: SparkSession, path: str, version: int, totals: list[tuple[int, int, int]], dealt: dict[int, int]
) -> DataFrame:
    """Writes one version of the map below ``path`` and reads it back; older versions stay as they are.

    It has every slot, also those without rows, with the totals and ``first_position`` as they were when it was stored.
    """
    begin = first_positions(totals, dealt)
    rows = [(version, slot, dealt[slot], size, n, begin[slot]) for slot, size, n in totals]
    place = f"{path}/version={version}"
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.parquet(place)
    return spark.read.schema(MAP_SCHEMA).parquet(place)


def latest_map(spark: SparkSession, path: str) -> DataFrame | None:
    """The latest version of the map below ``path``, None where no map has been stored."""
    try:
        stored = spark.read.schema(MAP_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    version = stored.agg(F.max("version")).first()[0]
    return None if version is None else stored.where(F.col("version") == version)


def rebalance(spark: SparkSession, path: str, shards: int) -> DataFrame:
    """Reads the latest version of the map below ``path``, edits it for ``shards`` shards and stores it as the next version.

    The map has one row per slot, so it passes the driver whatever the corpus. A map of an empty table is edited like
    any other: its slots are shared out by number. Without a stored map: ValueError.
    """
    stored = latest_map(spark, path)
    if stored is None:
        raise ValueError(f"there is no slot map below {path}")
    rows = stored.orderBy("virtual_slot").collect()
    totals = [(r.virtual_slot, r.slot_bytes, r.slot_rows) for r in rows]
    dealt = {r.virtual_slot: r.shard for r in rows}
    return store_map(spark, path, rows[0].version + 1, totals, rebalanced(totals, dealt, shards))


def shard(docs: DataFrame, shards: int = 24, slots: int = 8192, map_path: str | None = None) -> DataFrame:
    """Every document's shard and place: doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot.

    The law is ``bytes``: shards get near equal bytes, as close as the smallest slots allow. ``slot`` counts the rows
    of a shard from 0 without gaps, ordered by virtual slot, doc_id and checksum. ``grown_shard`` is null, as the map
    and not the key decides. The map has one row per slot, the proven bound of what is broadcast. Where a map is stored
    below ``map_path`` already, its latest version decides slots and shards, also for documents it has not seen, and
    places are counted anew.

    Empty table: no rows. Null text: size 8. Rows that repeat doc_id and text share a virtual slot and get places of
    their own, in any order. Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    stored = latest_map(spark, map_path) if map_path else None
    if stored is not None:
        return numbered(with_slots(docs, stored.count()), stored)
    placed = with_slots(docs, slots)
    totals = slot_totals(placed, slots)
    path = map_path or f"{shared_dir(spark)}/slot-maps/{uuid.uuid4().hex}"
    return _numbered(placed, store_map(spark, path, 1, totals, balanced(totals, shards)))


def numbered(placed: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Rows of ``with_slots`` by a stored map, which may be older: where slots begin is counted from the rows at hand."""
    rows = slot_map.collect()
    totals = slot_totals(placed, len(rows))
    begin = first_positions(totals, {r.virtual_slot: r.shard for r in rows})
    now = [(r.version, r.virtual_slot, r.shard, *totals[r.virtual_slot][1:], begin[r.virtual_slot]) for r in rows]
    return _numbered(placed, placed.sparkSession.createDataFrame(now, MAP_SCHEMA))


def _numbered(placed: DataFrame, slot_map: DataFrame) -> DataFrame:
    in_slot = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32")
    ranked = placed.withColumn("in_slot", F.row_number().over(in_slot) - 1)
    where = slot_map.select("virtual_slot", "shard", "first_position")
    return ranked.join(F.broadcast(where), "virtual_slot").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first_position") + F.col("in_slot")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )
