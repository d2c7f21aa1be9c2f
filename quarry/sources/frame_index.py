"""A small binary frame container: a fixed header, an index of offsets and the frames' bytes.

Layout, all numbers unsigned 32-bit little-endian: 8 bytes of magic, version, frame count, interval in milliseconds,
zeros up to byte 64; then (time, offset) for each frame and a sentinel (0xFFFFFFFF, end); then the frames in order.
Reading and writing are expressions on binary columns, so files are parsed where they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format.
MAGIC, HEADER, SENTINEL = "894249460D0A1A0A", 64, 0xFFFFFFFF


def number_at(content: Column, at: Column | int) -> Column:
    """The 32-bit number at a byte offset, as a long."""
    at = F.lit(at) if isinstance(at, int) else at
    digits = F.hex(F.substring(content, at + 1, F.lit(4)))
    turned = F.concat(*[F.substring(digits, 7 - 2 * i, 2) for i in range(4)])
    return F.conv(turned, 16, 10).cast("long")


def number_bytes(value: Column) -> Column:
    digits = F.lpad(F.hex(value.cast("long")), 8, "0")
    return F.unhex(F.concat(*[F.substring(digits, 7 - 2 * i, 2) for i in range(4)]))


def read_index(files: DataFrame, content: str = "content") -> DataFrame:
    """The files' columns with ``version``, ``interval_ms`` and ``frames``, an array of (time, offset, size).

    Files with another magic, a count their length can't hold or without the sentinel are left out.
    """
    data = F.col(content)
    count = number_at(data, 12)
    end = HEADER + 8 * count
    rows = files.where((F.hex(F.substring(data, 1, 8)) == MAGIC) & (F.length(data) >= HEADER + 8))
    rows = rows.where((F.length(data) >= end + 8) & (number_at(data, F.least(end, F.length(data)).cast("int")) == SENTINEL))

    def frame(i: Column) -> Column:
        at = (HEADER + 8 * i).cast("int")
        offset = number_at(data, at + 4)
        return F.struct(number_at(data, at).alias("time"), offset.alias("offset"), (number_at(data, at + 12) - offset).alias("size"))

    none = F.array().cast("array<struct<time:bigint,offset:bigint,size:bigint>>")
    frames = F.when(count > 0, F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), frame)).otherwise(none)
    return rows.withColumns({"version": number_at(data, 8), "interval_ms": number_at(data, 16), "frames": frames})


def frames(indexed: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """One row per frame: keys, frame (its number), time, body."""
    rows = indexed.select(*keys, content, F.posexplode("frames").alias("frame", "f"))
    body = F.substring(F.col(content), (F.col("f.offset") + 1).cast("int"), F.col("f.size").cast("int"))
    return rows.select(*keys, "frame", "f.time", body.alias("body"))


def written_files(rows: DataFrame, key: str, order: str, body: str, interval_ms: int) -> DataFrame:
    """key, content: the container of each key's bodies in order. A container is one file, so one row by its nature."""
    bodies = F.transform(F.array_sort(F.collect_list(F.struct(order, body))), lambda x: x[body])
    packed = rows.groupBy(key).agg(bodies.alias("bodies"))
    count = F.size("bodies")
    first = F.lit(HEADER) + 8 * (count + 1)
    ends = F.transform(
        "bodies", lambda b, i: first + F.aggregate(F.slice("bodies", F.lit(1), i), F.lit(0), lambda s, x: s + F.length(x))
    )
    index = F.transform(ends, lambda at, i: F.concat(number_bytes(i), number_bytes(at)))
    total = first + F.aggregate("bodies", F.lit(0), lambda s, x: s + F.length(x))
    head = F.concat(
        F.unhex(F.lit(MAGIC)), number_bytes(F.lit(0)), number_bytes(count), number_bytes(F.lit(interval_ms)),
        F.unhex(F.lit("00" * (HEADER - 20))),
    )
    joined = lambda parts: F.aggregate(parts, F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x))
    return packed.select(key, F.concat(head, joined(index), number_bytes(F.lit(SENTINEL)), number_bytes(total), joined(F.col("bodies"))).alias("content"))
