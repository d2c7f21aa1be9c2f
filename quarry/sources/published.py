"""Sinks that publish by one rename: versions of a table with rotated backups, and an outbox of streamed events.

``df.write.format("quarry_published").option("path", folder).mode("overwrite").save()`` writes a version. Tasks write
Parquet files into a folder that nobody reads. When all have ended, the version's list of files is written beside them and
one small file, ``_current.json``, is replaced by rename: who reads sees the old version or the new one, never parts. What a
failed attempt left behind isn't in the list. If the job fails, or a task or the driver is lost, the old version stays.
``keep`` versions stay (3), no older than ``max_age_days`` (0: any age); the current one stays in any case. One writer at a
time publishes a table.

``stream.writeStream.format("quarry_outbox")`` pushes events: each micro-batch is one published list of files by its number,
and a batch that runs again finds its number taken and adds nothing.

The store's rename must replace a file as a whole, as that of local and distributed file systems does.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

KEEP, DAY_S = 3, 86_400


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int


class Store:
    """A folder by path or URI, wherever it lies."""

    def __init__(self, folder: str):
        from pyarrow import fs

        by_uri = "://" in folder or folder.startswith("file:")
        self.files, self.folder = fs.FileSystem.from_uri(folder.rstrip("/")) if by_uri else (fs.LocalFileSystem(), folder.rstrip("/"))

    def at(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def read(self, name: str) -> dict | None:
        try:
            with self.files.open_input_stream(self.at(name)) as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def replace(self, name: str, value: dict) -> None:
        """Writes a small file beside its place and renames it: a reader finds the old or the new one, whole."""
        self.files.create_dir(self.folder, recursive=True)
        beside = self.at(f"{name}.{uuid.uuid4().hex}.tmp")
        with self.files.open_output_stream(beside) as f:
            f.write(json.dumps(value).encode())
        self.files.move(beside, self.at(name))

    def names(self, folder: str) -> list[str]:
        from pyarrow import fs

        return sorted(i.base_name for i in self.files.get_file_info(fs.FileSelector(self.at(folder), allow_not_found=True)))

    def drop(self, folder: str) -> None:
        from pyarrow import fs

        if self.files.get_file_info(self.at(folder)).type != fs.FileType.NotFound:
            self.files.delete_dir(self.at(folder))


def _part(store: Store, folder: str, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Part:
    """One task's file, row group by row group; without rows there is none."""
    from pyarrow import parquet

    rows, name, out = 0, f"part-{uuid.uuid4().hex}.parquet", None
    for batch in batches:
        if not batch.num_rows:
            continue
        if out is None:
            store.files.create_dir(store.at(folder), recursive=True)
            stream = store.files.open_output_stream(store.at(f"{folder}/{name}"))
            out = parquet.ParquetWriter(stream, batch.schema)
        out.write_batch(batch)
        rows += batch.num_rows
    if out is None:
        return Part("", 0)
    out.close()
    stream.close()
    return Part(name, rows)


def _listed(store: Store, folder: str, parts: list[Part | None]) -> dict:
    """The list of a folder's committed files; others in it, of attempts that failed, go."""
    kept = {p.name: p.rows for p in parts if p is not None and p.name}
    for name in store.names(folder):
        if name.endswith(".parquet") and name not in kept:
            store.files.delete_file(store.at(f"{folder}/{name}"))
    return {"files": sorted(kept), "rows": sum(kept.values())}


class VersionWriter(DataSourceArrowWriter):
    def __init__(self, schema: pa.Schema, options, overwrite: bool):
        if not overwrite:
            raise ValueError("a published table is replaced as a whole: use mode('overwrite')")
        self.schema, self.path = schema, options["path"]
        self.keep, self.max_age = int(options.get("keep", KEEP)), float(options.get("max_age_days", 0)) * DAY_S
        self.folder = f"_versions/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        return _part(Store(self.path), self.folder, self.schema, iterator)

    def commit(self, messages: list[Part | None]) -> None:
        store = Store(self.path)
        store.files.create_dir(store.at(self.folder), recursive=True)
        before = store.read("_current.json") or {"version": 0}
        for lost in _marks(store):  # of a driver that was lost before it could make its version the current one
            if lost["version"] > before["version"]:
                store.drop(lost["folder"])
        mark = {"version": before["version"] + 1, "folder": self.folder, "at": time.time()} | _listed(store, self.folder, messages)
        store.replace(f"{self.folder}/_version.json", mark)
        store.replace("_current.json", mark)
        self._prune(store, mark)

    def _prune(self, store: Store, current: dict) -> None:
        known = sorted((v for v in _marks(store) if v["version"] < current["version"]), key=lambda v: -v["version"])
        for nth, old in enumerate(known):
            if nth + 1 >= self.keep or self.max_age and current["at"] - old["at"] > self.max_age:
                store.drop(old["folder"])

    def abort(self, messages: list[Part | None]) -> None:
        Store(self.path).drop(self.folder)


def _marks(store: Store) -> list[dict]:
    found = (store.read(f"_versions/{name}/_version.json") for name in store.names("_versions"))
    return [v for v in found if v]


class PublishedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quarry_published"

    def writer(self, schema, overwrite: bool):
        from pyspark.sql.pandas.types import to_arrow_schema

        return VersionWriter(to_arrow_schema(schema), self.options, overwrite)


def publish(df: DataFrame, path: str, keep: int = KEEP, max_age_days: float = 0) -> None:
    """Makes the rows the table's current version."""
    df.sparkSession.dataSource.register(PublishedSource)
    df.write.format("quarry_published").option("path", path).option("keep", keep).option("max_age_days", max_age_days).mode("overwrite").save()


def versions(path: str) -> list[dict]:
    """The versions that are there, oldest first, with their numbers, times, rows and files."""
    store = Store(path)
    current = store.read("_current.json")
    return sorted((v for v in _marks(store) if current and v["version"] <= current["version"]), key=lambda v: v["version"])


def published(spark: SparkSession, path: str, schema, version: int | None = None) -> DataFrame:
    """The current version, or an older one that is still there; before the first there are no rows."""
    found = Store(path).read("_current.json") if version is None else next((v for v in versions(path) if v["version"] == version), None)
    if found is None and version is not None:
        raise ValueError(f"there is no version {version} below {path}")
    return _read(spark, path, schema, [f"{found['folder']}/{name}" for name in found["files"]] if found else [])


def _read(spark: SparkSession, path: str, schema, names: list[str]) -> DataFrame:
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path.rstrip('/')}/{name}" for name in names])


class OutboxWriter(DataSourceStreamArrowWriter):
    """Events of a stream: batch n is ``_batches/<n>.json``, a list of files, written once."""

    def __init__(self, schema: pa.Schema, options):
        self.schema, self.path = schema, options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        return _part(Store(self.path), "events", self.schema, iterator)

    def commit(self, messages: list[Part | None], batchId: int) -> None:
        store = Store(self.path)
        names = [p.name for p in messages if p is not None and p.name]
        if store.read(f"_batches/{batchId}.json") is not None:
            for name in names:  # this batch was pushed before the stream could note it down
                store.files.delete_file(store.at(f"events/{name}"))
            return
        store.files.create_dir(store.at("_batches"), recursive=True)
        store.replace(f"_batches/{batchId}.json", {"batch": batchId, "files": names, "rows": sum(p.rows for p in messages if p is not None)})

    def abort(self, messages: list[Part | None], batchId: int) -> None:
        store = Store(self.path)
        for part in messages:
            if part is not None and part.name:
                store.files.delete_file(store.at(f"events/{part.name}"))


class OutboxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quarry_outbox"

    def streamWriter(self, schema, overwrite: bool):
        from pyspark.sql.pandas.types import to_arrow_schema

        return OutboxWriter(to_arrow_schema(schema), self.options)


def pushed(spark: SparkSession, path: str, schema) -> DataFrame:
    """The events of all batches that were pushed."""
    store = Store(path)
    batches = [store.read(f"_batches/{name}") for name in store.names("_batches") if name.endswith(".json")]
    return _read(spark, path, schema, [f"events/{name}" for b in batches if b for name in b["files"]])
