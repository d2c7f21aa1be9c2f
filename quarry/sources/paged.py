"""A Python data source over a paged service: partitions from page metadata, filters pushed down to whole pages.

``spark.read.format("quarry_pages").option("path", folder)``. A service is a folder that all executors read:

* ``_libraries/*.json``: one line a library with ``library, title, kind, enabled``;
* ``_pages/*.json``: one line a page with ``library, page, rows, oldest, newest`` (numbers, of ``added``);
* ``library=<id>/page=<n>/*.json``: the page's rows as JSON lines, or ``*.json.gz``; in order of
  ``_place``, where rows have it, else as listed.

A filter on ``library`` leaves the pages of other libraries unopened and is done with; bounds on ``added`` leave pages
unopened whose rows are all outside, and are checked again on the rows that are read. Every page is retried on its own.
A library whose first page is missing is empty; a page that can't be read later fails the query.

A folder without page metadata holds ``page-<n>.json``, numbered from 0 up to the first that is missing.
"""

from __future__ import annotations

import json
import time
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

#: Pages have 1,000 rows; three attempts, waiting 2, 4 seconds.
PAGE_ROWS, ATTEMPTS, WAIT_S = 1000, 3, 2.0
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class Pages(InputPartition):
    def __init__(self, places: list[tuple[str | None, int, str]]):
        self.places = places


class PagedReader(DataSourceReader):
    def __init__(self, schema, options):
        self.fields = schema.fieldNames()
        self.folder = options["path"].rstrip("/")
        self.attempts = int(options.get("attempts", ATTEMPTS))
        self.wait = float(options.get("wait_seconds", WAIT_S))
        self.together = int(options.get("pages_per_task", 8))
        self.libraries: set | None = None
        self.bounds: list[tuple[str, object]] = []

    def _opened(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)

    def _rows(self, files, folder: str):
        from pyarrow import fs

        for info in sorted(files.get_file_info(fs.FileSelector(folder, allow_not_found=True)), key=lambda i: i.path):
            if info.is_file and info.path.endswith((".json", ".json.gz")):  # opened by what its name says
                with files.open_input_stream(info.path) as f:
                    yield from (json.loads(line) for line in f.read().decode().splitlines() if line.strip())

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = getattr(f, "attribute", None)
            if name == ("library",) and isinstance(f, (EqualTo, In)):
                found = set(f.value) if isinstance(f, In) else {f.value}
                self.libraries = found if self.libraries is None else self.libraries & found
            else:
                if name == ("added",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.bounds.append(("newest", f.value))
                elif name == ("added",) and isinstance(f, (LessThan, LessThanOrEqual)):
                    self.bounds.append(("oldest", f.value))
                yield f

    def _wanted(self, page: dict) -> bool:
        if self.libraries is not None and page["library"] not in self.libraries:
            return False
        ends = ((page.get(end), end, value) for end, value in self.bounds)
        return all(at is None or (at >= value if end == "newest" else at <= value) for at, end, value in ends)

    def partitions(self):
        from pyarrow import fs

        files, folder = self._opened()
        listed = list(self._rows(files, f"{folder}/_pages"))
        if listed:
            first: dict = {}
            for page in listed:
                first[page["library"]] = min(page["page"], first.get(page["library"], page["page"]))
            asked = sorted((p for p in listed if self._wanted(p)), key=lambda p: (str(p["library"]), p["page"]))
            place = lambda library, page: f"{folder}/library={quote(str(library), safe='')}/page={page}"
            libraries = sorted({p["library"] for p in asked}, key=str)
            kinds = files.get_file_info([place(k, first[k]) for k in libraries]) if libraries else []
            there = {k for k, info in zip(libraries, kinds) if info.type != fs.FileType.NotFound}
            places = [(p["library"], p["page"], place(p["library"], p["page"])) for p in asked if p["library"] in there]
        else:
            places = []
            while files.get_file_info(at := f"{folder}/page-{len(places)}.json").is_file:
                places.append((None, len(places), at))
        parts = [Pages(places[k : k + self.together]) for k in range(0, len(places), self.together)]
        return parts or [Pages([])]

    def _page(self, files, place: str) -> list[dict]:
        for attempt in range(self.attempts):
            try:
                if place.endswith(".json"):
                    with files.open_input_stream(place) as f:
                        return [json.loads(line) for line in f.read().decode().splitlines() if line.strip()]
                files.get_file_info(place).type.name == "Directory" or self._missing(place)
                return sorted(self._rows(files, place), key=lambda row: row.get("_place", 0))
            except (OSError, ValueError):
                if attempt + 1 == self.attempts:
                    raise
                time.sleep(self.wait * 2**attempt)
        return []

    @staticmethod
    def _missing(place: str):
        raise FileNotFoundError(place)

    def read(self, partition):
        if partition is None:
            return
        files, _ = self._opened()
        for library, page, place in partition.places:
            for nth, row in enumerate(self._page(files, place)):
                known = {"library": library, "page": page, "position": page * 1_000_000 + nth}
                yield tuple(row[name] if name in row else known.get(name) for name in self.fields)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quarry_pages"

    def schema(self) -> str:
        return "id long, title string"

    def reader(self, schema):
        return PagedReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Makes the source known to the session and lets Spark hand it filters."""
    spark.dataSource.register(PagedSource)
    spark.conf.set(PUSHDOWN, "true")


def items(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    """The service's items; ``schema`` may name ``library``, ``page`` and ``position``, a row's place in its listing."""
    register(spark)
    return spark.read.format("quarry_pages").options(path=path, **options).schema(schema).load()


def libraries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("library string, title string, kind string, enabled boolean").json(f"{path}/_libraries")


def publish(
    rows: DataFrame, known: DataFrame, path: str, page_rows: int = PAGE_ROWS, shape: list[Column] | None = None, compression: str | None = None
) -> None:
    """Writes a service: rows (library, added, place, ...) as pages of successive places, and its libraries.

    ``place`` is a row's number, from 1, in an order in which a library's rows follow each other; it is kept as ``_place``.
    ``shape`` makes the item's fields from a row, after rows have been moved; without it they are the row's columns but
    for ``place``. ``compression`` is none or gzip.
    """
    paged = rows.withColumn("page", F.floor((F.col("place") - 1) / page_rows).cast("long"))
    sorted_rows = paged.repartition("library", "page").sortWithinPartitions("library", "page", "place")
    own = [c for c in rows.columns if c not in ("library", "place")] if shape is None else shape
    # The writer may sort by page alone once more, so a row says where it belongs.
    shaped = sorted_rows.select("library", "page", *own, F.col("place").alias("_place"))
    shaped.write.partitionBy("library", "page").json(path, mode="overwrite", compression=compression)
    pages = paged.groupBy("library", "page").agg(F.count("*").alias("rows"), F.min("added").alias("oldest"), F.max("added").alias("newest"))
    pages.write.json(f"{path}/_pages")
    known.write.json(f"{path}/_libraries")
