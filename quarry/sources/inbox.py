"""A Python data source over an inbox of webhook requests, for streams by offset and for batches.

``spark.readStream.format("quarry_inbox").option("path", folder)``: a receiver closes one segment after the other, as folders
``segment=<n>`` of JSON lines with ``route, pin, form, body``. An offset is the number of segments before it, so a stream that
starts again goes on behind the last segment that it has noted, and a batch that is run again reads the same segments.
Segments are planned on the driver by name alone and read by the tasks, some in one. A line that isn't a JSON object is a
request without a route.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "segment long, line int, route string, pin string, form string, body string"
#: Segments that one task reads.
TOGETHER = 8


class Segments(InputPartition):
    def __init__(self, first: int, behind: int):
        self.first, self.behind = first, behind


class _Inbox:
    def __init__(self, options):
        self.folder = options["path"].rstrip("/")
        self.seen = 0

    def _opened(self):
        from pyarrow import fs

        by_uri = "://" in self.folder or self.folder.startswith("file:")
        return fs.FileSystem.from_uri(self.folder) if by_uri else (fs.LocalFileSystem(), self.folder)

    def closed(self) -> int:
        """How many segments are closed: they are numbered from 0 without gaps."""
        from pyarrow import fs

        files, folder = self._opened()
        while files.get_file_info(f"{folder}/segment={self.seen}").type != fs.FileType.NotFound:
            self.seen += 1
        return self.seen

    def planned(self, first: int, behind: int) -> list[Segments]:
        return [Segments(at, min(at + TOGETHER, behind)) for at in range(first, behind, TOGETHER)] or [Segments(0, 0)]

    def read(self, partition):
        from pyarrow import fs

        files, folder = self._opened()
        for segment in range(partition.first, partition.behind):
            line = 0
            for info in sorted(files.get_file_info(fs.FileSelector(f"{folder}/segment={segment}")), key=lambda i: i.path):
                if not info.is_file or info.base_name[0] in "._":
                    continue
                with files.open_input_stream(info.path) as f:
                    for one in f.read().decode().split("\n"):
                        if not one.strip():
                            continue
                        try:
                            found = json.loads(one)
                        except ValueError:
                            found = None
                        found = found if isinstance(found, dict) else {"body": one}
                        texts = (found.get(name) for name in ("route", "pin", "form", "body"))
                        yield (segment, line, *(t if t is None or isinstance(t, str) else json.dumps(t) for t in texts))
                        line += 1


class InboxReader(_Inbox, DataSourceReader):
    def partitions(self):
        return self.planned(0, self.closed())


class InboxStream(_Inbox, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"segment": 0}

    def latestOffset(self) -> dict:
        return {"segment": self.closed()}

    def partitions(self, start: dict, end: dict):
        return self.planned(start["segment"], end["segment"])


class InboxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quarry_inbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return InboxReader(self.options)

    def streamReader(self, schema):
        return InboxStream(self.options)


def stream(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(InboxSource)
    return spark.readStream.format("quarry_inbox").option("path", path).load()


def batch(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(InboxSource)
    return spark.read.format("quarry_inbox").option("path", path).load()


def fill(requests: DataFrame, path: str, first: int, rows: int = 1000) -> None:
    """Closes segments from number ``first`` on with requests that have a ``place`` from 1."""
    segment = (F.lit(first) + F.floor((F.col("place") - 1) / rows)).cast("long")
    dealt = requests.withColumn("segment", segment).repartition("segment").sortWithinPartitions("segment", "place")
    dealt.select("segment", "route", "pin", "form", "body").write.mode("append").partitionBy("segment").option("ignoreNullFields", "true").json(path)
