"""Polling of page dumps as a streaming source, with the table of answers as its sink.

Time is cut into rounds of ``ttl`` seconds; a page counts for the round in which it was read.
The offset is the round and the number of pages seen in it.  Inside a round a batch is
the pages that came since the last one; a new round makes all pages due again.  So a stream
that starts again from its checkpoint reads no page twice in a round, and a poll costs the
listing of names and the pages that are due.  Each task reads a run of pages.

Tasks and the planner read the folder by Arrow's file systems (local, hdfs, s3, gs), as
Python workers have no Hadoop client.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from augury.sources.listings import AnswerTable, fetch_all, known_pages

FORMAT = "augury_pages"
SCHEMA = "round long, page int, pos int, body string"


@dataclass
class Run(InputPartition):
    """Pages first to end - 1 of a round, by the names of their files."""

    round: int
    first: int
    names: list[str]


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)


class PageReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.ttl, self.run = options["path"], int(options.get("ttl", "3600")), int(options.get("pagespertask", "16"))
        self.now = options.get("now")

    def _names(self) -> list[str]:
        system, root = _opened(self.folder)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted(f.path for f in found if f.is_file and f.base_name.endswith((".json", ".ndjson")) and not f.base_name.startswith(("_", ".")))

    def initialOffset(self) -> dict:
        return {"round": -1, "pages": 0}

    def latestOffset(self) -> dict:
        return {"round": int(float(self.now or time.time()) // self.ttl), "pages": len(self._names())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first = start["pages"] if start["round"] == end["round"] else 0
        names = self._names()[: end["pages"]]
        return [Run(end["round"], k, names[k : min(k + self.run, len(names))]) for k in range(first, len(names), self.run)]

    def read(self, partition: Run) -> Iterator[tuple]:
        system, _ = _opened(self.folder)
        for page, name in enumerate(partition.names, partition.first):
            with system.open_input_stream(name) as f:
                lines = [line.strip() for line in f.read().decode().splitlines() if line.strip()]  # a page
            for pos, body in enumerate(lines or [None]):
                yield partition.round, page, pos, body


class Pages(DataSource):
    """A dump's pages: round, page, pos and body; a page without markets is a row with a null body."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> PageReader:
        return PageReader({k.lower(): v for k, v in self.options.items()})


def poll_pages(spark: SparkSession, folder: str, cache: AnswerTable, checkpoint: str, now: datetime | None = None, pages_per_task: int = 16, **trigger) -> StreamingQuery:
    """Keep the pages that are due as answers, request ``folder#page``, each until its round ends.

    A batch that runs again after a failure stores the same answers again, which changes nothing.
    """
    spark.dataSource.register(Pages)
    source = spark.readStream.format(FORMAT).option("ttl", str(cache.ttl)).option("pagesPerTask", str(pages_per_task))
    if now is not None:
        source = source.option("now", str(now.replace(tzinfo=UTC).timestamp()))

    def batch(df: DataFrame, _: int) -> None:
        # a page is as large as a page
        kept = df.groupBy("round", "page").agg(F.sort_array(F.collect_list(F.when(F.col("body").isNotNull(), F.struct("pos", "body")))).alias("b"))
        answers = kept.select("round", F.concat(F.lit(f"{folder}#"), F.col("page").cast("string")).alias("request"), F.to_json(F.transform("b", lambda x: x["body"])).alias("value")).persist()
        for r in sorted(x[0] for x in answers.select("round").distinct().collect()):  # a batch has one round
            at = datetime.fromtimestamp(r * cache.ttl, UTC).replace(tzinfo=None)
            cache.put(answers.filter(F.col("round") == r), at)
        answers.unpersist()

    return source.load(folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def polled_markets(folder: str, cache: AnswerTable, now: datetime, page_size: int = 100) -> DataFrame:
    """The pages that count at ``now``, up to the first short one: page, pos and body."""
    return fetch_all(known_pages(folder, cache, now), page_size=page_size, max_results=None)
