"""Market listings from page dumps, and a table that keeps answers until they expire.

A dump is a folder of newline-delimited JSON files, one file for each page, named so
that names sort in page order.
"""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from augury.functions.scalars import cache_key, contains_text
from augury.operators import markets
from augury.sources import files
from augury.sources.log import EventLog

PAGES = "page int, pos int, body string"


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """page, pos and body (a market's JSON) of a dump; pages are read in parallel, each whole."""
    raw = spark.read.option("pathGlobFilter", "*.{json,ndjson}").text(folder, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    # a row for each page
    names = raw.select("file").distinct().select("file", (F.row_number().over(W.orderBy("file")) - 1).alias("page"))
    lines = F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")
    return raw.join(names, "file").select("page", F.posexplode(lines).alias("pos", "body")).select("page", "pos", F.trim("body").alias("body"))


def typed(pages: DataFrame, schema: str) -> DataFrame:
    """Bodies by schema; lists given as JSON lists or as texts of them both come out as text."""
    return pages.select("page", "pos", F.from_json("body", schema).alias("m")).select("page", "pos", "m.*")


def fetch_all(pages: DataFrame, keyword: str | None = None, page_size: int = 100, max_results: int | None = 1000) -> DataFrame:
    """What a paginated scan returns: pages up to the first short one or to max_results rows read, then the keyword, then max_results.

    The row budget counts before the keyword filters; None is no budget, and no order.
    """
    sizes = pages.groupBy("page").agg(F.count("*").alias("n"))
    short = sizes.agg(F.min(F.when(F.col("n") < page_size, F.col("page"))).alias("last_page"))
    kept = pages.crossJoin(F.broadcast(short)).filter(F.col("page") <= F.coalesce("last_page", F.lit(2**31 - 1))).drop("last_page")  # one row
    if max_results is not None:
        kept = kept.filter(F.col("page") <= -(-max_results // page_size) - 1)
    if keyword:
        kept = kept.filter(contains_text(F.get_json_object("body", "$.question"), keyword))
    return kept if max_results is None else kept.orderBy("page", "pos").limit(max_results)


def scan_temperature_markets(spark: SparkSession, folder: str, year: int, page_size: int = 100, cache: AnswerTable | None = None, now: datetime | None = None) -> DataFrame:
    """All pages up to the first short one, the strict temperature markets of them, parsed.

    With a table of answers, pages whose answers have not expired at ``now`` come from it;
    the others are read and kept there, so that a poll reads again only what is due.
    """
    pages = read_pages(spark, folder) if cache is None else cached_pages(spark, folder, cache, now or datetime.now())
    raw = typed(fetch_all(pages, page_size=page_size, max_results=None), markets.RAW)
    return markets.temperature_infos(raw.filter(markets.is_temperature_strict()), year)


def cached_pages(spark: SparkSession, folder: str, cache: AnswerTable, now: datetime) -> DataFrame:
    """Pages by way of the table: request ``folder#page``, value the page's bodies as a JSON list."""
    pages = read_pages(spark, folder)
    request = F.concat(F.lit(f"{folder}#"), F.col("page").cast("string"))
    due = pages.select("page").distinct().join(cache.valid(now).select(F.substring_index("request", "#", -1).cast("int").alias("page"), "request").filter(F.col("request") == request), "page", "left_anti")
    # a page is as large as a page
    answers = pages.join(due, "page").groupBy("page").agg(F.sort_array(F.collect_list(F.struct("pos", "body"))).alias("b"))
    cache.put(answers.select(request.alias("request"), F.to_json(F.transform("b", lambda x: x["body"])).alias("value")), now)
    return known_pages(folder, cache, now)


def known_pages(folder: str, cache: AnswerTable, now: datetime) -> DataFrame:
    """page, pos and body of the pages whose answers count at ``now``."""
    known = cache.valid(now).filter(F.startswith("request", F.lit(f"{folder}#")))
    return known.select(F.substring_index("request", "#", -1).cast("int").alias("page"), F.posexplode(F.from_json("value", "array<string>")).alias("pos", "body"))


def midpoints(tokens: DataFrame, prices: DataFrame) -> DataFrame:
    """Prices for tokens; tokens whose answer is missing or no number are dropped.

    prices: token_id and answer, a JSON text such as {"mid": "0.65"}.
    """
    mid = F.get_json_object("answer", "$.mid").try_cast("double")
    return tokens.select("token_id").distinct().join(prices.select("token_id", mid.alias("price")).filter("price is not null"), "token_id")


def with_prices(markets: DataFrame, prices: DataFrame) -> DataFrame:
    return markets.join(prices, "token_id", "left")


class AnswerTable:
    """Answers by request, as a log: the latest one that has not expired counts.

    Answers lie in 16 partitions by the first sign of their key, and their files have Bloom
    filters on it, so that a look at a few requests reads few of them.
    """

    SCHEMA = "key string, request string, value string, expires_at timestamp_ntz, stored_at timestamp_ntz, deleted boolean"
    #: Requests that are looked up by name; for more, read ``valid`` and join.
    NAMED = 200

    def __init__(self, spark: SparkSession, folder: str, ttl_seconds: int = 3600):
        self.spark, self.ttl, self.rows = spark, ttl_seconds, EventLog(spark, folder, self.SCHEMA, "first", ("key",))

    def read(self) -> DataFrame:
        return self.rows.read().drop("first")

    def put(self, answers: DataFrame, now: datetime) -> None:
        """answers: request, value (JSON text)."""
        self._add(answers.select("request", "value"), now, now + timedelta(seconds=self.ttl), False)

    def delete(self, requests: DataFrame, now: datetime) -> None:
        self._add(requests.select("request", F.lit(None).cast("string").alias("value")), now, now, True)

    def _add(self, rows: DataFrame, now: datetime, until: datetime, deleted: bool) -> None:
        key = cache_key("request")
        rows = rows.select(key.alias("key"), "request", "value", self._ntz(until).alias("expires_at"), self._ntz(now).alias("stored_at"), F.lit(deleted).alias("deleted"), F.substring(key, 1, 1).alias("first"))
        self.rows.append(rows)

    @staticmethod
    def _ntz(t: datetime) -> Column:
        return F.lit(t.replace(tzinfo=None)).cast("timestamp_ntz")

    def _valid(self, rows: DataFrame, now: datetime) -> DataFrame:
        at = self._ntz(now)
        last = rows.filter(F.col("stored_at") <= at).groupBy("key").agg(F.max_by(F.struct("request", "value", "expires_at", "deleted"), F.struct("stored_at", "deleted")).alias("a")).select("a.*")
        return last.filter(~F.col("deleted") & (at < F.col("expires_at")) & F.try_parse_json("value").isNotNull()).select("request", "value")

    def valid(self, now: datetime) -> DataFrame:
        """request and value of answers that count at ``now``; texts that are no JSON do not."""
        return self._valid(self.read(), now)

    def rows_of(self, requests: list[str]) -> DataFrame:
        """The log's rows of a few requests: a filter on partition and key for each."""
        if len(requests) > self.NAMED:
            raise ValueError(f"more than {self.NAMED} requests: join with valid()")
        keys = [hashlib.md5(r.encode()).hexdigest() for r in requests]
        wanted = reduce(or_, [(F.col("key") == k) for k in keys], F.lit(False))
        return self.rows.read().filter(F.col("first").isin(sorted({k[0] for k in keys})) & wanted).drop("first")

    def get(self, requests: list[str], now: datetime) -> DataFrame:
        """request and value of what counts among a few requests."""
        return self._valid(self.rows_of(requests), now)

    def typed(self, now: datetime, schema: str) -> DataFrame:
        """request and value of what counts, the value read by a schema; answers of another type do not count."""
        return self.valid(now).select("request", F.from_json("value", schema).alias("value")).filter("value is not null")

    def _expired(self, now: datetime) -> Column:
        return F.col("deleted") | (self._ntz(now) >= F.col("expires_at"))

    def n_expired(self, now: datetime) -> int:
        return self.read().filter(self._expired(now)).count()

    def purge(self, now: datetime) -> int:
        """Drop the rows that have expired or are deleted; returns their number. What held them goes with the next purge."""
        n = self.n_expired(now)
        if not n:
            self.rows.sweep()
        else:

            def kept(rows: DataFrame) -> DataFrame:
                gone = rows.filter("deleted").groupBy("key").agg(F.max("stored_at").alias("gone"))
                return rows.filter(~self._expired(now)).join(gone, "key", "left").filter("gone is null or stored_at > gone").drop("gone").distinct()

            self.rows.rewrite(kept)
        return n


def write_dump(bodies: DataFrame, folder: str) -> None:
    """Add pages (page, body) to a dump, a file for each, by as many tasks as there are pages; a page is as large as a page."""
    spark, aside = bodies.sparkSession, files.scratch(bodies.sparkSession)
    one = bodies.groupBy("page").agg(F.array_join(F.sort_array(F.collect_list("body")), "\n").alias("value"))
    one.write.partitionBy("page").text(aside)
    for path in files.found(spark, f"{aside}/page=*/*.txt"):
        page = int(path.rsplit("/page=", 1)[1].split("/")[0])
        files.move(spark, path, f"{folder}/page-{page:06d}.ndjson")
    files.delete(spark, aside)


def remove_pages(spark: SparkSession, folder: str, first: int) -> None:
    """Take the pages from ``first`` on out of a dump."""
    for path in files.found(spark, f"{folder}/page-*.ndjson"):
        if int(path.rsplit("/page-", 1)[1].removesuffix(".ndjson")) >= first:
            files.delete(spark, path)


def dump_pages(rows: list[dict], folder: str, page_size: int = 100) -> None:
    """Write a dump, for tests and examples."""
    for i in range(0, len(rows), page_size):
        files.write_text(SparkSession.active(), f"{folder}/page-{i // page_size:06d}.ndjson", "".join(json.dumps(m) + "\n" for m in rows[i : i + page_size]))
