"""Logs of events: rows are added, never changed, by any number of writers at once.

Each append is a folder of its own, written by Spark's committer, so writers share no file
and no list of files; its ``_SUCCESS`` file, the last to come, is what makes it visible, so
a write that failed or still goes on is not seen.  Rows lie in partitions of a column, by
which reads prune folders.  What a table holds is a fold over its events that repeats
don't change; so ``rewrite`` may show rows twice for a moment, but loses none.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from augury.operators.trading import KEYS
from augury.schemas import TRADE, struct
from augury.sources import files


class EventLog:
    """Rows of ``schema`` under ``folder``, in partitions of the last column ``by``; ``bloom`` names columns with Bloom filters."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, by: str, bloom: tuple[str, ...] = ()):
        self.spark, self.folder, self.schema, self.by, self.bloom = spark, str(folder), struct(f"{schema}, {by} string"), by, bloom

    def writes(self) -> list[str]:
        """The folders of the writes that have ended."""
        return [p.removesuffix("/_SUCCESS") for p in files.found(self.spark, f"{self.folder}/write=*/_SUCCESS")]

    def append(self, rows: DataFrame) -> None:
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        out = rows.hint("rebalance", self.by).write.partitionBy(self.by)  # a file for each partition, more for a large one
        for c in self.bloom:
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
        out.parquet(f"{self.folder}/write={uuid.uuid4().hex}")

    def read(self, writes: list[str] | None = None) -> DataFrame:
        writes = self.writes() if writes is None else writes
        if not writes:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", self.folder).parquet(*writes).drop("write")

    def rewrite(self, kept=lambda rows: rows) -> None:
        """Many writes become one of the rows that ``kept`` gives; writes that end meanwhile stay as they are.

        The old folders are hidden, and removed by the next rewrite: a reader may have planned on them.
        """
        self.sweep()
        old = self.writes()
        if old:
            self.append(kept(self.read(old)))
            for w in old:
                files.rename(self.spark, f"{w}/_SUCCESS", f"{w}/_HIDDEN")

    def sweep(self) -> None:
        """Remove what the last rewrite hid."""
        for p in files.found(self.spark, f"{self.folder}/write=*/_HIDDEN"):
            files.delete(self.spark, p.removesuffix("/_HIDDEN"))


class TradeStore:
    """Trades as events: recorded once, settled once; the state is the first of each for a trade.

    A trade is told by ``identity``.  Of several recordings, and of several settlements, the
    earliest counts, then the least; so any number of recorders and settlers may run at
    once.  Events lie by the months of the trades' target dates, so settling some dates reads
    only their months.
    """

    def __init__(self, spark: SparkSession, folder: str, identity: tuple[str, ...] | list[str] = tuple(KEYS)):
        self.spark, self.identity = spark, list(identity)
        self.log = EventLog(spark, folder, f"event string, at string, {TRADE}", "month")

    @staticmethod
    def month(date: Column) -> Column:
        return F.coalesce(F.substring(date, 1, 7), F.lit("none"))

    def append(self, trades: DataFrame) -> None:
        """Record trades; those whose identity is recorded already change nothing."""
        self.log.append(trades.select(F.lit("recorded").alias("event"), F.coalesce("recorded_at", F.lit("")).alias("at"), *[f.name for f in struct(TRADE)], self.month(F.col("target_date")).alias("month")))

    def settle(self, settled: DataFrame, at: str) -> None:
        """Settle trades (identity, target_date, outcome, realized_pnl): only these are written."""
        told = {*self.identity, "target_date", "outcome", "realized_pnl"}
        cells = [F.col(f.name) if f.name in told else F.lit(None).cast(f.dataType).alias(f.name) for f in struct(TRADE)]
        self.log.append(settled.select(F.lit("settled").alias("event"), F.lit(at).alias("at"), *cells, self.month(F.col("target_date")).alias("month")))

    def read(self, months: list[str] | None = None) -> DataFrame:
        """The trades as they stand; of some months of target dates only these are read."""
        events = self.log.read()
        if months is not None:
            events = events.filter(F.col("month").isin(months))
        names = [f.name for f in struct(TRADE)]
        first = F.col("event") == "recorded"
        keys = [F.col(k).alias(f"__{k}") for k in self.identity]
        trade = F.min(F.when(first, F.struct("at", *names))).alias("t")
        done = F.min(F.when(~first, F.struct("at", "outcome", "realized_pnl"))).alias("s")
        state = events.groupBy(*keys).agg(trade, done).filter("t is not null")
        own = state["t"]["outcome"].isNotNull()
        cells = {"outcome": F.when(own, F.col("t.outcome")).otherwise(F.col("s.outcome")), "realized_pnl": F.when(own, F.col("t.realized_pnl")).otherwise(F.col("s.realized_pnl"))}
        return state.select(*[cells.get(n, F.col(f"t.{n}")).alias(n) for n in names])

    def compact(self) -> None:
        """One write in place of many, without repeated events."""
        self.log.rewrite(lambda rows: rows.distinct())
