"""Recording and settling trades as streams."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from augury.operators import trading
from augury.sources.log import TradeStore


def record_stream(signals: DataFrame, store: TradeStore, now: datetime, checkpoint: str, order_by: list[str], segments=None, timezones: DataFrame | None = None, **trigger) -> StreamingQuery:
    """Record each micro-batch: allowed, fresh, first of its key, not recorded yet.

    A batch that runs again after a failure adds nothing: its keys are recorded.  Nor do
    several streams at once: of a key's recordings the earliest counts.  The deadline is
    per row, so it is a filter and no watermark.
    """

    def batch(df: DataFrame, _: int) -> None:
        store.append(trading.record(df, store.read(), now, order_by, segments, timezones))

    return signals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


#: Months of target dates that a batch of truths reads by name; beyond, all are read.
NAMED_MONTHS = 240


def settle_stream(truth: DataFrame, store: TradeStore, specs: DataFrame, today: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Settle open trades as truths arrive (city, target_date, is_final, truth_label, truth_value).

    A batch reads the trades of its target dates' months and appends what it settles, no more; a
    batch that runs again settles nothing twice, for the earliest settlement counts.
    """

    def batch(df: DataFrame, number: int) -> None:
        # of several truths of a batch for one key: the final one, then the greater
        told = df.groupBy("city", "target_date").agg(F.max(F.struct(F.coalesce("is_final", F.lit(False)).alias("is_final"), "truth_label", "truth_value")).alias("t")).select("city", "target_date", "t.*").persist()
        named = specs.drop("is_final", "truth_label", "truth_value").join(told, ["city", "target_date"])
        months = [r[0] for r in told.select(store.month(F.col("target_date"))).distinct().limit(NAMED_MONTHS + 1).collect()]
        old = store.read(months if len(months) <= NAMED_MONTHS else None)
        done = trading.settle(old.filter("outcome is null"), named, today).filter("newly_settled")
        store.settle(done, f"{today}#{number:012d}")
        told.unpersist()

    return truth.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def first_of_each_stream(signals: DataFrame, event_time: str, delay: str) -> DataFrame:
    """Without a table of trades: one signal per key while the watermark keeps the key."""
    return signals.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(trading.KEYS)
