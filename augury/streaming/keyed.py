"""Settling as keyed state: open trades wait for the final truth of their city and date.

Trades and truths come as one stream in any order, over any number of restarts.  A key's
state is its waiting trades and, once known, the winner; a trade leaves the state when it
is settled.  No table of trades is read.

A trade passes through the state as JSON, packed and unpacked by Spark: for a key and batch
the state gains one array of its trades, so Python's work goes by keys, hardly by trades.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime
from itertools import batched

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from augury.functions import bins
from augury.operators import trading
from augury.sources.log import TradeStore

KEYS = ["city_or_segment", "target_date"]
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Times in JSON to the microsecond.
_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def events(trades: DataFrame | None, truths: DataFrame | None) -> DataFrame:
    """Trades (any columns, ``at``) and truths (city, target_date, is_final, truth_label, truth_value, outcome_bins, ``at``) as rows of one stream.

    ``at`` is the time by which a date is no longer in the future.
    """
    out = []
    if trades is not None:
        out.append(trades.withColumns({"kind": F.lit("trade"), "winner": F.lit(None).cast("string")}))
    if truths is not None:
        winner = F.coalesce("truth_label", bins.winning_label(F.col("truth_value"), "outcome_bins"))
        final = F.coalesce("is_final", F.lit(False))
        out.append(truths.select(F.col("city").alias("city_or_segment"), "target_date", F.lit("truth").alias("kind"), F.when(final, winner).alias("winner"), "at"))
    both = out[0] if len(out) == 1 else out[0].unionByName(out[1], allowMissingColumns=True)
    return both.withColumns({k: F.coalesce(k, F.lit("")) for k in KEYS})


class Settling(StatefulProcessor):
    """Of one city and date: emits arrays of trades with the winner once a final truth has one and the date has come."""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "trades string")  # JSON arrays, of at most an Arrow batch of trades
        self.winner = handle.getValueState("winner", "winner string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        told = []
        for part in rows:
            told += [max(w)] if (w := [x for x in part["winner"] if isinstance(x, str)]) else []
            if new := [x for x in part["trade"] if isinstance(x, str)]:
                self.waiting.appendValue((f"[{','.join(new)}]",))
        winner = self._winner()
        if winner is None and told:
            winner = max(told)  # several at once: the greater
            self.winner.update((winner,))
        if winner is None:
            return  # nothing is due before a winner, so no timer either
        if key[1] <= _date(timerValues.getCurrentWatermarkInMs()):
            yield from self._settled(key, winner)
        elif (comes := _millis(key[1])) is not None:
            self.handle.registerTimer(comes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settled(key, self._winner())

    def _winner(self) -> str | None:
        found = self.winner.get()
        return found[0] if found else None

    def _settled(self, key, winner: str | None) -> Iterator[pd.DataFrame]:
        settles = False
        for some in batched(self.waiting.get(), 4):
            settles = True
            yield pd.DataFrame({KEYS[0]: key[0], KEYS[1]: key[1], "trades": [t for (t,) in some], "winner": winner})
        if settles:
            self.waiting.clear()

    def close(self) -> None:
        pass


def _date(millis: int) -> str:
    return datetime.fromtimestamp(millis / 1000, UTC).date().isoformat()


def _millis(date: str) -> int | None:
    try:
        return int(datetime.fromisoformat(date).replace(tzinfo=UTC).timestamp() * 1000)
    except ValueError:
        return None


def settled(stream: DataFrame, no_leg: str = "reference", delay: str = "1 hour") -> DataFrame:
    """Trades as they are settled, with outcome and realized_pnl, of a stream of ``events``.

    The clock is the watermark, ``delay`` behind the latest ``at``: trades of dates after it
    wait for the date.  ``at`` should be the time of arrival: rows behind the clock are late
    and dropped, as with any watermark.
    """
    names = [f.name for f in stream.schema if f.name not in (*KEYS, "kind", "winner", "at")]
    trade = T.StructType([stream.schema[n] for n in names])
    packed = F.when(F.col("kind") == "trade", F.to_json(F.struct(*[F.col(f"`{n}`") for n in names]), _EXACT)).alias("trade")
    rows = stream.withWatermark("at", delay).select(*KEYS, "at", packed, F.when((F.col("kind") == "truth") & (F.col("winner") != ""), F.col("winner")).alias("winner"))
    rows = rows.filter("trade is not null or winner is not null or at is null")  # with `at` a filter stays behind the watermark, which is to see all rows
    out = T.StructType([T.StructField(k, T.StringType()) for k in (*KEYS, "trades", "winner")])
    ready = rows.groupBy(*KEYS).transformWithStateInPandas(Settling(), out, "Append", "EventTime")
    each = F.explode(F.from_json("trades", T.ArrayType(trade), {**_EXACT, "mode": "FAILFAST"})).alias("trade")
    ready = ready.select(*KEYS, each, "winner").select(*KEYS, "trade.*", "winner")
    return trading.paid(ready, F.col("winner"), no_leg).drop("winner")


@contextmanager
def _state_in_rocks(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def settle_keyed_stream(stream: DataFrame, store: TradeStore, checkpoint: str, no_leg: str = "reference", delay: str = "1 hour", **trigger) -> StreamingQuery:
    """Settlements of a stream of ``events`` appended to ``store``; a batch that runs again settles nothing twice."""
    done = settled(stream, no_leg, delay)
    with _state_in_rocks(stream.sparkSession):  # the store is chosen when a query starts
        return done.writeStream.foreachBatch(lambda df, n: store.settle(df, f"{n:012d}")).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
