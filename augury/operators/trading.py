"""Paper trades: record signals, settle trades, summarise; dry-run order receipts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from augury.functions import bins
from augury.functions import scalars as S
from augury.schemas import require

KEYS = ["city_or_segment", "target_date", "horizon"]


def min_edge(signals: DataFrame, least: float = 0.20) -> DataFrame:
    return signals.filter(F.coalesce("best_edge", F.lit(0.0)) >= least)


def allowed(signals: DataFrame, segments: DataFrame | list[str] | None) -> DataFrame:
    """None allows all, an empty list nothing."""
    if segments is None:
        return signals
    if isinstance(segments, list | set | tuple):
        segments = signals.sparkSession.createDataFrame([(s,) for s in segments], "segment string")
    keep = segments.select(F.col("segment").alias("city_or_segment")).distinct()
    return signals.join(keep, "city_or_segment", "left_semi")


def fresh(signals: DataFrame, now: datetime | Column, timezones: DataFrame | None = None) -> DataFrame:
    """Signals whose horizon's cutoff, in the segment's time zone (UTC if unknown), has not passed.

    ``timezones`` has city_or_segment and tz.
    """
    now = now if isinstance(now, Column) else F.lit(now.replace(tzinfo=None)).cast("timestamp_ntz")
    if timezones is None:
        return signals.filter(~S.is_stale("target_date", "horizon", F.lit("UTC"), now))
    tz = timezones.groupBy("city_or_segment").agg(F.min("tz").alias("__tz"))
    return signals.join(tz, "city_or_segment", "left").filter(~S.is_stale("target_date", "horizon", "__tz", now)).drop("__tz")


def first_of_each(signals: DataFrame, order_by: list[str]) -> DataFrame:
    """The first signal of each segment, date and horizon."""
    place = F.row_number().over(W.partitionBy(*KEYS).orderBy(*order_by))  # Spark keeps a task's first of each key before the exchange
    return signals.withColumn("__place", place).filter("__place = 1").drop("__place")


def not_recorded(signals: DataFrame, trades: DataFrame) -> DataFrame:
    return signals.join(trades.select(*KEYS).distinct(), KEYS, "left_anti")


def to_trades(signals: DataFrame, recorded_at: str, flat_stake: float = 1.0, bps: float = 30.0) -> DataFrame:
    return signals.select(
        F.lit(recorded_at).alias("recorded_at"),
        "city_or_segment",
        "target_date",
        "outcome_label",
        "direction",
        "gamma_price",
        F.round("best_edge", 6).alias("edge_after_fee"),
        "horizon",
        F.lit(float(flat_stake)).alias("flat_stake"),
        F.round(S.flat_stake_size(flat_stake, S.entry_price("direction", "gamma_price")), 6).alias("size"),
        F.round(S.fee(flat_stake, bps), 6).alias("fee_paid"),
        F.lit(None).cast("string").alias("outcome"),
        F.lit(None).cast("double").alias("realized_pnl"),
    )


def record(signals: DataFrame, existing: DataFrame | None, now: datetime, order_by: list[str], segments=None, timezones: DataFrame | None = None, flat_stake: float = 1.0, bps: float = 30.0) -> DataFrame:
    """The new trades: allowed, fresh, first of their key, and not recorded before."""
    require(signals, [*KEYS, "gamma_price", "best_edge", "direction", "outcome_label"])
    new = fresh(allowed(signals, segments), now, timezones)
    new = first_of_each(new, order_by)
    if existing is not None:
        new = not_recorded(new, existing)
    return to_trades(new, now.isoformat(), flat_stake, bps)


def settle(trades: DataFrame, specs: DataFrame, today: str, no_leg: str = "reference") -> DataFrame:
    """Trades with outcome, realized_pnl, pending_reason, newly_settled and is_profitable.

    outcome says whether the label won, whatever the direction; is_profitable whether the
    trade gained (null while it is open).

    specs: city, target_date, pos (the last of equal keys wins), outcome_bins, and the
    truth as is_final, truth_label, truth_value.  Reasons, in order: future, no_spec,
    not_final, no_truth, no_bin.  A settled trade stays as it is.  A "no" trade settles
    as a sale at its entry price, or with no_leg="complement" as a purchase of the
    complement.
    """
    # ties of pos: the truth that is final, then the greater label and value
    order = F.struct("pos", F.coalesce("is_final", F.lit(False)), "truth_label", "truth_value")
    keyed = specs.groupBy(F.coalesce("city", F.lit("")).alias("city_or_segment"), F.coalesce("target_date", F.lit("")).alias("target_date")).agg(
        F.max_by(F.struct("is_final", "truth_label", "truth_value", "outcome_bins"), order).alias("__s")
    )
    t = trades.withColumn("city_or_segment", F.coalesce("city_or_segment", F.lit(""))).withColumn("target_date", F.coalesce("target_date", F.lit("")))
    t = t.join(keyed, ["city_or_segment", "target_date"], "left")
    s = F.col("__s")
    winner = F.coalesce(s["truth_label"], bins.winning_label(s["truth_value"], s["outcome_bins"]))
    reason = (
        F.when(F.col("outcome").isNotNull(), None)
        .when(F.col("target_date") > today, "future")
        .when(s.isNull(), "no_spec")
        .when(~F.coalesce(s["is_final"], F.lit(False)), "not_final")
        .when(s["truth_label"].isNull() & s["truth_value"].isNull(), "no_truth")
        .when(winner.isNull(), "no_bin")
    )
    t = t.withColumn("__winner", winner).withColumn("pending_reason", reason)
    pnl = _profit(F.col("__winner"), no_leg)
    now = F.col("outcome").isNull() & F.col("pending_reason").isNull()
    return t.select(
        *[F.col(x) for x in trades.columns if x not in ("outcome", "realized_pnl")],
        F.when(now, S.outcome("outcome_label", "__winner")).otherwise(F.col("outcome")).alias("outcome"),
        F.when(now, F.round(pnl, 6)).otherwise(F.col("realized_pnl")).alias("realized_pnl"),
        "pending_reason",
        now.alias("newly_settled"),
        (F.when(now, F.round(pnl, 6)).otherwise(F.col("realized_pnl")) > 0).alias("is_profitable"),
    )


def _profit(winner: Column, no_leg: str) -> Column:
    """What a trade gains once ``winner`` is known."""
    if no_leg not in ("reference", "complement"):
        raise ValueError("no_leg must be reference or complement")
    direction, stake, fee = F.coalesce("direction", F.lit("yes")), F.coalesce("flat_stake", F.lit(1.0)), F.coalesce("fee_paid", F.lit(0.003))
    entry = S.entry_price(direction, "gamma_price")
    size = S.flat_stake_size(stake, entry)
    if no_leg == "reference":
        return S.settle_position("outcome_label", winner, entry, size, F.when(direction == "yes", "buy").otherwise("sell"), fee)
    hit = S.won("outcome_label", winner).cast("double")
    return (F.when(direction == "yes", hit).otherwise(1 - hit) - entry) * size - fee


def paid(trades: DataFrame, winner: Column, no_leg: str = "reference") -> DataFrame:
    """Open trades with the outcome and realized_pnl that ``winner`` gives them."""
    return trades.withColumns({"outcome": S.outcome("outcome_label", winner), "realized_pnl": F.round(_profit(winner, no_leg), 6)})


def settlement_summary(settled: DataFrame) -> DataFrame:
    """One row: settled (new ones), pending, total_pnl of all settled."""
    return settled.agg(
        F.count_if("newly_settled").alias("settled"), F.count_if(F.col("pending_reason").isNotNull()).alias("pending"), F.round(F.coalesce(F.sum("realized_pnl"), F.lit(0.0)), 6).alias("total_pnl")
    )


class LiveOrderError(RuntimeError):
    """An order that cannot be placed."""


def dry_run_orders(orders: DataFrame, placed_at: str) -> DataFrame:
    """Receipts for orders (token_id, side, price, size); invalid ones have status "rejected".

    Orders are never sent from here: a Spark task may run twice.
    """
    ok = (F.col("price") > 0) & (F.col("price") < 1) & (F.col("size") > 0) & F.upper("side").isin("BUY", "SELL")
    ok = F.coalesce(ok, F.lit(False))
    return orders.select(
        F.when(ok, F.concat(F.lit("dry-run-"), F.substring("token_id", 1, 8))).alias("order_id"),
        "token_id",
        F.upper("side").alias("side"),
        "price",
        "size",
        F.when(ok, "dry_run").otherwise("rejected").alias("status"),
        F.lit(placed_at).alias("placed_at"),
    )


def preflight(has_credentials: bool, healthy: bool | None = None) -> dict:
    """ok only with credentials and a healthy service; messages say what is missing."""
    messages = [] if has_credentials else ["credentials are missing"]
    if has_credentials and not healthy:
        messages.append("the service is not reachable")
    return {"ok": not messages, "messages": messages}
