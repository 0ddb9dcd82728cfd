"""Aggregates over trades: back-test metrics, gate, report figures, equity curve, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from augury.functions.scalars import c, calibration_bin
from augury.operators import ordering
from augury.schemas import require


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def backtest_metrics(trades: DataFrame) -> DataFrame:
    """num_trades, total_pnl, hit_rate (share of outcome "won"), avg_pnl_per_trade, avg_edge; zeros without trades."""
    require(trades, ["realized_pnl", "outcome", "edge"])
    n = F.count("*")
    return trades.agg(
        n.alias("num_trades"),
        _zero(F.sum("realized_pnl")).alias("total_pnl"),
        _zero(F.when(n > 0, F.count_if(F.col("outcome") == "won") / n)).alias("hit_rate"),
        _zero(F.when(n > 0, F.sum("realized_pnl") / n)).alias("avg_pnl_per_trade"),
        _zero(F.avg("edge")).alias("avg_edge"),
    )


def run_summary(trades: DataFrame, steps: DataFrame) -> DataFrame:
    """One row: total_pnl, hit_rate (share of pnl > 0), avg_edge, total_trades, steps."""
    t = trades.agg(F.count("*").alias("total_trades"), _zero(F.sum("realized_pnl")).alias("total_pnl"), _zero(F.avg((F.col("realized_pnl") > 0).cast("double"))).alias("hit_rate"), _zero(F.avg("edge")).alias("avg_edge"))
    return t.crossJoin(steps.agg(F.count("*").alias("steps")))


def panel_profile(panel: DataFrame) -> DataFrame:
    return panel.agg(F.count("*").alias("n_rows"), F.countDistinct("decision_date").alias("n_dates"), F.countDistinct("market_id").alias("n_markets"))


def number_keys(keys: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """key and num, 0, 1, 2 ...: the numbers of ``known`` stay, new keys of ``keys`` (key) go on from there; null keys have none."""
    fresh = keys.select(F.col("key").cast("string").alias("key")).filter("key is not null").distinct()
    if known is None:
        return ordering.ranked(fresh, ["key"]).select("key", F.col("__rank").cast("long").alias("num"))
    fresh = fresh.join(known, "key", "left_anti")
    most = known.agg(F.coalesce(F.max("num") + 1, F.lit(0)).alias("__from"))  # one row
    fresh = ordering.ranked(fresh, ["key"]).crossJoin(F.broadcast(most))
    return known.select("key", "num").unionByName(fresh.select("key", (F.col("__rank") + F.col("__from")).alias("num")))


def daily_profile(panel: DataFrame, numbers: DataFrame) -> DataFrame:
    """Per day and bucket of 32,768 numbered markets: n_rows and a bitmap of the markets; rows are counted in bucket null once.

    Days add up: a new day needs only its own rows (and ``number_keys`` for its new markets).
    """
    p = panel.select(F.col("decision_date").cast("string").alias("day"), F.col("market_id").cast("string").alias("key"))
    rows = p.groupBy("day").agg(F.count("*").alias("n_rows")).select("day", F.lit(None).cast("long").alias("bucket"), "n_rows", F.lit(None).cast("binary").alias("markets"))
    n = p.filter("key is not null").distinct().join(numbers, "key")
    maps = n.groupBy("day", F.bitmap_bucket_number("num").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("num")).alias("markets"))
    return rows.unionByName(maps.select("day", "bucket", F.lit(0).cast("long").alias("n_rows"), "markets"))


def profile_of_days(days: DataFrame) -> DataFrame:
    """n_rows, n_dates and n_markets, exact, from any days of ``daily_profile``."""
    markets = days.filter("bucket is not null").groupBy("bucket").agg(F.bitmap_count(F.bitmap_or_agg("markets")).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_markets"))
    rows = days.filter("bucket is null").agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.countDistinct("day").alias("n_dates"))
    return rows.crossJoin(markets)  # one row each


def gate_segments(trades: DataFrame, required: list[str], min_trades: int = 40, min_pnl: float = 0.0) -> DataFrame:
    """A row for each required segment: num_trades, total_pnl, passes, reason."""
    require(trades, ["segment", "realized_pnl"])
    spark = trades.sparkSession
    want = spark.createDataFrame([(s,) for s in required], "segment string")
    have = trades.groupBy("segment").agg(F.count("*").alias("n"), F.sum("realized_pnl").alias("p"))
    out = want.join(have, "segment", "left").select("segment", F.coalesce("n", F.lit(0)).cast("long").alias("num_trades"), _zero(F.col("p")).alias("total_pnl"))
    reason = F.when(F.col("num_trades") == 0, "missing").when(F.col("num_trades") < min_trades, "insufficient_trades").when(F.col("total_pnl") < min_pnl, "negative_pnl").otherwise("ok")
    return out.withColumn("reason", reason).withColumn("passes", F.col("reason") == "ok")


def gate_decision(trades: DataFrame, segments: DataFrame) -> DataFrame:
    """One row: GO if every segment passes (also if none is required, with a warning), and the figures over all trades."""
    d = segments.agg(
        F.when(F.coalesce(F.bool_and("passes"), F.lit(True)), "GO").otherwise("NO_GO").alias("decision"),
        F.when(F.count("*") == 0, "no segment is required, so nothing was checked").alias("warning"),
    )
    return d.crossJoin(trades.agg(_zero(F.sum("realized_pnl")).alias("aggregate_pnl"), F.count("*").alias("aggregate_trades")))


def allowed_segments(segments: DataFrame) -> DataFrame:
    return segments.filter("passes").select("segment").distinct()


def report_kpis(trades: DataFrame) -> DataFrame:
    """Settled trades only: total_pnl, hit_pct (pnl > 0), staked, roi_pct, avg_edge, n_settled."""
    t = trades.filter("realized_pnl is not null")
    n = F.count("*")
    staked = _zero(F.sum(F.coalesce("flat_stake", F.lit(0.0))))
    pnl = _zero(F.sum("realized_pnl"))
    return t.agg(
        n.alias("n_settled"),
        pnl.alias("total_pnl"),
        _zero(F.when(n > 0, 100.0 * F.count_if(F.col("realized_pnl") > 0) / n)).alias("hit_pct"),
        staked.alias("staked"),
        F.when(staked > 0, 100.0 * pnl / staked).otherwise(0.0).alias("roi_pct"),
        _zero(F.avg(F.coalesce("edge_after_fee", F.lit(0.0)))).alias("avg_edge"),
    )


def report_segments(trades: DataFrame) -> DataFrame:
    """Settled trades by segment ("unknown" if null): n, total_pnl, wins, hit_pct."""
    t = trades.filter("realized_pnl is not null").groupBy(F.coalesce("city_or_segment", F.lit("unknown")).alias("segment"))
    wins = F.count_if(F.col("realized_pnl") > 0)
    return t.agg(F.count("*").alias("n"), F.sum("realized_pnl").alias("total_pnl"), wins.alias("wins"), (100.0 * wins / F.count("*")).alias("hit_pct"))


def status_kpis(trades: DataFrame) -> DataFrame:
    settled = F.count("realized_pnl")
    return trades.agg(
        F.count("*").alias("n_trades"),
        F.count_if(F.col("realized_pnl").isNull()).alias("n_open"),
        settled.alias("n_settled"),
        _zero(F.sum("realized_pnl")).alias("total_pnl"),
        _zero(F.when(settled > 0, 100.0 * F.count_if(F.col("realized_pnl") > 0) / settled)).alias("hit_pct"),
    )


def equity_curve(trades: DataFrame, order_by: list[str], group_by: str | None = None) -> DataFrame:
    """cumulative_pnl along ``order_by``.

    The curve is global, yet no task sees all rows: sums of the groups before (days,
    say, which must rise with the order) are added to the running sum inside a group.
    Without ``group_by``, or where a group has over ``ordering.PART_ROWS`` rows, the rows are
    numbered and cut into runs of equal length, so that no day can be too long; that
    writes them once.  Rows of a null group are left out.
    """
    if group_by is not None:
        trades = trades.filter(F.col(group_by).isNotNull())
    if group_by is None or ordering.has_long_group(trades, group_by):
        order = order_by if group_by is None else [group_by, *order_by]
        runs = ordering.ranked(trades, order).withColumn("__run_", F.expr(f"__rank div {ordering.PART_ROWS}"))
        return curve_of_groups(runs, ["__rank"], "__run_").drop("__rank", "__run_")
    return curve_of_groups(trades, order_by, group_by)


def curve_of_groups(trades: DataFrame, order_by: list[str], group_by: str) -> DataFrame:
    """The curve with a group as one task each."""
    totals = trades.groupBy(group_by).agg(F.sum("realized_pnl").alias("__t"))
    before = W.orderBy(group_by).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(group_by, F.coalesce(F.sum("__t").over(before), F.lit(0.0)).alias("__before"))
    inside = W.partitionBy(group_by).orderBy(*order_by).rowsBetween(W.unboundedPreceding, 0)
    joined = trades.withColumn("__run", F.sum(F.coalesce("realized_pnl", F.lit(0.0))).over(inside)).join(totals, group_by)
    return joined.withColumn("cumulative_pnl", F.col("__run") + F.col("__before")).drop("__run", "__before")


def curve_extent(curve: DataFrame) -> DataFrame:
    """Least and greatest value; widened by one on each side where they are equal."""
    lo, hi = F.min("cumulative_pnl"), F.max("cumulative_pnl")
    return curve.agg(F.when(lo == hi, lo - 1).otherwise(lo).alias("lo"), F.when(lo == hi, hi + 1).otherwise(hi).alias("hi"))


def reliability(scored: DataFrame, prob="y_prob", truth="y_true", n_bins: int = 10) -> DataFrame:
    """bin, bin_center, mean_pred, frac_pos, n for each bin that has rows."""
    g = scored.groupBy(calibration_bin(prob, n_bins).alias("bin")).agg(F.avg(c(prob)).alias("mean_pred"), F.avg(c(truth).cast("double")).alias("frac_pos"), F.count("*").alias("n"))
    return g.select("bin", ((F.col("bin") + 0.5) / n_bins).alias("bin_center"), "mean_pred", "frac_pos", "n")


def brier_decomposition(scored: DataFrame, prob="y_prob", truth="y_true", n_bins: int = 10) -> DataFrame:
    """One row: uncertainty, resolution, reliability, brier_score, skill_score, n_samples; null figures without rows."""
    p, y = c(prob), c(truth).cast("double")
    g = scored.groupBy(calibration_bin(prob, n_bins).alias("bin")).agg(
        F.count("*").alias("n"), F.sum(p).alias("sp"), F.sum(y).alias("sy"), F.sum((p - y) * (p - y)).alias("se")
    )
    base = g.agg(F.sum("n").alias("total"), (F.sum("sy") / F.sum("n")).alias("clim"), (F.sum("se") / F.sum("n")).alias("bs"))
    fp, oy = F.col("sp") / F.col("n"), F.col("sy") / F.col("n")
    parts = g.crossJoin(F.broadcast(base)).groupBy("total", "clim", "bs").agg(  # one row
        (F.sum(F.col("n") * (fp - oy) * (fp - oy)) / F.col("total")).alias("reliability"), (F.sum(F.col("n") * (oy - F.col("clim")) * (oy - F.col("clim"))) / F.col("total")).alias("resolution")
    )
    unc = F.col("clim") * (1 - F.col("clim"))
    return parts.select(
        unc.alias("uncertainty"), "resolution", "reliability", F.col("bs").alias("brier_score"), F.when(unc > 0, 1 - F.col("bs") / unc).otherwise(0.0).alias("skill_score"), F.col("total").alias("n_samples")
    )
