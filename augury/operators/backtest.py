"""Walk-forward back-tests: train strictly before a date, evaluate on it.

Evaluation dates are every ``stride``-th distinct date.  The aggregate model needs
only counts per day and label, so the expanding train set is a running sum over
days, never a join of rows with all earlier rows.  Models that need rows are fitted
once per step from the driver: each step filters the panel, and all steps' rows are
united in one plan, so this is for tens of steps (the stride guard), not thousands.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from augury.functions import scalars as S
from augury.schemas import BACKTEST_TRADE, require, struct

MIN_STRIDE = 10


class Result(NamedTuple):
    trades: DataFrame
    steps: DataFrame


def feature_columns(panel: DataFrame) -> list[str]:
    return [x for x in panel.columns if x.startswith("feature_")]


def feature_profile(panel: DataFrame) -> DataFrame:
    """A row for each feature column: name, n (values that are no null or NaN), missing, mean, least, greatest.

    One aggregate over the feature columns alone; a column without values has null figures,
    a panel without features no row.
    """
    names = feature_columns(panel)
    value = {x: F.when(~F.isnan(F.col(x).cast("double")), F.col(x).cast("double")) for x in names}
    n = {x: F.count(v) for x, v in value.items()}
    rows = [F.struct(F.lit(x).alias("name"), n[x].alias("n"), (F.count("*") - n[x]).alias("missing"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("greatest")) for x, v in value.items()]
    if not rows:
        return panel.sparkSession.createDataFrame([], "name string, n long, missing long, mean double, least double, greatest double")
    return panel.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def eval_dates(panel: DataFrame, stride: int, min_train_rows: int) -> DataFrame:
    """eval_date and train_rows (rows strictly before) of the steps that have enough of them.

    Works on one row per day.
    """
    return _dates(panel.groupBy(F.col("decision_date").cast("string").alias("eval_date")).agg(F.count("*").alias("n")), stride, min_train_rows)


def _dates(days: DataFrame, stride: int, min_train_rows: int) -> DataFrame:
    """The same from rows per day (eval_date, n)."""
    w = W.orderBy("eval_date")
    days = days.select("eval_date", "n", (F.row_number().over(w) - 1).alias("i"), F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("train_rows"))
    return days.filter((F.col("i") % stride == 0) & (F.col("train_rows") >= min_train_rows)).select("eval_date", "train_rows")


def best_outcomes(scored: DataFrame, tiebreak: list[str]) -> DataFrame:
    """The likeliest outcome per market and date; ties go to the first by ``tiebreak``."""
    place = F.row_number().over(W.partitionBy("market_id", "decision_date").orderBy(F.col("predicted_prob").isNull(), -F.col("predicted_prob"), *tiebreak))
    return scored.withColumn("__place", place).filter("__place = 1").drop("__place")


def price_trades(best: DataFrame, flat_stake: float = 1.0, bps: float = 30.0) -> DataFrame:
    """Size, fee, profit and edge of a flat stake bought at the market price."""
    fee = S.fee(flat_stake, bps)
    size = S.backtest_size(flat_stake, "market_price")
    segment = F.col("segment") if "segment" in best.columns else F.lit(None).cast("string")
    return best.select(
        F.col("market_id").cast("string").alias("market_id"),
        F.col("decision_date").alias("eval_date"),
        "outcome_label",
        "predicted_prob",
        "market_price",
        S.settle_position("outcome_label", "winning_label", "market_price", size, F.lit("buy"), fee).alias("realized_pnl"),
        S.edge("predicted_prob", "market_price", fee).alias("edge"),
        segment.alias("segment"),
        "winning_label",
        S.outcome("outcome_label", "winning_label").alias("outcome"),
        size.alias("size"),
        fee.alias("fee_paid"),
    )


def _prepared(panel: DataFrame) -> DataFrame:
    require(panel, ["market_id", "decision_date", "outcome_label", "winning_label", "market_price"])
    return panel.withColumn("decision_date", F.col("decision_date").cast("string"))


def _steps(dates: DataFrame, scored: DataFrame, trades: DataFrame) -> DataFrame:
    seen = scored.groupBy(F.col("decision_date").alias("eval_date")).agg(F.count("*").alias("eval_rows"))
    made = trades.groupBy("eval_date").agg(F.count("*").alias("trades"))
    return dates.join(seen, "eval_date").join(made, "eval_date", "left").select("eval_date", "train_rows", "eval_rows", F.coalesce("trades", F.lit(0)).alias("trades"))


def walk_forward_rates(panel: DataFrame, stride: int, min_train_rows: int, tiebreak: list[str], flat_stake: float = 1.0, bps: float = 30.0) -> Result:
    """The aggregate model: a label's smoothed win rate so far, (wins + 1) / (n + 2).

    A label never seen before has n = wins = 0.
    """
    panel = _prepared(panel)
    # one pass over the rows gives the counts per day and label, and the days
    daily = panel.groupBy("decision_date", "outcome_label").agg(F.count("*").alias("n"), F.sum(S.won("outcome_label", "winning_label")).alias("wins"))
    dates = _dates(daily.groupBy(F.col("decision_date").alias("eval_date")).agg(F.sum("n").alias("n")), stride, min_train_rows)
    before = W.partitionBy("outcome_label").orderBy("decision_date").rowsBetween(W.unboundedPreceding, -1)
    rates = daily.select("decision_date", "outcome_label", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(x) for x in ("n", "wins")])
    rates = rates.select("decision_date", "outcome_label", ((F.col("wins") + 1.0) / (F.col("n") + 2.0)).alias("predicted_prob"))
    chosen = dates.select(F.col("eval_date").alias("decision_date"))
    # one row for each step and label
    rates = rates.join(chosen, "decision_date")
    scored = panel.join(rates, ["decision_date", "outcome_label"])
    trades = price_trades(best_outcomes(scored, tiebreak), flat_stake, bps)
    return Result(trades, _steps(dates, scored, trades))


def linear_steps(panel: DataFrame, stride: int, min_train_rows: int, features: list[str] | None = None, link: str = "identity") -> DataFrame:
    """eval_date, train_rows and coef (intercept first) of a linear model fitted to all rows before each step's date.

    One pass sums each day's products of features and labels; running sums over the days
    give every step's normal equations, which are solved a row at a time (by least norm
    where they are singular).  With ``link`` "logit" the coefficients are those of one
    Newton step of a logistic model from the rate of wins.  Missing features are zero.
    """
    if link not in ("identity", "logit"):
        raise ValueError("link must be identity or logit")
    panel = nan_free(_prepared(panel))
    names = features if features is not None else feature_columns(panel)
    x = [F.lit(1.0), *[F.col(f"`{n}`").cast("double") for n in names]]
    y = S.won("outcome_label", "winning_label").cast("double")
    d = len(x)
    sums = {f"g{i}_{j}": F.sum(x[i] * x[j]) for i in range(d) for j in range(i, d)} | {f"m{i}": F.sum(x[i] * y) for i in range(d)}
    days = panel.groupBy(F.col("decision_date").alias("eval_date")).agg(F.count("*").alias("n"), *[v.alias(k) for k, v in sums.items()])
    before = W.orderBy("eval_date").rowsBetween(W.unboundedPreceding, -1)  # a row for each day
    run = days.select("eval_date", *[F.coalesce(F.sum(k).over(before), F.lit(0.0)).alias(k) for k in sums])
    steps = _dates(days.select("eval_date", "n"), stride, min_train_rows).join(run, "eval_date")

    @F.pandas_udf("array<double>")
    def solved(gram: pd.Series, moments: pd.Series) -> pd.Series:
        out = []
        for g, m in zip(gram, moments, strict=True):
            a = np.zeros((d, d))
            a[np.triu_indices(d)] = g
            a = a + np.triu(a, 1).T
            b = np.linalg.lstsq(a, np.asarray(m), rcond=None)[0]
            if link == "logit":
                p = min(max(m[0] / max(a[0, 0], 1.0), 1e-9), 1 - 1e-9)
                b = b / (p * (1 - p))
                b[0] += np.log(p / (1 - p)) - 1 / (1 - p)
            out.append(b.tolist())
        return pd.Series(out)

    grams, moments = [k for k in sums if k[0] == "g"], [k for k in sums if k[0] == "m"]
    return steps.select("eval_date", "train_rows", solved(F.array(*grams), F.array(*moments)).alias("coef"))


def walk_forward_linear(panel: DataFrame, stride: int, min_train_rows: int, tiebreak: list[str], features: list[str] | None = None, link: str = "identity", flat_stake: float = 1.0, bps: float = 30.0) -> Result:
    """A linear model of the rows before each step, without a fit or a filter for each; probabilities are cut to 0 to 1."""
    fitted = linear_steps(panel, stride, min_train_rows, features, link)
    panel = nan_free(_prepared(panel))
    names = features if features is not None else feature_columns(panel)
    score = sum((F.col("coef")[k + 1] * F.col(f"`{n}`").cast("double") for k, n in enumerate(names)), F.col("coef")[0])
    prob = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) if link == "identity" else 1 / (1 + F.exp(-score))
    scored = panel.join(fitted.withColumnRenamed("eval_date", "decision_date").drop("train_rows"), "decision_date").withColumn("predicted_prob", prob).drop("coef")
    trades = price_trades(best_outcomes(scored, tiebreak), flat_stake, bps)
    return Result(trades, _steps(fitted.select("eval_date", "train_rows"), scored, trades))


def walk_forward_model(
    panel: DataFrame, make_model: Callable[[], object], stride: int, min_train_rows: int, tiebreak: list[str], flat_stake: float = 1.0, bps: float = 30.0, at_once: int = 3
) -> Result:
    """A model fitted from scratch for each step; ``make_model()`` gives fit(df) and predict_proba(df)."""
    panel = nan_free(_prepared(panel).withColumn("label", S.won("outcome_label", "winning_label").cast("double"))).cache()
    dates = eval_dates(panel, stride, min_train_rows).cache()
    days = [r[0] for r in dates.select("eval_date").orderBy("eval_date").collect()]  # a row for each step

    def step(day: str) -> DataFrame:
        model = make_model()
        model.fit(panel.filter(F.col("decision_date") < day), feature_columns(panel), "label")
        return model.predict_proba(panel.filter(F.col("decision_date") == day))

    with ThreadPoolExecutor(at_once) as pool:
        parts = list(pool.map(step, days))
    spark = panel.sparkSession
    if not parts:
        return Result(spark.createDataFrame([], struct(BACKTEST_TRADE)), spark.createDataFrame([], "eval_date string, train_rows long, eval_rows long, trades long"))
    scored = reduce(DataFrame.unionByName, parts)
    trades = price_trades(best_outcomes(scored, tiebreak), flat_stake, bps)
    return Result(trades, _steps(dates, scored, trades))


def nan_free(panel: DataFrame) -> DataFrame:
    """Missing features are zero for model fits."""
    return panel.fillna(0.0, feature_columns(panel)) if feature_columns(panel) else panel


def check_stride(stride: int) -> None:
    if stride < MIN_STRIDE:
        raise ValueError(f"stride must be at least {MIN_STRIDE}")
