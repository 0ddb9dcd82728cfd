"""Every operator as a query over the star-schema tables, with DuckDB SQL for its result.

Doubles are rounded on both sides: sums over a frame may differ in the last bit.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augury.functions import bins
from augury.functions import scalars as S
from augury.operators import backtest, features, markets, metrics, models, trading
from augury.plans.views import PANEL_SQL, SIGNALS_SQL, SPECS_SQL, ZONES, panel, signals, specs, table
from augury.sources import files, listings

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
STRIDE, MIN_TRAIN = 3, 20
REQUIRED = ["S0", "S1", "S2", "S3", "S4", "S5", "S6", "S7", "S8", "S9", "S99"]
NOW = datetime(1998, 6, 1, 12, 0)
TODAY = "1998-06-01"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


# back-test

WALK_SQL = f"""WITH {PANEL_SQL},
days AS (SELECT decision_date AS d, count(*) AS n FROM panel GROUP BY 1),
dates AS (SELECT d AS eval_date, train_rows FROM (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, coalesce(sum(n) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS train_rows FROM days) WHERE i % {STRIDE} = 0 AND train_rows >= {MIN_TRAIN}),
daily AS (SELECT decision_date AS d, outcome_label, count(*) AS n, sum((outcome_label = winning_label)::INT) AS w FROM panel GROUP BY 1, 2),
tr AS (SELECT eval_date, outcome_label, sum(n) AS n, sum(w) AS w FROM dates JOIN daily ON d < eval_date GROUP BY 1, 2),
scored AS (SELECT p.*, eval_date, (coalesce(w, 0) + 1.0::DOUBLE) / (coalesce(n, 0) + 2.0::DOUBLE) AS predicted_prob FROM panel p JOIN dates ON decision_date = eval_date LEFT JOIN tr USING (eval_date, outcome_label)),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY market_id, eval_date ORDER BY predicted_prob DESC, event_id) = 1),
trades AS (SELECT market_id, eval_date, outcome_label, predicted_prob, market_price, CASE WHEN outcome_label = winning_label THEN (1 - market_price) ELSE -market_price END * (1 / market_price) - 0.003 AS realized_pnl,
  predicted_prob - market_price - 0.003 AS edge, segment, winning_label, CASE WHEN outcome_label = winning_label THEN 'won' ELSE 'lost' END AS outcome, 1 / market_price AS size, 0.003::DOUBLE AS fee_paid FROM best)
"""


def walk(spark: SparkSession, sf_dir: str) -> backtest.Result:
    return backtest.walk_forward_rates(panel(spark, sf_dir), STRIDE, MIN_TRAIN, ["event_id"])


@query("q01_walkforward_trades", WALK_SQL + "SELECT market_id, eval_date, outcome_label, round(predicted_prob, 6) AS predicted_prob, round(market_price, 6) AS market_price, round(realized_pnl, 6) AS realized_pnl, round(edge, 6) AS edge, segment, winning_label, outcome, round(size, 6) AS size, round(fee_paid, 6) AS fee_paid FROM trades")
def q01(spark, sf_dir):
    t = walk(spark, sf_dir).trades
    return t.select("market_id", "eval_date", "outcome_label", "segment", "winning_label", "outcome", *r6("predicted_prob", "market_price", "realized_pnl", "edge", "size", "fee_paid"))


@query("q02_edge_calc", f"WITH {SIGNALS_SQL} SELECT o_orderkey, round(model_prob - gamma_price - 0.003 - 0.001, 6) AS edge, round(gamma_price * 30 / 10000, 8) AS fee FROM signals")
def q02(spark, sf_dir):
    return signals(spark, sf_dir).select("o_orderkey", F.round(S.edge("model_prob", "gamma_price", 0.003, 0.001), 6).alias("edge"), F.round(S.fee("gamma_price"), 8).alias("fee"))


@query("q03_flat_stake", f"WITH {SIGNALS_SQL} SELECT o_orderkey, round(1.0 / greatest(gamma_price, 1e-9), 6) AS size FROM signals")
def q03(spark, sf_dir):
    return signals(spark, sf_dir).select("o_orderkey", F.round(S.flat_stake_size(1.0, "gamma_price"), 6).alias("size"))


KELLY = "CASE WHEN gamma_price <= 0 OR gamma_price >= 1 THEN 0 ELSE greatest(0, 0.25 * (((1 - gamma_price) / gamma_price) * model_prob - (1 - model_prob)) / ((1 - gamma_price) / gamma_price)) END"


@query("q04_kelly_fraction", f"WITH {SIGNALS_SQL} SELECT o_orderkey, round(({KELLY})::DOUBLE, 6) AS kelly FROM signals")
def q04(spark, sf_dir):
    return signals(spark, sf_dir).select("o_orderkey", F.round(S.kelly_fraction("model_prob", "gamma_price"), 6).alias("kelly"))


@query("q05_kelly_stake_capped", f"WITH {SIGNALS_SQL} SELECT o_orderkey, round(least(({KELLY})::DOUBLE, 0.05::DOUBLE) * 1000, 6) AS stake FROM signals")
def q05(spark, sf_dir):
    return signals(spark, sf_dir).select("o_orderkey", F.round(S.kelly_stake_size("model_prob", "gamma_price", 1000.0), 6).alias("stake"))


@query(
    "q06_settle_positions_buy_sell",
    f"""WITH {SIGNALS_SQL}, t AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 'warm' WHEN o_orderstatus = 'O' THEN 'hot' END AS w, (coalesce(outcome_label = CASE WHEN o_orderstatus = 'F' THEN 'warm' WHEN o_orderstatus = 'O' THEN 'hot' END, false))::INT::DOUBLE AS pay FROM signals)
SELECT o_orderkey, w AS winner, round((pay - gamma_price) * 2 - 0.003, 6) AS pnl_buy, round((gamma_price - pay) * 2 - 0.003, 6) AS pnl_sell FROM t""",
)
def q06(spark, sf_dir):
    w = F.when(F.col("o_orderstatus") == "F", "warm").when(F.col("o_orderstatus") == "O", "hot")
    s = signals(spark, sf_dir).withColumn("winner", w)
    pnl = lambda side: F.round(S.settle_position("outcome_label", "winner", "gamma_price", 2.0, F.lit(side), 0.003), 6)
    return s.select("o_orderkey", "winner", pnl("buy").alias("pnl_buy"), pnl("sell").alias("pnl_sell"))


@query("q07_label_derivation", f"WITH {PANEL_SQL} SELECT event_id, (outcome_label = winning_label)::INT AS label FROM panel")
def q07(spark, sf_dir):
    return panel(spark, sf_dir).select("event_id", S.won("outcome_label", "winning_label").alias("label"))


# features


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("q08_lag_features_grouped", "SELECT event_id, lag(value, 1) OVER w AS value_lag1, lag(value, 3) OVER w AS value_lag3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def q08(spark, sf_dir):
    return features.add_lags(_events(spark, sf_dir), ["value"], [1, 3], ["ts", "event_id"], "user_id").select("event_id", "value_lag1", "value_lag3")


@query("q09_lag_features_fill", "SELECT event_id, coalesce(lag(value, 2) OVER (PARTITION BY event_type ORDER BY ts, event_id), -1) AS value_lag2 FROM events")
def q09(spark, sf_dir):
    return features.add_lags(_events(spark, sf_dir), ["value"], [2], ["ts", "event_id"], "event_type", -1.0).select("event_id", "value_lag2")


@query("q10_lead_features", 'SELECT event_id, lead(value, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS "value_lag-1" FROM events')
def q10(spark, sf_dir):
    return features.add_lags(_events(spark, sf_dir), ["value"], [-1], ["ts", "event_id"], "user_id").select("event_id", "`value_lag-1`")


def _roll(spark, sf_dir, stats, n=5, least=1):
    out = features.add_rolling_stats(_events(spark, sf_dir), ["value"], [n], ["ts", "event_id"], stats, "user_id", least)
    return out.select("event_id", *r6(*[f"value_roll{n}_{s}" for s in stats]))


_ROLL = "FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {0} PRECEDING AND CURRENT ROW)"


@query("q11_rolling_mean_std", "SELECT event_id, round(avg(value) OVER w, 6) AS value_roll5_mean, round(stddev_samp(value) OVER w, 6) AS value_roll5_std " + _ROLL.format(4))
def q11(spark, sf_dir):
    return _roll(spark, sf_dir, ["mean", "std"])


@query("q12_rolling_min_max", "SELECT event_id, round(min(value) OVER w, 6) AS value_roll5_min, round(max(value) OVER w, 6) AS value_roll5_max " + _ROLL.format(4))
def q12(spark, sf_dir):
    return _roll(spark, sf_dir, ["min", "max"])


@query("q13_rolling_median", "SELECT event_id, round(median(value) OVER w, 6) AS value_roll5_median " + _ROLL.format(4))
def q13(spark, sf_dir):
    return _roll(spark, sf_dir, ["median"])


@query("q14_rolling_min_periods", "SELECT event_id, round(CASE WHEN count(value) OVER w >= 4 THEN avg(value) OVER w END, 6) AS value_roll7_mean " + _ROLL.format(6))
def q14(spark, sf_dir):
    return _roll(spark, sf_dir, ["mean"], 7, 4)


@query("q15_cyclical_hour", "SELECT event_id, round(sin(2 * pi() * hour(ts) / 24), 9) + 0 AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 9) + 0 AS hour_cos FROM events")
def q15(spark, sf_dir):
    out = _events(spark, sf_dir).select("event_id", *features.encode_cyclical(F.hour("ts"), 24, "hour"))
    return out.select("event_id", *[(F.round(x, 9) + F.lit(0.0)).alias(x) for x in ("hour_sin", "hour_cos")])


@query("q16_onehot_event_type", "SELECT event_id, " + ", ".join(f"(event_type = '{v}')::INT::DOUBLE AS event_type_{v}" for v in ("error", "purchase", "signup", "view")) + " FROM events")
def q16(spark, sf_dir):
    return features.encode_onehot(_events(spark, sf_dir).select("event_id", "event_type"), ["event_type"])


@query("q17_clip_iqr", "WITH b AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS z FROM events) SELECT event_id, round(least(greatest(value, a - 1.5 * (z - a)), z + 1.5 * (z - a)), 6) AS value FROM events, b")
def q17(spark, sf_dir):
    return features.clip_outliers(_events(spark, sf_dir).select("event_id", "value"), ["value"], iqr_factor=1.5).select("event_id", *r6("value"))


@query("q17_clip_zscore", "WITH b AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) SELECT event_id, round(least(greatest(value, m - 2 * s), m + 2 * s), 6) AS value FROM events, b")
def q17z(spark, sf_dir):
    return features.clip_outliers(_events(spark, sf_dir).select("event_id", "value"), ["value"], "zscore", zscore_threshold=2.0).select("event_id", *r6("value"))


# metrics, gate, report


@query("q18_backtest_metrics", WALK_SQL + "SELECT count(*) AS num_trades, round(sum(realized_pnl), 4) AS total_pnl, round(avg((outcome = 'won')::INT), 6) AS hit_rate, round(avg(realized_pnl), 6) AS avg_pnl_per_trade, round(avg(edge), 6) AS avg_edge FROM trades")
def q18(spark, sf_dir):
    return metrics.backtest_metrics(walk(spark, sf_dir).trades).select("num_trades", F.round("total_pnl", 4).alias("total_pnl"), *r6("hit_rate", "avg_pnl_per_trade", "avg_edge"))


@query("q18_run_summary", WALK_SQL + "SELECT count(*) AS total_trades, round(sum(realized_pnl), 4) AS total_pnl, round(avg((realized_pnl > 0)::INT), 6) AS hit_rate, round(avg(edge), 6) AS avg_edge, (SELECT count(DISTINCT eval_date) FROM scored) AS steps FROM trades")
def q18s(spark, sf_dir):
    r = walk(spark, sf_dir)
    return metrics.run_summary(r.trades, r.steps).select("total_trades", F.round("total_pnl", 4).alias("total_pnl"), *r6("hit_rate", "avg_edge"), "steps")


@query("q19_backtest_steps", WALK_SQL + "SELECT eval_date, train_rows, (SELECT count(*) FROM scored s WHERE s.eval_date = d.eval_date) AS eval_rows, (SELECT count(*) FROM trades t WHERE t.eval_date = d.eval_date) AS trades FROM dates d")
def q19(spark, sf_dir):
    return walk(spark, sf_dir).steps


GATE_SQL = WALK_SQL + ", req AS (SELECT unnest(['" + "','".join(REQUIRED) + """']) AS segment), agg AS (SELECT segment, count(*) AS n, sum(realized_pnl) AS p FROM trades GROUP BY 1),
gate AS (SELECT segment, coalesce(n, 0) AS num_trades, coalesce(p, 0) AS total_pnl, CASE WHEN coalesce(n, 0) = 0 THEN 'missing' WHEN n < 40 THEN 'insufficient_trades' WHEN p < 0 THEN 'negative_pnl' ELSE 'ok' END AS reason FROM req LEFT JOIN agg USING (segment)) """


def _gate(spark, sf_dir):
    t = walk(spark, sf_dir).trades
    return t, metrics.gate_segments(t, REQUIRED)


@query("q20_holdout_gate_segments", GATE_SQL + "SELECT segment, num_trades, round(total_pnl, 4) AS total_pnl, reason = 'ok' AS passes, reason FROM gate")
def q20(spark, sf_dir):
    return _gate(spark, sf_dir)[1].select("segment", "num_trades", F.round("total_pnl", 4).alias("total_pnl"), "passes", "reason")


@query("q21_holdout_gate_decision", GATE_SQL + "SELECT CASE WHEN (SELECT bool_and(reason = 'ok') FROM gate) THEN 'GO' ELSE 'NO_GO' END AS decision, round(sum(realized_pnl), 4) AS aggregate_pnl, count(*) AS aggregate_trades FROM trades")
def q21(spark, sf_dir):
    return metrics.gate_decision(*_gate(spark, sf_dir)).select("decision", F.round("aggregate_pnl", 4).alias("aggregate_pnl"), "aggregate_trades")


@query("q22_allowed_segments", GATE_SQL + "SELECT segment FROM gate WHERE reason = 'ok'")
def q22(spark, sf_dir):
    return metrics.allowed_segments(_gate(spark, sf_dir)[1])


@query("q23_equity_curve", "SELECT event_id, round(sum(value - 50) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS cumulative_pnl FROM events")
def q23(spark, sf_dir):
    t = _events(spark, sf_dir).select("event_id", "ts", (F.col("value") - 50).alias("realized_pnl"), F.to_date("ts").alias("day"))
    return metrics.equity_curve(t, ["ts", "event_id"], "day").select("event_id", F.round("cumulative_pnl", 4).alias("cumulative_pnl"))


@query("q23_curve_extent", "SELECT round(min(c), 4) AS lo, round(max(c), 4) AS hi FROM (SELECT sum(value - 50) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS c FROM events)")
def q23e(spark, sf_dir):
    t = _events(spark, sf_dir).select("event_id", "ts", (F.col("value") - 50).alias("realized_pnl"), F.to_date("ts").alias("day"))
    return metrics.curve_extent(metrics.equity_curve(t, ["ts", "event_id"], "day")).select(F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


def _report_trades(spark, sf_dir):
    pnl = F.when(F.col("o_orderkey") % 4 != 0, F.col("best_edge") * 3 - 0.5)
    return signals(spark, sf_dir).select("city_or_segment", F.when(F.col("o_orderkey") % 5 != 0, 1.5).alias("flat_stake"), F.col("best_edge").alias("edge_after_fee"), pnl.alias("realized_pnl"))


REPORT_SQL = f"WITH {SIGNALS_SQL}, tr AS (SELECT city_or_segment, CASE WHEN o_orderkey % 5 <> 0 THEN 1.5::DOUBLE END AS flat_stake, best_edge AS edge_after_fee, CASE WHEN o_orderkey % 4 <> 0 THEN best_edge * 3 - 0.5 END AS realized_pnl FROM signals) "


@query("q24_report_kpis", REPORT_SQL + "SELECT count(*) AS n_settled, round(sum(realized_pnl), 4) AS total_pnl, round(100 * avg((realized_pnl > 0)::INT), 6) AS hit_pct, round(sum(coalesce(flat_stake, 0)), 4) AS staked, round(100 * sum(realized_pnl) / sum(coalesce(flat_stake, 0)), 6) AS roi_pct, round(avg(coalesce(edge_after_fee, 0)), 6) AS avg_edge FROM tr WHERE realized_pnl IS NOT NULL")
def q24(spark, sf_dir):
    return metrics.report_kpis(_report_trades(spark, sf_dir)).select("n_settled", F.round("total_pnl", 4).alias("total_pnl"), F.round("staked", 4).alias("staked"), *r6("hit_pct", "roi_pct", "avg_edge"))


@query("q24_segment_report", REPORT_SQL + "SELECT city_or_segment AS segment, count(*) AS n, round(sum(realized_pnl), 4) AS total_pnl, sum((realized_pnl > 0)::INT)::BIGINT AS wins, round(100 * avg((realized_pnl > 0)::INT), 6) AS hit_pct FROM tr WHERE realized_pnl IS NOT NULL GROUP BY 1")
def q24s(spark, sf_dir):
    return metrics.report_segments(_report_trades(spark, sf_dir)).select("segment", "n", F.round("total_pnl", 4).alias("total_pnl"), "wins", *r6("hit_pct"))


@query("q24_status_kpis", REPORT_SQL + "SELECT count(*) AS n_trades, count(*) FILTER (realized_pnl IS NULL) AS n_open, count(realized_pnl) AS n_settled, round(sum(realized_pnl), 4) AS total_pnl, round(100.0 * count(*) FILTER (realized_pnl > 0) / count(realized_pnl), 6) AS hit_pct FROM tr")
def q24k(spark, sf_dir):
    return metrics.status_kpis(_report_trades(spark, sf_dir)).select("n_trades", "n_open", "n_settled", F.round("total_pnl", 4).alias("total_pnl"), *r6("hit_pct"))


# calibration

_EDGES = ", ".join(f"{e!r}::DOUBLE" for e in S.bin_edges(10))
SCORE_SQL = f"""WITH {PANEL_SQL}, s AS (SELECT market_price AS y_prob, (outcome_label = winning_label)::INT::DOUBLE AS y_true FROM panel),
b AS (SELECT *, greatest(0, least(9, len(list_filter([{_EDGES}], lambda e: e <= y_prob)) - 1))::INT AS bin FROM s) """


def _scored(spark, sf_dir):
    return panel(spark, sf_dir).select("event_id", F.col("market_price").alias("y_prob"), S.won("outcome_label", "winning_label").cast("double").alias("y_true"))


@query(
    "q25_brier_decomposition",
    SCORE_SQL
    + """, g AS (SELECT bin, count(*) AS n, avg(y_prob) AS f, avg(y_true) AS o FROM b GROUP BY 1), t AS (SELECT avg(y_true) AS c, count(*) AS n, avg((y_prob - y_true) * (y_prob - y_true)) AS bs FROM s)
SELECT round(c * (1 - c), 6) AS uncertainty, round((SELECT sum(g.n * (o - c) * (o - c)) FROM g) / t.n, 6) AS resolution, round((SELECT sum(g.n * (f - o) * (f - o)) FROM g) / t.n, 6) AS reliability, round(bs, 6) AS brier_score, round(1 - bs / (c * (1 - c)), 6) AS skill_score, n AS n_samples FROM t""",
)
def q25(spark, sf_dir):
    return metrics.brier_decomposition(_scored(spark, sf_dir)).select(*r6("uncertainty", "resolution", "reliability", "brier_score", "skill_score"), "n_samples")


@query("q26_reliability_curve", SCORE_SQL + "SELECT bin, round((bin + 0.5) / 10, 6)::DOUBLE AS bin_center, round(avg(y_prob), 6) AS mean_pred, round(avg(y_true), 6) AS frac_pos, count(*) AS n FROM b GROUP BY bin")
def q26(spark, sf_dir):
    return metrics.reliability(_scored(spark, sf_dir)).select("bin", F.round("bin_center", 6).cast("double").alias("bin_center"), *r6("mean_pred", "frac_pos"), "n")


@query("q27_panel_profile", f"WITH {PANEL_SQL} SELECT count(*) AS n_rows, count(DISTINCT decision_date) AS n_dates, count(DISTINCT market_id) AS n_markets FROM panel")
def q27(spark, sf_dir):
    return metrics.panel_profile(panel(spark, sf_dir))


# recording


@query("q28_min_edge_filter", f"WITH {SIGNALS_SQL} SELECT o_orderkey FROM signals WHERE best_edge >= 0.2")
def q28(spark, sf_dir):
    return trading.min_edge(signals(spark, sf_dir), 0.2).select("o_orderkey")


ALLOWED = ["NATION_1", "NATION_7", "NATION_20"]


@query("q29_segment_allow_list", f"WITH {SIGNALS_SQL} SELECT o_orderkey, city_or_segment FROM signals WHERE city_or_segment IN ('NATION_1', 'NATION_7', 'NATION_20')")
def q29(spark, sf_dir):
    return trading.allowed(signals(spark, sf_dir), ALLOWED).select("o_orderkey", "city_or_segment")


def _zones(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_name").alias("city_or_segment"), F.get(F.array(*map(F.lit, ZONES)), F.col("n_regionkey").cast("int")).alias("tz"))


FRESH_SQL = f"""WITH {SIGNALS_SQL}, f AS (SELECT *, target_date::DATE + CASE horizon WHEN 'market_open' THEN -2 WHEN 'previous_evening' THEN -1 ELSE 0 END AS day, CASE horizon WHEN 'market_open' THEN 12 WHEN 'previous_evening' THEN 18 WHEN 'morning_of' THEN 6 ELSE 0 END AS h, (['{"','".join(ZONES)}'])[n_regionkey + 1] AS tz FROM signals),
fresh AS (SELECT * FROM f WHERE timezone('UTC', timezone(tz, day::TIMESTAMP + to_hours(h))) > TIMESTAMP '1998-06-01 12:00:00') """


@query("q30_stale_filter_tz", FRESH_SQL + "SELECT o_orderkey, horizon, target_date FROM fresh")
def q30(spark, sf_dir):
    return trading.fresh(signals(spark, sf_dir), NOW, _zones(spark, sf_dir)).select("o_orderkey", "horizon", "target_date")


@query("q31_record_dedup_first_wins", FRESH_SQL + "SELECT o_orderkey FROM fresh QUALIFY row_number() OVER (PARTITION BY city_or_segment, target_date, horizon ORDER BY o_orderkey) = 1")
def q31(spark, sf_dir):
    return trading.first_of_each(trading.fresh(signals(spark, sf_dir), NOW, _zones(spark, sf_dir)), ["o_orderkey"]).select("o_orderkey")


@query(
    "q32_record_against_existing",
    FRESH_SQL
    + """, old AS (SELECT DISTINCT city_or_segment, target_date, horizon FROM signals WHERE o_orderkey % 7 = 0),
new AS (SELECT * FROM fresh WHERE city_or_segment <> 'NATION_3' QUALIFY row_number() OVER (PARTITION BY city_or_segment, target_date, horizon ORDER BY o_orderkey) = 1)
SELECT '1998-06-01T12:00:00' AS recorded_at, city_or_segment, target_date, outcome_label, direction, round(gamma_price, 6) AS gamma_price, round(best_edge, 6) AS edge_after_fee, horizon, 1.0::DOUBLE AS flat_stake,
  round(1 / greatest(CASE WHEN direction = 'yes' THEN gamma_price ELSE 1 - gamma_price END, 1e-9), 6) AS size, 0.003::DOUBLE AS fee_paid, NULL::VARCHAR AS outcome, NULL::DOUBLE AS realized_pnl FROM new ANTI JOIN old USING (city_or_segment, target_date, horizon)""",
)
def q32(spark, sf_dir):
    s = signals(spark, sf_dir)
    names = [f"NATION_{i}" for i in range(25) if i != 3]
    out = trading.record(s, s.filter("o_orderkey % 7 = 0"), NOW, ["o_orderkey"], names, _zones(spark, sf_dir))
    return out.withColumn("gamma_price", F.round("gamma_price", 6))


# settling

SETTLE_SQL = f"""WITH {SIGNALS_SQL}, {SPECS_SQL},
tr AS (SELECT o_orderkey, city_or_segment, target_date, outcome_label, direction, gamma_price, CASE WHEN o_orderkey % 4 <> 0 THEN 2.0::DOUBLE END AS flat_stake, CASE WHEN o_orderkey % 6 <> 0 THEN 0.01::DOUBLE END AS fee_paid,
  CASE WHEN o_orderkey % 13 = 0 THEN 'won' END AS outcome, CASE WHEN o_orderkey % 13 = 0 THEN 0.697::DOUBLE END AS realized_pnl FROM signals),
last AS (SELECT * FROM specs QUALIFY row_number() OVER (PARTITION BY city, target_date ORDER BY pos DESC) = 1),
j AS (SELECT tr.*, s.city, s.is_final, s.truth_label, s.truth_value, coalesce(s.truth_label, CASE WHEN s.truth_value < 15 THEN 'cold' WHEN s.truth_value < 25 THEN 'warm' WHEN s.truth_value <= 40 THEN 'hot' END) AS winner FROM tr LEFT JOIN last s ON s.city = city_or_segment AND s.target_date = tr.target_date),
k AS (SELECT *, CASE WHEN outcome IS NOT NULL THEN NULL WHEN target_date > '{TODAY}' THEN 'future' WHEN city IS NULL THEN 'no_spec' WHEN NOT is_final THEN 'not_final' WHEN truth_label IS NULL AND truth_value IS NULL THEN 'no_truth' WHEN winner IS NULL THEN 'no_bin' END AS pending_reason,
  CASE WHEN direction = 'yes' THEN gamma_price ELSE 1 - gamma_price END AS entry, coalesce(flat_stake, 1) AS stake, coalesce(fee_paid, 0.003) AS fee, (outcome_label = winner)::INT AS pay FROM j),
settled AS (SELECT o_orderkey, pending_reason, outcome IS NULL AND pending_reason IS NULL AS newly_settled, CASE WHEN outcome IS NULL AND pending_reason IS NULL THEN CASE WHEN pay = 1 THEN 'won' ELSE 'lost' END ELSE outcome END AS outcome,
  CASE WHEN outcome IS NULL AND pending_reason IS NULL THEN round(CASE WHEN direction = 'yes' THEN (pay - entry) ELSE (entry - pay) END * stake / greatest(entry, 1e-9) - fee, 6) ELSE realized_pnl END AS realized_pnl FROM k) """


def trades_to_settle(spark, sf_dir):
    k = F.col("o_orderkey")
    return signals(spark, sf_dir).select(
        "o_orderkey", F.col("market_id").alias("recorded_at"), "city_or_segment", "target_date", "outcome_label", "direction", "gamma_price", F.when(k % 4 != 0, 2.0).alias("flat_stake"), F.when(k % 6 != 0, 0.01).alias("fee_paid"),
        F.when(k % 13 == 0, "won").alias("outcome"), F.when(k % 13 == 0, 0.697).alias("realized_pnl"),
    )


def _settled(spark, sf_dir):
    return trading.settle(trades_to_settle(spark, sf_dir), specs(spark, sf_dir), TODAY)


@query("q33_settle_trades", SETTLE_SQL + "SELECT o_orderkey, outcome, realized_pnl, pending_reason, newly_settled FROM settled")
def q33(spark, sf_dir):
    return _settled(spark, sf_dir).select("o_orderkey", "outcome", "realized_pnl", "pending_reason", "newly_settled")


@query("q34_settlement_summary", SETTLE_SQL + "SELECT count(*) FILTER (newly_settled) AS settled, count(pending_reason) AS pending, round(sum(realized_pnl), 4) AS total_pnl FROM settled")
def q34(spark, sf_dir):
    return trading.settlement_summary(_settled(spark, sf_dir)).select("settled", "pending", F.round("total_pnl", 4).alias("total_pnl"))


# market texts


@query("q35_keyword_filter", "SELECT p_partkey, p_name FROM part WHERE contains(lower(coalesce(p_name, '')), 'ring')")
def q35(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(S.contains_text("p_name", "RING")).select("p_partkey", "p_name")


def _questions(spark, sf_dir):
    k = F.col("n_nationkey")
    month = F.get(F.array(*[F.lit(m) for m in ("May", "Sep", "December", "Feb")]), (k % 4).cast("int"))
    q = F.concat(F.when(k % 3 == 0, "Will it rain? ").otherwise(""), F.lit("Highest temperature in "), "n_name", F.lit(" on "), month, F.lit(" "), (k + 1).cast("string"), F.when(k % 5 == 0, ", 2024").otherwise(""), F.when(k % 7 == 0, "").otherwise("?"))
    return table(spark, sf_dir, "nation").select("n_nationkey", q.alias("question"))


_QSQL = "WITH q AS (SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'Will it rain? ' ELSE '' END || 'Highest temperature in ' || n_name || ' on ' || (['May','Sep','December','Feb'])[1 + n_nationkey % 4] || ' ' || (n_nationkey + 1) || CASE WHEN n_nationkey % 5 = 0 THEN ', 2024' ELSE '' END || CASE WHEN n_nationkey % 7 = 0 THEN '' ELSE '?' END AS question FROM nation)"


@query(
    "q36_parse_question",
    _QSQL
    + r""", m AS (SELECT *, regexp_extract(question, '(?i)highest temperature in (.+) on (.+?)\?', 1) AS city, regexp_extract(question, '(?i)highest temperature in (.+) on (.+?)\?', 2) AS raw FROM q),
d AS (SELECT *, regexp_extract(raw, '^([A-Za-z]+ [0-9]{1,2})(, [0-9]{4})?$', 1) AS day FROM m)
SELECT n_nationkey, city, coalesce(strftime(coalesce(try_strptime(day || ' 2023', '%B %d %Y'), try_strptime(day || ' 2023', '%b %d %Y')), '%Y-%m-%d'), raw) AS target_date,
  regexp_extract(question, '(?i)^highest temperature in ([\w\s,]+?) on (.+?)\??$', 1) AS city_anchored FROM d""",
)
def q36(spark, sf_dir):
    return _questions(spark, sf_dir).select(
        "n_nationkey", F.regexp_extract("question", markets.GREEDY, 1).alias("city"), S.human_date(F.regexp_extract("question", markets.GREEDY, 2), 2023).alias("target_date"), F.regexp_extract("question", markets.NAMED, 1).alias("city_anchored")
    )


def _listed(spark, sf_dir):
    k = F.col("n_nationkey")
    null = F.lit(None).cast("string")
    return _questions(spark, sf_dir).select(
        "*",
        F.when(k % 2 == 0, "Source: Wunderground station").when(k % 5 == 0, "none").otherwise(null).alias("description"),
        F.when(k % 4 == 1, '["Yes", "No"]').when(k % 4 == 3, null).otherwise('["28-30°C", ">35°C"]').alias("outcomes"),
        F.lit(None).cast("array<struct<outcome:string,label:string,name:string,price:string>>").alias("tokens"),
    )


@query(
    "q37_is_temperature",
    _QSQL
    + r""", l AS (SELECT *, CASE WHEN n_nationkey % 2 = 0 THEN 'Source: Wunderground station' WHEN n_nationkey % 5 = 0 THEN 'none' END AS description, CASE WHEN n_nationkey % 4 = 1 THEN '["Yes", "No"]' WHEN n_nationkey % 4 = 3 THEN NULL ELSE '["28-30°C", ">35°C"]' END AS outcomes FROM q),
f AS (SELECT *, coalesce(contains(lower(description), 'wunderground'), false) AS hint, coalesce(contains(outcomes, '°C'), false) AS deg FROM l)
SELECT n_nationkey, regexp_matches(question, '(?i)highest temperature in (.+) on (.+?)\?') AND hint AND deg AS strict, NOT (description IS NOT NULL AND NOT hint AND outcomes IS NOT NULL AND NOT deg) AS soft, false AS race FROM f""",
)
def q37(spark, sf_dir):
    return _listed(spark, sf_dir).select("n_nationkey", markets.is_temperature_strict().alias("strict"), markets.is_temperature_soft().alias("soft"), markets.is_race().alias("race"))


def _priced(spark, sf_dir):
    k = F.col("p_partkey")
    prices = F.when(k % 5 == 0, F.lit("oops")).when(k % 5 == 1, F.lit('["0.1", "x", "0.3"]')).when(k % 5 == 2, F.lit('["0.25"]')).otherwise(F.format_string('["%.2f", "0.40", "0.05", "0.9"]', k % 50 / 100))
    return table(spark, sf_dir, "part").select("p_partkey", F.lit('["a", "b", "c"]').alias("labels_text"), prices.alias("prices_text"))


@query(
    "q38_parse_json_lists",
    """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 1 THEN ['0.1', 'x', '0.3'] WHEN p_partkey % 5 = 2 THEN ['0.25'] WHEN p_partkey % 5 > 2 THEN [printf('%.2f', p_partkey % 50 / 100), '0.40', '0.05', '0.9'] END AS l FROM part),
e AS (SELECT p_partkey, list_transform(coalesce(l, []), lambda x: coalesce(try_cast(x AS DOUBLE), 0)) AS each_, CASE WHEN l IS NULL OR p_partkey % 5 = 1 THEN [0.5, 0.5, 0.5]::DOUBLE[] ELSE list_transform(l, lambda x: x::DOUBLE) END AS whole FROM p)
SELECT p_partkey, len(each_)::INT AS n_each, round(coalesce(list_max(each_), 0.5), 6) AS best_each, round(whole[1], 6) AS first_price, round(coalesce(whole[3], 0.5), 6) AS third_price, round(list_max(whole), 6) AS best_price FROM e""",
)
def q38(spark, sf_dir):
    p = _priced(spark, sf_dir).select("p_partkey", S.json_list("labels_text").alias("labels"), "prices_text")
    p = p.withColumns({"each": S.prices_each("prices_text"), "whole": S.prices_all_or_half("prices_text", "labels")}).withColumn("zipped", S.label_prices("labels", "whole"))
    return p.select(
        "p_partkey", F.size("each").alias("n_each"), F.round(S.best_price("each"), 6).alias("best_each"), F.round(F.get("zipped", F.lit(0))["price"], 6).alias("first_price"), F.round(F.get("zipped", F.lit(2))["price"], 6).alias("third_price"), F.round(S.best_price("whole"), 6).alias("best_price")
    )


_LABEL_FORMS = ["%d-%d°C", ">%d°F", "<= %d°C", "%d°C", "%d to %d", "%d°C or higher"]


@query(
    "q39_parse_temp_bounds",
    """WITH l AS (SELECT p_partkey, p_size AS v, CASE p_partkey % 6 WHEN 0 THEN p_size || '-' || (p_size + 2) || '°C' WHEN 1 THEN '>' || p_size || '°F' WHEN 2 THEN '<= ' || p_size || '°C' WHEN 3 THEN p_size || '°C' WHEN 4 THEN p_size || ' to ' || (p_size + 2) ELSE p_size || '°C or higher' END AS label FROM part)
SELECT p_partkey, label, CASE p_partkey % 6 WHEN 0 THEN v WHEN 1 THEN v WHEN 3 THEN v - 0.5 WHEN 4 THEN v END::DOUBLE AS lower, CASE p_partkey % 6 WHEN 0 THEN v + 2 WHEN 2 THEN v WHEN 3 THEN v + 0.5 WHEN 4 THEN v + 2 END::DOUBLE AS upper, p_partkey % 6 <> 5 AS parse_ok FROM l""",
)
def q39(spark, sf_dir):
    k, v = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    v2 = (F.col("p_size") + 2).cast("string")
    label = F.when(k == 0, F.concat(v, F.lit("-"), v2, F.lit("°C"))).when(k == 1, F.concat(F.lit(">"), v, F.lit("°F"))).when(k == 2, F.concat(F.lit("<= "), v, F.lit("°C"))).when(k == 3, F.concat(v, F.lit("°C"))).when(k == 4, F.concat(v, F.lit(" to "), v2)).otherwise(F.concat(v, F.lit("°C or higher")))
    p = table(spark, sf_dir, "part").select("p_partkey", label.alias("label")).withColumn("b", bins.temperature_bounds("label"))
    return p.select("p_partkey", "label", "b.lower", "b.upper", "b.parse_ok")


@query("q40_resolve_winning_bin", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'cold' WHEN p_size <= 25 THEN 'mild' WHEN p_size >= 25 AND p_size < 40 THEN 'warm' END AS winner FROM part")
def q40(spark, sf_dir):
    b = F.expr("array(named_struct('label','cold','lower',cast(null as double),'upper',10D,'lower_inclusive',true,'upper_inclusive',false), named_struct('label','mild','lower',10D,'upper',25D,'lower_inclusive',true,'upper_inclusive',true), named_struct('label','warm','lower',25D,'upper',40D,'lower_inclusive',true,'upper_inclusive',false))")
    return table(spark, sf_dir, "part").withColumn("bins", b).select("p_partkey", bins.winning_label(F.col("p_size").cast("double"), "bins").alias("winner"))


# models: no SQL


# neighbours whose means do not rise are pooled, all runs of them at once, until none are left
ISOTONIC_SQL = (
    SCORE_SQL.replace("WITH", "WITH RECURSIVE", 1)
    + """, e AS (SELECT event_id, market_price AS y_prob FROM panel),
r AS (SELECT 0 AS it, y_prob AS lo, y_prob AS hi, count(*)::BIGINT AS n, sum(y_true)::DOUBLE AS t FROM s WHERE y_prob IS NOT NULL AND y_true IS NOT NULL GROUP BY y_prob
UNION ALL SELECT it + 1, min(lo), max(hi), sum(n)::BIGINT, sum(t)::DOUBLE FROM (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (ORDER BY lo) AS grp, bool_or(bad) OVER () AS found FROM (SELECT *, coalesce(lag(t / n) OVER (ORDER BY lo) >= t / n, false) AS bad FROM r)) WHERE found GROUP BY it, grp),
fit AS (SELECT lo, t / n AS v FROM r WHERE it = (SELECT max(it) FROM r)) """
)


@query("q41_isotonic_calibration", ISOTONIC_SQL + "SELECT event_id, round(y_prob, 6) AS y_prob, round(v, 6) AS calibrated FROM e ASOF LEFT JOIN fit ON y_prob >= lo")
def q41(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return models.IsotonicCalibrator().fit(s).transform(s).select("event_id", *r6("y_prob", "calibrated"))


@query("q42_walkforward_logreg")
def q42(spark, sf_dir):
    p = panel(spark, sf_dir)
    r = backtest.walk_forward_model(p, lambda: models.SparkForecaster("logistic_regression", maxIter=20), 10, MIN_TRAIN, ["event_id"])
    return r.trades


@query("q43_champion_roundtrip")
def q43(spark, sf_dir):
    p = panel(spark, sf_dir).withColumn("label", S.won("outcome_label", "winning_label").cast("double"))
    m = models.SparkForecaster("logistic_regression", maxIter=10).fit(p, ["feature_value", "feature_hour"])
    segments = metrics.gate_segments(walk(spark, sf_dir).trades, ["S0"], min_trades=1, min_pnl=-1e9)
    gate = models.gate_to_dict(segments, metrics.gate_decision(walk(spark, sf_dir).trades, segments))
    folder = files.scratch(spark)
    models.Champion.publish(folder, m, gate, "weather_tmax")
    back = models.Champion.load(f"{folder}/champion.json")
    return back.load_model().predict_proba(p).select("event_id", "predicted_prob")


def _prices(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").filter(k % 3 != 0).select(k.cast("string").alias("token_id"), F.when(k % 5 == 0, "{}").otherwise(F.format_string('{"mid": "%.2f"}', k % 90 / 100)).alias("answer"))


@query("q44_price_lookup_inner", "SELECT p_partkey::VARCHAR AS token_id, round((p_partkey % 90) / 100.0, 6)::DOUBLE AS price FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 5 <> 0")
def q44(spark, sf_dir):
    tokens = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("token_id"))
    return listings.midpoints(tokens, _prices(spark, sf_dir)).select("token_id", *r6("price"))


@query("q44_price_lookup_left", "SELECT p_partkey::VARCHAR AS token_id, CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 THEN round((p_partkey % 90) / 100.0, 6)::DOUBLE END AS price FROM part")
def q44l(spark, sf_dir):
    tokens = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("token_id"))
    return listings.with_prices(tokens, listings.midpoints(tokens, _prices(spark, sf_dir))).select("token_id", *r6("price"))


@query("q45_ttl_and_key", "SELECT event_id, md5(event_type || ':' || event_id) AS key, TIMESTAMP '2024-01-15 00:00:00' < ts + INTERVAL 3600 SECOND AS valid FROM events")
def q45(spark, sf_dir):
    until = F.col("ts") + F.expr("INTERVAL 3600 SECOND")
    return _events(spark, sf_dir).select("event_id", S.cache_key(F.concat("event_type", F.lit(":"), "event_id")).alias("key"), (F.lit("2024-01-15 00:00:00").cast("timestamp_ntz") < until).alias("valid"))


@query("q46_stream_record", f"WITH {SIGNALS_SQL} SELECT DISTINCT city_or_segment, target_date, horizon FROM signals")
def q46(spark, sf_dir):
    """Signals as a stream of files, recorded batch by batch; the keys in the table."""
    from augury.sources.log import TradeStore
    from augury.streaming.record import record_stream

    root = files.scratch(spark)
    signals(spark, sf_dir).repartition(3).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{root}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    store = TradeStore(spark, f"{root}/trades")
    record_stream(stream, store, datetime(1900, 1, 1), f"{root}/checkpoint", ["o_orderkey"]).awaitTermination()
    return store.read().select("city_or_segment", "target_date", "horizon")


def _all() -> None:
    from augury.plans import flows  # noqa: F401  registers its queries here


def queries() -> dict[str, Query]:
    _all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_SQL)
