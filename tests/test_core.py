"""Operators on hand-made rows: orders, nulls, ties, states, files, streams, commands."""

import json
import random
import uuid
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from augury import cli, config, schemas
from augury.functions import bins
from augury.functions import scalars as S
from augury.operators import backtest, features, markets, metrics, models, ordering, report, trading
from augury.plans import flows
from augury.plugins import MarketPlugin, PluginRegistry, RacePlugin, TemperaturePlugin, discover_plugins
from augury.sources import files, listings, log, polling, tables
from augury.streaming import keyed
from augury.streaming.record import record_stream, settle_stream


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_scalars(spark):
    r = one(
        spark,
        edge=S.edge(0.6, 0.3, 0.003), fee=S.fee(1.0), size=S.flat_stake_size(1.0, 0.25), tiny=S.flat_stake_size(1.0, 0.0), k0=S.kelly_fraction(0.5, 0.0), k1=S.kelly_fraction(0.6, 0.5), k2=S.kelly_fraction(0.1, 0.5),
        cap=S.kelly_stake_size(0.9, 0.5, 1000.0), buy=S.settle_position(F.lit("a"), F.lit("a"), 0.3, 3.33, F.lit("buy"), 0.003), sell=S.settle_position(F.lit("a"), F.lit("b"), 0.7, 1.43, F.lit("sell")), nul=S.settle_position(F.lit("a"), F.lit(None), 0.3, 1.0, F.lit("buy")),
    )
    assert r.edge == pytest.approx(0.297) and r.fee == pytest.approx(0.003) and r["size"] == 4 and r.tiny == pytest.approx(1e9)
    assert (r.k0, r.k2) == (0, 0) and r.k1 == pytest.approx(0.05) and r.cap == 50
    assert r.buy == pytest.approx(0.7 * 3.33 - 0.003) and r.sell == pytest.approx(0.7 * 1.43) and r.nul == pytest.approx(-0.3)


def test_bin_edges_and_dates(spark):
    p = [0.0, 0.1, 0.2, 0.3, 0.6, 0.7, 0.9, 1.0, float("nan"), -0.1, 1.2]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double").orderBy("i").select(S.calibration_bin("p")).collect()]
    assert got == [0, 1, 2, 2, 5, 6, 9, 9, 9, 0, 9]
    d = lambda t, **k: one(spark, x=S.human_date(F.lit(t), 2025, **k)).x
    assert d("May 13") == "2025-05-13" and d("Sep 1, 2024") == "2025-09-01" and d("Sep 1, 2024", keep_year=True) == "2024-09-01" and d("2024-01-02") == "2024-01-02" and d("Feb 29") == "Feb 29"


def test_bins(spark):
    rows = spark.createDataFrame([(s,) for s in ("28-30°C", "30°C", ">35°C", "<20°C", "Unknown bin", "1.2.3")], "s string").select(bins.temperature_bounds("s").alias("b")).collect()
    assert [(r.b.lower, r.b.upper) for r in rows] == [(28, 30), (29.5, 30.5), (35, None), (None, 20), (None, None), (None, None)]
    label = lambda v: one(spark, x=bins.winning_label(v, bins.bins_of(F.array(F.lit("<15"), F.lit("15-25"), F.lit(">25"))))).x
    assert [label(F.lit(v)) for v in (10.0, 15.0, 20.0, 25.0, 30.0)] == ["<15", "<15", "15-25", "15-25", ">25"] and label(F.lit(None).cast("double")) is None


ROWS = [(1, "A", 20.0), (2, "B", 15.0), (3, "A", 22.0), (4, "B", None), (5, None, 9.0), (6, "A", float("nan")), (7, None, 8.0)]


def test_feature_windows(spark):
    df = spark.createDataFrame(ROWS, "seq int, city string, temp double")
    lag = {r.seq: r.temp_lag1 for r in features.add_lags(df, ["temp"], [1], "seq", "city").collect()}
    assert lag == {1: None, 2: None, 3: 20.0, 4: 15.0, 5: None, 6: 22.0, 7: None}
    assert {r.seq: r.temp_lag1 for r in features.add_lags(df, ["temp"], [1], "seq", "city", -9.0).collect()}[7] == -9.0
    roll = {r.seq: (r.temp_roll2_mean, r.temp_roll2_median) for r in features.add_rolling_stats(df, ["temp"], [2], "seq", ["mean", "median"], "city").collect()}
    assert roll[3] == (21.0, 21.0) and roll[4] == (15.0, 15.0) and roll[6] == (22.0, 22.0) and roll[5] == (None, None)
    with pytest.raises(KeyError, match="nope"):
        features.add_lags(df, ["nope"], [1], "seq")
    hot = features.encode_onehot(df, ["city", "seq"])
    assert hot.columns == ["temp", "seq", "city_B"] and [r.city_B for r in hot.orderBy("seq").collect()] == [0, 1, 0, 1, 0, 0, 0]
    x = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 100, -100)] + [(None,)], "x double")
    out = [r.x for r in features.clip_outliers(x, ["x"], iqr_factor=1.5).collect()]
    assert max(v for v in out if v is not None) < 100 and out[-1] is None


def test_metrics_and_gate(spark):
    t = spark.createDataFrame([("A", 0.1, "won", 0.2)] * 50 + [("B", 0.1, "won", 0.1)] * 5 + [("C", -0.1, "lost", None)] * 50, "segment string, realized_pnl double, outcome string, edge double")
    g = {r.segment: r.reason for r in metrics.gate_segments(t, ["A", "B", "C", "D"]).collect()}
    assert g == {"A": "ok", "B": "insufficient_trades", "C": "negative_pnl", "D": "missing"}
    seg = metrics.gate_segments(t, ["A", "D"])
    assert metrics.gate_decision(t, seg).first().decision == "NO_GO" and metrics.gate_decision(t, metrics.gate_segments(t, ["A"])).first().decision == "GO"
    assert metrics.gate_decision(t, seg.limit(0)).first().decision == "GO"
    empty = metrics.backtest_metrics(t.limit(0)).first()
    assert tuple(empty) == (0, 0, 0, 0, 0)
    m = metrics.backtest_metrics(t).first()
    assert m.num_trades == 105 and m.hit_rate == pytest.approx(55 / 105)
    perfect = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0)] * 5, "y_prob double, y_true double")
    b = metrics.brier_decomposition(perfect).first()
    assert b.brier_score == 0 and b.skill_score == 1 and abs(b.reliability - b.resolution + b.uncertainty - b.brier_score) < 1e-9


def panel(spark, n=60):
    rows = [(f"m{i % 5}", f"2024-01-{1 + i // 5:02d}", lab, "hot" if i % 3 == 0 else "warm", 0.2 + (i % 7) / 10, "S", float(i % 4), i) for i in range(n) for lab in ("warm", "hot")]
    return spark.createDataFrame(rows, "market_id string, decision_date string, outcome_label string, winning_label string, market_price double, segment string, feature_x double, i int")


def test_walk_forward(spark):
    p = panel(spark)
    for r in (backtest.walk_forward_rates(p, 3, 20, ["outcome_label"]), backtest.walk_forward_model(p, lambda: models.SparkForecaster(maxIter=5), 5, 20, ["outcome_label"])):
        steps = {s.eval_date: s for s in r.steps.collect()}
        trades = r.trades.collect()
        assert trades and len(trades) == sum(s.trades for s in steps.values())
        for d, s in steps.items():
            assert s.train_rows == p.filter(F.col("decision_date") < d).count() >= 20
        assert len({(t.market_id, t.eval_date) for t in trades}) == len(trades)
        assert all(0 <= t.predicted_prob <= 1 and t.segment == "S" for t in trades)
    none = backtest.walk_forward_model(p, models.SparkForecaster, 5, 10**6, ["outcome_label"])
    assert none.trades.count() == 0 and none.trades.columns == [f.name for f in schemas.struct(schemas.BACKTEST_TRADE)]
    only = p.withColumn("winning_label", F.lit("no"))
    assert {t.predicted_prob for t in backtest.walk_forward_model(only, models.SparkForecaster, 9, 20, ["outcome_label"]).trades.collect()} == {0.0}
    with pytest.raises(ValueError):
        backtest.check_stride(9)


def sig(**k):
    base = {"market_id": "m", "city_or_segment": "X", "target_date": "2099-12-31", "horizon": "morning_of", "outcome_label": "hot", "direction": "yes", "gamma_price": 0.25, "model_prob": 0.6, "best_edge": 0.3, "yes_edge": 0.3, "no_edge": -0.3, "question": ""}
    return base | k


def signals(spark, rows):
    kind = schemas.struct(schemas.SIGNAL)
    return spark.createDataFrame([tuple(r[f.name] for f in kind) for r in rows], kind)


def test_record(spark):
    now = datetime(2024, 6, 1, 12)
    s = signals(spark, [sig(market_id="a"), sig(market_id="b"), sig(city_or_segment="Y"), sig(target_date="2020-01-01"), sig(target_date="May 1"), sig(horizon="odd", direction="no")])
    new = trading.record(s, None, now, ["market_id"])
    assert new.count() == 3 and {r["size"] for r in new.collect()} == {4.0, round(1 / 0.75, 6)}
    assert trading.record(s, new, now, ["market_id"]).count() == 0
    assert trading.record(s, None, now, ["market_id"], segments=[]).count() == 0 and trading.record(s, None, now, ["market_id"], segments=["Y"]).count() == 1
    near = signals(spark, [sig(target_date="2024-06-01")])
    zones = spark.createDataFrame([("X", "America/Los_Angeles")], "city_or_segment string, tz string")
    assert trading.fresh(near, now).count() == 0 and trading.fresh(near, now, zones).count() == 1


def test_settle(spark):
    kind = schemas.struct(schemas.TRADE)
    t = {"recorded_at": "r", "city_or_segment": "X", "target_date": "2024-01-01", "outcome_label": "hot", "direction": "yes", "gamma_price": 0.3, "edge_after_fee": 0.1, "horizon": "h", "flat_stake": 1.0, "size": 3.3, "fee_paid": 0.003, "outcome": None, "realized_pnl": None}
    rows = [t, t | {"direction": "no"}, t | {"outcome_label": "cold"}, t | {"target_date": "2099-01-01"}, t | {"city_or_segment": "Z"}, t | {"city_or_segment": "P"}, t | {"city_or_segment": "Q"}, t | {"city_or_segment": "R"}, t | {"outcome": "won", "realized_pnl": 0.697}]
    trades = spark.createDataFrame([tuple(r[f.name] for f in kind) for r in rows], kind)
    specs = spark.createDataFrame([("X", 1, True, "cold", None), ("X", 2, True, None, 32.5), ("P", 3, False, "hot", None), ("Q", 4, True, None, None), ("R", 5, True, None, 999.0)], "city string, pos int, is_final boolean, truth_label string, truth_value double")
    specs = specs.withColumn("target_date", F.lit("2024-01-01")).withColumn("outcome_bins", bins.bins_of(F.array(F.lit("<30"), F.lit("30-40"))))
    specs = specs.withColumn("outcome_bins", F.transform("outcome_bins", lambda b: b.withField("label", F.when(b["label"] == "<30", "cold").otherwise("hot"))))
    done = trading.settle(trades, specs, "2024-06-01")
    got = sorted(((r.city_or_segment, r.target_date, r.direction, r.outcome_label, r.outcome, r.realized_pnl, r.pending_reason) for r in done.collect()), key=str)
    reasons = {(g[0], g[1]): g[6] for g in got if g[6]}
    assert reasons == {("X", "2099-01-01"): "future", ("Z", "2024-01-01"): "no_spec", ("P", "2024-01-01"): "not_final", ("Q", "2024-01-01"): "no_truth", ("R", "2024-01-01"): "no_bin"}
    pnl = {(g[2], g[3]): g[5] for g in got if g[4] and g[5] != 0.697}
    assert pnl["yes", "hot"] == pytest.approx(0.7 / 0.3 - 0.003, abs=1e-6) and pnl["no", "hot"] == pytest.approx(-0.3 / 0.7 - 0.003, abs=1e-6)
    s = trading.settlement_summary(done).first()
    assert (s.settled, s.pending) == (3, 5)
    other = {(r.direction, r.outcome_label): r.realized_pnl for r in trading.settle(trades, specs, "2024-06-01", "complement").filter("newly_settled").collect()}
    assert other["no", "hot"] == pytest.approx(-1.003, abs=1e-6)
    receipts = trading.dry_run_orders(spark.createDataFrame([("tok-12345678", "buy", 0.5, 1.0), ("t", "BUY", 1.5, 1.0), ("t", "HOLD", 0.5, 1.0)], "token_id string, side string, price double, size double"), "now").collect()
    assert [r.status for r in receipts] == ["dry_run", "rejected", "rejected"] and receipts[0].order_id == "dry-run-tok-1234"
    assert trading.preflight(True, True)["ok"] and not trading.preflight(False)["ok"]


RAW = [
    {"id": "1", "slug": "s", "question": "Highest temperature in São Paulo on May 13?", "description": "Wunderground", "outcomes": '["<20°C", "20-25°C", ">25°C"]', "outcomePrices": '["0.1", "0.7"]', "clobTokenIds": '["t1", "t2", "t3"]', "active": True},
    {"id": "2", "question": "Highest temperature in Rome on May 14?", "tokens": [{"outcome": "30°C", "price": "0.4"}, {"name": ">30°C"}]},
    {"id": "3", "question": "Who wins the Monaco Grand Prix?", "gp": "monaco", "tokens": [{"outcome": "Max"}, {"outcome": "Lando"}]},
    {"id": "4", "question": "Highest temperature in Oslo on May 14?", "description": "a guess", "outcomes": '["Yes", "No"]'},
]


def test_listings_to_training_rows(spark, tmp_path):
    folder = str(tmp_path / "pages")
    listings.dump_pages(RAW, folder, 3)
    pages = listings.read_pages(spark, folder)
    assert pages.count() == 4 and listings.fetch_all(pages, page_size=3).count() == 4
    assert listings.fetch_all(pages, "ROME", 3).count() == 1 and listings.fetch_all(pages, page_size=3, max_results=3).count() == 3
    raw = listings.typed(pages, markets.RAW)
    assert [r.market_id for r in markets.temperature_infos(raw.filter(markets.is_temperature_strict()), 2024).collect()] == ["1"]
    plug = TemperaturePlugin(observed=spark.createDataFrame([("São Paulo", "2024-05-13", 22.0)], "city string, target_date string, value double"), year=2024)
    specs = plug.discover_markets(raw)
    got = {r.market_id: r for r in specs.collect()}
    assert set(got) == {"1", "2"} and got["1"].city == "São Paulo" and got["1"].market_price == 0.7 and [p.price for p in got["1"].outcome_schema] == [0.1, 0.7, 0.5]
    assert got["2"].unit == "C" and [b.lower for b in got["2"].outcome_bins] == [29.5, 30.0]
    train = plug.build_training_rows(specs, "morning_of").collect()
    assert len(train) == 3 and {r.winning_label for r in train} == {"20-25°C"} and "feature_lead_hours" in train[0].asDict()
    race = RacePlugin(results=spark.createDataFrame([("monaco", "race_winner", "Max")], "gp string, market_type string, winner string"))
    rows = race.build_training_rows(race.discover_markets(raw), "morning_of").collect()
    assert {r.outcome_label for r in rows} == {"Max", "Lando"} and {r.winning_label for r in rows} == {"Max"}
    assert markets.legacy_temperature_specs(raw).filter("market_id = '2'").first().timezone == "UTC"
    reg = PluginRegistry()
    reg.register(plug)
    with pytest.raises(ValueError):
        reg.register(plug)
    with pytest.raises(KeyError):
        reg.get("none")
    assert reg.list_families() == ["weather_tmax"] and discover_plugins() == {} and issubclass(TemperaturePlugin, MarketPlugin)


def test_answer_table(spark, tmp_path):
    table = listings.AnswerTable(spark, str(tmp_path / "answers"), 60)
    t0 = datetime(2024, 1, 1)
    assert table.valid(t0).count() == 0
    table.put(spark.createDataFrame([("a", "{}"), ("b", "no json"), ("c", "[1]")], "request string, value string"), t0)
    table.delete(spark.createDataFrame([("c",)], "request string"), t0)
    assert {r.request for r in table.valid(t0).collect()} == {"a"} and table.valid(datetime(2024, 1, 1, 0, 1)).count() == 0
    assert table.n_expired(datetime(2024, 1, 2)) == 4


def test_files_models_report_cli(spark, tmp_path, capsys):
    p = panel(spark)
    path = str(tmp_path / "panel.csv")
    p.drop("i").toPandas().to_csv(path, index=False)
    back = tables.read_panel(spark, path)
    assert back.count() == p.count() and dict(back.dtypes)["feature_x"] == "double" and dict(back.dtypes)["decision_date"] == "string"
    with pytest.raises(FileNotFoundError):
        tables.read_panel(spark, str(tmp_path / "none.parquet"))
    with pytest.raises(ValueError):
        (tmp_path / "x.txt").write_text("")
        tables.read_panel(spark, str(tmp_path / "x.txt"))
    assert tables.read_trades_json(spark, str(tmp_path / "none.json")).count() == 0
    trades = {"trades": [{"recorded_at": "2024-01-01", "city_or_segment": "<b>", "gamma_price": 0.3, "flat_stake": 1.0, "realized_pnl": 3.64, "outcome": "won"}, {"recorded_at": "2024-01-02", "city_or_segment": "Z", "realized_pnl": -3.0}, {"recorded_at": "2024-01-03"}]}
    (tmp_path / "t.json").write_text(json.dumps(trades))
    out = report.write_report(tables.read_trades_json(spark, str(tmp_path / "t.json")), str(tmp_path / "r.html"), "T & <x>", 0.2)
    html = out.read_text()
    assert "<b></td>" not in html and "+$0.64" in html and "polyline" in html and "0.2000" in html
    m = models.SparkForecaster("random_forest", numTrees=3).fit(p.withColumn("label", S.won("outcome_label", "winning_label").cast("double")), ["feature_x"])
    with pytest.raises(ValueError):
        models.Champion.publish(str(tmp_path / "c"), m, {"decision": "NO_GO"}, "weather_tmax")
    assert not (tmp_path / "c").exists()
    gate = {"decision": "GO", "segment_results": [{"segment": "S", "passes": True}, {"segment": "T", "passes": False}]}
    models.Champion.publish(str(tmp_path / "c"), m, gate, "weather_tmax")
    c = models.Champion.load(str(tmp_path / "c/champion.json"))
    assert c.allowed_segments() == {"S"} and c.load_model().predict_proba(p).count() == p.count() and c.load_calibrator() is None
    with pytest.raises(ValueError):
        models.SparkForecaster("nope")
    with pytest.raises(RuntimeError):
        models.IsotonicCalibrator().transform(p)
    cal = models.IsotonicCalibrator().fit(spark.createDataFrame([(0.1, 0.0), (0.5, 1.0), (0.9, 1.0)], "y_prob double, y_true double"))
    assert [r.calibrated for r in cal.transform(spark.createDataFrame([(-0.5,), (1.5,)], "y_prob double")).collect()] == [0.0, 1.0]
    assert cli.main(["version"]) == 0 and cli.main(["backtest", "--panel", path, "--stride", "5"]) == 1
    assert cli.main(["backtest", "--panel", path, "--stride", "10", "--model", "rates", "--output", str(tmp_path / "m.json")]) == 0
    assert cli.main(["status", "--artifacts", str(tmp_path / "none")]) == 0 and cli.main(["report", "--trades", "none.json"]) == 1
    store = log.TradeStore(spark, str(tmp_path / "store"))
    assert store.read().count() == 0
    new = trading.record(signals(spark, [sig()]), store.read(), datetime(2024, 1, 1), ["market_id"])
    store.append(new)
    store.append(trading.record(signals(spark, [sig(), sig(city_or_segment="W")]), store.read(), datetime(2024, 1, 1), ["market_id"]))
    assert store.read().count() == 2
    store.settle(store.read().limit(1).withColumns({"outcome": F.lit("won"), "realized_pnl": F.lit(0.5)}), "2024-01-02")
    assert store.read().count() == 2 and [r.realized_pnl for r in store.read().filter("outcome = 'won'").collect()] == [0.5]


def test_settings(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("AUGURY_MIN_EDGE=0.5\nAUGURY_LOG_LEVEL='DEBUG'\n#x\n")
    s = config.Settings.read({"AUGURY_MIN_EDGE": "0.4"}, str(tmp_path / ".env"))
    assert s.min_edge == 0.4 and s.log_level == "DEBUG" and not s.has_api_credentials
    w = config.Workspace.from_name("w", str(tmp_path)).make()
    assert w.parquet.is_dir() and "w" in w.environment().values()
    with pytest.raises(OSError, match="missing"):
        config.Workspace.from_env()
    assert config.logger("augury.x").name == "augury.x"


def test_windows_in_chunks_equal_whole_windows(spark):
    rows = [(i, "abc"[i * 7 % 3] if i % 11 else None, float(i * 37 % 101) if i % 5 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, g string, v double").repartition(5)
    for group in (None, "g"):
        make = lambda w: {"lag": F.lag("v", 3).over(w), "lead": F.lead("v", 2).over(w), "mean": F.avg("v").over(w.rowsBetween(-4, 0))}
        whole = df.withColumns(make((W.partitionBy(group) if group else W.partitionBy()).orderBy("i")))
        for n in (1, 7, 64, 1000):
            got = ordering.framed(df, group, ["i"], 4, 2, make, n)
            assert sorted(got.collect(), key=lambda r: r.i) == sorted(whole.collect(), key=lambda r: r.i), (group, n)


def test_exact_quantiles(spark):
    r = random.Random(4)
    sets = {"few": [3.0, 1.0], "one": [5.0], "ties": [1.0] * 400 + [2.0] * 300 + [9.0], "many": [r.gauss(0, 1) for _ in range(3001)], "none": []}
    for name, values in sets.items():
        df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
        for accuracy in (10, 100_000):
            got = ordering.quantiles(df, {"v": F.when(~F.isnan("v"), F.col("v"))}, [0.0, 0.25, 0.5, 0.75, 1.0], accuracy).first().v
            want = [None] * 5 if not values else np.quantile(values, [0, 0.25, 0.5, 0.75, 1]).tolist()
            assert got == pytest.approx(want) if values else got == want, (name, accuracy)


def test_report_curve_ends_with_the_last_trade(spark, tmp_path):
    rows = [(f"2020-01-01T{i:06d}", f"c{i % 1500}", "d", "h", 1.0) for i in range(2500)]
    df = spark.createDataFrame(rows, "recorded_at string, city_or_segment string, target_date string, horizon string, realized_pnl double")
    points = report.curve_points(df)
    assert len(points) == 2000 and points[-1] == 2500 and points == sorted(points)
    t = df.select("*", *[F.lit(None).cast(k).alias(n) for n, k in (("flat_stake", "double"), ("edge_after_fee", "double"), ("outcome_label", "string"), ("gamma_price", "double"), ("outcome", "string"))])
    html = report.write_report(t, str(tmp_path / "r.html")).read_text()
    assert "and 500 segments with fewer trades" in html and "and 2300 older trades" in html


def test_unknown_keys_of_signals_fail(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"signals": [{"market_id": "a", "best_edge": 0.3}, {"market_id": "b", "edgy": 1}]}))
    with pytest.raises(Exception, match="edgy"):
        tables.read_signals_json(spark, str(tmp_path / "s.json")).collect()
    (tmp_path / "t.json").write_text(json.dumps({"signals": [{"market_id": "a", "best_edge": 0.3}]}))
    assert [(r.market_id, r.best_edge) for r in tables.read_signals_json(spark, str(tmp_path / "t.json")).collect()] == [("a", 0.3)]


def test_purge_and_versions(spark, tmp_path):
    table = listings.AnswerTable(spark, str(tmp_path / "a"), 60)
    t0 = datetime(2024, 1, 1)
    table.put(spark.createDataFrame([("a", "{}"), ("b", "{}")], "request string, value string"), t0)
    table.put(spark.createDataFrame([("c", '{"x": 1}')], "request string, value string"), datetime(2024, 1, 1, 1))
    table.delete(spark.createDataFrame([("b",)], "request string"), t0)
    assert table.purge(datetime(2024, 1, 1, 1)) == 3 and table.purge(datetime(2024, 1, 1, 1)) == 0
    assert [r.request for r in table.read().collect()] == ["c"] and len([p for p in (tmp_path / "a").iterdir() if p.is_dir()]) == 1
    assert [r.value.x for r in table.typed(datetime(2024, 1, 1, 1), "x int").collect()] == [1]
    with pytest.raises(FileNotFoundError):
        files.read_text(spark, str(tmp_path / "none"))


def files_scanned(df):
    """Files that the scan of a plan without exchanges has read."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numFiles").value()


def _trade(i, date="2024-05-01", **more):
    return {"recorded_at": f"r{i}", "city_or_segment": "S", "target_date": date, "horizon": f"h{i}", "outcome_label": "warm", "direction": "yes", "gamma_price": 0.4, "flat_stake": 1.0, "fee_paid": 0.0} | more


def _trades(spark, rows):
    kind = schemas.struct(schemas.TRADE)
    return spark.createDataFrame([tuple(r.get(f.name) for f in kind) for r in rows], kind)


def test_eight_writers_at_once_lose_nothing(spark, tmp_path):
    """Recorders, of new trades and of one that all record, beside a settler and a rewrite."""
    store = log.TradeStore(spark, str(tmp_path / "s"))
    store.append(_trades(spark, [_trade(100 + k) for k in range(4)]))
    done = store.read().withColumns({"outcome": F.lit("won"), "realized_pnl": F.lit(1.0)})

    def write(k):
        if k == 7:
            store.settle(done, "2024-05-02")
        elif k == 6:
            store.compact()
        else:
            store.append(_trades(spark, [_trade(k), _trade(50, recorded_at=f"{k}")]))

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(write, range(8)))
    rows = {r.horizon: r for r in store.read().collect()}
    assert sorted(rows) == sorted([*[f"h{k}" for k in range(6)], "h50", *[f"h{100 + k}" for k in range(4)]])
    assert rows["h50"].recorded_at == "0" and all(rows[f"h{100 + k}"].realized_pnl == 1.0 for k in range(4))
    store.compact()
    assert len(store.log.writes()) == 1 and store.read().count() == 11
    before = {p for p in (tmp_path / "s").rglob("*.parquet")}
    store.settle(done.limit(0), "2024-05-03")
    assert store.read().count() == 11 and before <= {p for p in (tmp_path / "s").rglob("*.parquet")}


def test_a_failed_write_is_not_seen(spark, tmp_path):
    store = log.TradeStore(spark, str(tmp_path / "s"))
    store.append(_trades(spark, [_trade(1)]))
    bad = _trades(spark, [_trade(2), _trade(3, date="2023-01-01")]).withColumn("outcome_label", F.when(F.col("horizon") == "h2", F.raise_error(F.lit("no"))).otherwise(F.col("outcome_label")))
    with pytest.raises(Exception, match="no"):
        store.append(bad)
    (tmp_path / "s/write=dead/month=2024-05").mkdir(parents=True)
    assert store.read().count() == 1


def test_a_batch_of_truths_writes_what_it_settles(spark, tmp_path):
    store = log.TradeStore(spark, str(tmp_path / "s"))
    store.append(_trades(spark, [_trade(k, date=f"2024-{k:02d}-01") for k in range(1, 10)]))
    truth = "city string, target_date string, is_final boolean, truth_label string, truth_value double"
    told = spark.createDataFrame([("S", "2024-03-01", True, "warm", None), ("S", "2024-04-01", False, "warm", None)], truth)
    told.write.parquet(str(tmp_path / "t"))
    specs = told.select("city", "target_date", F.lit(0).alias("pos"), F.lit(None).cast(f"array<{schemas.BIN}>").alias("outcome_bins"))
    settle_stream(spark.readStream.schema(truth).parquet(str(tmp_path / "t")), store, specs, "2024-12-01", str(tmp_path / "c")).awaitTermination()
    assert store.log.read().filter("event = 'settled'").count() == 1 and store.read().filter("outcome = 'won'").count() == 1
    assert files_scanned(store.log.read().filter("month in ('2024-03')")) == 2 < files_scanned(store.log.read())


def test_two_recording_streams_at_once(spark, tmp_path):
    store = log.TradeStore(spark, str(tmp_path / "s"))
    rows = signals(spark, [sig(horizon=f"h{k}", target_date="2999-01-01") for k in range(20)])
    rows.write.parquet(str(tmp_path / "in"))
    both = [record_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), store, datetime(2024, 1, 1), str(tmp_path / f"c{k}"), ["market_id"]) for k in range(2)]
    for q in both:
        q.awaitTermination()
    assert store.read().count() == 20


def test_keyed_settling_over_restarts(spark, tmp_path):
    """Truth after and before trades, not final first, a date still to come that a timer settles, a second truth that changes nothing."""
    at = lambda t: F.lit(t).cast("timestamp")
    names = ["recorded_at", "city_or_segment", "target_date", "horizon", "outcome_label", "direction", "gamma_price", "flat_stake", "fee_paid"]
    trade = lambda rows, t: _trades(spark, rows).select(*names).withColumn("at", at(t))
    told = lambda date, final, label, t: spark.createDataFrame([("S", date, final, label, None, None)], f"city string, target_date string, is_final boolean, truth_label string, truth_value double, outcome_bins array<{schemas.BIN}>").withColumn("at", at(t))
    kind = keyed.events(trade([_trade(1)], "2024-05-01"), told("x", True, "y", "2024-05-01")).schema
    store = log.TradeStore(spark, str(tmp_path / "s"), ["recorded_at"])

    def feed(*parts):
        for p in parts:
            p.select(*[F.col(f.name).cast(f.dataType) for f in kind]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in")) if set(p.columns) == set(kind.names) else p.unionByName(spark.createDataFrame([], kind), allowMissingColumns=True).select(*kind.names).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        keyed.settle_keyed_stream(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), store, str(tmp_path / "c")).awaitTermination()
        return {(r.recorded_at, r.outcome) for r in store.log.read().filter("event = 'settled'").collect()}

    ev = keyed.events
    assert not feed(ev(trade([_trade(1), _trade(2, date="2024-05-09")], "2024-05-01"), None), ev(None, told("2024-05-01", False, "warm", "2024-05-01")))
    assert feed(ev(None, told("2024-05-01", True, "warm", "2024-05-02")), ev(None, told("2024-05-09", True, "hot", "2024-05-02")), ev(trade([_trade(3)], "2024-05-03"), None)) == {("r1", "won"), ("r3", "won")}
    assert feed(ev(None, told("2024-05-01", True, "hot", "2024-05-03")), ev(trade([_trade(4), _trade(5, date="2024-05-09")], "2024-05-03"), None)) == {("r1", "won"), ("r3", "won"), ("r4", "won")}
    late = feed(ev(None, told("other", False, None, "2024-05-10")), ev(None, told("other", False, None, "2024-05-11")))
    assert late == {("r1", "won"), ("r3", "won"), ("r4", "won"), ("r2", "lost"), ("r5", "lost")}


def test_keyed_state_holds_arrays_of_trades(spark, tmp_path):
    """Trades of a key and batch are few elements of state, not one each; all come back as they were, NaN, microseconds and signs too."""
    n, when = 25_000, F.timestamp_micros(F.lit(1_714_500_000_000_001) + F.col("id"))
    t = spark.range(n).select(
        F.concat(F.lit("r"), "id").alias("recorded_at"), F.lit("S").alias("city_or_segment"), F.when(F.col("id") % 5 == 0, "2024-05-09").otherwise("2024-05-01").alias("target_date"), F.when(F.col("id") % 2 == 0, "warm").otherwise("hot").alias("outcome_label"),
        F.lit("yes").alias("direction"), (F.rand(1) / 3).alias("gamma_price"), F.when(F.col("id") % 3 == 0, F.lit(float("nan"))).when(F.col("id") % 3 == 1, 2.0).alias("flat_stake"), F.lit(0.0).alias("fee_paid"), when.alias("seen at"), F.when(F.col("id") % 2 == 0, 'a "b", \\ [{ü\n').alias("note"),
        F.array(F.col("id"), F.lit(None)).alias("marks"), F.to_date(F.lit("2024-02-29")).alias("day"), F.encode(F.col("id").cast("string"), "utf-8").alias("raw"), (F.col("id") / 7).cast("decimal(20,9)").alias("exact"), F.lit("2024-05-01 00:00:00").cast("timestamp").alias("at"),
    )
    told = spark.createDataFrame([("S", d, final, label, None, None) for d in ("2024-05-01", "2024-05-09") for final, label in ((False, "cold"), (True, "hot"), (True, "warm"))], f"city string, target_date string, is_final boolean, truth_label string, truth_value double, outcome_bins array<{schemas.BIN}>")
    kind = keyed.events(t, told.withColumn("at", F.lit("2024-05-02").cast("timestamp"))).schema

    def feed(rows):
        rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in kind]).write.mode("append").parquet(str(tmp_path / "in"))
        with keyed._state_in_rocks(spark):
            done = keyed.settled(spark.readStream.schema(kind).parquet(str(tmp_path / "in")))
            done.writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"), "parquet").awaitTermination()
        return spark.read.parquet(str(tmp_path / "out"))

    assert feed(keyed.events(t, told.limit(0).withColumn("at", F.lit(None).cast("timestamp")))).count() == 0
    assert spark.read.format("statestore").option("path", str(tmp_path / "c")).option("stateVarName", "waiting").load().count() <= 5
    early = feed(keyed.events(t.limit(0), told.withColumn("at", F.lit("2024-05-02").cast("timestamp"))))
    assert early.count() == n - n // 5 and early.filter("target_date = '2024-05-09'").count() == 0
    out = feed(keyed.events(t.limit(0), told.limit(1).withColumns({"is_final": F.lit(False), "at": F.lit("2024-05-10").cast("timestamp")})))
    assert {tuple(r) for r in out.groupBy("outcome_label", "outcome").count().collect()} == {("warm", "won", n // 2), ("hot", "lost", n // 2)}
    names = [f"`{c}`" for c in t.columns if c != "at"]
    got, want = out.select(*names), t.select(*names)
    assert dict(got.dtypes) == dict(want.dtypes) and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_a_look_at_ten_requests_reads_few_files(spark, tmp_path):
    table = listings.AnswerTable(spark, str(tmp_path / "a"), 60)
    t0 = datetime(2024, 1, 1)
    for part in range(3):
        table.put(spark.range(part * 1000, part * 1000 + 1000).select(F.concat(F.lit("r"), "id").alias("request"), F.lit("{}").alias("value")), t0)
    asked = [f"r{k}" for k in range(0, 2000, 400)] + ["none"] * 3
    rows = table.rows_of(asked)
    assert sorted(r.request for r in table.get(asked, t0).collect()) == sorted(asked[:5])
    assert files_scanned(rows) <= files_scanned(table.read()) / 2
    with pytest.raises(ValueError):
        table.get([str(k) for k in range(201)], t0)


def test_gate_without_segments_warns(spark):
    t = spark.createDataFrame([("S", 1.0)], "segment string, realized_pnl double")
    d = metrics.gate_decision(t, metrics.gate_segments(t, ["S"], 1).limit(0)).first()
    assert d.decision == "GO" and "nothing was checked" in d.warning
    assert metrics.gate_decision(t, metrics.gate_segments(t, ["S"], 1)).first().warning is None


def test_commands(spark, tmp_path, capsys):
    a = str(tmp_path / "artifacts")
    rows = [{"id": str(i), "question": f"Will {'F1' if i % 2 else 'rain'} happen {i}?"} for i in range(70)]
    listings.dump_pages(rows, str(tmp_path / "pages"), 100)
    assert cli.main(["scan-markets", "--pages", str(tmp_path / "none")]) == 1
    assert cli.main(["scan-markets", "--pages", str(tmp_path / "pages"), "--limit", "60"]) == 0
    assert len([x for x in capsys.readouterr().out.splitlines() if "happen" in x]) == 50
    signals_path = tmp_path / "signals.json"
    signals_path.write_text(json.dumps({"signals": [{"market_id": "m", "city_or_segment": "S", "target_date": "2999-01-01", "horizon": "morning_of", "outcome_label": "warm", "direction": "yes", "gamma_price": 0.4, "best_edge": 0.3}, {"market_id": "n", "city_or_segment": "T", "target_date": "2999-01-01", "horizon": "morning_of", "outcome_label": "warm", "direction": "yes", "gamma_price": 0.4, "best_edge": 0.3}]}))
    record = ["record-trades", "--artifacts", a, "--signals", str(signals_path)]
    assert cli.main(record) == 1
    train = spark.createDataFrame([(0.1, 0.0), (0.9, 1.0)] * 4, "feature_x double, label double")
    models.SparkForecaster("logistic_regression", maxIter=2).fit(train, ["feature_x"]).save(str(tmp_path / "model"))
    (tmp_path / "no.json").write_text(json.dumps({"decision": "NO_GO", "segment_results": [{"segment": "S", "passes": False, "reason": "missing"}]}))
    (tmp_path / "go.json").write_text(json.dumps({"decision": "GO", "segment_results": [{"segment": "S", "passes": True, "reason": "ok"}]}))
    promote = ["promote-champion", "--artifacts", a, "--model", str(tmp_path / "model"), "--gate"]
    assert cli.main([*promote, str(tmp_path / "none.json")]) == 1 and cli.main([*promote, str(tmp_path / "no.json")]) == 1
    assert "S missing" in capsys.readouterr().out
    assert cli.main([*promote, str(tmp_path / "go.json")]) == 0
    assert cli.main(record) == 0 and cli.main(record) == 0
    out = capsys.readouterr().out
    assert "recorded 1 trades" in out and "recorded 0 trades" in out
    spec = spark.createDataFrame([("S", "2999-01-01", 1, [("warm", None, None, True, True)], True, "warm", None)], "city string, target_date string, pos int, outcome_bins array<struct<label:string,lower:double,upper:double,lower_inclusive:boolean,upper_inclusive:boolean>>, is_final boolean, truth_label string, truth_value double")
    spec.write.parquet(str(tmp_path / "specs"))
    assert cli.main(["settle-trades", "--artifacts", a, "--specs", str(tmp_path / "specs"), "--today", "2999-02-01"]) == 0
    assert cli.main(["status", "--artifacts", a]) == 0
    out = capsys.readouterr().out
    assert "settled 1, pending 0" in out and "trades 1, open 0, settled 1" in out and "champion: champion" in out
    assert cli.main(["workspace", "w"]) == 2 and cli.main(["workspace", "w", "true"]) == 0


# steps from running sums, curves, wide frames, bins as a table, bitmaps


def test_linear_steps_equal_fits_from_scratch(spark):
    r = np.random.default_rng(3)
    rows = [(f"m{k}", f"2024-01-{1 + k // 12:02d}", "a", "a" if r.random() < 0.6 else "b", 0.5, float(x), None if k % 17 == 0 else float(z), float(2 * x)) for k, (x, z) in enumerate(r.normal(size=(240, 2)))]
    p = spark.createDataFrame(rows, "market_id string, decision_date string, outcome_label string, winning_label string, market_price double, feature_x double, feature_z double, feature_twice double")
    for link in ("identity", "logit"):
        for features in (["feature_x", "feature_z"], ["feature_x", "feature_twice"]):
            steps = {s.eval_date: s for s in backtest.linear_steps(p, 3, 20, features, link).collect()}
            assert len(steps) == 6
            at = [{"feature_x": 5, "feature_z": 6, "feature_twice": 7}[f] for f in features]
            for day, s in steps.items():
                own = [row for row in rows if row[1] < day]
                x = np.array([[1.0, *[row[i] or 0.0 for i in at]] for row in own])
                y = np.array([float(row[2] == row[3]) for row in own])
                want = np.linalg.lstsq(x, y, rcond=None)[0]
                if link == "logit":  # one step of Newton's method from the rate
                    q = y.mean()
                    start = np.array([np.log(q / (1 - q)), *[0.0] * len(features)])
                    want = start + np.linalg.lstsq(x * np.sqrt(q * (1 - q)), (y - q) / np.sqrt(q * (1 - q)), rcond=None)[0]
                assert s.train_rows == len(own) and np.allclose(x @ np.array(s.coef), x @ want, atol=1e-6)
    out = backtest.walk_forward_linear(p, 3, 20, ["outcome_label"], ["feature_x"], "logit")
    assert out.trades.count() == 6 * 12 and all(0 < t.predicted_prob < 1 for t in out.trades.collect())
    with pytest.raises(ValueError):
        backtest.linear_steps(p, 3, 20, link="probit")
    assert backtest.walk_forward_linear(p.limit(0), 3, 20, ["outcome_label"]).trades.count() == 0


def test_a_peak_of_one_trade_is_in_the_picture(spark, tmp_path):
    n = 5000
    pnl = [0.1 if k % 2 else -0.1 for k in range(n)]
    pnl[2500], pnl[2501] = 1000.0, -1000.0
    t = spark.createDataFrame([(f"2024-01-01T{k:06d}", "c", "d", "h", v) for k, v in enumerate(pnl)], "recorded_at string, city_or_segment string, target_date string, horizon string, realized_pnl double")
    points = report.curve_extremes(t).collect()
    curve = np.cumsum(pnl)
    assert max(p.cumulative_pnl for p in points) == pytest.approx(curve.max()) and len(points) <= 4 * report.COLUMNS
    by = {}
    for p in points:
        assert p.cumulative_pnl == pytest.approx(curve[p.rank])
        by.setdefault(p.column, []).append((p.rank, p.cumulative_pnl))
    assert len(by) == report.COLUMNS and all(min(v)[0] == min(k for k in range(n) if k * report.COLUMNS // n == c) for c, v in by.items())
    html = report.write_report(t.withColumns({c: F.lit(None).cast("double") for c in ("flat_stake", "edge_after_fee", "gamma_price")}).withColumns({c: F.lit(None).cast("string") for c in ("outcome_label", "outcome")}), str(tmp_path / "r.html")).read_text()
    line = html.split('points="')[1].split('"')[0].split()
    assert min(float(p.split(",")[1]) for p in line) == report.PAD
    assert report.svg([]) == "" and report.curve_extremes(t.limit(0)).count() == 0


@pytest.mark.parametrize("group", [None, "g"])
def test_medians_slide_over_chunks_and_groups(spark, group):
    r = np.random.default_rng(1)
    rows = [(k, None if k % 50 == 3 else "ab"[k % 2 if k < 500 else 0], None if k % 7 == 0 else float("nan") if k % 11 == 0 else float(v)) for k, v in enumerate(r.normal(size=900))]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    out = {x.id: x.m for x in ordering.sliding_medians(df.withColumn("v", F.when(~F.isnan("v"), F.col("v"))), {"m": ("v", 300)}, group, ["id"], 2, rows=310).collect()}
    assert len(out) == len(rows)
    for k, g, _ in rows:
        frame = [x[2] for x in rows if x[0] <= k and (group is None or x[1] == g)][-300:]
        frame = [v for v in frame if v is not None and v == v]
        want = float(np.median(frame)) if len(frame) >= 2 else None
        assert out[k] == pytest.approx(want) if want is not None else out[k] is None
    made = features.add_rolling_stats(df, ["v"], [300, 4], ["id"], ["median", "max"], group)
    assert {"v_roll300_median", "v_roll300_max", "v_roll4_median", "v_roll4_max"} <= set(made.columns) and made.count() == len(rows)


def test_bins_of_a_table_meet_by_equality(spark):
    r = random.Random(2)
    some = lambda: r.choice([None, None, float("nan"), *[float(r.randrange(-20, 20)) for _ in range(9)]])
    table = [(r.choice("xyz"), k, f"b{k}", some(), some(), r.random() < 0.5, r.random() < 0.5) for k in range(60)] + [("open", 1, "all", None, None, True, True), ("one", 1, "point", 3.0, 3.0, True, True), ("turned", 1, "none", 5.0, 1.0, True, True)]
    values = [(k, r.choice("xyz"), some()) for k in range(400)] + [(900 + i, g, v) for i, (g, v) in enumerate((g, v) for g in ("open", "one", "turned", "nokey") for v in (None, float("nan"), 3.0, 2.0, 9.0))]
    b = spark.createDataFrame(table, "g string, pos int, label string, lower double, upper double, lower_inclusive boolean, upper_inclusive boolean")
    out = bins.first_bins(spark.createDataFrame(values, "id int, g string, value double"), b, ["g"], widths=5)
    listed = b.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("pos", F.struct("label", "lower", "upper", "lower_inclusive", "upper_inclusive").alias("b")))).alias("l"))
    want = spark.createDataFrame(values, "id int, g string, value double").join(listed, "g", "left").select("id", bins.winning_label(F.col("value"), F.transform("l", lambda x: x["b"])).alias("w"))
    assert {(x.id, x.winner) for x in out.collect()} == {(x.id, x.w) for x in want.collect()} and out.count() == len(values)
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_day_more_reads_only_that_day(spark, tmp_path):
    rows = [(f"2024-01-{1 + k % 5:02d}", None if k % 40 == 0 else f"m{k * k % 97}") for k in range(500)]
    p = spark.createDataFrame(rows, "decision_date string, market_id string")
    numbers, got = None, str(tmp_path / "days")
    for day in ("2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04", "2024-01-05"):
        own = p.filter(F.col("decision_date") == day)
        numbers = ordering.written(metrics.number_keys(own.select(F.col("market_id").alias("key")), numbers))
        metrics.daily_profile(own, numbers).write.mode("append").parquet(got)
    assert numbers.count() == numbers.select("num").distinct().count() == len({m for _, m in rows if m})
    assert metrics.profile_of_days(spark.read.parquet(got)).first() == metrics.panel_profile(p).select("n_rows", "n_dates", "n_markets").first()
    assert tuple(metrics.profile_of_days(spark.read.parquet(got).limit(0)).first()) == (0, 0, 0)


def test_quantiles_of_few_and_equal_values(spark):
    for values in ([], [1.0], [2.0, 2.0, 2.0], [1.0, 2.0], [None, 3.0, 1.0, 2.0], list(map(float, range(101)))):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        got = ordering.quantiles(df, {"v": F.col("v")}, [0.25, 0.75, 1.0]).first().v
        have = [v for v in values if v is not None]
        want = np.quantile(have, [0.25, 0.75, 1.0]).tolist() if have else [None] * 3
        assert got == pytest.approx(want) if have else got == want


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_isotonic_blocks_merge_over_parts(spark, parts):
    r = random.Random(7)
    rows = [(round(r.random(), 2), float(r.random() < 0.5)) for _ in range(300)] + [(0.5, 1.0)] * 100 + [(None, 1.0), (float("nan"), 0.0), (0.3, None)]
    df = spark.createDataFrame(rows, "y_prob double, y_true double")
    told = {}
    for p, y in rows[:-3]:
        n, t = told.get(p, (0, 0.0))
        told[p] = (n + 1, t + y)
    xs = sorted(told)
    mean = lambda a, b: sum(told[x][1] for x in xs[a : b + 1]) / sum(told[x][0] for x in xs[a : b + 1])
    want = {x: max(min(mean(a, b) for b in range(k, len(xs))) for a in range(k + 1)) for k, x in enumerate(xs)}
    cal = models.IsotonicCalibrator().fit(df, parts=parts)
    for most in (1_000_000, 2):
        got = {x.y_prob: x.calibrated for x in cal.transform(df, most_knots=most).collect() if x.y_prob in want}
        assert got == pytest.approx(want)
        assert {x.calibrated for x in cal.transform(df.filter("y_prob is null or isnan(y_prob)"), most_knots=most).collect()} == {None}
    assert cal.blocks.count() == len(set(want.values())) and cal.blocks.agg({"n": "sum"}).first()[0] == 400


def test_isotonic_values_between_blocks(spark, tmp_path):
    made = [(k / 200, float(k % 3 == 0 or k > 150)) for k in range(0, 200, 2)]
    cal = models.IsotonicCalibrator().fit(spark.createDataFrame(made, "y_prob double, y_true double"))
    cal.save(str(tmp_path / "c"))
    asked = spark.createDataFrame([(k / 317 - 0.1,) for k in range(400)], "y_prob double")
    one = [x.calibrated for x in models.IsotonicCalibrator.load(str(tmp_path / "c")).transform(asked).orderBy("y_prob").collect()]
    two = [x.calibrated for x in cal.transform(asked, most_knots=3).orderBy("y_prob").collect()]
    assert one == pytest.approx(two) and one == sorted(one) and len(set(one)) > 3
    with pytest.raises(ValueError):
        models.IsotonicCalibrator().fit(asked.limit(0).withColumn("y_true", F.lit(1.0)))


def test_a_poll_reads_what_is_due(spark, tmp_path):
    folder, check = str(tmp_path / "pages"), str(tmp_path / "check")
    cache = listings.AnswerTable(spark, str(tmp_path / "answers"), 3600)
    rows = [{"id": f"m{k}", "question": f"q{k}"} for k in range(7)]
    poll = lambda at: polling.poll_pages(spark, folder, cache, check, at, 2).awaitTermination()
    reads = lambda: Counter(x.request.rsplit("#", 1)[1] for x in cache.read().collect())
    poll(datetime(2024, 1, 1, 0, 1))
    assert reads() == {}
    listings.dump_pages(rows[:6], folder, 2)
    for minute in (2, 3):  # each call is a stream started again
        poll(datetime(2024, 1, 1, 0, minute))
        assert reads() == {"0": 1, "1": 1, "2": 1}
    (tmp_path / "pages" / "page-000003.ndjson").write_text("\n")
    poll(datetime(2024, 1, 1, 0, 59))
    assert reads() == {"0": 1, "1": 1, "2": 1, "3": 1}
    at = datetime(2024, 1, 1, 0, 59, 30)
    assert {x.body for x in polling.polled_markets(folder, cache, at, 2).collect()} == {json.dumps(r) for r in rows[:6]}
    assert polling.polled_markets(folder, cache, datetime(2024, 1, 1, 1, 0), 2).count() == 0
    poll(datetime(2024, 1, 1, 1, 0))
    assert reads() == {"0": 2, "1": 2, "2": 2, "3": 2}
    assert polling.polled_markets(folder, cache, datetime(2024, 1, 1, 1, 30), 2).count() == 6


@pytest.mark.parametrize("kind", ["gradient_boosting", "random_forest", "logistic_regression"])
def test_models_of_three_classes(spark, tmp_path, kind):
    rows = [(float(k % 30), float(k % 30 // 10)) for k in range(300)]
    df = spark.createDataFrame(rows, "feature_x double, label double")
    few = {"gradient_boosting": {"maxIter": 3, "maxDepth": 2}, "random_forest": {"numTrees": 5}, "logistic_regression": {"maxIter": 50, "C": 1e6}}[kind]
    m = models.SparkForecaster(kind, **few).fit(df, ["feature_x"])
    m.save(str(tmp_path / "m"))
    back = models.SparkForecaster.load(str(tmp_path / "m"))
    got = back.class_probabilities(df).collect()
    assert all(len(r.probabilities) == 3 and sum(r.probabilities) == pytest.approx(1) and min(r.probabilities) >= 0 for r in got)
    right = sum(max(range(3), key=r.probabilities.__getitem__) == r.label for r in got)
    assert right >= (300 if kind == "gradient_boosting" else 270)
    assert sorted(r.predicted_prob for r in back.predict_proba(df).collect()) == pytest.approx(sorted(r.probabilities[1] for r in got))


def test_long_groups_are_counted(spark, monkeypatch):
    rows = [(i, "aab"[i % 3] if i % 9 else None, float(i * 37 % 101) if i % 5 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, g string, v double").repartition(4)
    lag = lambda **k: sorted(features.add_lags(df, ["v"], [2, -1], "i", "g", **k).collect(), key=lambda r: r.i)
    roll = lambda **k: sorted(features.add_rolling_stats(df, ["v"], [4], "i", ["mean", "max"], "g", **k).collect(), key=lambda r: r.i)
    curve = lambda: sorted(metrics.equity_curve(df.withColumn("realized_pnl", F.col("v")).withColumn("day", F.expr("i div 100")), ["i"], "day").select("i", F.round("cumulative_pnl", 6)).collect())
    assert not ordering.has_long_group(df, "g") and ordering.has_long_group(df, "g", 100)
    want = lag(large_groups=False), roll(large_groups=False), curve()
    assert want[0] == lag() and want[1] == roll()
    monkeypatch.setattr(ordering, "PART_ROWS", 40)
    assert ordering.has_long_group(df, "g")
    assert "__chunk" in features.add_lags(df, ["v"], [2], "i", "g")._jdf.queryExecution().optimizedPlan().toString()
    assert want == (lag(), roll(), curve())


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"market_id": "m1", "gamma_price": 0.5}\n\n{"market_id": null}\n')
    rows = tables.read_signals_lines(spark, str(tmp_path)).select("market_id", "gamma_price").collect()
    assert sorted(map(tuple, rows), key=str) == [("m1", 0.5), (None, None)]
    assert tables.read_trades_lines(spark, str(tmp_path / "none")).count() == 0
    for bad in ('{"market_id": "m2", "other": 1}', "no json", "[1]", '{"market_id": '):
        (tmp_path / "b.json").write_text(bad + "\n")
        with pytest.raises(Exception, match="unknown keys: other|no JSON object|MALFORMED"):
            tables.read_signals_lines(spark, str(tmp_path)).collect()


def test_feature_profile(spark):
    df = spark.createDataFrame([(1.0, None, "x"), (float("nan"), None, "y"), (3.0, None, "z")], "feature_a double, feature_b int, other string")
    assert [tuple(r) for r in backtest.feature_profile(df).orderBy("name").collect()] == [("feature_a", 2, 1, 2.0, 1.0, 3.0), ("feature_b", 0, 3, None, None, None)]
    assert backtest.feature_profile(df.select("other")).count() == 0
    assert backtest.feature_profile(df.limit(0)).filter("n = 0 and missing = 0").count() == 2


@pytest.mark.parametrize("read, name", [(tables.read_trades_json, "trades"), (tables.read_signals_json, "signals")])
def test_documents_of_a_large_group_are_bounded(spark, tmp_path, monkeypatch, read, name):
    monkeypatch.setattr(flows, "DOCUMENT_ROWS", 100, raising=False)
    rows = spark.range(3000).select(F.col("id").cast("string").alias("target_date"), F.when(F.col("id") < 2990, 1).otherwise(2).alias("region"))
    flows._documents(rows, name, "region", str(tmp_path / "d"))
    sizes = [r.n for r in spark.read.option("recursiveFileLookup", "true").text(str(tmp_path / "d"), wholetext=True).select(F.size(F.json_object_keys("value")).alias("keys"), F.size(F.split("value", "target_date")).alias("n")).collect()]
    assert len(sizes) >= 30 and max(sizes) <= 200
    assert {r.target_date for r in read(spark, str(tmp_path / "d")).collect()} == {str(k) for k in range(3000)}
    flows._documents(rows.limit(0), name, "region", str(tmp_path / "none"))
    assert read(spark, str(tmp_path / "none")).count() == 0


def test_no_number_meets_all_the_bins_that_hold_it(spark):
    """Bins of wide, overlapping runs: before, each number was compared with a list of all bins of its bucket."""
    b = spark.range(3000).select((F.col("id") % 2).alias("g"), (-F.col("id")).alias("pos"), F.concat(F.lit("b"), "id").alias("label"), F.when(F.col("id") % 3 != 0, F.col("id") * 1.0).alias("lower"), (F.col("id") + 1500.0).alias("upper"), F.lit(True).alias("lower_inclusive"), F.lit(False).alias("upper_inclusive"))
    v = spark.range(6000).select("id", (F.col("id") % 3).alias("g"), (F.col("id") * 1.0).alias("value"))
    out = bins.first_bins(v, b, ["g"], widths=7)
    assert "collect_list" not in out._jdf.queryExecution().toString()
    got = {r.id: r.winner for r in out.collect()}
    assert len(got) == 6000
    for k in range(0, 6000, 7):
        held = [x for x in range(2999, -1, -1) if x % 2 == k % 3 and (x % 3 == 0 or x <= k) and k < x + 1500]
        assert got[k] == (f"b{held[0]}" if held else None), k


def test_a_task_of_medians_holds_a_short_chunk(spark, tmp_path, monkeypatch):
    """Rows that pandas gets at once grow with the frame, not with the table or its groups."""
    seen = str(tmp_path / "seen")
    df = spark.range(450_000).select("id", F.lit("a").alias("g"), (F.col("id") * 7919 % 1000).cast("double").alias("v"))
    apply = type(df.groupBy("g")).applyInPandas

    def counted(self, fn, schema):
        def told(pdf):
            with open(f"{seen}-{uuid.uuid4().hex}", "w") as f:
                f.write(str(len(pdf)))
            return fn(pdf)

        return apply(self, told, schema)

    monkeypatch.setattr(type(df.groupBy("g")), "applyInPandas", counted)
    out = features.add_rolling_stats(df, ["v"], [1000], ["id"], ["median"], "g")
    assert out.filter("v_roll1000_median is null").count() == 0
    sizes = [int(p.read_text()) for p in tmp_path.glob("seen-*")]
    assert sum(sizes) >= 450_000 and max(sizes) <= 101_000
    last = out.filter("id in (450, 100500, 449999)").select("id", "v_roll1000_median").collect()
    assert {r.id: r.v_roll1000_median for r in last} == {k: float(np.median([x * 7919 % 1000 for x in range(max(0, k - 999), k + 1)])) for k in (450, 100500, 449999)}
