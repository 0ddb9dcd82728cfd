"""Queries on sources and sinks, listings, plugins, answers, streams and calibration."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augury.functions import bins
from augury.functions import scalars as S
from augury.operators import backtest, features, markets, metrics, models, ordering, report, trading
from augury.plans.queries import GATE_SQL, SCORE_SQL, SETTLE_SQL, WALK_SQL, _gate, _listed, _QSQL, _scored, _settled, query, r6, trades_to_settle, walk
from augury.plans.views import PANEL_SQL, SIGNALS_SQL, panel, signals, specs, table
from augury.plugins.base import PluginRegistry
from augury.plugins.families import RacePlugin, TemperaturePlugin
from augury.schemas import SIGNAL, TRADE, struct
from augury.sources import files, listings, log, polling, tables
from augury.streaming import keyed
from augury.streaming.record import settle_stream

# files


@query("q47_panel_parquet_scan", f"WITH {PANEL_SQL} SELECT event_id, market_id, segment, round(market_price, 6) AS market_price, round(feature_value, 6) AS feature_value FROM panel")
def q47(spark, sf_dir):
    path = files.scratch(spark) + "/panel.parquet"
    panel(spark, sf_dir).write.parquet(path)
    out = tables.read_panel(spark, path, ["feature_value"])
    return out.select(*[c for c in out.columns if c in ("event_id", "market_id", "segment") or c.startswith("feature_")], "market_price").withColumns({c: F.round(c, 6) for c in ("market_price", "feature_value")})


@query("q47_panel_csv_scan", f"WITH {PANEL_SQL} SELECT event_id, decision_date, outcome_label, winning_label, round(market_price, 6) AS market_price, round(feature_value, 6) AS feature_value FROM panel")
def q47c(spark, sf_dir):
    path = files.scratch(spark) + "/panel.csv"
    panel(spark, sf_dir).select("event_id", "decision_date", "outcome_label", "winning_label", "market_price", "feature_value").write.csv(path, header=True)
    out = tables.read_panel(spark, path)
    return out.select(F.col("event_id").cast("long").alias("event_id"), "decision_date", "outcome_label", "winning_label", *r6("market_price", "feature_value"))


#: Rows of a JSON document, about; a reader holds one as a whole.
DOCUMENT_ROWS = 10_000


def _documents(rows: DataFrame, name: str, by: str, path: str) -> None:
    """JSON documents {name: [...]}, a file each, of the rows of a value of ``by``; more rows make more documents."""
    n, most = rows.groupBy(by).count().agg(F.sum("count"), F.max("count")).first()
    own = [c for c in rows.columns if c != by]
    dealt = rows.withColumn("document", F.pmod(F.xxhash64(*own), F.lit(-(-(most or 1) // DOCUMENT_ROWS)))).repartition(-(-(n or 1) // DOCUMENT_ROWS), by, "document")
    one = dealt.groupBy(by, "document").agg(F.to_json(F.struct(F.collect_list(F.struct(*own)).alias(name))).alias("value"))
    one.write.partitionBy(by, "document").text(path)


@query("q48_trades_json_scan", f"WITH {SIGNALS_SQL} SELECT market_id AS recorded_at, city_or_segment, target_date, direction, round(gamma_price, 6) AS gamma_price, CASE WHEN o_orderkey % 3 = 0 THEN 'won' END AS outcome, NULL::DOUBLE AS realized_pnl FROM signals")
def q48(spark, sf_dir):
    path = files.scratch(spark) + "/trades"
    s = signals(spark, sf_dir)
    _documents(s.select(F.col("market_id").alias("recorded_at"), "city_or_segment", "target_date", "direction", "gamma_price", F.when(F.col("o_orderkey") % 3 == 0, "won").alias("outcome"), F.col("n_regionkey").alias("region")), "trades", "region", path)
    return tables.read_trades_json(spark, path).select("recorded_at", "city_or_segment", "target_date", "direction", *r6("gamma_price"), "outcome", "realized_pnl")


@query("q48_signals_json_scan", f"WITH {SIGNALS_SQL} SELECT market_id, city_or_segment, target_date, horizon, outcome_label, direction, round(gamma_price, 6) AS gamma_price, round(model_prob, 6) AS model_prob, round(best_edge, 6) AS best_edge, NULL::VARCHAR AS question FROM signals")
def q48s(spark, sf_dir):
    path = files.scratch(spark) + "/signals"
    known = [f.name for f in struct(SIGNAL)]
    s = signals(spark, sf_dir)
    _documents(s.select(*[c for c in s.columns if c in known], F.col("n_regionkey").alias("region")), "signals", "region", path)
    return tables.read_signals_json(spark, path).select("market_id", "city_or_segment", "target_date", "horizon", "outcome_label", "direction", *r6("gamma_price", "model_prob", "best_edge"), "question")


@query("q48_json_lines_scan", f"WITH {SIGNALS_SQL} SELECT market_id, city_or_segment, target_date, horizon, round(gamma_price, 6) AS gamma_price, CASE WHEN o_orderkey % 2 = 0 THEN round(best_edge, 6) END AS best_edge FROM signals")
def q48l(spark, sf_dir):
    path = files.scratch(spark) + "/signals"
    s = signals(spark, sf_dir)
    s.select("market_id", "city_or_segment", "target_date", "horizon", "gamma_price", F.when(F.col("o_orderkey") % 2 == 0, F.col("best_edge")).alias("best_edge")).write.json(path)
    return tables.read_signals_lines(spark, path).select("market_id", "city_or_segment", "target_date", "horizon", *r6("gamma_price", "best_edge"))


@query("q49_gate_json_scan", GATE_SQL + "SELECT segment, num_trades, round(total_pnl, 4) AS total_pnl, reason = 'ok' AS passes, reason FROM gate")
def q49(spark, sf_dir):
    trades, segments = _gate(spark, sf_dir)
    path = files.scratch(spark) + "/gate.json"
    files.write_text(spark, path, json.dumps(models.gate_to_dict(segments, metrics.gate_decision(trades, segments))))
    rows = tables.read_gate_json(path, spark)["segment_results"]
    out = spark.createDataFrame([(r["segment"], r["num_trades"], float(r["total_pnl"]), r["passes"], r["reason"]) for r in rows], "segment string, num_trades long, total_pnl double, passes boolean, reason string")
    return out.withColumn("total_pnl", F.round("total_pnl", 4))


@query("q50_run_summary_json", WALK_SQL + "SELECT count(*) AS total_trades, round(sum(realized_pnl), 4) AS total_pnl, round(avg((realized_pnl > 0)::INT), 6) AS hit_rate, round(avg(edge), 6) AS avg_edge, (SELECT count(DISTINCT eval_date) FROM scored) AS steps FROM trades")
def q50(spark, sf_dir):
    r = walk(spark, sf_dir)
    path = files.scratch(spark) + "/metrics.json"
    files.write_text(spark, path, json.dumps(metrics.run_summary(r.trades, r.steps).first().asDict()))
    out = spark.read.schema("total_trades long, total_pnl double, hit_rate double, avg_edge double, steps long").json(path)
    return out.select("total_trades", F.round("total_pnl", 4).alias("total_pnl"), *r6("hit_rate", "avg_edge"), "steps")


@query("q51_champion_segments", WALK_SQL + """, passed AS (SELECT segment FROM trades WHERE segment IN ('S0', 'S3', 'S5') GROUP BY segment HAVING count(*) >= 1 AND sum(realized_pnl) >= -1e9)
SELECT segment, feature_hour, count(*) AS n, CASE WHEN feature_hour >= 12 THEN 1.0 ELSE 0.0 END::DOUBLE AS predicted_prob FROM panel SEMI JOIN passed USING (segment) GROUP BY segment, feature_hour""")
def q51(spark, sf_dir):
    """A tree of one split, which hours decide, fitted, published with its gate, read back and asked about the allowed segments."""
    p = panel(spark, sf_dir)
    tree = DecisionTreeClassifier(maxDepth=1, maxBins=32)
    m = models.SparkForecaster(tree).fit(p.withColumn("label", (F.col("feature_hour") >= 12).cast("double")), ["feature_hour"])
    trades = walk(spark, sf_dir).trades
    segments = metrics.gate_segments(trades, ["S0", "S3", "S5"], min_trades=1, min_pnl=-1e9)
    folder = files.scratch(spark)
    models.Champion.publish(folder, m, models.gate_to_dict(segments, metrics.gate_decision(trades, segments)), "weather_tmax")
    back = models.Champion.load(f"{folder}/champion.json")
    scored = back.load_model().predict_proba(p.filter(F.col("segment").isin(sorted(back.allowed_segments()))))
    return scored.groupBy("segment", "feature_hour").agg(F.count("*").alias("n"), F.avg("predicted_prob").alias("predicted_prob"))


@query("q77_boosted_classes", f"WITH {PANEL_SQL} SELECT segment, feature_hour, count(*) AS n, floor(feature_hour / 8)::BIGINT AS class FROM panel GROUP BY segment, feature_hour")
def q77(spark, sf_dir):
    """Boosted trees of three classes, which hours decide, fitted to the whole panel, saved and read back: the likeliest class."""
    p, path = panel(spark, sf_dir), files.scratch(spark)
    models.BoostedForecaster(maxIter=3, maxDepth=2).fit(p.withColumn("label", F.floor(F.col("feature_hour") / 8).cast("double")), ["feature_hour"]).save(path)
    scored = models.SparkForecaster.load(path).class_probabilities(p)
    best = F.array_position("probabilities", F.array_max("probabilities")) - 1
    return scored.groupBy("segment", "feature_hour", best.alias("class")).agg(F.count("*").alias("n"))


# listings


def _dump(spark: SparkSession, sf_dir: str) -> str:
    """The nations' listings as pages of ten: nations are 25, whatever the scale."""
    rows = [{k: v for k, v in r.asDict().items() if v is not None and k != "n_nationkey"} | {"id": f"m{r.n_nationkey}"} for r in _listed(spark, sf_dir).orderBy("n_nationkey").collect()]
    folder = files.scratch(spark) + "/pages"
    listings.dump_pages(rows, folder, 10)
    return folder


@query("q52_scan_pages", _QSQL + "SELECT n_nationkey // 10 AS page, n_nationkey % 10 AS pos, 'm' || n_nationkey AS id FROM q WHERE n_nationkey < 20 AND contains(lower(question), 'rain')")
def q52(spark, sf_dir):
    found = listings.fetch_all(listings.read_pages(spark, _dump(spark, sf_dir)), "RAIN", page_size=10, max_results=20)
    return found.select(F.col("page").cast("long").alias("page"), F.col("pos").cast("long").alias("pos"), F.get_json_object("body", "$.id").alias("id"))


_INFO_SQL = (
    _QSQL
    + r""", l AS (SELECT *, CASE WHEN n_nationkey % 2 = 0 THEN 'wunderground' ELSE '' END AS description, CASE WHEN n_nationkey % 4 IN (0, 2) THEN '°C' ELSE '' END AS outcomes FROM q)
SELECT 'm' || n_nationkey AS market_id, n_name AS city, strftime(coalesce(try_strptime(day || ' 2023', '%B %d %Y'), try_strptime(day || ' 2023', '%b %d %Y')), '%Y-%m-%d') AS target_date, 'C' AS unit, 2 AS n_labels, true AS active
FROM (SELECT *, 'NATION_' || n_nationkey AS n_name, (['May','Sep','December','Feb'])[1 + n_nationkey % 4] || ' ' || (n_nationkey + 1) AS day FROM l) WHERE regexp_matches(question, '(?i)highest temperature in (.+) on (.+?)\?') AND description = 'wunderground' AND outcomes = '°C'"""
)


@query("q53_temperature_scan_cached", _INFO_SQL)
def q53(spark, sf_dir):
    """The scan twice with a table of answers: the second one reads what the first has kept."""
    folder = _dump(spark, sf_dir)
    cache = listings.AnswerTable(spark, files.scratch(spark), 3600)
    at = datetime(2024, 1, 1)
    listings.scan_temperature_markets(spark, folder, 2023, 10, cache, at)
    out = listings.scan_temperature_markets(spark, folder, 2023, 10, cache, at + timedelta(minutes=5))
    return out.select("market_id", "city", "target_date", "unit", F.size("outcome_labels").alias("n_labels"), "active")


@query("q76_polled_pages", "SELECT 'm' || p_partkey AS id, p_partkey % 40 AS page, p_name AS question, 1 + (p_partkey % 40 < 20)::BIGINT AS reads FROM part")
def q76(spark, sf_dir):
    """Parts as pages that come in two halves: a stream polls after each, and once more when the first round is over and half the pages have gone."""
    folder, root = files.scratch(spark) + "/pages", files.scratch(spark)
    cache = listings.AnswerTable(spark, f"{root}/answers", 3600)
    k = F.col("p_partkey")
    page = (k % 40).cast("int")
    body = table(spark, sf_dir, "part").select(page.alias("page"), k, F.to_json(F.struct(F.concat(F.lit("m"), k.cast("string")).alias("id"), F.col("p_name").alias("question"))).alias("body"))
    for half, at in ((page < 20, datetime(2024, 1, 1, 0, 10)), (page >= 20, datetime(2024, 1, 1, 0, 20)), (None, datetime(2024, 1, 1, 0, 40))):
        if half is not None:
            listings.write_dump(body.filter(half), folder)
        polling.poll_pages(spark, folder, cache, f"{root}/stream", at).awaitTermination()
    listings.remove_pages(spark, folder, 20)
    polling.poll_pages(spark, folder, cache, f"{root}/stream", datetime(2024, 1, 1, 1, 5)).awaitTermination()
    request = F.substring_index("request", "#", -1).cast("long")
    reads = cache.read().groupBy(request.alias("page")).agg(F.count("*").alias("reads"))
    known = cache.read().select(request.alias("page"), "value").distinct()
    found = known.select("page", F.explode(F.from_json("value", "array<string>")).alias("body")).join(reads, "page")
    return found.select(F.get_json_object("body", "$.id").alias("id"), "page", F.get_json_object("body", "$.question").alias("question"), "reads")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw listings from parts: canonical ones with JSON lists, older ones with tokens, races, and others."""
    k = F.col("p_partkey")
    n = k.cast("string")
    day = (k % 28 + 1).cast("string")
    token = lambda a, b: F.struct(F.lit(a).alias("outcome"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("name"), b.alias("price"))
    null = F.lit(None).cast("string")
    question = (
        F.when(k % 4 == 0, F.concat(F.lit("Who wins the Grand Prix "), n, F.lit("?")))
        .when(k % 4 == 1, F.concat(F.lit("Highest temperature in City"), (k % 50).cast("string"), F.lit(", Land on May "), day, F.lit("?")))
        .otherwise(F.concat(F.lit("Highest temperature in City"), (k % 50).cast("string"), F.lit(" on May "), day))
    )
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(k % 7 != 0, F.concat(F.lit("m"), n)).alias("id"), F.concat(F.lit("x"), n).alias("market_id"), null.alias("conditionId"), F.when(k % 3 != 0, F.concat(F.lit("s"), n)).alias("slug"),
        question.alias("question"), null.alias("description"), F.when(k % 6 != 0, "2024-06-01").alias("endDate"), F.lit("2024-07-01").alias("close_time"), F.lit(None).cast("boolean").alias("active"),
        F.when(k % 5 != 0, F.when(k % 2 == 0, '["10-20°C", ">20°C", "35°C"]').otherwise('["50-60°F", ">60°F"]')).alias("outcomes"),
        F.when(k % 3 == 0, '["0.2", "0.5"]').when(k % 3 == 1, '["0.2", "bad"]').alias("outcomePrices"), F.lit('["t1", "t2"]').alias("clobTokenIds"),
        F.array(token("15-25°C", F.lit("0.4")), token("no number", F.lit("x"))).alias("tokens"), F.lit("Fallback").alias("city"), F.lit("2024-05-09").alias("target_date"), null.alias("timezone"),
        F.when(k % 8 == 0, "monaco").alias("gp"), null.alias("market_type"),
    )


_RAW_SQL = """raw AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 <> 0 THEN 'm' || p_partkey ELSE 'x' || p_partkey END AS market_id, CASE WHEN p_partkey % 3 <> 0 THEN 's' || p_partkey WHEN p_partkey % 7 <> 0 THEN 'm' || p_partkey ELSE 'x' || p_partkey END AS slug,
  p_partkey % 5 <> 0 AS canonical, p_partkey % 4 = 0 AS race, p_partkey % 2 = 0 AS celsius, CASE WHEN p_partkey % 6 <> 0 THEN '2024-06-01' ELSE '2024-07-01' END AS close_time,
  CASE WHEN p_partkey % 4 = 1 THEN 'City' || (p_partkey % 50) || ', Land' WHEN p_partkey % 4 = 0 THEN 'Fallback' ELSE 'City' || (p_partkey % 50) END AS city,
  '2024-05-' || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') AS day FROM part)"""


@query(
    "q54_temperature_specs",
    f"""WITH {_RAW_SQL} SELECT k AS p_partkey, market_id, slug, close_time, city, day AS target_date, CASE WHEN NOT canonical OR celsius THEN 'C' ELSE 'F' END AS unit, CASE WHEN NOT canonical THEN 2 WHEN celsius THEN 3 ELSE 2 END AS n_bins,
  CASE WHEN NOT canonical THEN '15-25°C' WHEN celsius THEN '10-20°C' ELSE '50-60°F' END AS label, CASE WHEN NOT canonical THEN 15 WHEN celsius THEN 10 ELSE 50 END::DOUBLE AS lower, CASE WHEN NOT canonical THEN 25 WHEN celsius THEN 20 ELSE 60 END::DOUBLE AS upper,
  CASE WHEN NOT canonical THEN 0.4 WHEN k % 3 = 0 THEN 0.2 ELSE 0.5 END::DOUBLE AS first_price, 0.5::DOUBLE AS market_price FROM raw WHERE NOT race""",
)
def q54(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    out = TemperaturePlugin(year=2024).discover_markets(raw.filter("p_partkey % 4 <> 0"))
    b = F.get("outcome_bins", F.lit(0))
    return out.select(
        F.regexp_extract("market_id", "[0-9]+", 0).cast("long").alias("p_partkey"), "market_id", "slug", "close_time", "city", "target_date", "unit", F.size("outcome_bins").alias("n_bins"), b["label"].alias("label"), b["lower"].alias("lower"), b["upper"].alias("upper"),
        F.get("outcome_schema", F.lit(0))["price"].alias("first_price"), "market_price",
    )


@query("q54_written_years", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 2015 + p_partkey % 7 ELSE 2024 END || '-' || lpad((1 + p_partkey % 12)::VARCHAR, 2, '0') || '-' || lpad((1 + p_partkey % 28)::VARCHAR, 2, '0') AS target_date,
  '2024' || '-' || lpad((1 + p_partkey % 12)::VARCHAR, 2, '0') || '-' || lpad((1 + p_partkey % 28)::VARCHAR, 2, '0') AS overwritten FROM part""")
def q54y(spark, sf_dir):
    """A year in a question wins over the year given, or is overwritten, as asked."""
    k = F.col("p_partkey")
    month = F.get(F.array(*[F.lit(m) for m in "January February March April May June July August September October November December".split()]), (k % 12).cast("int"))
    day = F.concat(month, F.lit(" "), (k % 28 + 1).cast("string"), F.when(k % 3 == 0, F.concat(F.lit(", "), (k % 7 + 2015).cast("string"))).otherwise(""))
    q = F.concat(F.lit("Highest temperature in Town on "), day, F.lit("?")).alias("question")
    null = [F.lit(None).cast("string").alias(c) for c in ("conditionId", "slug", "outcomes", "outcomePrices", "clobTokenIds", "endDate")]
    raw = table(spark, sf_dir, "part").select(k.cast("string").alias("id"), q, *null, F.lit(None).cast("boolean").alias("active"))
    kept, old = markets.temperature_infos(raw, 2024, keep_year=True), markets.temperature_infos(raw, 2024)
    return kept.join(old.select("market_id", F.col("target_date").alias("overwritten")), "market_id").select(F.col("market_id").cast("long").alias("p_partkey"), "target_date", "overwritten")


@query(
    "q55_legacy_specs",
    f"WITH {_RAW_SQL} SELECT k AS p_partkey, market_id, slug, CASE WHEN k % 4 = 1 OR race THEN 'Fallback' ELSE city END AS city, '2024-05-09' AS target_date, 'UTC' AS timezone, 2 AS n_bins, 15::DOUBLE AS lower, 25::DOUBLE AS upper, 'range' AS market_family FROM raw",
)
def q55(spark, sf_dir):
    out = markets.legacy_temperature_specs(_raw(spark, sf_dir))
    b = F.get("outcome_bins", F.lit(0))
    return out.select(F.regexp_extract("market_id", "[0-9]+", 0).cast("long").alias("p_partkey"), "market_id", "slug", "city", "target_date", "timezone", F.size("outcome_bins").alias("n_bins"), b["lower"].alias("lower"), b["upper"].alias("upper"), "market_family")


@query(
    "q56_race_specs",
    "SELECT CASE WHEN p_partkey % 7 <> 0 THEN 'm' || p_partkey ELSE '' END AS market_id, CASE WHEN p_partkey % 3 <> 0 THEN 's' || p_partkey ELSE '' END AS slug, 'Who wins the Grand Prix ' || p_partkey || '?' AS question, CASE WHEN p_partkey % 8 = 0 THEN 'monaco' ELSE '' END AS gp, 'race_winner' AS market_type, 'categorical' AS market_family, 2 AS n_bins, '15-25°C' AS label, NULL::DOUBLE AS lower FROM part WHERE p_partkey % 4 = 0",
)
def q56(spark, sf_dir):
    out = RacePlugin().discover_markets(_raw(spark, sf_dir))
    b = F.get("outcome_bins", F.lit(0))
    return out.select("market_id", "slug", "question", "gp", "market_type", "market_family", F.size("outcome_bins").alias("n_bins"), b["label"].alias("label"), b["lower"].alias("lower"))


@query("q56_race_predicate", "SELECT p_partkey, p_partkey % 4 = 0 AS race FROM part")
def q56r(spark, sf_dir):
    return _raw(spark, sf_dir).select("p_partkey", markets.is_race().alias("race"))


@query(
    "q57_unit_detection",
    "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'F' ELSE 'C' END AS listed_unit, CASE p_partkey % 3 WHEN 1 THEN 'C' ELSE 'F' END AS spec_unit FROM part",
)
def q57(spark, sf_dir):
    k = F.col("p_partkey") % 3
    labels = F.when(k == 0, F.array(F.lit("10°f"), F.lit("x"))).when(k == 1, F.array(F.lit("10°C"))).otherwise(F.array(F.lit("ten")))
    return table(spark, sf_dir, "part").select("p_partkey", S.unit_any_f(labels).alias("listed_unit"), S.unit_any_c(labels).alias("spec_unit"))


# plugins


def _observed(spark, sf_dir):
    """What was seen in most of the cities, by day."""
    seen = _raw(spark, sf_dir).filter("p_partkey % 4 <> 0 and p_partkey % 9 <> 0")
    city = F.concat(F.lit("City"), (F.col("p_partkey") % 50).cast("string"), F.when(F.col("p_partkey") % 4 == 1, ", Land").otherwise(""))
    return seen.select(city.alias("city"), F.format_string("2024-05-%02d", (F.col("p_partkey") % 28 + 1).cast("int")).alias("target_date"), (F.col("p_partkey") % 60 + 5).cast("double").alias("value"))


_TRAIN_SQL = f"""WITH {_RAW_SQL}, seen AS (SELECT city, day, max(k % 60 + 5)::DOUBLE AS v FROM raw WHERE NOT race AND k % 9 <> 0 GROUP BY 1, 2),
s AS (SELECT raw.*, v, CASE WHEN NOT canonical THEN CASE WHEN v >= 15 AND v <= 25 THEN '15-25°C' ELSE 'no number' END WHEN celsius THEN CASE WHEN v >= 10 AND v <= 20 THEN '10-20°C' WHEN v >= 20 THEN '>20°C' END ELSE CASE WHEN v >= 50 AND v <= 60 THEN '50-60°F' WHEN v >= 60 THEN '>60°F' END END AS winning_label
  FROM raw LEFT JOIN seen USING (city, day) WHERE NOT race) """


@query("q58_plugin_truth", _TRAIN_SQL + "SELECT market_id, v AS truth_value, v IS NOT NULL AS is_final FROM s")
def q58(spark, sf_dir):
    plug = TemperaturePlugin(observed=_observed(spark, sf_dir), year=2024)
    return plug.is_truth_final(plug.discover_markets(_raw(spark, sf_dir).filter("p_partkey % 4 <> 0"))).select("market_id", "truth_value", "is_final")


@query("q58_training_rows_numeric", _TRAIN_SQL + ", o AS (SELECT *, unnest(CASE WHEN NOT canonical THEN ['15-25°C', 'no number'] WHEN celsius THEN ['10-20°C', '>20°C', '35°C'] ELSE ['50-60°F', '>60°F'] END) AS outcome_label FROM s WHERE v IS NOT NULL AND winning_label IS NOT NULL) SELECT market_id, 'morning_of' AS decision_horizon, day AS decision_date, outcome_label, winning_label, 0.0::DOUBLE AS feature_lead_hours FROM o")
def q58n(spark, sf_dir):
    plug = TemperaturePlugin(observed=_observed(spark, sf_dir), year=2024)
    rows = plug.build_training_rows(plug.discover_markets(_raw(spark, sf_dir).filter("p_partkey % 4 <> 0")), "morning_of")
    return rows.select("market_id", "decision_horizon", "decision_date", "outcome_label", "winning_label", "feature_lead_hours")


@query(
    "q59_training_rows_categorical",
    "SELECT 'm' || p_partkey AS market_id, 'no number' AS winning_label, unnest(['15-25°C', 'no number']) AS outcome_label, 0.1::DOUBLE AS feature_historical_win_rate, 0.5::DOUBLE AS market_price FROM part WHERE p_partkey % 8 = 0 AND p_partkey % 7 <> 0",
)
def q59(spark, sf_dir):
    won = spark.createDataFrame([("monaco", "race_winner", "no number")], "gp string, market_type string, winner string")
    plug = RacePlugin(results=won)
    rows = plug.build_training_rows(plug.discover_markets(_raw(spark, sf_dir).filter("id is not null")), "morning_of")
    return rows.select("market_id", "winning_label", "outcome_label", "feature_historical_win_rate", "market_price")


@query("q60_plugin_families", "SELECT 'sports_f1' AS family, 0 AS pos, count(*) AS specs FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT 'weather_tmax', 1, count(*) FROM part WHERE p_partkey % 4 <> 0")
def q60(spark, sf_dir):
    """The registered families in order, and how many markets each finds."""
    reg = PluginRegistry()
    reg.register(TemperaturePlugin(year=2024))
    reg.register(RacePlugin())
    raw = {"sports_f1": _raw(spark, sf_dir), "weather_tmax": _raw(spark, sf_dir).filter("p_partkey % 4 <> 0")}
    found = [reg.get(f).discover_markets(raw[f]).groupBy().agg(F.lit(f).alias("family"), F.lit(k).alias("pos"), F.count("*").alias("specs")) for k, f in enumerate(reg.list_families())]
    return found[0].unionByName(found[1])


@query("q60_feature_profile", f"WITH {PANEL_SQL} SELECT 'feature_value' AS name, count(feature_value) AS n, count(*) - count(feature_value) AS missing, round(avg(feature_value), 6) AS mean, min(feature_value) AS least, max(feature_value) AS greatest FROM panel UNION ALL SELECT 'feature_hour', count(feature_hour), count(*) - count(feature_hour), round(avg(feature_hour), 6), min(feature_hour), max(feature_hour) FROM panel")
def q60v(spark, sf_dir):
    return backtest.feature_profile(panel(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@query("q60_feature_columns", "SELECT unnest(['feature_hour', 'feature_value']) AS name")
def q60f(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in backtest.feature_columns(panel(spark, sf_dir))], "name string")


# answers

_NOW = datetime(2024, 1, 15)


def _answers(spark, sf_dir) -> listings.AnswerTable:
    """An answer for each part: a third expired, every fifth deleted, every seventh no JSON."""
    cache = listings.AnswerTable(spark, files.scratch(spark), 3600)
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("r"), k.cast("string")).alias("request"), F.when(k % 7 == 0, "no json").otherwise(F.format_string('{"mid": "%d"}', k)).alias("value"), "p_partkey")
    cache.put(p.filter("p_partkey % 3 = 0"), _NOW - timedelta(hours=2))
    cache.put(p.filter("p_partkey % 3 <> 0"), _NOW - timedelta(minutes=5))
    cache.delete(p.filter("p_partkey % 5 = 0"), _NOW - timedelta(minutes=1))
    return cache


@query("q61_cache_purge", "SELECT 'r' || p_partkey AS request, (SELECT count(*) FROM part WHERE p_partkey % 3 = 0) + (SELECT count(*) FROM part WHERE p_partkey % 5 = 0) AS purged FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 5 <> 0")
def q61(spark, sf_dir):
    cache = _answers(spark, sf_dir)
    n = cache.purge(_NOW)
    return cache.read().select("request", F.lit(n).cast("long").alias("purged"))


@query("q61_typed_answers", "SELECT 'r' || p_partkey AS request, p_partkey::VARCHAR AS mid FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0")
def q61t(spark, sf_dir):
    return _answers(spark, sf_dir).typed(_NOW, "mid string").select("request", "value.mid")


# settling, orders, report


@query("q62_settle_stream", f"""WITH {SIGNALS_SQL}, t AS (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 'warm' ELSE 'hot' END AS w FROM signals WHERE o_orderkey % 3 = 0 QUALIFY row_number() OVER (PARTITION BY city_or_segment, target_date ORDER BY o_orderkey DESC) = 1)
SELECT s.market_id AS recorded_at, CASE WHEN w IS NULL OR s.target_date > '1998-06-01' THEN NULL WHEN s.outcome_label = w THEN 'won' ELSE 'lost' END AS outcome FROM signals s LEFT JOIN t ON t.city_or_segment = s.city_or_segment AND t.target_date = s.target_date""")
def q62(spark, sf_dir):
    """Open trades settled by a stream of truths, file after file."""
    root = files.scratch(spark)
    s = signals(spark, sf_dir)
    store = log.TradeStore(spark, f"{root}/trades", ["recorded_at"])
    store.append(s.select(*[F.col(c) for c in s.columns if c in [f.name for f in struct(TRADE)]], F.col("market_id").alias("recorded_at"), *[F.lit(None).alias(f.name) for f in struct(TRADE) if f.name not in [*s.columns, "recorded_at"]]))
    last = s.filter("o_orderkey % 3 = 0").groupBy("city_or_segment", "target_date").agg(F.max("o_orderkey").alias("o"))
    truth = last.select(F.col("city_or_segment").alias("city"), "target_date", F.lit(True).alias("is_final"), F.when(F.col("o") % 2 == 0, "warm").otherwise("hot").alias("truth_label"), F.lit(None).cast("double").alias("truth_value"))
    truth.repartition(2, "city").write.parquet(f"{root}/truth")
    stream = spark.readStream.schema(truth.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/truth")
    settle_stream(stream, store, specs(spark, sf_dir).drop("pos").groupBy("city", "target_date").agg(F.first("outcome_bins").alias("outcome_bins")).unionByName(truth.select("city", "target_date", F.lit(None).cast("array<struct<label:string,lower:double,upper:double,lower_inclusive:boolean,upper_inclusive:boolean>>").alias("outcome_bins"))).dropDuplicates(["city", "target_date"]).withColumn("pos", F.lit(0)), "1998-06-01", f"{root}/checkpoint").awaitTermination()
    return store.read().select("recorded_at", "outcome")


@query("q70_settle_keyed_state", SETTLE_SQL + "SELECT o_orderkey, outcome, realized_pnl, newly_settled FROM settled")
def q70(spark, sf_dir):
    """Trades before and after their truths, first none of them final, the stream stopped in between; state is by city and date."""
    root, k = files.scratch(spark), F.col("o_orderkey")
    t = trades_to_settle(spark, sf_dir)
    at = lambda text: F.lit(text).cast("timestamp")
    told = specs(spark, sf_dir)
    last = F.max_by(F.struct("is_final", "truth_label", "truth_value", "outcome_bins"), "pos").alias("s")
    told.groupBy("city", "target_date").agg(last).select("city", "target_date", "s.*").write.parquet(f"{root}/told")
    told = spark.read.parquet(f"{root}/told").withColumn("at", at("1998-05-31 06:00:00"))  # nothing may come later than the clock allows
    open_ = t.filter("outcome is null").drop("outcome", "realized_pnl").withColumn("at", at("1998-05-30 00:00:00"))
    clock = keyed.events(open_.limit(0), told.limit(1).withColumns({"city": F.lit(""), "is_final": F.lit(False), "at": at("1998-06-01 12:00:00")}))
    kind = clock.schema
    source = f"{root}/in"

    store = log.TradeStore(spark, f"{root}/trades", ["recorded_at"])
    store.append(open_.select(*[F.col(f.name) if f.name in open_.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in struct(TRADE)]))

    def feed(*parts):
        """Rows written by any number of tasks come as one batch: a run of the stream takes all files, and then moves the clock."""
        for rows in parts:
            rows.select(*[F.col(f.name).cast(f.dataType) for f in kind]).write.mode("append").parquet(source)
        keyed.settle_keyed_stream(spark.readStream.schema(kind).parquet(source), store, f"{root}/checkpoint").awaitTermination()

    feed(keyed.events(open_.filter(k % 2 == 0), told.limit(0)), keyed.events(open_.limit(0), told.withColumns({"is_final": F.lit(False), "at": at("1998-05-30 12:00:00")})))
    feed(keyed.events(open_.limit(0), told))
    feed(keyed.events(open_.filter(k % 2 == 1).withColumn("at", at("1998-05-31 07:00:00")), told.limit(0)), clock)
    now = store.read().select("recorded_at", F.col("outcome").alias("o"), F.col("realized_pnl").alias("p"))
    out = t.join(now, "recorded_at", "left")
    return out.select("o_orderkey", F.coalesce("outcome", "o").alias("outcome"), F.coalesce("realized_pnl", "p").alias("realized_pnl"), F.col("o").isNotNull().alias("newly_settled"))


@query("q63_is_profitable", SETTLE_SQL + "SELECT o_orderkey, outcome, realized_pnl > 0 AS is_profitable FROM settled")
def q63(spark, sf_dir):
    return _settled(spark, sf_dir).select("o_orderkey", "outcome", "is_profitable")


@query("q64_dry_run_orders", "SELECT p_partkey, CASE WHEN ok THEN 'dry-run-' || left('token' || p_partkey, 8) END AS order_id, upper(side) AS side, CASE WHEN ok THEN 'dry_run' ELSE 'rejected' END AS status FROM (SELECT *, p_partkey % 10 > 0 AND p_size > 3 AND side IN ('buy', 'SELL') AS ok FROM (SELECT p_partkey, p_size, CASE p_partkey % 3 WHEN 0 THEN 'buy' WHEN 1 THEN 'SELL' ELSE 'hold' END AS side FROM part))")
def q64(spark, sf_dir):
    k = F.col("p_partkey")
    orders = table(spark, sf_dir, "part").select(F.concat(F.lit("token"), k.cast("string")).alias("token_id"), F.when(k % 3 == 0, "buy").when(k % 3 == 1, "SELL").otherwise("hold").alias("side"), (k % 10 / 10).alias("price"), F.greatest(F.col("p_size") - 3, F.lit(0)).cast("double").alias("size"))
    return trading.dry_run_orders(orders, "now").select(F.regexp_extract("token_id", "[0-9]+", 0).cast("long").alias("p_partkey"), "order_id", "side", "status")


@query("q64_preflight", "SELECT credentials, healthy, ok, n_messages, CASE WHEN ok THEN (SELECT count(*) FROM part WHERE p_partkey % 10 > 0 AND p_size > 3 AND p_partkey % 3 < 2) ELSE 0 END AS orders FROM (SELECT unnest([true, true, false]) AS credentials, unnest([true, false, true]) AS healthy, unnest([true, false, false]) AS ok, unnest([0, 1, 1]) AS n_messages)")
def q64p(spark, sf_dir):
    """How many of the table's orders may go after each preflight."""
    good = q64(spark, sf_dir).filter("status = 'dry_run'").count()
    cases = [(True, True), (True, False), (False, True)]
    rows = [(*c, (r := trading.preflight(*c))["ok"], len(r["messages"]), good if r["ok"] else 0) for c in cases]
    return spark.createDataFrame(rows, "credentials boolean, healthy boolean, ok boolean, n_messages int, orders long")


@query("q65_report_curve", f"""WITH {SIGNALS_SQL}, t AS (SELECT target_date || '#' || lpad(o_orderkey::VARCHAR, 12, '0') AS r, best_edge * 3 - 0.5 AS pnl FROM signals WHERE o_orderkey % 4 <> 0),
c AS (SELECT row_number() OVER w - 1 AS k, count(*) OVER () AS n, sum(pnl) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING) AS v FROM t WINDOW w AS (ORDER BY r)),
d AS (SELECT k * least(n, 2000) // n AS run, arg_max(v, k) AS v FROM c GROUP BY 1) SELECT (row_number() OVER (ORDER BY run) - 1)::BIGINT AS point, round(v, 4) AS cumulative_pnl FROM d""")
def q65(spark, sf_dir):
    s = signals(spark, sf_dir).filter("o_orderkey % 4 <> 0")
    t = s.select("city_or_segment", "target_date", "horizon", F.concat("target_date", F.lit("#"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("recorded_at"), (F.col("best_edge") * 3 - 0.5).alias("realized_pnl"))
    points = report.curve_points(t)
    return spark.createDataFrame([(i, v) for i, v in enumerate(points)], "point long, cumulative_pnl double").withColumn("cumulative_pnl", F.round("cumulative_pnl", 4))


@query("q66_signed_dollars", "SELECT p_partkey, CASE WHEN v < 0 THEN '-$' ELSE '+$' END || printf('%.2f', abs(v)) AS text FROM (SELECT p_partkey, (p_partkey % 200 - 100)::DOUBLE AS v FROM part)")
def q66(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.signed_dollars((F.col("p_partkey") % 200 - 100).cast("double")).alias("text"))


# features without groups


@query("q68_lags_of_the_whole_table", 'SELECT event_id, lag(value, 2) OVER w AS value_lag2, lead(value, 1) OVER w AS "value_lag-1" FROM events WINDOW w AS (ORDER BY ts, event_id)')
def q68(spark, sf_dir):
    return features.add_lags(table(spark, sf_dir, "events"), ["value"], [2, -1], ["ts", "event_id"]).select("event_id", "value_lag2", "`value_lag-1`")


@query("q68_rolling_large_groups", "SELECT event_id, round(avg(value) OVER w, 6) AS value_roll9_mean, round(max(value) OVER w, 6) AS value_roll9_max FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)")
def q68g(spark, sf_dir):
    out = features.add_rolling_stats(table(spark, sf_dir, "events"), ["value"], [9], ["ts", "event_id"], ["mean", "max"], "event_type", large_groups=True)
    return out.select("event_id", *r6("value_roll9_mean", "value_roll9_max"))


@query("q69_equity_curve_in_runs", "SELECT event_id, round(sum(value - 50) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS cumulative_pnl FROM events")
def q69(spark, sf_dir):
    t = table(spark, sf_dir, "events").select("event_id", "ts", (F.col("value") - 50).alias("realized_pnl"))
    return metrics.equity_curve(t, ["ts", "event_id"]).select("event_id", F.round("cumulative_pnl", 4).alias("cumulative_pnl"))


@query("q71_walkforward_linear", f"""WITH {PANEL_SQL}, daily AS (SELECT decision_date AS d, count(*) AS n, sum(feature_value) AS sx, sum(feature_value * feature_value) AS sxx, sum((outcome_label = winning_label)::INT) AS sy, sum(CASE WHEN outcome_label = winning_label THEN feature_value ELSE 0 END) AS sxy FROM panel GROUP BY 1),
run AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, sum(n) OVER w AS n, sum(sx) OVER w AS sx, sum(sxx) OVER w AS sxx, sum(sy) OVER w AS sy, sum(sxy) OVER w AS sxy FROM daily WINDOW w AS (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fit AS (SELECT d, n, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b, (sy - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx) / n AS a FROM run WHERE i % 3 = 0 AND n >= 20),
scored AS (SELECT p.*, least(1.0::DOUBLE, greatest(0.0::DOUBLE, a + b * feature_value)) AS prob FROM panel p JOIN fit ON decision_date = d)
SELECT event_id, round(prob, 6) AS predicted_prob, round(market_price, 6) AS market_price FROM scored""")
def q71(spark, sf_dir):
    """Every step's model from running sums over days; every row of the chosen days scored."""
    p = panel(spark, sf_dir)
    fitted = backtest.linear_steps(p, 3, 20, ["feature_value"])
    scored = p.join(fitted.withColumnRenamed("eval_date", "decision_date"), "decision_date")
    prob = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("coef")[0] + F.col("coef")[1] * F.col("feature_value")))
    return scored.select("event_id", F.round(prob, 6).alias("predicted_prob"), F.round("market_price", 6).alias("market_price"))


@query("q71_walkforward_linear_steps", WALK_SQL + "SELECT eval_date, train_rows, (SELECT count(*) FROM panel WHERE decision_date = eval_date) AS eval_rows, (SELECT count(DISTINCT market_id) FROM panel WHERE decision_date = eval_date) AS trades FROM dates")
def q71s(spark, sf_dir):
    return backtest.walk_forward_linear(panel(spark, sf_dir), 3, 20, ["event_id"], ["feature_value", "feature_hour"], "logit").steps


@query("q72_report_curve_extremes", f"""WITH {SIGNALS_SQL}, t AS (SELECT target_date || '#' || lpad(o_orderkey::VARCHAR, 12, '0') AS r, best_edge * 3 - 0.5 AS pnl FROM signals WHERE o_orderkey % 4 <> 0),
c AS (SELECT row_number() OVER (ORDER BY r) - 1 AS k, count(*) OVER () AS n, sum(pnl) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING) AS v FROM t), g AS (SELECT *, k * 720 // n AS col FROM c)
SELECT col, round(max(v), 4) AS hi, round(min(v), 4) AS lo, round(arg_min(v, k), 4) AS first, round(arg_max(v, k), 4) AS last FROM g GROUP BY col""")
def q72(spark, sf_dir):
    s = signals(spark, sf_dir).filter("o_orderkey % 4 <> 0")
    t = s.select("city_or_segment", "target_date", "horizon", F.concat("target_date", F.lit("#"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("recorded_at"), (F.col("best_edge") * 3 - 0.5).alias("realized_pnl"))
    v = F.col("cumulative_pnl")
    g = report.curve_extremes(t).groupBy(F.col("column").alias("col")).agg(F.max(v).alias("hi"), F.min(v).alias("lo"), F.min_by(v, "rank").alias("first"), F.max_by(v, "rank").alias("last"))
    return g.select("col", *[F.round(x, 4).alias(x) for x in ("hi", "lo", "first", "last")])


@query("q73_median_of_wide_frames", "SELECT event_id, round(median(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 9999 PRECEDING AND CURRENT ROW), 6) AS value_roll10000_median FROM events")
def q73(spark, sf_dir):
    out = features.add_rolling_stats(table(spark, sf_dir, "events"), ["value"], [10_000], ["ts", "event_id"], ["median"])
    return out.select("event_id", *r6("value_roll10000_median"))


@query("q73_median_of_wide_frames_grouped", "SELECT event_id, round(median(value) OVER w, 6) AS value_roll500_median, round(max(value) OVER w, 6) AS value_roll500_max FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 499 PRECEDING AND CURRENT ROW)")
def q73g(spark, sf_dir):
    out = features.add_rolling_stats(table(spark, sf_dir, "events"), ["value"], [500], ["ts", "event_id"], ["median", "max"], "event_type")
    return out.select("event_id", *r6("value_roll500_median", "value_roll500_max"))


@query("q74_first_bin_of_a_table", """WITH b AS (SELECT p_size % 5 AS k, p_partkey AS pos, 'b' || p_partkey AS label, CASE WHEN p_partkey % 7 <> 0 THEN (p_partkey % 40 * 30)::DOUBLE END AS lo, CASE WHEN p_partkey % 11 <> 0 THEN (p_partkey % 40 * 30 + p_partkey % 50)::DOUBLE END AS hi, p_partkey % 2 = 0 AS li, p_partkey % 3 = 0 AS ui FROM part WHERE p_partkey % 9 = 0),
v AS (SELECT o_orderkey, o_orderkey % 6 AS k, (floor(o_totalprice)::BIGINT % 1400)::DOUBLE AS value FROM orders)
SELECT o_orderkey, any_value(value) AS value, arg_min(label, pos) AS winner FROM v LEFT JOIN b ON v.k = b.k AND (lo IS NULL OR value > lo OR (li AND value = lo)) AND (hi IS NULL OR value < hi OR (ui AND value = hi)) GROUP BY o_orderkey""")
def q74(spark, sf_dir):
    """Bins as rows, open and closed, bounded and not, of several keys, and orders' prices looked up in them."""
    k = F.col("p_partkey")
    low = (k % 40 * 30).cast("double")
    b = table(spark, sf_dir, "part").filter(k % 9 == 0).select(
        (F.col("p_size") % 5).cast("long").alias("k"), k.alias("pos"), F.concat(F.lit("b"), k.cast("string")).alias("label"), F.when(k % 7 != 0, low).alias("lower"), F.when(k % 11 != 0, low + k % 50).alias("upper"), (k % 2 == 0).alias("lower_inclusive"), (k % 3 == 0).alias("upper_inclusive")
    )
    v = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 6).cast("long").alias("k"), (F.floor("o_totalprice").cast("long") % 1400).cast("double").alias("value"))
    return bins.first_bins(v, b, ["k"]).select("o_orderkey", "value", "winner")


@query("q75_profile_by_days", f"WITH {PANEL_SQL} SELECT count(*) AS n_rows, count(DISTINCT decision_date) AS n_dates, count(DISTINCT market_id) AS n_markets FROM panel")
def q75(spark, sf_dir):
    """The profile from bitmaps of days that were written one part after the other."""
    p, root = panel(spark, sf_dir), files.scratch(spark)
    old = F.dayofmonth("ts") <= 15
    numbers = ordering.written(metrics.number_keys(p.filter(old).select(F.col("market_id").alias("key"))))
    metrics.daily_profile(p.filter(old), numbers).write.parquet(f"{root}/days/part=1")
    numbers = ordering.written(metrics.number_keys(p.filter(~old).select(F.col("market_id").alias("key")), numbers))
    metrics.daily_profile(p.filter(~old), numbers).write.parquet(f"{root}/days/part=2")
    return metrics.profile_of_days(spark.read.parquet(f"{root}/days"))


@query("q61_answers_by_key", "SELECT 'r' || p_partkey AS request, '{\"mid\": \"' || p_partkey || '\"}' AS value FROM part WHERE p_partkey <= 40 AND p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0")
def q61k(spark, sf_dir):
    """Forty requests looked up by key among all answers."""
    return _answers(spark, sf_dir).get([f"r{k}" for k in range(1, 41)], _NOW)


# calibration

_POOLED_SQL = (
    SCORE_SQL
    + """, g AS (SELECT round(y_prob, 2) AS p, count(*) AS n, sum(y_true) AS t FROM s GROUP BY 1), c AS (SELECT p, row_number() OVER w AS i, sum(n) OVER w AS n, sum(t) OVER w AS t FROM g WINDOW w AS (ORDER BY p)),
pairs AS (SELECT a.i AS a, b.i AS b, (b.t - coalesce(z.t, 0)) / (b.n - coalesce(z.n, 0)) AS m FROM c a JOIN c b ON b.i >= a.i LEFT JOIN c z ON z.i = a.i - 1),
low AS (SELECT c.i, a, min(m) AS m FROM c JOIN pairs ON a <= c.i AND b >= c.i GROUP BY 1, 2), fit AS (SELECT i, max(m) AS v FROM low GROUP BY 1)
SELECT round(p, 2) AS y_prob, round(v, 6) AS calibrated FROM fit JOIN c USING (i)"""
)


def _percent(spark, sf_dir):
    return _scored(spark, sf_dir).select(F.round("y_prob", 2).alias("y_prob"), "y_true")


@query("q67_isotonic_percent", _POOLED_SQL)
def q67(spark, sf_dir):
    s = _percent(spark, sf_dir)
    return models.IsotonicCalibrator().fit(s).transform(s.select("y_prob").distinct()).select("y_prob", *r6("calibrated"))


@query("q67_calibrator_roundtrip", _POOLED_SQL)
def q67r(spark, sf_dir):
    s, path = _percent(spark, sf_dir), files.scratch(spark)
    models.IsotonicCalibrator().fit(s).save(path)
    return models.IsotonicCalibrator.load(path).transform(s.select("y_prob").distinct()).select("y_prob", *r6("calibrated"))
