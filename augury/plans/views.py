"""Derived tables that the queries run on, from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = ["click", "error", "purchase", "signup", "view"]
ZONES = ["UTC", "America/New_York", "Asia/Tokyo", "Europe/London", "Australia/Sydney"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision panel from events; event_id is unique."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        "event_id",
        "ts",
        F.col("user_id").cast("string").alias("market_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("decision_date"),
        F.col("event_type").alias("outcome_label"),
        F.get(F.array(*map(F.lit, LABELS)), F.pmod(k, F.lit(5))).alias("winning_label"),
        F.least(F.lit(0.95), F.greatest(F.lit(0.05), F.col("value") / 100)).alias("market_price"),
        F.concat(F.lit("S"), F.pmod("user_id", F.lit(10)).cast("string")).alias("segment"),
        F.col("value").alias("feature_value"),
        F.hour("ts").cast("double").alias("feature_hour"),
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge signals from orders; o_orderkey is unique."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    p = F.substring("o_orderpriority", 1, 1).cast("int")
    price, prob = (F.pmod("o_orderkey", F.lit(97)) + 2) / 100.0, (F.pmod("o_custkey", F.lit(89)) + 6) / 100.0
    s = o.join(c, "o_custkey").join(n, "c_nationkey")
    s = s.select("o_orderkey", "o_orderstatus", "n_regionkey", F.col("n_name").alias("city_or_segment"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("target_date"), F.when(p <= 2, "market_open").when(p == 3, "previous_evening").when(p == 4, "morning_of").otherwise("other").alias("horizon"), price.alias("gamma_price"), prob.alias("model_prob"))
    return s.select(
        "*",
        F.concat(F.lit("m"), "o_orderkey").alias("market_id"),
        F.when(F.pmod("o_orderkey", F.lit(3)) == 0, "warm").otherwise("hot").alias("outcome_label"),
        F.when(F.col("model_prob") >= F.col("gamma_price"), "yes").otherwise("no").alias("direction"),
        (F.abs(F.col("model_prob") - F.col("gamma_price")) - 0.003).alias("best_edge"),
    )


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spec and truth for most (city, date) pairs; pos is the order of listing."""
    s = signals(spark, sf_dir).filter(F.pmod("o_orderkey", F.lit(11)) != 0)
    b = F.expr("array(named_struct('label','cold','lower',cast(null as double),'upper',15D,'lower_inclusive',true,'upper_inclusive',false), named_struct('label','warm','lower',15D,'upper',25D,'lower_inclusive',true,'upper_inclusive',false), named_struct('label','hot','lower',25D,'upper',40D,'lower_inclusive',true,'upper_inclusive',true))")
    k = F.col("o_orderkey")
    return s.select(
        F.col("city_or_segment").alias("city"),
        "target_date",
        k.alias("pos"),
        b.alias("outcome_bins"),
        (F.col("o_orderstatus") != "P").alias("is_final"),
        F.when((F.col("o_orderstatus") == "F") & (k % 2 == 0), F.when(k % 4 == 0, "warm").otherwise("hot")).alias("truth_label"),
        F.when((F.col("o_orderstatus") == "F") & (k % 2 == 1) | (F.col("o_orderstatus") == "O") & (k % 5 != 0), (k % 50).cast("double")).alias("truth_value"),
    )


PANEL_SQL = """panel AS (SELECT event_id, ts, user_id::VARCHAR AS market_id, strftime(ts, '%Y-%m-%d') AS decision_date, event_type AS outcome_label,
  (['click','error','purchase','signup','view'])[1 + (json_extract_string(props, '$.k')::INTEGER % 5)] AS winning_label,
  least(0.95::DOUBLE, greatest(0.05::DOUBLE, value / 100)) AS market_price, 'S' || (user_id % 10) AS segment, value AS feature_value, hour(ts)::DOUBLE AS feature_hour FROM events)"""

SIGNALS_SQL = """sig0 AS (SELECT o_orderkey, o_orderstatus, n_regionkey, n_name AS city_or_segment, strftime(o_orderdate, '%Y-%m-%d') AS target_date,
  CASE WHEN left(o_orderpriority, 1)::INT <= 2 THEN 'market_open' WHEN left(o_orderpriority, 1) = '3' THEN 'previous_evening' WHEN left(o_orderpriority, 1) = '4' THEN 'morning_of' ELSE 'other' END AS horizon,
  (o_orderkey % 97 + 2) / 100.0::DOUBLE AS gamma_price, (o_custkey % 89 + 6) / 100.0::DOUBLE AS model_prob
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
signals AS (SELECT *, 'm' || o_orderkey AS market_id, CASE WHEN o_orderkey % 3 = 0 THEN 'warm' ELSE 'hot' END AS outcome_label,
  CASE WHEN model_prob >= gamma_price THEN 'yes' ELSE 'no' END AS direction, abs(model_prob - gamma_price) - 0.003::DOUBLE AS best_edge FROM sig0)"""

SPECS_SQL = """specs AS (SELECT city_or_segment AS city, target_date, o_orderkey AS pos, o_orderstatus <> 'P' AS is_final,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'warm' ELSE 'hot' END END AS truth_label,
  CASE WHEN (o_orderstatus = 'F' AND o_orderkey % 2 = 1) OR (o_orderstatus = 'O' AND o_orderkey % 5 <> 0) THEN (o_orderkey % 50)::DOUBLE END AS truth_value
  FROM signals WHERE o_orderkey % 11 <> 0)"""
