"""The two families that come with the engine: highest temperatures and race winners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augury.operators import markets
from augury.plugins.base import MarketPlugin


class TemperaturePlugin(MarketPlugin):
    """Markets on a city's highest temperature; bins of degrees.

    forecasts: city, target_date and numbers; observed: city, target_date, value.
    Without forecasts the features are zeros; without observations there is no truth.
    """

    family = "weather_tmax"

    def __init__(self, forecasts: DataFrame | None = None, observed: DataFrame | None = None, year: int | None = None, keep_year: bool = False):
        self.forecasts, self.observed, self.year, self.keep_year = forecasts, observed, year, keep_year

    def discover_markets(self, raw: DataFrame) -> DataFrame:
        return markets.temperature_specs(raw.filter(markets.is_temperature_soft()), self.year, self.keep_year)

    def fetch_features(self, specs: DataFrame, horizon: str) -> DataFrame:
        if self.forecasts is None:
            return specs.select("market_id", *[F.lit(0.0).alias(x) for x in markets.STUB_FEATURES])
        return specs.select("market_id", "city", "target_date").join(self.forecasts, ["city", "target_date"]).drop("city", "target_date")

    def fetch_truth(self, specs: DataFrame) -> DataFrame:
        if self.observed is None:
            return specs.select("market_id", F.lit(None).cast("double").alias("truth_value"), F.lit(None).cast("string").alias("truth_label"))
        seen = self.observed.groupBy("city", "target_date").agg(F.max("value").alias("truth_value"))
        return specs.select("market_id", "city", "target_date").join(seen, ["city", "target_date"], "left").select("market_id", "truth_value", F.lit(None).cast("string").alias("truth_label"))


class RacePlugin(MarketPlugin):
    """Markets on race winners; bins are names.  results: gp, market_type, winner."""

    family = "sports_f1"

    def __init__(self, telemetry: DataFrame | None = None, results: DataFrame | None = None):
        self.telemetry, self.results = telemetry, results

    def discover_markets(self, raw: DataFrame) -> DataFrame:
        return markets.race_specs(raw.filter(markets.is_race()))

    def fetch_features(self, specs: DataFrame, horizon: str) -> DataFrame:
        if self.telemetry is None:
            return specs.select("market_id", F.lit(0.0).alias("quali_gap_s"), F.lit(0.1).alias("historical_win_rate"))
        return specs.select("market_id", "gp").join(self.telemetry, "gp").drop("gp")

    def fetch_truth(self, specs: DataFrame) -> DataFrame:
        none = F.lit(None).cast("double").alias("truth_value")
        if self.results is None:
            return specs.select("market_id", none, F.lit(None).cast("string").alias("truth_label"))
        won = self.results.groupBy("gp", "market_type").agg(F.max("winner").alias("truth_label"))
        return specs.select("market_id", "gp", "market_type").join(won, ["gp", "market_type"], "left").select("market_id", none, "truth_label")
