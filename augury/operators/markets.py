"""Raw market listings to typed specs, and specs with truth to training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augury.functions import bins
from augury.functions import scalars as S

# Question patterns and the sources that resolve such markets.
GREEDY = r"(?i)highest temperature in (.+) on (.+?)\?"
LOOSE = r"(?i)highest temperature in .+ on .+?"
NAMED = r"(?iU)^highest temperature in ([\w\s,]+?) on (.+?)\??$"
LEGACY = r"(?iU)^highest temperature in ([\w\s]+) on (.+?)\??$"
SOURCE_HINTS = ("wunderground", "central weather administration", "hong kong observatory", "highest temperature recorded")
RACE_WORDS = ("f1", "formula 1", "grand prix", "gp winner")
STUB_FEATURES = (
    "forecast_temperature_2m_max", "forecast_temperature_2m_mean", "forecast_temperature_2m_min", "forecast_dew_point_2m_mean",
    "forecast_relative_humidity_2m_mean", "forecast_wind_speed_10m_mean", "forecast_cloud_cover_mean", "lead_hours",
)

#: Raw listings: every field as text, as listings differ in types.
RAW = (
    "id string, market_id string, conditionId string, slug string, question string, description string, endDate string, close_time string, active boolean, "
    "outcomes string, outcomePrices string, clobTokenIds string, tokens array<struct<outcome:string,label:string,name:string,price:string>>, "
    "city string, target_date string, timezone string, gp string, market_type string"
)


def _text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def _hinted(description: Column) -> Column:
    low = F.lower(_text(description))
    out = F.lit(False)
    for h in SOURCE_HINTS:
        out = out | F.contains(low, F.lit(h))
    return out


def token_labels(tokens: Column) -> Column:
    return F.transform(F.coalesce(tokens, F.expr("cast(array() as array<struct<outcome:string,label:string,name:string,price:string>>)")), lambda t: F.coalesce(t["outcome"], t["label"], t["name"], F.lit("")))


def is_temperature_strict() -> Column:
    """Question, source and a label with a degree sign must all be there."""
    question = F.trim(_text(F.col("question"))).rlike(GREEDY)
    labels = F.exists(S.json_list("outcomes"), lambda x: F.contains(F.lower(x), F.lit("°c")) | F.contains(F.lower(x), F.lit("°f")))
    return question & _hinted(F.col("description")) & labels


def is_temperature_soft() -> Column:
    """The question must match; refused only if source and labels are both given and both fail."""
    tokens = token_labels(F.col("tokens"))
    joined = F.when(F.size(tokens) > 0, F.array_join(tokens, " ")).otherwise(_text(F.col("outcomes")))
    hint = F.when(_text(F.col("description")) != "", _hinted(F.col("description")))
    degrees = F.when(F.trim(joined) != "", F.contains(joined, F.lit("°C")) | F.contains(joined, F.lit("°F")))
    no = lambda x: x.eqNullSafe(F.lit(False))
    return _text(F.col("question")).rlike(LOOSE) & ~(no(hint) & no(degrees))


def is_race() -> Column:
    q = F.lower(_text(F.col("question")))
    out = F.lit(False)
    for w in RACE_WORDS:
        out = out | F.contains(q, F.lit(w))
    return out


def temperature_infos(raw: DataFrame, year: int, keep_year: bool = False) -> DataFrame:
    """The parsed view of strict temperature markets; others are left out.  With ``keep_year`` a year in the text wins."""
    q = F.trim(_text(F.col("question")))
    labels = S.json_list("outcomes")
    return raw.filter(q.rlike(GREEDY)).select(
        F.coalesce("id", "conditionId", F.lit("")).alias("market_id"),
        q.alias("question"),
        _text(F.col("slug")).alias("slug"),
        F.trim(F.regexp_extract(q, GREEDY, 1)).alias("city"),
        S.human_date(F.regexp_extract(q, GREEDY, 2), year, keep_year).alias("target_date"),
        S.unit_any_f(labels).alias("unit"),
        S.json_list("clobTokenIds").alias("token_ids"),
        labels.alias("outcome_labels"),
        S.prices_each("outcomePrices").alias("outcome_prices"),
        _text(F.col("endDate")).alias("end_date"),
        F.coalesce("active", F.lit(True)).alias("active"),
    )


def _spec(raw: DataFrame, **columns: Column) -> DataFrame:
    null = lambda t: F.lit(None).cast(t)
    base = {
        "timezone": null("string"), "unit": null("string"), "market_price": null("double"), "token_ids": null("array<string>"),
        "outcome_schema": null("array<struct<label:string,price:double>>"), "gp": null("string"), "market_type": null("string"), "city": null("string"), "target_date": null("string"),
    } | columns
    order = ["market_id", "slug", "question", "outcome_bins", "close_time", "market_family", "tags", "city", "target_date", "timezone", "unit", "market_price", "token_ids", "outcome_schema", "gp", "market_type"]
    return raw.select(*[base[x].alias(x) for x in order])


def temperature_specs(raw: DataFrame, year: int | None = None, keep_year: bool = False) -> DataFrame:
    """Specs of temperature markets.  With ``year`` the date becomes ISO text (with ``keep_year`` a year in the text wins), else it stays as asked."""
    canonical = _text(F.col("outcomes")) != ""
    old = token_labels(F.col("tokens"))
    old_prices = F.transform(F.col("tokens"), lambda t: F.coalesce(t["price"].try_cast("double"), F.lit(0.5)))
    raw = raw.withColumn("__labels", F.when(canonical, S.json_list("outcomes")).otherwise(old))
    prices = F.when(canonical, S.prices_all_or_half("outcomePrices", "__labels")).otherwise(old_prices)
    raw = raw.withColumn("__prices", prices)
    q = _text(F.col("question"))
    date = F.when(q.rlike(NAMED), F.trim(F.regexp_extract(q, NAMED, 2))).otherwise(_text(F.col("target_date")))
    return _spec(
        raw,
        market_id=F.coalesce("id", "market_id", F.lit("")),
        slug=F.coalesce("slug", "id", "market_id", F.lit("")),
        question=q,
        outcome_bins=bins.bins_of("__labels"),
        close_time=F.coalesce("endDate", "close_time", F.lit("")),
        market_family=F.lit("range"),
        tags=F.array(F.lit("weather"), F.lit("temperature")),
        city=F.when(q.rlike(NAMED), F.trim(F.regexp_extract(q, NAMED, 1))).otherwise(_text(F.col("city"))),
        target_date=S.human_date(date, year, keep_year) if year else date,
        unit=S.unit_any_c("__labels"),
        market_price=S.best_price(F.when(F.size("__prices") < F.size("__labels"), F.concat("__prices", F.array(F.lit(0.5)))).otherwise(F.col("__prices"))),
        token_ids=S.json_list("clobTokenIds"),
        outcome_schema=S.label_prices("__labels", "__prices"),
    )


def legacy_temperature_specs(raw: DataFrame) -> DataFrame:
    """The older form: tokens only, a city without commas, the date as given."""
    q = _text(F.col("question"))
    return _spec(
        raw,
        market_id=F.coalesce("id", "market_id", F.lit("")),
        slug=F.coalesce("slug", "id", "market_id", F.lit("")),
        question=q,
        outcome_bins=bins.bins_of(token_labels(F.col("tokens"))),
        close_time=F.coalesce("endDate", "close_time", F.lit("")),
        market_family=F.lit("range"),
        tags=F.array(F.lit("weather"), F.lit("temperature")),
        city=F.when(q.rlike(LEGACY), F.trim(F.regexp_extract(q, LEGACY, 1))).otherwise(_text(F.col("city"))),
        target_date=_text(F.col("target_date")),
        timezone=F.coalesce("timezone", F.lit("UTC")),
    )


def race_specs(raw: DataFrame) -> DataFrame:
    return _spec(
        raw,
        market_id=_text(F.col("id")),
        slug=_text(F.col("slug")),
        question=_text(F.col("question")),
        outcome_bins=bins.bins_of(F.transform(token_labels(F.col("tokens")), lambda x: F.when(x == "", F.lit("?")).otherwise(x)), parse=False),
        close_time=_text(F.col("endDate")),
        market_family=F.lit("categorical"),
        tags=F.array(F.lit("sports"), F.lit("f1")),
        gp=_text(F.col("gp")),
        market_type=F.coalesce("market_type", F.lit("race_winner")),
    )


def training_rows(specs: DataFrame, truth: DataFrame, features: DataFrame, horizon: str, decision_date: Column | None = None) -> DataFrame:
    """A row for each outcome of each market whose winner is known.

    truth: market_id, truth_value, truth_label; features: market_id and numbers, which
    get the prefix feature_.  A market without truth, bin or features is left out.
    """
    keys = [x for x in features.columns if x != "market_id"]
    named = features.select("market_id", *[F.col(x).alias(x if x.startswith("feature_") else f"feature_{x}") for x in keys])
    t = specs.join(truth, "market_id").withColumn("winning_label", F.coalesce("truth_label", bins.winning_label("truth_value", "outcome_bins"))).filter("winning_label is not null")
    t = t.join(named, "market_id")
    # few outcomes per market, so the explode is bounded
    t = t.select("*", F.posexplode("outcome_bins").alias("__pos", "__bin"))
    price = F.coalesce(F.get("outcome_schema", F.col("__pos"))["price"], F.col("market_price"), F.lit(0.5))
    day = decision_date if decision_date is not None else F.col("target_date")
    return t.select("market_id", F.lit(horizon).alias("decision_horizon"), day.alias("decision_date"), F.col("__bin.label").alias("outcome_label"), "winning_label", price.alias("market_price"), *named.columns[1:])
