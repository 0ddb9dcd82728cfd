"""Scalar rules as column expressions: prices, sizes, fees, profit, dates, JSON texts."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Days and hour, local time, after which a signal of this horizon is stale.
HORIZON_CUTOFFS = {"market_open": (-2, 12), "previous_evening": (-1, 18), "morning_of": (0, 6)}
TINY = 1e-9


def c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def edge(prob, price, fee=0.0, slippage=0.0) -> Column:
    return c(prob) - c(price) - c(fee) - c(slippage)


def fee(stake, bps=30.0) -> Column:
    return c(stake) * c(bps) / F.lit(10000.0)


def flat_stake_size(stake, price) -> Column:
    return c(stake) / F.greatest(c(price), F.lit(TINY))


def kelly_fraction(prob, price, fraction=0.25) -> Column:
    """Zero outside prices between 0 and 1; never negative."""
    odds = (F.lit(1.0) - c(price)) / c(price)
    full = (odds * c(prob) - (F.lit(1.0) - c(prob))) / odds
    return F.when((c(price) <= 0) | (c(price) >= 1), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), c(fraction) * full))


def kelly_stake_size(prob, price, bankroll, fraction=0.25, max_exposure=0.05) -> Column:
    return F.least(kelly_fraction(prob, price, fraction), c(max_exposure)) * c(bankroll)


def settle_position(label, winner, price, size, side, fee_paid=0.0) -> Column:
    """Profit of a position; every side but "buy" is a sale.  A null winner pays nothing."""
    payout = F.coalesce(c(label) == c(winner), F.lit(False)).cast("double")
    return F.when(c(side) == "buy", (payout - c(price)) * c(size) - c(fee_paid)).otherwise((c(price) - payout) * c(size) - c(fee_paid))


def entry_price(direction, price) -> Column:
    return F.when(c(direction) == "yes", c(price)).otherwise(F.lit(1.0) - c(price))


def backtest_size(stake, price) -> Column:
    return F.when(c(price) > 0, c(stake) / c(price)).otherwise(F.lit(0.0))


def won(label, winner) -> Column:
    """1 where the labels are equal; null equals nothing."""
    return F.coalesce(c(label) == c(winner), F.lit(False)).cast("int")


def outcome(label, winner) -> Column:
    return F.when(won(label, winner) == 1, F.lit("won")).otherwise(F.lit("lost"))


def bin_edges(n: int) -> list[float]:
    return [k * (1 / n) for k in range(n)] + [1.0]


def calibration_bin(prob, n: int = 10) -> Column:
    """The equal-width bin that holds a probability; 1.0 and NaN go to the last, negatives to the first."""
    edges = F.array(*[F.lit(e) for e in bin_edges(n)])
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.size(F.filter(edges, lambda e: e <= c(prob))) - 1))


def clip01(x) -> Column:
    return F.when(c(x).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c(x))))


def cutoff_utc(target_date, horizon, timezone) -> Column:
    """When a signal becomes stale, in UTC without zone.  Unknown horizons: midnight of the day; no zone: UTC."""
    day = F.coalesce(*[F.when(c(horizon) == k, F.lit(d)) for k, (d, _) in HORIZON_CUTOFFS.items()], F.lit(0))
    hour = F.coalesce(*[F.when(c(horizon) == k, F.lit(h)) for k, (_, h) in HORIZON_CUTOFFS.items()], F.lit(0))
    at = F.date_add(c(target_date).try_cast("date"), day)
    local = F.make_timestamp_ntz(F.year(at), F.month(at), F.dayofmonth(at), hour, F.lit(0), F.lit(0))
    return F.to_utc_timestamp(local, F.coalesce(c(timezone), F.lit("UTC"))).cast("timestamp_ntz")


def is_stale(target_date, horizon, timezone, now) -> Column:
    """A date that cannot be read is stale."""
    return F.coalesce(now >= cutoff_utc(target_date, horizon, timezone), F.lit(True))


def contains_text(text, word: str) -> Column:
    """Case-insensitive, literal; a null text is empty."""
    return F.contains(F.lower(F.coalesce(c(text), F.lit(""))), F.lit(word.lower()))


def human_date(text, year: int, keep_year: bool = False) -> Column:
    """'May 13', 'Sep 1', 'May 13, 2024' as ISO text; other texts as they are.

    The year given always wins, unless ``keep_year`` prefers one in the text.
    """
    raw = F.trim(c(text))
    day = F.regexp_extract(raw, r"^([A-Za-z]+ [0-9]{1,2})(?:, [0-9]{4})?$", 1)
    own = F.regexp_extract(raw, r"^[A-Za-z]+ [0-9]{1,2}, ([0-9]{4})$", 1)
    y = F.when(own != "", own).otherwise(F.lit(str(year))) if keep_year else F.lit(str(year))
    whole = F.concat(day, F.lit(" "), y)
    read = F.coalesce(*[F.try_to_date(whole, f) for f in ("MMMM d yyyy", "MMM d yyyy")])
    return F.coalesce(F.date_format(read, "yyyy-MM-dd"), raw)


def json_list(text) -> Column:
    """A JSON list as an array of texts; anything else is empty."""
    return F.coalesce(F.from_json(c(text), "array<string>"), F.expr("cast(array() as array<string>)"))


def prices_each(text) -> Column:
    """Prices of a JSON list; one that is no number is 0."""
    return F.transform(json_list(text), lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0)))


def prices_all_or_half(text, labels) -> Column:
    """Prices of a JSON list; if one is no number or there is no list, 0.5 for each label."""
    raw = F.from_json(c(text), "array<string>")
    read = F.transform(raw, lambda x: x.try_cast("double"))
    half = F.transform(c(labels), lambda _: F.lit(0.5))
    return F.when(raw.isNull() | F.exists(read, lambda x: x.isNull()), half).otherwise(read)


def label_prices(labels, prices) -> Column:
    """Labels and prices by place: missing prices are 0.5, spare ones are cut."""
    return F.transform(c(labels), lambda x, i: F.struct(x.alias("label"), F.coalesce(F.get(c(prices), i), F.lit(0.5)).alias("price")))


def best_price(prices) -> Column:
    return F.coalesce(F.array_max(c(prices)), F.lit(0.5))


def unit_any_f(labels) -> Column:
    """F if a label has °f in any case, else C."""
    return F.when(F.exists(c(labels), lambda x: F.contains(F.lower(x), F.lit("°f"))), F.lit("F")).otherwise(F.lit("C"))


def unit_any_c(labels) -> Column:
    """C if a label has °C, else F."""
    return F.when(F.exists(c(labels), lambda x: F.contains(x, F.lit("°C"))), F.lit("C")).otherwise(F.lit("F"))


def cache_key(text) -> Column:
    return F.md5(c(text).cast("binary"))


def signed_dollars(x) -> Column:
    return F.concat(F.when(c(x) < 0, F.lit("-$")).otherwise(F.lit("+$")), F.format_string("%.2f", F.abs(c(x))))


def register_sql_functions(spark: SparkSession) -> None:
    """The price and size rules for SQL texts, as SQL functions that Catalyst inlines."""
    bodies = {
        "market_edge(p DOUBLE, price DOUBLE, fee DOUBLE, slippage DOUBLE)": "p - price - fee - slippage",
        "market_fee(stake DOUBLE, bps DOUBLE)": "stake * bps / 10000D",
        "flat_size(stake DOUBLE, price DOUBLE)": f"stake / greatest(price, {TINY}D)",
        "kelly(p DOUBLE, price DOUBLE, fraction DOUBLE)": "CASE WHEN price <= 0 OR price >= 1 THEN 0D ELSE greatest(0D, fraction * (((1 - price) / price) * p - (1 - p)) / ((1 - price) / price)) END",
        "position_pnl(won BOOLEAN, price DOUBLE, size DOUBLE, side STRING, fee DOUBLE)": "CASE WHEN side = 'buy' THEN (CAST(won AS DOUBLE) - price) * size - fee ELSE (price - CAST(won AS DOUBLE)) * size - fee END",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS DOUBLE RETURN {body}")
