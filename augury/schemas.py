"""Table schemas, and checks that public functions make on entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BIN = "struct<label:string,lower:double,upper:double,lower_inclusive:boolean,upper_inclusive:boolean>"
SPEC = (
    f"market_id string, slug string, question string, outcome_bins array<{BIN}>, close_time string, market_family string, tags array<string>, "
    "city string, target_date string, timezone string, unit string, market_price double, token_ids array<string>, "
    "outcome_schema array<struct<label:string,price:double>>, gp string, market_type string"
)
PANEL = "market_id string, decision_date string, outcome_label string, winning_label string, market_price double, segment string"
SIGNAL = (
    "market_id string, city_or_segment string, target_date string, horizon string, outcome_label string, direction string, "
    "gamma_price double, model_prob double, best_edge double, yes_edge double, no_edge double, question string"
)
TRADE = (
    "recorded_at string, city_or_segment string, target_date string, outcome_label string, direction string, gamma_price double, "
    "edge_after_fee double, horizon string, flat_stake double, size double, fee_paid double, outcome string, realized_pnl double"
)
BACKTEST_TRADE = (
    "market_id string, eval_date string, outcome_label string, predicted_prob double, market_price double, realized_pnl double, edge double, "
    "segment string, winning_label string, outcome string, size double, fee_paid double"
)
RECEIPT = "order_id string, token_id string, side string, price double, size double, status string, placed_at string"
#: market_family values in use.
FAMILIES = ("binary", "range", "categorical", "numeric")


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def require(df: DataFrame, columns: list[str]) -> None:
    """A missing column is a KeyError that names it."""
    for c in columns:
        if c not in df.columns:
            raise KeyError(f"Column '{c}' not found in {df.columns}")


def nan_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Spark's aggregates take NaN for a value; missing numbers are null here."""
    kinds = dict(df.dtypes)
    names = [c for c in columns or df.columns if kinds.get(c) in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in names}) if names else df
