"""Feature transforms: lags, rolling statistics, cyclical, one-hot and clipped columns.

Row order is never implied: windows take ``order_by``, which should end in a unique
column.  NaN counts as missing.  With ``group_by`` each group has its own window; a
null group has no neighbours, so its lags are the fill value and its rolling
statistics are null.  Without groups, or where a group is long, the table is ordered
and cut into chunks that overlap by the frame (``ordering.framed``), so that no task
holds a whole table or group; that writes the table once.  Whether a group is long
(over ``ordering.PART_ROWS`` rows) is counted, unless ``large_groups`` says so or not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from augury.operators import ordering
from augury.schemas import require

STATS = ("mean", "std", "min", "max", "median")


def _framed(df: DataFrame, group_by: str | None, order_by, large_groups: bool | None, back: int, ahead: int, make) -> DataFrame:
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    if group_by and large_groups is None:
        large_groups = ordering.has_long_group(df, group_by)
    if group_by and not large_groups:
        return df.withColumns(make(W.partitionBy(group_by).orderBy(*order)))
    return ordering.framed(df, group_by, order, back, ahead, make)


#: Rows of a frame from which a median slides along instead of being taken anew for each row.
WIDE = 256


def _missing_to_null(df: DataFrame, col: str) -> Column:
    return F.when(~F.isnan(col), F.col(col)) if dict(df.dtypes)[col] in ("double", "float") else F.col(col)


def add_lags(df: DataFrame, cols: list[str], lags: list[int], order_by, group_by: str | None = None, fill_value: float | None = None, large_groups: bool | None = None) -> DataFrame:
    """``{col}_lag{n}`` for each column and lag; negative lags look ahead; missing values get ``fill_value``."""
    require(df, [*cols, *([group_by] if group_by else [])])

    def make(w: WindowSpec) -> dict[str, Column]:
        out = {}
        for col in cols:
            for n in lags:
                v = F.lag(_missing_to_null(df, col), n).over(w)
                v = F.when(F.col(group_by).isNotNull(), v) if group_by else v
                out[f"{col}_lag{n}"] = v if fill_value is None else F.coalesce(v, F.lit(fill_value))
        return out

    return _framed(df, group_by, order_by, large_groups, max([0, *lags]), max([0, *(-n for n in lags)]), make)


def add_rolling_stats(df: DataFrame, cols: list[str], windows: list[int], order_by, stats: list[str] | None = None, group_by: str | None = None, min_periods: int = 1, large_groups: bool | None = None) -> DataFrame:
    """``{col}_roll{w}_{stat}`` over the last w rows; null below ``min_periods`` values."""
    require(df, [*cols, *([group_by] if group_by else [])])
    unknown = set(stats or ()) - set(STATS)
    if unknown:
        raise ValueError(f"unknown statistics: {sorted(unknown)}")

    wide = {f"{col}_roll{n}_median": (col, n) for col in cols for n in windows if n > WIDE and "median" in (stats or ())}
    if wide:
        # a median over a window function costs the frame for each row
        order = [order_by] if isinstance(order_by, str) else list(order_by)
        df = ordering.sliding_medians(df.withColumns({c: _missing_to_null(df, c) for c in cols}), wide, group_by, order, min_periods)
        if group_by:
            df = df.withColumns({name: F.when(F.col(group_by).isNotNull(), F.col(name)) for name in wide})

    def make(w: WindowSpec) -> dict[str, Column]:
        out = {}
        for col in cols:
            v = _missing_to_null(df, col)
            for n in windows:
                frame = w.rowsBetween(-(n - 1), 0)
                made = {"mean": F.avg(v), "std": F.stddev_samp(v), "min": F.min(v), "max": F.max(v), "median": F.percentile(v, 0.5)}
                enough = F.count(v).over(frame) >= min_periods
                enough = enough & F.col(group_by).isNotNull() if group_by else enough
                for stat in stats or ["mean", "std"]:
                    if f"{col}_roll{n}_{stat}" in wide:
                        continue
                    out[f"{col}_roll{n}_{stat}"] = F.when(enough, made[stat].over(frame))
        return out

    if wide and len(wide) == len(cols) * len(windows) * len(stats or ()):
        return df
    return _framed(df, group_by, order_by, large_groups, max([0, *windows]), 0, make)


def encode_cyclical(col, period: float, name: str = "x") -> list[Column]:
    """``{name}_sin`` and ``{name}_cos``."""
    angle = F.lit(2.0) * F.pi() * (F.col(col) if isinstance(col, str) else col) / F.lit(float(period))
    return [F.sin(angle).alias(f"{name}_sin"), F.cos(angle).alias(f"{name}_cos")]


def categories(df: DataFrame, col: str, most: int = 10_000) -> list[str]:
    """The sorted distinct values; more than ``most`` is an error, as each becomes a column."""
    found = [r[0] for r in df.select(col).filter(F.col(col).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{col} has more than {most} categories")
    return sorted(found)


def encode_onehot(df: DataFrame, cols: list[str], drop_first: bool = True) -> DataFrame:
    """Text columns become ``{col}_{value}`` columns of 0 and 1, behind the others; numeric ones only move to the end."""
    require(df, cols)
    kinds = dict(df.dtypes)
    numeric = [x for x in cols if kinds[x] not in ("string", "boolean")]
    out = [F.col(x) for x in df.columns if x not in cols] + [F.col(x) for x in numeric]
    for x in cols:
        if x not in numeric:
            out += [F.coalesce((F.col(x) == F.lit(v)).cast("double"), F.lit(0.0)).alias(f"{x}_{v}") for v in categories(df, x)[int(drop_first) :]]
    return df.select(*out)


def clip_bounds(df: DataFrame, cols: list[str], method: str = "iqr", iqr_factor: float = 3.0, zscore_threshold: float = 4.0) -> DataFrame:
    """One row: ``{col}_lo`` and ``{col}_hi``.  Every method but "iqr" is the z-score."""
    made = []
    if method == "iqr":
        q = ordering.quantiles(df, {x: _missing_to_null(df, x) for x in cols}, [0.25, 0.75])
        for x in cols:
            a, z = F.get(x, F.lit(0)), F.get(x, F.lit(1))
            made += [(a - iqr_factor * (z - a)).alias(f"{x}_lo"), (z + iqr_factor * (z - a)).alias(f"{x}_hi")]
        return q.select(*made)
    for x in cols:
        v = _missing_to_null(df, x)
        made += [(F.avg(v) - zscore_threshold * F.stddev_samp(v)).alias(f"{x}_lo"), (F.avg(v) + zscore_threshold * F.stddev_samp(v)).alias(f"{x}_hi")]
    return df.agg(*made)


def clip_outliers(df: DataFrame, cols: list[str], method: str = "iqr", iqr_factor: float = 3.0, zscore_threshold: float = 4.0) -> DataFrame:
    """Values outside the bounds become the bounds; null stays null, without bounds nothing is clipped."""
    require(df, cols)
    bounds = clip_bounds(df, cols, method, iqr_factor, zscore_threshold)
    joined = df.crossJoin(F.broadcast(bounds))  # one row
    out = {x: F.when(F.col(x).isNotNull(), F.least(F.greatest(F.col(x), F.col(f"{x}_lo")), F.col(f"{x}_hi"))) for x in cols}
    return joined.select(*[out[x].alias(x) if x in out else F.col(x) for x in df.columns])
