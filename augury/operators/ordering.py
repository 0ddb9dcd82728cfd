"""A global order without a global window: rows are numbered, and framed, part by part."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from augury.sources import files

#: Rows of a part or a chunk, about.
PART_ROWS = 1_000_000
#: Rows of a chunk that Python holds, about; of a long frame four times its rows.
SLIDE_ROWS = 100_000


def written(df: DataFrame) -> DataFrame:
    """``df`` by way of Parquet in the shared folder, which cuts the lineage."""
    path = files.scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """``df`` with __rank 0, 1, 2 ... along ``keys``, which should end in a unique column.

    A range exchange sorts rows into parts and is written, so that a part is fixed; a
    row's rank is its place in its part plus the counts of the parts before.
    """
    if parts is None:
        parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // PART_ROWS))
    dealt = written(df.repartitionByRange(parts, *keys).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # a row for each part
    counts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(W.partitionBy("__part").orderBy(*keys)) - 1
    return dealt.withColumn("__place", place).join(F.broadcast(counts), "__part").withColumn("__rank", F.col("__place") + F.col("__before")).drop("__part", "__place", "__before")


def has_long_group(df: DataFrame, group_by: str, rows: int | None = None) -> bool:
    """Whether a group is too long for one task: over ``rows`` rows (``PART_ROWS``), null being a group; reads this column alone."""
    return not df.groupBy(group_by).agg(F.count("*").alias("n")).filter(F.col("n") > (rows or PART_ROWS)).isEmpty()


def framed(df: DataFrame, group_by: str | None, order_by: list[str], back: int, ahead: int, make: Callable[[WindowSpec], dict[str, Column]], rows: int | None = None) -> DataFrame:
    """Columns of windows that look at most ``back`` rows back and ``ahead`` rows on, over groups of any size.

    Rows are numbered by group and order and cut into chunks of ``rows``; a chunk also gets
    the last rows of the one before and the first of the one behind, as its frames need.
    """
    rows = max(rows or PART_ROWS, back, ahead, 1)
    groups = [group_by] if group_by else []
    r = ranked(df, [*groups, *order_by]).withColumn("__chunk", F.expr(f"__rank div {rows}"))
    place = F.col("__rank") % rows
    to = F.array(F.col("__chunk"), F.when(place >= rows - back, F.col("__chunk") + 1), F.when(place < ahead, F.col("__chunk") - 1))
    r = r.withColumn("__to", F.explode(F.filter(to, lambda x: x.isNotNull())))
    w = W.partitionBy("__to", *groups).orderBy("__rank")
    return r.withColumns(make(w)).filter("__to = __chunk").drop("__rank", "__chunk", "__to")


def sliding_medians(df: DataFrame, cols: dict[str, tuple[str, int]], group_by: str | None, order_by: list[str], least: int = 1, rows: int | None = None) -> DataFrame:
    """``df`` with a median over the last n rows for each name of ``cols`` (column, n), for frames and groups of any length.

    Rows are dealt as in ``framed``; a task slides an ordered structure along its chunk, so
    that a row costs the logarithm of its frame, not the frame.  Python holds one chunk a
    task, so chunks are shorter than those of window functions.
    """
    back = max(n for _, n in cols.values())
    rows = max(rows or max(SLIDE_ROWS, 4 * back), back, 1)
    groups = [group_by] if group_by else []
    r = ranked(df, [*groups, *order_by]).withColumn("__chunk", F.expr(f"__rank div {rows}"))
    to = F.array(F.col("__chunk"), F.when(F.col("__rank") % rows >= rows - back, F.col("__chunk") + 1))
    r = r.withColumn("__to", F.explode(F.filter(to, lambda x: x.isNotNull())))
    values = {name: f"__v{k}" for k, name in enumerate(cols)}
    r = r.withColumns({values[name]: F.col(c).cast("double") for name, (c, _) in cols.items()})
    slim = r.select("__to", "__chunk", "__rank", *[F.col(g).alias("__g") for g in groups], *values.values())

    def slide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__rank")
        out = {"__rank": pdf["__rank"]}
        by = pdf.groupby("__g", sort=False, dropna=False) if groups else None
        for name, (_, n) in cols.items():
            rolled = (by[values[name]] if groups else pdf[values[name]]).rolling(n, min_periods=max(least, 1)).median()
            out[name] = rolled.droplevel(0).reindex(pdf.index) if groups else rolled
        own = pdf["__chunk"] == pdf["__to"]
        return pd.DataFrame(out)[own].astype({"__rank": "int64"})

    found = slim.groupBy("__to").applyInPandas(slide, "__rank long, " + ", ".join(f"`{n}` double" for n in cols))
    found = found.select("__rank", *[F.when(~F.isnan(n), F.col(f"`{n}`")).alias(n) for n in cols])
    return r.filter("__to = __chunk").drop("__to", "__chunk", *values.values()).join(found, "__rank").drop("__rank")


def quantiles(df: DataFrame, cols: dict[str, Column], probs: list[float], accuracy: int = 100_000) -> DataFrame:
    """One row: for each name of ``cols`` an array of the exact quantiles, linearly interpolated; null without values.

    A sketch gives a bracket around each; then values in a bracket are counted (equal ones
    as one row), and those at the quantile's two ranks are picked.
    """
    names, d = list(cols), 2 / accuracy
    at = [x for p in probs for x in (max(0.0, p - d), min(1.0, p + d))]
    v = df.select(*[c.cast("double").alias(n) for n, c in cols.items()])
    cuts = v.agg(*[F.percentile_approx(n, at, accuracy).alias(f"__cut_{n}") for n in names], *[F.count(n).alias(f"__n_{n}") for n in names])
    cuts = written(cuts)  # a row
    asked = [(n, k, p) for n in names for k, p in enumerate(probs)]
    one = v.crossJoin(F.broadcast(cuts))
    edge = {(n, k): (F.get(f"__cut_{n}", F.lit(2 * k)), F.get(f"__cut_{n}", F.lit(2 * k + 1))) for n, k, _ in asked}
    # of what lies below a bracket the number and the greatest value, of what lies above the least: a rank may be one off its edge
    outside = one.agg(*[x for n, k, _ in asked for x in (
        F.count_if(F.col(n) < edge[n, k][0]).alias(f"__b_{n}_{k}"), F.max(F.when(F.col(n) < edge[n, k][0], F.col(n))).alias(f"__l_{n}_{k}"), F.min(F.when(F.col(n) > edge[n, k][1], F.col(n))).alias(f"__a_{n}_{k}"))])
    cell = lambda n, k, zone, value, many: F.struct(F.lit(n).alias("name"), F.lit(k).alias("k"), F.lit(zone).alias("zone"), value.alias("v"), many.cast("long").alias("many"))
    inside = F.array(*[F.when(F.col(n).between(*edge[n, k]), cell(n, k, 1, F.col(n), F.lit(1))) for n, k, _ in asked])
    found = one.select(F.explode(F.filter(inside, lambda x: x.isNotNull())).alias("x")).select("x.*").groupBy("name", "k", "zone", "v").agg(F.sum("many").alias("many"))
    ends = F.array(*[x for n, k, _ in asked for x in (cell(n, k, 0, F.col(f"__l_{n}_{k}"), F.col(f"__b_{n}_{k}")), cell(n, k, 2, F.col(f"__a_{n}_{k}"), F.lit(1)))])
    found = found.unionByName(outside.select(F.explode(ends).alias("x")).select("x.*").filter("v is not null"))
    share_of = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("k"), F.lit(p).alias("p"), F.col(f"__n_{n}").alias("n")) for n, k, p in asked])
    found = found.join(F.broadcast(cuts.select(F.explode(share_of).alias("x")).select("x.*")), ["name", "k"])  # a row for each quantile
    upto = F.sum("many").over(W.partitionBy("name", "k").orderBy("zone", "v"))
    rank = F.col("p") * (F.col("n") - 1)
    found = found.withColumn("upto", upto).withColumn("rank", rank)
    first, second = (F.min(F.when(F.col("upto") > F.floor("rank") + i, F.col("v"))) for i in (0, 1))
    share = F.first(F.col("rank") - F.floor("rank"))
    q = found.groupBy("name", "k").agg((first + F.when(share > 0, share * (second - first)).otherwise(0.0)).alias("q"))
    return q.agg(*[F.array(*[F.max(F.when((F.col("name") == n) & (F.col("k") == k), F.col("q"))) for k in range(len(probs))]).alias(n) for n in names])
