"""Isotonic calibration by blocks that merge: pool adjacent violators in range parts, then over the parts' blocks.

A block is a run of scores with one value, the mean of their truths.  Pooling blocks again
gives what pooling their rows at once gives, in whatever groups of neighbours it is done, so
parts meet a few at a time until one is left.  For truths of 0 and 1 the blocks' means are
different fractions, so n rows have at most about n^(2/3) blocks: a million for a billion rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augury.functions.scalars import clip01
from augury.operators.ordering import PART_ROWS, ranked, written

BLOCK = "part long, lo double, hi double, n long, t double"
#: Parts whose blocks meet in one task.
FAN_IN = 8
#: Knots that may be broadcast: 16 MB.
MOST_KNOTS = 1_000_000


def pool(pdf: pd.DataFrame) -> pd.DataFrame:
    """Neighbouring blocks whose means do not rise become one."""
    pdf = pdf.sort_values("lo")
    out: list[list] = []
    for lo, hi, n, t in zip(*(pdf[c].tolist() for c in ("lo", "hi", "n", "t")), strict=True):
        while out and out[-1][3] / out[-1][2] >= t / n:
            first = out.pop()
            lo, n, t = first[0], n + first[2], t + first[3]
        out.append([lo, hi, n, t])
    return pd.DataFrame([[pdf["part"].iloc[0], *b] for b in out], columns=["part", "lo", "hi", "n", "t"])


def pooled_blocks(df: DataFrame, prob: str, truth: str, parts: int | None = None) -> DataFrame:
    """The blocks (lo, hi, n, t) of the isotonic fit; rows without a score or a truth are left out."""
    p, y = F.col(prob).cast("double"), F.col(truth).cast("double")
    rows = df.select((p + 0.0).alias("lo"), y.alias("y")).filter("lo is not null and not isnan(lo) and y is not null and not isnan(y)")
    points = written(rows.groupBy("lo").agg(F.count("*").alias("n"), F.sum("y").alias("t")))
    if parts is None:
        parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-points.count() // PART_ROWS))
    dealt = points.repartitionByRange(parts, "lo").select(F.spark_partition_id().cast("long").alias("part"), "lo", F.col("lo").alias("hi"), "n", "t")
    blocks = written(written(dealt).groupBy("part").applyInPandas(pool, BLOCK))
    while parts > 1:
        blocks = written(blocks.withColumn("part", F.expr(f"part div {FAN_IN}")).groupBy("part").applyInPandas(pool, BLOCK))
        parts = -(-parts // FAN_IN)
    return blocks.drop("part")


def interpolated(df: DataFrame, blocks: DataFrame, prob: str, out: str, most_knots: int = MOST_KNOTS) -> DataFrame:
    """``df`` with the fit's value at each score: a block's own, between blocks on the line from one to the next, outside the ends' values.

    The blocks' ends are broadcast while there are at most ``most_knots``.  Beyond, runs of them
    are rows, their first scores are broadcast, and a score is joined with its run.
    """
    value = F.col("t") / F.col("n")
    knots = written(blocks.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("x"), value.alias("v")))
    many, sc = knots.count(), df.sparkSession.sparkContext
    score = F.col(prob).cast("double")
    if many <= most_knots:
        found = knots.orderBy("x").toPandas()  # at most most_knots
        sent = sc.broadcast((found["x"].to_numpy(), found["v"].to_numpy()))

        @F.pandas_udf("double")
        def at(x: pd.Series) -> pd.Series:
            return pd.Series(np.interp(x, *sent.value), index=x.index).where(x.notna(), None)

        return df.withColumn(out, at(score))
    run = max(64, -(-many // most_knots))
    numbered = ranked(knots, ["x"]).withColumn("__run", F.expr(f"__rank div {run}"))
    # a run also has the first knot of the one behind
    to = F.explode(F.filter(F.array(F.col("__run"), F.when(F.col("__rank") % run == 0, F.col("__run") - 1)), lambda r: r.isNotNull() & (r >= 0)))
    runs = written(numbered.select(to.alias("__run"), "x", "v").groupBy("__run").agg(F.sort_array(F.collect_list(F.struct("x", "v"))).alias("__knots")))
    first = runs.select("__run", F.col("__knots")[0]["x"].alias("x")).orderBy("__run").toPandas()  # at most most_knots, or a 64th of all
    edges = sc.broadcast(first["x"].to_numpy())

    @F.pandas_udf("long")
    def run_of(x: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(np.searchsorted(edges.value, x.fillna(-np.inf), side="right") - 1, 0), index=x.index)

    below = F.element_at(F.filter("__knots", lambda k: k["x"] <= score), -1)
    above = F.get(F.filter("__knots", lambda k: k["x"] >= score), F.lit(0))
    a, b = F.col("__a"), F.col("__b")
    line = a["v"] + (b["v"] - a["v"]) * (score - a["x"]) / (b["x"] - a["x"])
    got = F.when(score.isNull() | F.isnan(score), None).when(a.isNull(), b["v"]).when(b.isNull() | (a["x"] == b["x"]), a["v"]).otherwise(line)
    joined = df.withColumn("__run", run_of(score)).join(runs, "__run", "left")
    safe = F.when(F.exists("__knots", lambda k: k["x"] <= score), below)
    return joined.withColumn("__a", safe).withColumn("__b", above).withColumn(out, got).drop("__run", "__knots", "__a", "__b")


class IsotonicCalibrator:
    """Monotone map from raw to calibrated probabilities, clipped to 0 to 1; a score that is null or NaN has no value."""

    def __init__(self):
        self.blocks: DataFrame | None = None

    def fit(self, df: DataFrame, prob: str = "y_prob", truth: str = "y_true", parts: int | None = None) -> IsotonicCalibrator:
        blocks = pooled_blocks(df, prob, truth, parts)
        if blocks.isEmpty():
            raise ValueError("no row has a score and a truth")
        self.blocks = blocks
        return self

    def transform(self, df: DataFrame, prob: str = "y_prob", most_knots: int = MOST_KNOTS) -> DataFrame:
        """``df`` with calibrated."""
        if self.blocks is None:
            raise RuntimeError("fit the calibrator before using it")
        return interpolated(df, self.blocks, prob, "calibrated", most_knots).withColumn("calibrated", clip01("calibrated"))

    def save(self, path: str) -> None:
        if self.blocks is None:
            raise RuntimeError("fit the calibrator before saving")
        self.blocks.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, path: str) -> IsotonicCalibrator:
        out = cls()
        out.blocks = SparkSession.active().read.parquet(path)
        return out
