"""Connected components of a links table, by alternating large and small stars.

Each round is joins and minima over the links; no node's neighbours are gathered,
so a node with very many links is an ordinary skewed join.  Every round is written
to the shared folder, which cuts the lineage, and the round before is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augury.llm.common import discard, materialise


def connected_components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, root) for every node of ``links`` (columns u and v, longs): root is the smallest node reachable.

    Null ends and self-links are ignored, repeated links count once, and an empty
    table gives an empty result.
    """
    e = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    old: list[str] = []
    e = materialise(e, old)
    seen = None
    for _ in range(most_rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        seen = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        new: list[str] = []
        e = materialise(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), new)
        discard(e.sparkSession, old)
        old = new
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
