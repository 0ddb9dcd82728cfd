"""Exact length histogram: what any context limit costs, from one pass over the texts.

Documents are aggregated by encoded length.  Suffix sums over the distinct lengths
then answer totals, quantiles and truncated totals for every limit at once.  The
suffix sums run in two levels (inside blocks of lengths, then over blocks), so no
task holds more than one block of distinct lengths or the short list of blocks.

A null or empty text has length 0; repeated rows count each; an empty table gives
an empty histogram; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from augury.llm.common import map_rows, materialise
from augury.llm.tokens import Encoder, default_vocabulary

BLOCK = 1024


def lengths(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per document: n_tokens."""
    path = vocabulary or default_vocabulary()

    def make():
        encoder = Encoder.of(path)
        return lambda c: ((len(ids) // 4,) for ids in encoder.each(c[0]))

    return map_rows(docs, ["text"], "n_tokens long", make)


def histogram(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    return lengths(docs, vocabulary).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def context_table(hist: DataFrame) -> DataFrame:
    """For every distinct length L, taken as a context limit: what is kept and cut.

    docs_at_least and tokens_at_least are suffix sums from L on; truncated_total is
    the sum of min(length, L); docs_over counts documents that lose tokens;
    quantile, docs_at_most / docs_total, is the share of documents that fit whole.  The histogram is written
    first, since blocks and lengths both read it and each reading would encode anew.
    """
    h = materialise(hist).select(
        F.col("n_tokens").alias("context_limit"), "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("n_tokens_here"), F.expr(f"n_tokens div {BLOCK}").alias("block")
    )
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("n_tokens_here").alias("bt"))
    later = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy("block").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    zero = F.lit(0).cast("long")
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("bd").over(later), zero).alias("later_docs"),
        F.coalesce(F.sum("bt").over(later), zero).alias("later_tokens"),
        F.sum("bd").over(whole).alias("docs_total"),
        F.sum("bt").over(whole).alias("tokens_total"),
    )
    inside = W.partitionBy("block").orderBy(F.desc("context_limit")).rowsBetween(W.unboundedPreceding, 0)
    out = h.join(blocks, "block").select(
        "context_limit",
        "n_docs",
        (F.sum("n_docs").over(inside) + F.col("later_docs")).alias("docs_at_least"),
        (F.sum("n_tokens_here").over(inside) + F.col("later_tokens")).alias("tokens_at_least"),
        "docs_total",
        "tokens_total",
    )
    return out.select(
        "*",
        (F.col("docs_at_least") - F.col("n_docs")).alias("docs_over"),
        (F.col("docs_total") - F.col("docs_at_least") + F.col("n_docs")).alias("docs_at_most"),
        ((F.col("docs_total") - F.col("docs_at_least") + F.col("n_docs")) / F.col("docs_total")).alias("quantile"),
        (F.col("tokens_total") - F.col("tokens_at_least") + F.col("context_limit") * F.col("docs_at_least")).alias("truncated_total"),
    )


def quantiles(table: DataFrame, probs: list[float]) -> DataFrame:
    """prob and context_limit: the least length that at least this share of the documents does not exceed; exact."""
    asked = F.array(*[F.struct(F.lit(float(p)).alias("prob")) for p in probs])
    far = table.select("context_limit", F.inline(F.filter(asked, lambda p: F.col("docs_at_most") >= p["prob"] * F.col("docs_total"))))
    return far.groupBy("prob").agg(F.min("context_limit").alias("context_limit"))


def truncated_totals(table: DataFrame, limits: DataFrame) -> DataFrame:
    """truncated_total for any limits (column context_limit), whether a document has that length or not.

    The suffix sums at the next distinct length answer for limits between lengths.
    Both sides are interleaved and the next length is carried back, in two levels.
    """
    total = table.agg(F.max("tokens_total").alias("t"))
    both = table.select("context_limit", F.struct("docs_at_least", "tokens_at_least").alias("s"), F.lit(False).alias("asked")).unionByName(
        limits.select(F.col("context_limit").cast("long"), F.lit(None).cast("struct<docs_at_least:bigint,tokens_at_least:bigint>").alias("s"), F.lit(True).alias("asked"))
    )
    both = both.withColumn("block", F.expr(f"context_limit div {BLOCK}"))
    first = both.groupBy("block").agg(F.min_by("s", F.when(F.col("s").isNotNull(), F.col("context_limit"))).alias("s0"))
    first = first.select("block", F.first("s0", ignorenulls=True).over(W.orderBy("block").rowsBetween(1, W.unboundedFollowing)).alias("s1"))
    inside = W.partitionBy("block").orderBy("context_limit", "asked").rowsBetween(0, W.unboundedFollowing)
    # an asked limit that equals a length sorts behind it: look back at equal lengths too
    same = W.partitionBy("block", "context_limit")
    out = both.select("*", F.first("s", ignorenulls=True).over(inside).alias("next"), F.max("s").over(same).alias("equal")).filter("asked")
    got = F.coalesce(F.col("equal"), F.col("next"), F.col("s1"))
    out = out.join(first, "block", "left").crossJoin(F.broadcast(total))  # one row
    docs, tokens = F.coalesce(got["docs_at_least"], F.lit(0)), F.coalesce(got["tokens_at_least"], F.lit(0))
    return out.select("context_limit", (F.coalesce(F.col("t"), F.lit(0)) - tokens + F.col("context_limit") * docs).alias("truncated_total"))
