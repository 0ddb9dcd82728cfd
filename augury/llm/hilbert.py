"""Hilbert-curve ordering of rows into shards, with DataFrame functions only.

Several metadata dimensions are quantised at their own quantiles, a row's cell is
numbered along the Hilbert curve through the grid, rows are sorted by that number
and cut into runs of equal counts.  A shard then covers a compact region of the
grid, so minimum and maximum of every dimension prune files.

Rows are numbered without a global window: a range exchange sorts them into
written parts, parts are counted, and a row's rank is its place in its part plus
the counts of the parts before.  The sort key ends in the row's id and checksum,
so a cell that holds a third of all rows still spreads over many parts.

The number of parts grows with the rows, so that no part has many more than a million.
Texts are compared whole: sources or ids that begin alike fall into different buckets.

Nulls of a dimension go to its lowest bucket, a null text has no bytes and
checksum 0, a null id sorts first, ids may be numbers or texts, equal rows get
different slots in any order, and an empty table gives an empty result.
``shard_documents`` does not read other columns; ``write_shards`` keeps them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from augury.llm.common import materialise

#: Rows of a part, about.
PART_ROWS = 1_000_000


def text_cuts(rows: DataFrame, name: str, bits: int, parts: int) -> DataFrame:
    """One row, ``cuts``: the different texts at the 2^bits quantiles of a column, compared whole, in order.

    Distinct texts are counted, sorted into written parts by a range exchange and added up;
    a text is a cut if a quantile's place lies among its rows.
    """
    counts = rows.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("__text")).agg(F.count("*").alias("__many"))
    dealt = materialise(counts.repartitionByRange(parts, "__text").withColumn("__part", F.spark_partition_id()))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # a row for each part
    whole = W.orderBy("__part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sums = dealt.groupBy("__part").agg(F.sum("__many").alias("__n"))
    sums = sums.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(whole).alias("__all"))
    upto = F.sum("__many").over(W.partitionBy("__part").orderBy("__text"))
    told = dealt.withColumn("__upto", upto).join(F.broadcast(sums), "__part").withColumn("__upto", F.col("__upto") + F.col("__before"))
    place = lambda n: F.least(F.floor(n / F.col("__all") * 2**bits), F.lit(2**bits - 1))
    # at most 2^bits - 1 texts
    return told.filter(place(F.col("__upto")) > place(F.col("__upto") - F.col("__many"))).agg(F.sort_array(F.collect_list("__text")).alias("cuts"))


def cell(value: Column, cuts: Column, bits: int) -> Column:
    """How many of the cut points lie below the value, stretched to 0 to 2^bits - 1: a dimension of few values counts as much as others."""
    return F.call_function("div", F.size(F.filter(cuts, lambda x: x < value)) * (2**bits - 1), F.greatest(F.size(cuts), F.lit(1))).cast("long")


def curve_index(axes: list[Column], bits: int) -> Column:
    """The place on the Hilbert curve of a cell with these coordinates, 0 to 2^bits - 1 each.

    Works from the highest bit down: each level undoes the rotation and reflection
    that the curve has made so far, then a Gray code turns the levels into a number.
    """
    n = len(axes)
    steps = F.expr(f"transform(sequence(0, {(bits - 1) * n - 1}), s -> named_struct('q', shiftleft(1L, cast({bits - 1} - s div {n} as int)), 'i', s % {n}))") if bits > 1 else F.expr("cast(array() as array<struct<q:bigint,i:int>>)")

    def turn(x: Column, s: Column) -> Column:
        q, i = s["q"], s["i"]
        low, first, own = q - 1, x[0], F.get(x, i)
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        flip = own.bitwiseAND(q) != 0
        head = F.when(flip, first.bitwiseXOR(low)).otherwise(first.bitwiseXOR(swap))
        return F.transform(x, lambda v, k: F.when(k == 0, head).when((k == i) & ~flip, v.bitwiseXOR(swap)).otherwise(v))

    turned = F.aggregate(steps, F.array(*[a.cast("long") for a in axes]), turn)
    # Gray decoding along the axes, then along the levels
    chained = F.aggregate(
        F.sequence(F.lit(1), F.lit(n - 1)), turned, lambda x, i: F.transform(x, lambda v, k: F.when(k == i, v.bitwiseXOR(F.get(x, i - 1))).otherwise(v))
    ) if n > 1 else turned
    levels = F.expr(f"transform(sequence(1, {bits - 1}), s -> shiftleft(1L, {bits} - s))") if bits > 1 else F.expr("cast(array() as array<bigint>)")

    def spread(x: Column) -> Column:
        last = x[n - 1]
        t = F.aggregate(levels, F.lit(0).cast("long"), lambda acc, q: F.when(last.bitwiseAND(q) != 0, acc.bitwiseXOR(q - 1)).otherwise(acc))
        return F.transform(x, lambda v: v.bitwiseXOR(t))

    places = F.expr(f"sequence(0, {bits * n - 1})")
    # one array element in, one number out: the lambda keeps the expression from doubling
    number = F.transform(
        F.transform(F.array(chained), spread),
        lambda x: F.aggregate(
            places,
            F.lit(0).cast("long"),
            lambda acc, s: acc * 2 + F.when(F.get(x, s % n).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(bits - 1) - F.floor(s / n).cast("int"))) != 0, 1).otherwise(0),
        ),
    )
    return F.get(number, F.lit(0))


def ordered_parts(rows: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """Rows with a rank 0, 1, 2 ... along ``keys``, and n_rows, the number of all.

    The range exchange is written before it is counted: a part is then fixed.
    """
    dealt = materialise(rows.repartitionByRange(parts, *keys).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy("__part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    counts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(whole).alias("n_rows"))
    place = F.row_number().over(W.partitionBy("__part").orderBy(*keys)).cast("long") - 1
    # one row for each part, a number that the caller sets
    return dealt.withColumn("__place", place).join(F.broadcast(counts), "__part").withColumn("rank", F.col("__place") + F.col("__before")).drop("__part", "__place", "__before")


def hilbert_order(rows: DataFrame, dimensions: list[str], keys: list[str], bits: int = 5, parts: int | None = None) -> DataFrame:
    """``rows`` with curve (its place on the curve), rank and n_rows.

    dimensions: integer or text columns, quantised at their own 2^bits quantiles over all rows.
    """
    if len(dimensions) * bits > 62:
        raise ValueError("dimensions times bits must be 62 or less")
    rows = materialise(rows)
    if parts is None:
        parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_ROWS))
    at = [i / 2**bits for i in range(1, 2**bits)]
    texts = {d for d in dimensions if rows.schema[d].dataType.simpleString() == "string"}
    numbers = [F.percentile_approx(d, at, 10_000).alias(f"__cut_{i}") for i, d in enumerate(dimensions) if d not in texts]
    cuts = rows.agg(F.count("*").alias("__cut_rows"), *numbers)
    for i, d in enumerate(dimensions):
        if d in texts:
            cuts = cuts.crossJoin(F.broadcast(text_cuts(rows, d, bits, parts).withColumnRenamed("cuts", f"__cut_{i}")))  # a row each

    def axis(i: int, d: str) -> Column:
        if d in texts:
            return cell(F.col(d), F.col(f"__cut_{i}"), bits)
        return cell(F.coalesce(F.col(d), F.lit(-1).cast("long")), F.coalesce(F.array_distinct(F.col(f"__cut_{i}")), F.expr("cast(array() as array<bigint>)")), bits)

    # one row of cut points
    cells = rows.crossJoin(F.broadcast(cuts)).withColumn("curve", curve_index([axis(i, d) for i, d in enumerate(dimensions)], bits))
    cells = cells.drop("__cut_rows", *[f"__cut_{i}" for i in range(len(dimensions))])
    return ordered_parts(cells, ["curve", *keys], parts)


def cut_runs(ranked: DataFrame, shards: int) -> DataFrame:
    """Shard and slot by rank: shard s takes ranks floor(s n / shards) on; counts are at most one apart."""
    shard = F.expr(f"cast((rank * {shards} + {shards} + n_rows - 1) div n_rows - 1 as bigint)")
    return ranked.withColumn("__s", shard).withColumn("slot", F.expr(f"rank - (__s * n_rows) div {shards}")).withColumn("shard", F.col("__s").cast("int")).drop("__s", "rank", "n_rows")


#: Dimensions of a document, and what orders it inside a cell.
DIMENSIONS, KEYS = ["__lang", "__source", "__size", "__id"], ["__key", "__crc", "__size"]


def _measured(docs: DataFrame) -> list[Column]:
    """Language, source, size and id as dimensions, the id itself and the text's checksum."""
    text, id_ = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id")
    return [
        F.col("lang").cast("string").alias("__lang"),
        F.col("source").cast("string").alias("__source"),
        (F.octet_length(text).cast("long") + 16).alias("__size"),
        (id_ if docs.schema["doc_id"].dataType.simpleString() == "string" else id_.cast("long")).alias("__id"),
        id_.alias("__key"),
        F.crc32(F.encode(text, "UTF-8")).alias("__crc"),
    ]


def shard_documents(docs: DataFrame, shards: int = 40, bits: int = 5, parts: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, curve, shard and slot for each document.

    Dimensions are language, source, size and id.
    """
    ranked = hilbert_order(docs.select(*_measured(docs)), DIMENSIONS, KEYS, bits, parts)
    return cut_runs(ranked, shards).select(F.col("__key").alias("doc_id"), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), "curve", "shard", "slot")


def write_shards(docs: DataFrame, folder: str, shards: int = 40, bits: int = 5, parts: int | None = None) -> None:
    """Write ``docs``, all columns, to Parquet folders ``__shard=0, 1 ...``, each a run of the curve.

    A file holds a piece of one run in the curve's order, so that the minimum and maximum
    that Parquet keeps of language, source, size or id let a filter skip most files.
    """
    ranked = hilbert_order(docs.select(F.struct(*docs.columns).alias("__row"), *_measured(docs)), DIMENSIONS, KEYS, bits, parts)
    placed = cut_runs(ranked, shards).withColumnRenamed("shard", "__shard")
    placed.sortWithinPartitions("__shard", "slot").select("__row.*", "__shard").write.partitionBy("__shard").parquet(folder)
