"""Outcome bins: bounds read from labels, membership, and the first bin that holds a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from augury.functions.scalars import c

_NUMBER = r"([0-9.]+)"


def contains(value, b: Column) -> Column:
    """Null bounds are open; NaN counts as inside, as comparisons with it never exclude."""
    v = c(value)
    below = (b["lower"].isNotNull()) & ~F.isnan(v) & F.when(F.coalesce(b["lower_inclusive"], F.lit(True)), v < b["lower"]).otherwise(v <= b["lower"])
    above = (b["upper"].isNotNull()) & ~F.isnan(v) & F.when(F.coalesce(b["upper_inclusive"], F.lit(True)), v > b["upper"]).otherwise(v >= b["upper"])
    return ~(below | above)


def winning_label(value, bins) -> Column:
    """The label of the first bin, in list order, that holds the value; null if none does or the value is null."""
    return F.when(c(value).isNotNull(), F.get(F.filter(c(bins), lambda b: contains(value, b)), F.lit(0))["label"])


def first_bins(values: DataFrame, table: DataFrame, keys: list[str], value: str = "value", widths: int = 64) -> DataFrame:
    """``values`` (keys, a number, any columns) with winner: the label of the first bin of the key that holds the number, null if none.

    ``table`` has a row for each bin: keys, pos, label, lower, upper, lower_inclusive,
    upper_inclusive; null bounds are open.  NaN is in every bin, as no comparison excludes
    it.  All bounds of all keys get ranks, which makes a bin a run of places: the bounds
    and the gaps behind them.  A run is cut into few dyadic blocks, a block keeps its first
    bin, and a place the first of the blocks around it.  So a number needs only the bound
    before it, which a range exchange of numbers and bounds into ``widths`` parts or more
    brings beside it: the work grows with numbers and bins, not with how many bins hold a number.
    """
    from augury.operators import ordering

    number = F.col(value).cast("double") + 0.0  # no negative zero
    known = table.dropna(subset=keys).withColumns({b: F.col(b).cast("double") + 0.0 for b in ("lower", "upper")})
    nan = F.lit(float("nan"))
    # a key's places begin at a null bound, below all others, and end at NaN
    points = known.select(*keys, F.explode(F.array("lower", "upper", F.lit(None).cast("double"), nan)).alias("__b")).distinct()
    points = ordering.written(ordering.ranked(points, [*keys, "__b"]))
    levels = max(1, (2 * points.count() + 1).bit_length())
    ends = points.groupBy(*keys).agg(F.min("__rank").alias("__lo"), F.max("__rank").alias("__hi"))
    at = lambda b: points.filter("__b is not null").select(*keys, F.col("__b").alias(b), F.col("__rank").alias(f"__{b}"))
    runs = known.join(ends, keys).join(at("lower"), [*keys, "lower"], "left").join(at("upper"), [*keys, "upper"], "left")
    # bound r is place 2 r, the gap behind it 2 r + 1; of a null bound only the gap is used
    from_ = F.when(F.col("lower").isNull(), F.col("__lo") * 2 + 1).otherwise(F.col("__lower") * 2 + F.when(F.coalesce("lower_inclusive", F.lit(True)), 0).otherwise(1))
    to = F.when(F.col("upper").isNull(), F.col("__hi") * 2).otherwise(F.col("__upper") * 2 - F.when(F.coalesce("upper_inclusive", F.lit(True)), 0).otherwise(1))
    bin_ = F.min(F.struct("pos", F.struct("label", *[F.col(c) for c in ("lower", "upper", "lower_inclusive", "upper_inclusive")]).alias("b"))).alias("bin")
    all_of_key = F.struct((F.col("__hi") * 2).alias("a"), (F.col("__hi") * 2).alias("z"))
    runs = runs.withColumn("__run", F.explode(F.array(F.struct(from_.alias("a"), to.alias("z")), all_of_key)))
    runs = runs.select(F.col("__run.a").alias("a"), (F.col("__run.z") + 1).alias("z"), "pos", "label", "lower", "upper", "lower_inclusive", "upper_inclusive").filter("a < z").groupBy("a", "z").agg(bin_)
    # at level j the blocks from a to z not in a larger one: the first if it is odd, the last if the one behind it is odd
    l, r = "shiftright(a + shiftleft(1L, j) - 1, j)", "shiftright(z, j)"
    block = F.explode(F.expr(f"""flatten(transform(sequence(0, {levels}), j -> filter(array(
        if({l} < {r} and {l} % 2 = 1, named_struct('level', j, 'n', {l}), null), if({l} < {r} and {r} % 2 = 1, named_struct('level', j, 'n', {r} - 1), null)), x -> x is not null)))"""))
    blocks = runs.select("bin", block.alias("x")).groupBy("x.level", "x.n").agg(F.min("bin").alias("bin"))
    place = F.explode(F.array(F.col("__rank") * 2, F.col("__rank") * 2 + 1)).alias("place")
    around = points.select(place).select("place", F.expr(f"explode(transform(sequence(0, {levels}), j -> named_struct('level', j, 'n', shiftright(place, j))))").alias("x")).select("place", "x.level", "x.n")
    first = ordering.written(around.join(blocks.hint("merge"), ["level", "n"]).groupBy("place").agg(F.min("bin")["b"]["label"].alias("label")))
    half = lambda name, odd: first.filter(F.col("place") % 2 == odd).select(F.expr("place div 2").alias("__rank"), F.col("label").alias(name))
    points = points.join(half("on", 0), "__rank", "left").join(half("behind", 1), "__rank", "left")

    own = {k: f"__k{i}" for i, k in enumerate(keys)}
    told = F.struct(*[F.col(k).alias(x) for k, x in own.items()], F.col("__b").alias("v"), "on", "behind")
    row = F.struct(*[F.col(f"`{c}`") for c in values.columns])
    both = values.select(*keys, number.alias("__b"), F.monotonically_increasing_id().alias("__i"), row.alias("__row"))
    both = both.unionByName(points.select(*keys, "__b", F.lit(-1).cast("long").alias("__i"), told.alias("__told")), allowMissingColumns=True)
    order = [*keys, "__b", "__i"]  # a bound comes before its numbers, which their row numbers spread
    parts = max(widths, -(-values.count() // ordering.PART_ROWS))
    dealt = ordering.written(both.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    last = dealt.filter("__told is not null").groupBy("__part").agg(F.max("__told").alias("__told"))
    every = dealt.sparkSession.range(parts).select(F.col("id").cast("int").alias("__part")).join(last, "__part", "left")  # a row for each part
    before = every.select("__part", F.last("__told", ignorenulls=True).over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)).alias("__before"))
    near = F.last("__told", ignorenulls=True).over(W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    out = dealt.withColumn("__near", near).filter("__row is not null").join(F.broadcast(before), "__part").withColumn("__near", F.coalesce("__near", "__before"))
    same = F.lit(True)
    for k, x in own.items():
        same = same & (F.col(k) == F.col("__near")[x])
    equal = F.col("__b") == F.col("__near")["v"]
    winner = F.when(F.col("__b").isNotNull() & same, F.when(equal, F.col("__near")["on"]).otherwise(F.col("__near")["behind"]))
    return out.select(F.col("__row"), winner.alias("winner")).select("__row.*", "winner")


def temperature_bounds(label) -> Column:
    """struct(lower, upper, parse_ok) of a label such as 28-30°C, >35°C, <20°C or 30°C.

    Other labels have no bounds, which holds everything; parse_ok then says no.
    """
    s = F.trim(F.replace(F.replace(c(label), F.lit("°C"), F.lit("")), F.lit("°F"), F.lit("")))
    span, more, less, one = rf"^{_NUMBER}\s*[-–to]+\s*{_NUMBER}", rf"^>=?\s*{_NUMBER}", rf"^<=?\s*{_NUMBER}", rf"^{_NUMBER}$"
    get = lambda p, g: F.regexp_extract(s, p, g).try_cast("double")
    lower = F.when(s.rlike(span), get(span, 1)).when(s.rlike(more), get(more, 1)).when(s.rlike(less), F.lit(None)).when(s.rlike(one), get(one, 1) - 0.5)
    upper = F.when(s.rlike(span), get(span, 2)).when(s.rlike(more), F.lit(None)).when(s.rlike(less), get(less, 1)).when(s.rlike(one), get(one, 1) + 0.5)
    return F.struct(lower.alias("lower"), upper.alias("upper"), F.coalesce(s.rlike(f"{span}|{more}|{less}|{one}"), F.lit(False)).alias("parse_ok"))


def bins_of(labels, parse: bool = True) -> Column:
    """Bins for labels in order; without ``parse`` they have no bounds."""

    def one(x: Column) -> Column:
        b = temperature_bounds(x)
        none = F.lit(None).cast("double")
        return F.struct(x.alias("label"), (b["lower"] if parse else none).alias("lower"), (b["upper"] if parse else none).alias("upper"), F.lit(True).alias("lower_inclusive"), F.lit(True).alias("upper_inclusive"))

    return F.transform(c(labels), one)
