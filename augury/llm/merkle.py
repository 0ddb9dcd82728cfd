"""Merkle manifest of a dataset: a trie over exact ranks, one subtree for each group, and proofs.

Each row is a leaf, the digest of its columns.  A row's rank inside its group (source) by
its id is found without a sort of the group: rows are counted for each prefix of the id's
digits (base 256), longer prefixes are rolled up into shorter ones, and sums of counts run
down again, inside one parent at a time, so that no window holds more than 256 counts.
Different rows of one id go by the digits of their leaves in the same way.

A rank's base-16 digits are a leaf's path in a trie.  Nodes are reduced from the longest
prefixes on: the children of a node become its digest, until a group has one node, its
subroot.  Subroots, by group, make the root in the same way.  Going down again, each node
hands its children the siblings on their way to the root, so a proof costs each leaf the
siblings of its own node only.

Null ids come first, as the least integer; rows of equal id go by their leaf digest, and
equal rows, whose leaves are equal, take ranks next to each other.  A null group is a group
of its own and the first.  A null value enters a digest as ``-``.  An empty table has no
rows and, as its root, the digest of nothing.  Ids must be integers; other columns of the
table, whatever their names, take no part.  Ids spread over all of 64 bits cost more rounds
of counts than dense ones, not larger ones.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from augury.llm.common import discard, materialise
from augury.operators.ordering import ranked

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT_BITS = 4
FANOUT = 1 << FANOUT_BITS
#: Bits of a digit of the histograms: a window has at most so many counts, 2 ** 8.
DIGIT_BITS = 8
#: Equal rows that one task numbers; more are dealt out first.
RUN = 4096
#: Hexadecimal signs of a digest.
HEX = 64


def sealed(values: list[Column]) -> Column:
    """The digest of a row: of each value its UTF-8 byte count, a colon and itself, or ``-``."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass
class Manifest:
    """levels[k] has the nodes over 16 ** (k + 1) ranks: grp, size, node, kids, digest; roots likewise over the groups."""

    levels: list[DataFrame]
    roots: list[DataFrame]
    subroots: DataFrame  # grp, subroot
    root: str
    made: list[str] = field(default_factory=list)


def _up(size: Column, level: int) -> Column:
    """Nodes at a level of a group of ``size`` leaves."""
    return F.ceil(size / F.lit(float(FANOUT**level)))


def rank_starts(counts: DataFrame, groups: list[str], key: str, bits: int, within: list[str]) -> DataFrame:
    """``counts`` (n rows for each of its rows) with how many rows of the group stand before (start) and are in it (size).

    ``key`` is an unsigned integer of at most ``bits`` bits, by which rows stand; rows
    alike but for the last digit go by ``within``, which tells them apart.
    """
    tall = max(1, -(-bits // DIGIT_BITS))
    levels = [counts]
    for _ in range(1, tall):
        levels.append(levels[-1].groupBy(*groups, F.shiftrightunsigned(key, DIGIT_BITS).alias(key)).agg(F.sum("n").alias("n")))
    above = None
    for level in reversed(range(tall)):
        here = levels[level]
        if above is None:
            w = W.partitionBy(*groups)
            here = here.withColumn("size", F.sum("n").over(w)).withColumn("__from", F.lit(0).cast("long"))
        else:
            here = here.withColumn("__up", F.shiftrightunsigned(key, DIGIT_BITS))
            here = here.join(above.select(*groups, F.col(key).alias("__up"), F.col("start").alias("__from"), "size"), [*groups, "__up"])
            w = W.partitionBy(*groups, "__up")
        w = w.orderBy(*(within if level == 0 else [key])).rowsBetween(W.unboundedPreceding, -1)
        above = here.withColumn("start", F.col("__from") + F.coalesce(F.sum("n").over(w), F.lit(0))).drop("__from", "__up")
    return above


def ranks(leaves: DataFrame, made: list[str]) -> DataFrame:
    """A row for each row of ``leaves`` (grp, key, doc_id, leaf, told): grp, size, pos, doc_id, leaf, told."""
    ids = materialise(leaves.groupBy("grp", "key").agg(F.count("*").alias("n"), F.min("leaf").alias("leaf"), F.max("leaf").alias("last"), F.max("told").alias("told"), F.max("doc_id").alias("doc_id")), made)
    # one row
    low, high, most, several = ids.agg(F.min("key"), F.max("key"), F.max("n"), F.count_if(F.col("leaf") != F.col("last"))).first()
    if most is None:
        return leaves.select("grp", F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("pos"), "doc_id", "leaf", "told")
    bits = 64 if low < 0 <= high else (low ^ high).bit_length()  # the higher bits are the same everywhere
    placed = rank_starts(ids, ["grp"], "key", bits, ["key"])
    entries = placed
    if several:
        placed = materialise(placed, made)
        entries = placed.filter("leaf = last")
        again = placed.filter("leaf <> last").select("grp", "key", F.col("start").alias("first"), F.col("size").alias("whole"))
        found = leaves.join(again.select("grp", "key"), ["grp", "key"], "left_semi").groupBy("grp", "key", "leaf").agg(F.count("*").alias("n"), F.max("told").alias("told"), F.max("doc_id").alias("doc_id"))
        found = materialise(found, made)
        crowd = found.groupBy("grp", "key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        bits = min(60, max(DIGIT_BITS, crowd.bit_length()))
        found = found.withColumn("own", F.shiftrightunsigned(F.conv(F.substring("leaf", 1, 15), 16, 10).cast("long"), 60 - bits))
        found = rank_starts(found, ["grp", "key"], "own", bits, ["leaf"]).drop("size").join(again, ["grp", "key"])
        found = found.withColumn("start", F.col("start") + F.col("first")).withColumnRenamed("whole", "size")
        cols = ["grp", "size", "start", "n", "doc_id", "leaf", "told"]
        entries = entries.select(*cols).unionByName(found.select(*cols))
    entries = entries.select("grp", "size", "start", "n", "doc_id", "leaf", "told")
    if most == 1:
        return entries.withColumnRenamed("start", "pos").drop("n")
    if most > RUN:
        runs = entries.withColumn("run", F.expr(f"explode(sequence(0L, (n - 1) div {RUN}))"))
        runs = runs.withColumns({"start": F.expr(f"start + run * {RUN}"), "n": F.expr(f"least(n - run * {RUN}, {RUN}L)")}).drop("run")
        entries = runs.repartition("grp", "start")
    return entries.withColumn("pos", F.expr("explode(sequence(start, start + n - 1))")).drop("start", "n")


def climb(rows: DataFrame, most: int, carried: list[str], made: list[str]) -> list[DataFrame]:
    """The levels over ``rows`` (grp, size, pos, digest and what is carried); a lone row is its own node. ``most``: the greatest size."""
    levels: list[DataFrame] = []
    while not levels or -(-most // FANOUT ** len(levels)) > 1:
        if levels:
            rows = levels[-1].filter(_up(F.col("size"), len(levels)) > 1).select("grp", "size", F.col("node").alias("pos"), "digest")
            carried = []
        kid = F.struct((F.col("pos") % FANOUT).cast("int").alias("at"), "digest", *carried)
        nodes = rows.groupBy("grp", "size", F.shiftright("pos", FANOUT_BITS).alias("node")).agg(F.sort_array(F.collect_list(kid)).alias("kids"))
        own = F.sha2(F.array_join("kids.digest", ""), 256)
        levels.append(materialise(nodes.withColumn("digest", F.when(F.col("size") > 1, own).otherwise(F.element_at("kids.digest", 1))), made))
    return levels


def build(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "source", by: str = "doc_id", told: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs``. ``told`` names columns as a doubtful copy tells them; each leaf keeps that copy's digest too."""
    if not isinstance(docs.schema[by].dataType, T.IntegralType):
        raise ValueError(f"{by} must be an integer")
    made: list[str] = []
    leaf = sealed([F.col(f"`{c}`") for c in columns])
    other = sealed([(told or {}).get(c, F.col(f"`{c}`")) for c in columns]) if told else leaf
    least = F.lit(-(2**63)).cast("long")
    leaves = materialise(
        docs.select(
            F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0")).alias("grp"),
            F.coalesce(F.col(by).cast("long"), least).bitwiseXOR(least).alias("key"),
            F.col(by).cast("long").alias("doc_id"), leaf.alias("leaf"), other.alias("told"),
        ), made,
    )
    rows = ranks(leaves, made).withColumnRenamed("leaf", "digest")
    most = leaves.groupBy("grp").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    levels = climb(rows, most, ["doc_id", "told"], made)
    tops = [x.filter(_up(F.col("size"), k + 1) <= 1).select("grp", F.col("digest").alias("subroot")) for k, x in enumerate(levels)]
    subroots = tops[0]
    for x in tops[1:]:
        subroots = subroots.unionByName(x)
    subroots = materialise(subroots, made)
    n = subroots.count()
    if not n:
        return Manifest(levels, [], subroots, _digest_of_nothing(docs), made)
    placed = ranked(subroots, ["grp"]).select(F.lit("").alias("grp"), F.lit(n).cast("long").alias("size"), F.col("__rank").cast("long").alias("pos"), F.col("subroot").alias("digest"), F.col("grp").alias("name"))
    roots = climb(placed, n, ["name"], made)
    return Manifest(levels, roots, subroots, roots[-1].select("digest").first()[0], made)


def _digest_of_nothing(docs: DataFrame) -> str:
    return docs.sparkSession.range(1).select(F.sha2(F.lit(""), 256)).first()[0]


def _step(at: Column, kids: str = "kids", sized: Column | None = None) -> Column:
    """A child's place and the digests of its siblings, as the only step; none in a group of one."""
    whole = F.array_join(f"{kids}.digest", "")
    sibs = F.concat(F.substring(whole, F.lit(1), at * HEX), F.substring(whole, at * HEX + HEX + 1, F.length(whole)))
    one = F.array(F.struct(at.alias("at"), sibs.alias("sibs")))
    return F.when(F.col("size") > 1, one).otherwise(F.array().cast("array<struct<at:int,sibs:string>>"))


def _descend(levels: list[DataFrame], ways: DataFrame) -> DataFrame:
    """The first level's nodes with the way (place and siblings, step by step) from each to the root; ``ways``: grp, subroot and way of each whole group."""
    below = None
    for k in reversed(range(len(levels))):
        here = levels[k]
        top = here.filter(_up(F.col("size"), k + 1) <= 1).join(ways, "grp").select(*here.columns, "subroot", "way")
        if below is not None:
            top = top.unionByName(here.filter(_up(F.col("size"), k + 1) > 1).join(below, ["grp", "node"]).select(*here.columns, "subroot", "way"))
        if k == 0:
            return top
        kid = F.col("kid")
        below = top.withColumn("kid", F.explode("kids")).select("grp", "subroot", (F.col("node") * FANOUT + kid["at"]).alias("node"), F.concat(_step(kid["at"]), F.col("way")).alias("way"))
    raise ValueError("no levels")


def proofs(m: Manifest) -> DataFrame:
    """Per leaf: doc_id, grp, leaf, told, subroot, root, proof_sha256, folded_root, verified.

    The root folded from the copy's leaf (``told``) and the leaf's own siblings equals the
    manifest's root just if the copy is what was sealed.
    """
    none = F.array().cast("array<struct<at:int,sibs:string>>")
    if not m.roots:
        ways = m.subroots.select("grp", "subroot", none.alias("way"))
    else:
        top = _descend(m.roots, m.roots[-1].select("grp", F.col("digest").alias("subroot"), none.alias("way"))).drop("subroot")
        kid = F.col("kid")
        ways = top.withColumn("kid", F.explode("kids")).select(kid["name"].alias("grp"), kid["digest"].alias("subroot"), F.concat(_step(kid["at"]), F.col("way")).alias("way"))
    ways = materialise(ways, m.made)
    nodes = _descend(m.levels, ways)

    def folded(steps: Column, start: Column) -> Column:
        def up(acc: Column, s: Column) -> Column:
            return F.sha2(F.concat(F.substring(s["sibs"], F.lit(1), s["at"] * HEX), acc, F.substring(s["sibs"], s["at"] * HEX + 1, F.length(s["sibs"]))), 256)

        return F.aggregate(steps, start, up)

    def of(kid: Column) -> Column:
        steps = F.concat(_step(kid["at"]), F.col("way"))
        return F.struct(
            kid["doc_id"].alias("doc_id"), kid["digest"].alias("leaf"), kid["told"].alias("told"),
            F.sha2(F.array_join(F.transform(steps, lambda s: s["sibs"]), ""), 256).alias("proof_sha256"), folded(steps, kid["told"]).alias("folded_root"),
        )

    out = nodes.select("grp", "subroot", F.inline(F.transform("kids", of)))
    return out.withColumn("root", F.lit(m.root)).withColumn("verified", F.col("folded_root") == F.col("root"))


def forget(m: Manifest) -> None:
    """Remove what the manifest has written."""
    discard(m.subroots.sparkSession, m.made)
