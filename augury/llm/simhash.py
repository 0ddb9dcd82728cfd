"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint has one or more 64-bit lanes, each a majority vote over the hashes of
word shingles.  Lanes are cut into so few segments that a close pair must agree in
one of them up to a single bit.  For each segment, every variant with one bit
wildcarded is indexed; an equality join on variants finds the candidates, and the
full distance verifies them.  With one lane, links up to distance k are complete if
k // segments <= 1 (k = 2 with 2 segments).

Equal fingerprints are one node from the start, so copies never meet in pairs.  A
segment value that more than ``most`` fingerprints share is hot.  Fingerprints that
are hot there meet the others by the join, but not each other; for these, one-lane
fingerprints go an exact way whose groups are bounded by construction: two of them
lie within 2 bits just if one-bit neighbourhoods (65 points each) share a point.
Only one lane is linked; near-copies at a lower similarity are the task of ``copies``.

A null or empty text has no shingles and fingerprint zero; a null id never is the
smallest; repeated rows get the same class; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augury.llm.common import join_spread, map_rows, materialise
from augury.llm.graph import connected_components

#: Fingerprints that may share a segment's value and still be joined with each other.
HOT_VALUE = 16
_MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15], dtype=np.uint64)


@dataclass(frozen=True)
class Scheme:
    """words: shingle length; lanes: 64-bit words of the fingerprint; segments: of each lane; distance: bits that may differ."""

    words: int = 5
    lanes: int = 1
    segments: int = 2
    distance: int = 2

    @property
    def segment_bits(self) -> int:
        return 64 // self.segments


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle: words parted by white space, A-Z lower-cased, joined by a space."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.zeros(0, dtype=np.uint64)
    whole = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(whole, 42)], dtype=np.uint64)
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(whole[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=False)], dtype=np.uint64)


def lane_hashes(h: np.ndarray, lane: int) -> np.ndarray:
    """Lane 0 votes with the hashes themselves, further lanes with mixed ones."""
    if lane == 0:
        return h
    x = h + np.uint64(int(_MIX[2]) * lane % 2**64)
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str | None, words: int, lanes: int = 1) -> list[int]:
    """Signed 64-bit lanes; a bit is 1 if it is set in over half the hashes."""
    return votes_of(shingle_hashes(text, words), lanes)


def votes_of(h: np.ndarray, lanes: int) -> list[int]:
    if not len(h):
        return [0] * lanes
    out = []
    for lane in range(lanes):
        votes = np.zeros(64, dtype=np.int64)
        for at in range(0, len(h), 16384):
            bits = np.unpackbits(lane_hashes(h[at : at + 16384], lane).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes += bits.sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(votes * 2 > len(h), bitorder="little").view("<i8")[0]))
    return out


def fingerprints(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """doc_id and the lanes f0, f1 ..., read from whole texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        return lambda c: ((d, *fingerprint(t, scheme.words, scheme.lanes)) for d, t in zip(*c, strict=True))

    return map_rows(docs, ["doc_id", "text"], f"doc_id {kind}, " + ", ".join(f"{x} long" for x in _lanes(scheme)), make)


def _lanes(scheme: Scheme) -> list[str]:
    return [f"f{i}" for i in range(scheme.lanes)]


def _segments(scheme: Scheme) -> Column:
    """An array of (number, value) of all segments."""
    size, mask = scheme.segment_bits, 2**scheme.segment_bits - 1
    at = [(lane, s) for lane in range(scheme.lanes) for s in range(scheme.segments)]

    def value(lane: int, s: int) -> Column:
        return F.shiftrightunsigned(f"f{lane}", s * size).bitwiseAND(F.lit(mask).cast("long"))

    return F.array(*[F.struct(F.lit(k).alias("seg"), value(lane, s).alias("value")) for k, (lane, s) in enumerate(at)])


def _variants(nodes: DataFrame, scheme: Scheme, keep: list[str]) -> DataFrame:
    """A row for each node and wildcard bit: key (segment, bit, the rest of the segment) and whether the segment is hot."""
    size = scheme.segment_bits
    marked = nodes.select(*keep, "hot_mask", F.explode(_segments(scheme)).alias("s"))
    key = F.expr(f"explode(transform(sequence(0, {size - 1}), i -> shiftleft(cast(s.seg * {size} + i as bigint), {size}) | (s.value & ~shiftleft(1L, cast(i as int)))))")
    return marked.select(*keep, F.expr("(shiftrightunsigned(hot_mask, s.seg) & 1L) = 1L").alias("hot"), key.alias("key"))


def _mark_hot(nodes: DataFrame, scheme: Scheme, most: int) -> DataFrame:
    """Adds hot_mask: a bit for each segment whose value more than ``most`` nodes share."""
    values = nodes.select("node", F.explode(_segments(scheme)).alias("s")).select("node", "s.seg", "s.value")
    hot = values.groupBy("seg", "value").agg(F.count("*").alias("n")).filter(F.col("n") > most).drop("n")
    masks = values.join(hot.hint("merge"), ["seg", "value"]).groupBy("node").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("seg"))).alias("hot_mask"))
    return nodes.join(masks, "node", "left").withColumn("hot_mask", F.coalesce("hot_mask", F.lit(0).cast("long")))


def links(nodes: DataFrame, scheme: Scheme, most: int = HOT_VALUE) -> DataFrame:
    """Links (u, v) between nodes (columns node, f0 ...) whose fingerprints are close.

    Complete as to components.  Spark sizes exploded rows by the table before, so joins of
    variants and points are told to merge, lest 64 rows a node are broadcast.
    """
    if scheme.lanes > 1 or scheme.distance > 2:
        raise ValueError("links are those of one lane up to distance 2; for less alike texts see the module copies")
    nodes = materialise(_mark_hot(nodes, scheme, most))
    v = _variants(nodes, scheme, ["node"])
    cool = v.filter(~F.col("hot")).select("key", "node")
    warm = v.filter("hot").select("key", "node")
    near = F.bit_count(F.col("a.node").bitwiseXOR(F.col("b.node"))) <= scheme.distance
    a, b = cool.alias("a"), cool.alias("b")
    pairs = a.join(b.hint("merge"), (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & near).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    b = warm.alias("b")
    pairs = pairs.unionByName(a.join(b.hint("merge"), (F.col("a.key") == F.col("b.key")) & near).select(F.col("a.node").alias("u"), F.col("b.node").alias("v")))
    hot_nodes = nodes.filter("hot_mask <> 0")
    if scheme.distance == 0:  # nodes are distinct
        return pairs
    if scheme.distance == 2:
        points = hot_nodes.select("node", F.explode(F.expr("array_append(transform(sequence(0, 63), i -> node ^ shiftleft(1L, cast(i as int))), node)")).alias("point"))
    else:  # fingerprints one bit apart are equal after a wildcard
        points = hot_nodes.select("node", F.explode(F.expr("transform(sequence(0, 63), i -> named_struct('i', i, 'rest', node & ~shiftleft(1L, cast(i as int))))")).alias("point"))
    hubs = points.groupBy("point").agg(F.min("node").alias("hub"), F.max("node").alias("far")).filter("hub <> far")
    return pairs.unionByName(points.join(hubs.hint("merge"), "point").filter("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))).distinct()


def near_duplicates(docs: DataFrame, scheme: Scheme, most: int = HOT_VALUE) -> DataFrame:
    """doc_id, the lanes, and component_id: the smallest doc_id reachable over links."""
    lanes = _lanes(scheme)
    found = materialise(fingerprints(docs, scheme))
    # a node is a distinct fingerprint: itself, or a 64-bit hash of its lanes
    node = F.col("f0") if scheme.lanes == 1 else F.xxhash64(*lanes)
    nodes = materialise(found.groupBy(*lanes).agg(F.min("doc_id").alias("first"), F.count("*").alias("many")).withColumn("node", node))
    roots = connected_components(links(nodes.select("node", *lanes), scheme, most))
    linked = nodes.join(roots, "node")
    # only roots that have links can gather more than one node
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = linked.join(least, "root").select("node", "component_id")
    # fingerprints of one document are their own component or have a link; others are joined by their text form
    members = nodes.join(linked, "node", "left").withColumn("component_id", F.coalesce("component_id", "first"))
    members = materialise(members.select(F.hex("node").alias("__node"), "many", F.struct("component_id").alias("__found")))
    out = join_spread(found.withColumn("__node", F.hex(node)), members, ["__node"], "__found", found.count(), F.xxhash64("doc_id"))
    return out.select("doc_id", *lanes, F.col("__found.component_id").alias("component_id"))


def hex_fingerprint(lane: Column) -> Column:
    return F.lpad(F.lower(F.hex(lane)), 16, "0")


def keep_one_of_each(docs: DataFrame, most: int | None = None) -> DataFrame:
    """``docs`` without near-copies, see ``copies.keep_one_of_each``."""
    from augury.llm import copies

    return copies.keep_one_of_each(docs, most=copies.BLOCK_NODES if most is None else most)
