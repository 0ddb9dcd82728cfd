"""Best-fit packing with exact complements.

Documents become token pieces of at most ``capacity``; pieces share sequences of
that capacity, as few as can be.  Only the counts of each piece length meet on the
driver: at most ``capacity`` numbers, whatever the size of the corpus.  There, an
index of single, pair and triple sums of lengths answers which combination exactly
fills the gap of a longer piece; singles, then pairs, then triples are consumed as
often as counts allow.  What no combination fills goes to the open sequence with the
least room that suffices (best fit).  So that short pieces are left for that, the
shortest ones, with a stated share of all tokens, take no part in sums.  The plan is a
list of rank intervals per length, and each task finds its pieces' places in it.

A piece's rank among those of its length is counted per salted group, so a length
that a third of all pieces has spreads over many tasks.

A null or empty text is one end token; repeated rows are packed each; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from augury.llm.common import map_rows, materialise
from augury.llm.tokens import Encoder, default_vocabulary

CAPACITY = 2048
#: Pieces of one salted group of a length, about.
GROUP_ROWS = 200_000


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian 32-bit)."""
    path = vocabulary or default_vocabulary()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        encoder, step = Encoder.of(path), 4 * capacity

        def run(c):
            for doc_id, ids in zip(c[0], encoder.each(c[1]), strict=True):
                ids += b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    row = (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part))
                    yield (*row, part) if with_ids else row

        return run

    return map_rows(docs, ["doc_id", "text"], f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids, make)


class Sums:
    """Which lengths, one to three, make a sum, largest first, as long as their counts last.

    A sum's pairs are listed when it is first asked for.  Counts only fall, so a pair that
    has run out is never looked at again.
    """

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.there = counts > 0
        self.lengths = np.flatnonzero(self.there)[::-1].tolist()
        self.pairs: dict[int, list[int]] = {}  # the larger lengths of a sum's pairs, smallest first

    def _left(self, a: int, b: int, held: tuple[int, ...]) -> bool:
        have = self.counts
        return bool(have[a] > held.count(a) + (a == b) and have[b] > held.count(b))

    def pair(self, total: int, most: int, held: tuple[int, ...]) -> tuple[int, int] | None:
        found = self.pairs.get(total)
        if found is None:
            a = np.arange((total + 1) // 2, min(total, len(self.there)))
            found = self.pairs[total] = a[self.there[a] & self.there[total - a]].tolist()
        while found and not self._left(found[-1], total - found[-1], ()):
            found.pop()
        return next(((a, total - a) for a in reversed(found) if a <= most and self._left(a, total - a, held)), None)

    def find(self, total: int, most: int, size: int, held: tuple[int, ...]) -> tuple[int, ...] | None:
        """``size`` lengths, none over ``most``, beside those that are held."""
        if size == 1:
            return (total,) if 0 < total <= most and self.counts[total] > held.count(total) else None
        if size == 2:
            return self.pair(total, most, held)
        for a in self.lengths:
            if 3 * a < total:
                return None
            if a <= min(most, total - 2) and self.counts[a] > held.count(a):
                two = self.pair(total - a, a, (*held, a))
                if two:
                    return (a, *two)
        return None


#: Shares of all tokens, in the shortest pieces, that sums may spare, in the order of trial.
SPARED = (0.04, 0.08, 0.16, 0.32, 0.64)


def plan(counts: dict[int, int], capacity: int = CAPACITY, spared: tuple[float, ...] = SPARED) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in one sequence) and how many sequences have each.

    Uses every piece once; sums never exceed the capacity.  The shares are tried in turn
    until the plan needs no more sequences than all tokens do; else the best one is taken.
    """
    bound = -(-sum(length * n for length, n in counts.items()) // capacity)
    plans: list[list[tuple[tuple[int, ...], int]]] = []
    for share in spared:
        plans.append(plan_once(counts, capacity, share))
        if sum(times for _, times in plans[-1]) <= bound:
            break
    return min(plans, key=lambda p: sum(times for _, times in p), default=[])


def plan_once(counts: dict[int, int], capacity: int, share: float) -> list[tuple[tuple[int, ...], int]]:
    have = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        have[length] = n
    out: list[tuple[tuple[int, ...], int]] = []
    if have[capacity]:
        out.append(((capacity,), int(have[capacity])))
    tokens = int(have @ np.arange(capacity + 1))
    have[capacity] = 0
    # the shortest pieces stay out of sums
    room, short = int(tokens * share), np.zeros(capacity + 1, dtype=np.int64)
    for length in np.flatnonzero(have).tolist():
        short[length] = min(have[length], room // length)
        room -= length * short[length]
        if short[length] < have[length]:
            break
    have -= short
    sums = Sums(have)
    for size in (1, 2, 3):
        for length in range(capacity - 1, 0, -1):
            while have[length]:
                fill = sums.find(capacity - length, length, size, (length,))
                if fill is None:
                    break
                whole = (length, *fill)
                times = min(int(have[x]) // whole.count(x) for x in set(whole))
                for x in whole:
                    have[x] -= times
                out.append((whole, times))
    have += short
    return out + best_fit({length: int(have[length]) for length in np.flatnonzero(have).tolist()}, capacity)


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first: open sequences are grouped by what they hold."""
    open_by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms = np.zeros(capacity + 1, dtype=bool)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            fits = np.flatnonzero(rooms[length:])
            if not len(fits):
                # each new sequence takes as many of this length as fit
                per = capacity // length
                for held, times in ((per, n // per), (n % per, 1 if n % per else 0)):
                    if times and held:
                        room = capacity - held * length
                        open_by_room.setdefault(room, []).append(((length,) * held, times))
                        rooms[room] = True
                n = 0
                break
            room = length + int(fits[0])
            held, times = open_by_room[room].pop()
            used = min(times, n)
            if times > used:
                open_by_room[room].append((held, times - used))
            rooms[room] = bool(open_by_room[room])
            open_by_room.setdefault(room - length, []).append(((*held, length), used))
            rooms[room - length] = True
            n -= used
    return [p for room in sorted(open_by_room) for p in open_by_room[room]]


def intervals(patterns: list[tuple[tuple[int, ...], int]], capacity: int = CAPACITY) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: first ranks, first sequence ids and offsets of the runs that hold it."""
    taken = np.zeros(capacity + 1, dtype=np.int64)
    rows: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for lengths, times in patterns:
        offset = 0
        for x in lengths:
            rows.setdefault(x, []).append((int(taken[x]), base, offset))
            taken[x] += times
            offset += x
        base += times
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for x, r in rows.items()}


def ranked(found: DataFrame, group_rows: int = GROUP_ROWS) -> tuple[DataFrame, dict[int, int]]:
    """Pieces with their rank among those of equal length, and the count of each length."""
    totals = {r[0]: r[1] for r in found.groupBy("length").agg(F.count("*")).collect()}  # at most capacity rows
    salts = max(16, -(-max(totals.values(), default=0) // group_rows))
    salted = found.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    sizes = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = W.partitionBy("length").orderBy("__salt").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(W.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")).cast("long") - 1
    out = salted.withColumn("__place", place).join(sizes, ["length", "__salt"]).withColumn("rank", F.col("__place") + F.col("__before"))
    return out.drop("__salt", "__place", "__before"), totals


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    rows, totals = ranked(found)
    sent = found.sparkSession.sparkContext.broadcast(intervals(plan(totals, capacity), capacity))
    kind = found.schema["doc_id"].dataType.simpleString()

    def make():
        at = sent.value

        def run(c) -> Iterator[tuple]:
            for doc_id, piece, start, length, crc, rank in zip(*c, strict=True):
                first, base, offset = at[length]
                k = int(np.searchsorted(first, rank, side="right")) - 1
                yield doc_id, piece, start, length, crc, int(base[k]) + rank - int(first[k]), int(offset[k])

        return run

    return map_rows(rows, ["doc_id", "piece", "start", "length", "ids_crc32", "rank"], f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", make)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    return pack(materialise(pieces(docs, capacity, vocabulary)), capacity)


def sequences(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, ids (array of ints).

    A sequence gathers at most ``capacity`` tokens, so its group is bounded.
    """
    found = materialise(pieces(docs, capacity, vocabulary, with_ids=True).withColumn("doc_id", F.monotonically_increasing_id()))
    placed = pack(found.drop("ids"), capacity).select("doc_id", "piece", "sequence_id", "offset")
    parts = found.join(placed, ["doc_id", "piece"]).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))

    def join(c):
        for s, p in zip(*c, strict=True):
            ids = np.frombuffer(b"".join(x["ids"] for x in p), dtype="<u4")
            yield s, len(ids), ids.astype(np.int32)

    return map_rows(parts, ["sequence_id", "parts"], "sequence_id long, n_tokens int, ids array<int>", lambda: join)
