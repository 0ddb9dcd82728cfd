"""Substring dedup: words go that stand in a window of ``n`` words which an earlier document holds too.

Windows are sought level by level.  A level has a length, half of the next one; the last
is ``n`` itself.  Of the windows of a level's length inside one of ``n`` words, the one
with the least hash stands for it, so equal windows of ``n`` words have equal stand-ins,
and neighbours mostly share theirs: few hashes for each text are compared, not one for
each word.  Stand-ins that two documents hold survive; only windows of ``n`` words whose
stand-in survived go on to twice the length, until none is left or the length is ``n``,
where windows are compared by 128 bits and the least document of each is found.

Exact copies are told apart first: of documents of equal words all but those with the
least id lose every word, if there are ``n`` of them, and one row of each id goes on.

Words are the runs of signs other than space and U+0009 to U+000D, unchanged.  A null or
blank text has no words.  A null id is neither smaller nor larger than another: such rows
lose nothing and take nothing.  Rows of equal ids take nothing from each other; repeated
rows have equal results.  Texts of any length are read whole, about a million bytes at a
time.  Columns other than doc_id and text take no part, whatever their names, and stay in
``cut``.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from augury.llm.common import discard, map_rows, materialise

WINDOW = 50
#: Lengths under which windows are not halved further.
LEAST = 16
#: Bytes of a text that are cut into words at once.
SLICE = 1 << 20
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def lengths(n: int, least: int = LEAST) -> list[int]:
    """The levels' lengths: ``n``, and halves before it while they are whole numbers of at least ``least``."""
    out = [n]
    while out[0] % 2 == 0 and out[0] // 2 >= least:
        out.insert(0, out[0] // 2)
    return out


def pieces(text: str | None, size: int | None = None) -> Iterator[list[bytes]]:
    """The words of a text, a slice after another."""
    raw, at, size = (text or "").encode("utf-8", "surrogatepass"), 0, size or SLICE
    while at < len(raw):
        gap = _GAP.search(raw, at + size) if len(raw) - at > size else None
        end = gap.start() if gap else len(raw)
        words = _WORD.findall(raw, at, end)
        if words:
            yield words
        at = end + 1


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^k and base^-k modulo 2^64 for k < n at least."""
    held = _POWERS.get(base)
    if held is None or len(held[0]) < n:
        size = 1 << max(12, n.bit_length())
        made = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        held = _POWERS[base] = (made[0], made[1])
    return held


def rolled(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """A hash of each ``n`` consecutive hashes: a polynomial in ``base`` modulo 2^64."""
    up, down = _powers(base, len(h) + 1)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)])
    out = (sums[n:] - sums[:-n]) * down[: len(h) - n + 1]
    out = (out ^ (out >> np.uint64(29))) * np.uint64(base)
    return out ^ (out >> np.uint64(32))


def least_of(a: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` consecutive numbers."""
    p, now = 1, a
    while 2 * p <= w:
        now = np.minimum(now[:-p], now[p:])
        p *= 2
    n = len(a) - w + 1
    return np.minimum(now[:n], now[w - p : w - p + n])


def stand_ins(h: np.ndarray, length: int, n: int) -> np.ndarray:
    """For each window of ``n`` of the hashes, the least hash of the windows of ``length`` in it."""
    return least_of(rolled(h, length, _BASES[0]), n - length + 1)


def runs(text: str | None, n: int, seeds: tuple[int, ...] = (0,)) -> Iterator[tuple[int, list[np.ndarray], list[bytes]]]:
    """Slices of a text: the place of the first word, its words' hashes by each seed, and the slice's new words.

    Hashes begin with those of the ``n`` - 1 words before, so each window of ``n`` words is in one slice.
    """
    before = [np.zeros(0, dtype=np.uint64) for _ in seeds]
    at = 0
    for words in pieces(text):
        own = [np.concatenate([b, np.fromiter((xxhash.xxh64_intdigest(w, s) for w in words), dtype=np.uint64, count=len(words))]) for b, s in zip(before, seeds, strict=True)]
        yield at, own, words
        at += max(0, len(own[0]) - n + 1)
        before = [x[max(0, len(x) - n + 1) :] for x in own]


def _distinct(parts: list[np.ndarray]) -> list[int]:
    return np.unique(np.concatenate(parts)).view(np.int64).tolist() if parts else []


def _read(docs: DataFrame, n: int, length: int) -> DataFrame:
    """doc_id, xx, n_words, whole (digest of the words) and the stand-ins of each row; null for rows that can share none."""

    def make():
        def run(c):
            for doc_id, xx, text in zip(*c, strict=True):
                sha, many, found = hashlib.sha256(), 0, []
                for _, (h,), words in runs(text, n):
                    sha.update((b" " if many else b"") + b" ".join(words))
                    many += len(words)
                    if len(h) >= n and doc_id is not None:
                        v = stand_ins(h, length, n)
                        found.append(v[np.concatenate([[True], v[1:] != v[:-1]])])
                yield doc_id, xx, many, sha.digest(), _distinct(found) if found else None

        return run

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", F.xxhash64("text").alias("xx"), "text"), ["doc_id", "xx", "text"], f"doc_id {kind}, xx long, n_words long, whole binary, stand array<long>", make)


def _copies(read: DataFrame, n: int) -> DataFrame:
    """whole and first (the least id) of the sequences of words that several ids have."""
    some = read.filter(F.col("doc_id").isNotNull() & (F.col("n_words") >= n)).groupBy("whole").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    return some.filter("first < last").drop("last")


def _survivors(rows: DataFrame, made: list[str]) -> DataFrame:
    """doc_id, xx, alive: the stand-ins of each row (doc_id, xx, stand) that another document holds too."""
    held = rows.select("doc_id", "xx", F.explode("stand").alias("h"))
    shared = materialise(held.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).filter("a < z").select("h"), made)
    return materialise(held.join(shared, "h").groupBy("doc_id", "xx").agg(F.collect_set("h").alias("alive")), made)


def _with_texts(docs: DataFrame, alive: DataFrame) -> DataFrame:
    """The texts of the rows of ``alive`` (doc_id, xx and more)."""
    return docs.select("doc_id", F.xxhash64("text").alias("xx"), "text").join(alive, ["doc_id", "xx"])


def _again(docs: DataFrame, alive: DataFrame, n: int, length: int, last: int) -> DataFrame:
    """The stand-ins of ``length`` of windows whose stand-in of length ``last`` is alive."""

    def run(c):
        for doc_id, xx, text, held in zip(*c, strict=True):
            keep, found = np.array(held, dtype=np.int64).view(np.uint64), []
            for _, (h,), _ in runs(text, n):
                if len(h) >= n:
                    found.append(stand_ins(h, length, n)[np.isin(stand_ins(h, last, n), keep)])
            yield doc_id, xx, _distinct(found)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(_with_texts(docs, alive), ["doc_id", "xx", "text", "alive"], f"doc_id {kind}, xx long, stand array<long>", lambda: run)


def _map_arrays(df: DataFrame, columns: list[str], schema: str, run: Callable[..., Iterator[list]]) -> DataFrame:
    """``run`` of each row gives columns of many rows at once."""
    kind = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                for found in run(*(b.column(i)[k].as_py() for i in range(b.num_columns))):
                    yield pa.RecordBatch.from_arrays([x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(found, arrow, strict=True)], schema=arrow)

    return df.select(*columns).mapInArrow(task, kind)


def _windows(docs: DataFrame, alive: DataFrame, n: int, last: int) -> DataFrame:
    """k1, k2 (128 bits of a window), doc_id, xx and s (its first word) of the windows whose stand-in of length ``last`` is alive."""

    def run(doc_id, xx, text, held):
        keep = np.array(held, dtype=np.int64).view(np.uint64)
        for at, hs, _ in runs(text, n, (0, 1)):
            if len(hs[0]) >= n:
                s = np.flatnonzero(np.isin(stand_ins(hs[0], last, n), keep))
                if len(s):
                    k1, k2 = (rolled(h, n, b)[s].view(np.int64) for h, b in zip(hs, _BASES, strict=True))
                    yield [k1, k2, pa.repeat(doc_id, len(s)), pa.repeat(xx, len(s)), s + at]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _map_arrays(_with_texts(docs, alive), ["doc_id", "xx", "text", "alive"], f"k1 long, k2 long, doc_id {kind}, xx long, s int", run)


def _all_windows(docs: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """The same without a level before the last: every window."""
    return _windows(docs, rows.select("doc_id", "xx", F.col("stand").alias("alive")).distinct(), n, n)


def cut_words(text: str | None, starts: list[int], n: int) -> tuple[int, int, str, bytes]:
    """Words, removed words, digest and text of the words left, joined by a space, without those in windows that begin at ``starts``."""
    many = sum(map(len, pieces(text)))
    edge = np.zeros(many + 1, dtype=np.int64)
    s = np.unique(np.array(starts, dtype=np.int64))
    edge[s] += 1
    edge[s + n] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    kept: list[bytes] = []
    at = 0
    for words in pieces(text):
        kept.append(b" ".join(w for w, x in zip(words, gone[at : at + len(words)].tolist(), strict=True) if not x))
        at += len(words)
    out = b" ".join(k for k in kept if k)
    return many, int(gone.sum()), hashlib.sha256(out).hexdigest(), out


def find(docs: DataFrame, n: int = WINDOW, texts: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, xx (hash of the text), n_words, n_removed, kept_sha256; with ``texts`` also kept.

    kept is null where nothing was removed.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    levels = lengths(n)
    first: list[str] = []
    read = materialise(_read(docs, n, levels[0]), first)
    copies = materialise(_copies(read, n), first)
    own = F.col("first").isNull() | (F.col("doc_id") == F.col("first"))
    rows = materialise(read.join(copies, "whole", "left").select("doc_id", "xx", "n_words", "whole", own.alias("own"), F.when(own, F.col("stand")).alias("stand")))
    discard(spark, first)
    made: list[str] = []
    going = rows.filter("stand is not null")
    if len(levels) == 1:
        windows = materialise(_all_windows(docs, going, n), made)
    else:
        alive = _survivors(going, made)
        for last, length in zip(levels, levels[1:-1], strict=False):
            if alive.isEmpty():
                break
            alive = _survivors(materialise(_again(docs, alive, n, length, last), made), made)
        windows = materialise(_windows(docs, alive, n, levels[-2]), made)
    least = windows.groupBy("k1", "k2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).filter("a < z").select("k1", "k2", F.col("a").alias("least"))
    least = materialise(least, made)
    starts = windows.join(least, ["k1", "k2"]).filter("doc_id > least").groupBy("doc_id", "xx").agg(F.collect_set("s").alias("starts"))
    starts = materialise(starts, made)

    def run(c):
        for doc_id, xx, text, s in zip(*c, strict=True):
            _, gone, sha, kept = cut_words(text, s, n)
            yield doc_id, xx, gone, sha, kept.decode("utf-8", "surrogatepass") if texts else None

    cut = map_rows(_with_texts(docs, starts), ["doc_id", "xx", "text", "starts"], f"doc_id {kind}, xx long, gone long, sha string, kept string", lambda: run)
    cut = materialise(cut.distinct())  # repeated rows have equal results
    discard(spark, made)
    out = rows.drop("stand").join(cut, ["doc_id", "xx"], "left")
    whole = F.lower(F.hex("whole"))
    empty = hashlib.sha256().hexdigest()
    out = out.select(
        "doc_id", "xx", "n_words",
        F.when(~F.col("own"), F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(~F.col("own"), F.lit(empty)).otherwise(F.coalesce("sha", whole)).alias("kept_sha256"),
        F.when(~F.col("own"), F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )
    return out if texts else out.drop("kept")


def cut(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """``docs`` without the words that earlier documents hold; texts that lose words become the words left, joined by a space."""
    names = {c.lower() for c in docs.columns}
    key, id_, new = (_unused(names, x) for x in ("__xx", "__id", "__kept"))
    found = find(docs.select("doc_id", "text"), n, texts=True).filter("n_removed > 0")
    found = found.select(F.col("doc_id").alias(id_), F.col("xx").alias(key), F.col("kept").alias(new)).distinct()
    rows = docs.withColumn(key + "_own", F.xxhash64("text"))
    out = rows.join(found, (rows["doc_id"] == found[id_]) & (rows[key + "_own"] == found[key]), "left")
    return out.select(*[F.coalesce(F.col(new), F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def _unused(names: set[str], name: str) -> str:
    while name in names or f"{name}_own" in names:
        name += "_"
    return name
