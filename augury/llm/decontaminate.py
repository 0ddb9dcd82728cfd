"""Benchmark decontamination: exact word windows of test items found in training texts.

Windows of ``n`` consecutive normalised item words are hashed into a set that every
task gets; a shorter item is one window.  Document words are numbered by the items'
vocabulary, runs of known words are hashed as windows, looked up, and every hit is
verified word by word.  Hits mark words, spans or documents.

The set is broadcast only up to ``max_windows`` windows.  A larger set goes another
way: a bitmap of the items' windows, of a stated size, is broadcast, and the document
windows that it lets pass are shuffled to the items' windows by hash and compared word
by word there.  A window that very many documents hold is dealt into ``SALTS`` parts.
Both ways judge each row by its own text, whatever its id, give the same hits and cut
the same spans.

A null text has no words, an empty table of items hits nothing, a null item id is
the empty string, items with equal ids count once, equal windows of several items
hit for each of them, repeated rows and other columns of documents stay.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augury.llm.common import filter_rows, map_column, map_rows, materialise

WINDOW = 10
#: Windows that may be broadcast; beyond, windows are shuffled.
MAX_WINDOWS = 500_000
#: Bits of the bitmap that the second way broadcasts: 16 for each window, and at most this many (64 MB).
MOST_BITS = 1 << 29
SALTS = 16
_PAGE = 1 << 18  # bits of a page of the bitmap
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_P = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def windows_of(words: list[bytes], n: int) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [tuple(words)] if words else []


class Index:
    """The windows of the items, by length: sorted hashes and the items of each window."""

    def __init__(self, items: list[tuple[str, str | None]], n: int):
        self.items = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.items)}
        by_length: dict[int, dict[tuple[int, ...], set[int]]] = defaultdict(lambda: defaultdict(set))
        self.vocabulary: dict[bytes, int] = {}
        for item, text in items:
            for w in windows_of(words_of(text), n):
                by_length[len(w)][tuple(self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w)].add(number[item])
        self.by_length = {}
        for length, found in by_length.items():
            keys = np.array(list(found), dtype=np.uint64).reshape(-1, length)
            h = self.hashes(keys)
            at: dict[int, list] = defaultdict(list)
            for k, value in zip(h.tolist(), found.items(), strict=True):
                at[k].append(value)
            self.by_length[length] = (np.unique(h), dict(at))

    @staticmethod
    def hashes(windows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(windows), dtype=np.uint64)
        for k in range(windows.shape[1]):
            out = (out ^ windows[:, k]) * _P
            out ^= out >> np.uint64(29)
        return out

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, list[str]]:
        """Which words are hit; the ids of items with occurring windows, sorted."""
        n = len(words)
        hit = np.zeros(n + 1, dtype=np.int64)
        found: set[int] = set()
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.uint64, count=n)
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        for length, (sorted_hashes, at) in self.by_length.items():
            if n < length:
                continue
            starts = np.flatnonzero(known[length:] - known[:-length] == length)
            if not len(starts):
                continue
            view = np.lib.stride_tricks.sliding_window_view(ids, length)
            for s0 in range(0, len(starts), 65536):
                some = starts[s0 : s0 + 65536]
                h = self.hashes(view[some])
                place = np.minimum(np.searchsorted(sorted_hashes, h), len(sorted_hashes) - 1)
                for s, k in zip(some[sorted_hashes[place] == h].tolist(), h[sorted_hashes[place] == h].tolist(), strict=True):
                    window = tuple(view[s].tolist())
                    for key, owners in at[k]:
                        if key == window:
                            hit[s] += 1
                            hit[s + length] -= 1
                            found |= owners
        return np.cumsum(hit[:-1]) > 0, sorted(self.items[i] for i in found)


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").filter("text is not null")


def n_windows(benchmark: DataFrame, n: int = WINDOW) -> int:
    """An upper bound on the items' windows, without holding them: one window per byte of text at most, counted exactly by words."""
    counted = map_rows(_items(benchmark), ["text"], "n long", lambda: lambda c: ((len(windows_of(words_of(t), n)),) for t in c[0]))
    return counted.agg(F.sum("n")).first()[0] or 0


def build_index(benchmark: DataFrame, n: int = WINDOW, max_windows: int = MAX_WINDOWS) -> Index | None:
    """The index, or None if it has more windows than may be broadcast."""
    if n_windows(benchmark, n) > max_windows:
        return None
    return Index([tuple(r) for r in _items(benchmark).collect()], n)  # bounded by max_windows


def scan_documents(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    index = build_index(benchmark, n, max_windows)
    if index is None:
        return _scan_by_shuffle(docs, benchmark, n)
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def make():
        idx = sent.value

        def run(c):
            for doc_id, text in zip(*c, strict=True):
                words = words_of(text)
                hit, items = idx.scan(words)
                k = int(hit.sum())
                yield doc_id, len(words), k, len(items), digest(items), k > 0

        return run

    return map_rows(docs, ["doc_id", "text"], schema, make)


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` written down with a number for each row, and that column's name."""
    number = "__row"
    while number in docs.columns:
        number += "_"
    return materialise(docs.withColumn(number, F.monotonically_increasing_id())), number


def _bitmap(items: DataFrame, n: int, most_bits: int) -> tuple[np.ndarray, int]:
    """A bit for each of the items' window hashes, made page by page in tasks; and how far hashes are shifted."""
    bits = max(10, min((16 * max(n, 1)).bit_length(), most_bits.bit_length() - 1))
    shift = 64 - bits
    size = min(_PAGE, 1 << bits)
    places = items.select(F.shiftrightunsigned("h", shift).alias("place")).distinct()
    pages = places.select(F.expr(f"place div {size}").alias("page"), F.expr(f"cast(place % {size} as int)").alias("bit")).groupBy("page").agg(F.collect_list("bit").alias("bits"))

    def draw(c):
        for page, found in zip(*c, strict=True):
            own = np.zeros(size, dtype=bool)
            own[found] = True
            yield page, np.packbits(own, bitorder="little").tobytes()

    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    # at most MOST_BITS in all, whatever the number of windows
    for page, raw in map_rows(pages, ["page", "bits"], "page long, raw binary", lambda: draw).toLocalIterator():
        out[page * size // 8 : (page + 1) * size // 8] = np.frombuffer(bytes(raw), dtype=np.uint8)
    return out, shift


def _window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows, from the words' hashes."""
    out = np.full(len(h) - length + 1, length, dtype=np.uint64)
    for k in range(length):
        out = (out ^ h[k : k + len(out)]) * _P
        out ^= out >> np.uint64(29)
    return out


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def _places_by_shuffle(rows: DataFrame, items: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """Where windows of items occur: __row, s, length and owners, the set of items that hold the window, of ``rows`` (__row, text); a row for each place."""
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())  # at most n
    bitmap, shift = _bitmap(items, items.count(), most_bits)
    sent = rows.sparkSession.sparkContext.broadcast(bitmap)

    def make():
        bits = sent.value

        def spread(c):
            for row, text in zip(*c, strict=True):
                words = words_of(text)
                hashed = _word_hashes(words)
                for length in lengths:
                    if len(words) < length:
                        continue
                    h = _window_hashes(hashed, length)
                    place = (h >> np.uint64(shift)).astype(np.int64)
                    for s in np.flatnonzero(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).tolist():
                        yield row, s, length, int(h[s].astype(np.int64)), b" ".join(words[s : s + length])

        return spread

    seen = map_rows(rows, ["__row", "text"], "__row long, s int, length int, h long, win binary", make)
    # each window goes to one of several parts, by its row
    seen = seen.withColumn("salt", F.pmod(F.xxhash64("__row"), F.lit(SALTS)).cast("int"))
    own = items.select("h", "length", "win", "owners").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return materialise(seen.join(own, ["h", "length", "win", "salt"]).select("__row", "s", "length", "owners"))


def _item_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """item, h, length and win of each distinct window of each item, and owners, which names the set of items that hold the window.

    The name is a sum of two hashes of each item, so no set is gathered; equal sets have equal names.
    """

    def cut(c):
        for item, text in zip(*c, strict=True):
            for w in set(windows_of(words_of(text), n)):
                yield item, int(_window_hashes(_word_hashes(list(w)), len(w))[0].astype(np.int64)), len(w), b" ".join(w)

    cells = materialise(map_rows(_items(benchmark), ["item", "text"], "item string, h long, length int, win binary", lambda: cut).distinct())
    wide = lambda seed: F.sum(F.xxhash64(F.lit(seed), "item").cast("decimal(20,0)")).cast("string")
    named = cells.groupBy("h", "length", "win").agg(F.concat_ws(":", F.count("*").cast("string"), wide(1), wide(2)).alias("owners"))
    return materialise(cells.join(named, ["h", "length", "win"]))


def _owners(items: DataFrame) -> DataFrame:
    """owners and item: the items of each set, by way of the set's least window."""
    window = F.struct("h", "length", "win")
    least = items.groupBy("owners").agg(F.min(window).alias("w")).select("owners", "w.*")
    return items.join(least, ["owners", "h", "length", "win"]).select("owners", "item")


def _scan_by_shuffle(docs: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    """The same result when the items' windows are too many to broadcast.

    Rows are numbered by an id that is written down, so repeated documents stay apart.
    """
    rows, _ = _numbered(docs.select("doc_id", "text"))
    items = _item_windows(benchmark, n)
    places = _places_by_shuffle(rows, items)
    spans = places.groupBy("__row").agg(F.collect_set(F.struct("s", "length")).alias("spans"))
    # a passage's windows mostly have one set of owners, which is looked up once for a document
    owners = places.select("__row", "owners").distinct().join(_owners(items), "owners").groupBy("__row").agg(F.collect_set("item").alias("items"))
    joined = rows.join(spans, "__row", "left").join(owners, "__row", "left")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def close(c):
        for doc_id, text, at, ids in zip(*c, strict=True):
            hit = np.zeros(len(words_of(text)), dtype=bool)
            for x in at or []:
                hit[x["s"] : x["s"] + x["length"]] = True
            ids, k = sorted(ids or []), int(hit.sum())
            yield doc_id, len(hit), k, len(ids), digest(ids), k > 0

    return map_rows(joined, ["doc_id", "text", "spans", "items"], f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean", lambda: close)


def _decontaminate_by_shuffle(docs: DataFrame, benchmark: DataFrame, action: str, n: int) -> DataFrame:
    """Each row judged by its own text, told apart by its number."""
    rows, number = _numbered(docs)
    places = _places_by_shuffle(rows.select(F.col(number).alias("__row"), "text"), _item_windows(benchmark, n))
    if action == "documents":
        bad = places.select(F.col("__row").alias("__bad")).distinct()
        return rows.join(bad, rows[number] == bad["__bad"], "left_anti").drop(number)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, starts: pd.Series, lengths: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else cut_words(t, s, k) for t, s, k in zip(texts, starts, lengths, strict=True)], dtype=object)

    spans = places.groupBy("__row").agg(F.collect_set(F.struct("s", "length")).alias("x")).select("__row", F.col("x.s").alias("s"), F.col("x.length").alias("length")).alias("spans_")
    joined = rows.alias("rows_").join(spans, F.col(f"rows_.{number}") == F.col("spans_.__row"), "left")
    return joined.select(*[cut("rows_.text", "spans_.s", "spans_.length").alias("text") if c == "text" else F.col(f"rows_.`{c}`") for c in docs.columns])


def cut_words(text: str, starts: np.ndarray, lengths: np.ndarray) -> str:
    """The text without the words of these spans."""
    raw = text.encode("utf-8", "surrogatepass")
    words = list(_WORD.finditer(raw.lower()))
    hit = np.zeros(len(words), dtype=bool)
    for s, k in zip(starts, lengths, strict=True):
        hit[s : s + k] = True
    return _without(raw, words, hit)


def _without(raw: bytes, words: list[re.Match[bytes]], hit: np.ndarray) -> str:
    out, at = [], 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    for first, last in zip(edges[::2], edges[1::2], strict=True):
        out.append(raw[at : words[first].start()])
        at = words[last - 1].end()
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def clean_text(text: str | None, index: Index) -> tuple[str | None, bool]:
    """The text without its hit words (runs of them go with what stands between), and whether any were hit."""
    if not text:
        return text, False
    raw = text.encode("utf-8", "surrogatepass")
    words = list(_WORD.finditer(raw.lower()))
    hit, _ = index.scan([m[0] for m in words])
    if not hit.any():
        return text, False
    return _without(raw, words, hit), True


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "documents", n: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` without contaminated documents (action "documents") or without hit spans ("spans"); all columns stay."""
    if action not in ("documents", "spans"):
        raise ValueError("action must be documents or spans")
    index = build_index(benchmark, n, max_windows)
    if index is None:
        return _decontaminate_by_shuffle(docs, benchmark, action, n)
    sent = docs.sparkSession.sparkContext.broadcast(index)
    if action == "documents":
        return filter_rows(docs, "text", lambda: lambda texts: [not sent.value.scan(words_of(t))[0].any() for t in texts])
    return map_column(docs, "text", lambda: lambda texts: [clean_text(t, sent.value)[0] for t in texts])
