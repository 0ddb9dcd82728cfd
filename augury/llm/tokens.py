"""Token ids of a word-level byte-pair vocabulary, by whole arrays of words.

The vocabulary file's own pre-tokenizer encodes every word by itself, so a text's
ids are its words' ids in a row.  Texts made only of characters for which Python's
and the library's notions of case, space and letter agree are cut into words by their
bytes' classes, about a million bytes at a time; words are looked up in a table that
is kept between texts, and those it lacks are merged all together.  Every other text,
and every very long word, goes to the library.  Both give the same ids.

A null or empty text has no ids.  A text of any length is encoded whole, in slices
that end at white space.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np

#: Characters of the quick way: ASCII without odd controls, Latin letters, a few marks.
_ODD = re.compile("[^\\t\\n\\r -~¡«·»¿À-ÖØ-öø-įı-ňŊ-ž]")
_SPACE = re.compile(r"\s")
#: The pre-tokenizer and normalizer for which the quick way holds.
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
CACHE_WORDS = 200_000
CACHE_KEYS = 50_000  # in each of two generations
SLICE = 1 << 20  # characters of texts that are encoded together, about
LONG = 16  # bytes of a word that the table holds

#: Byte-level vocabularies write bytes without a printable Latin-1 sign as letters from 256 on.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}

_BLANK, _LETTER, _DIGIT, _MARK = range(4)
_APOSTROPHE = ord("'")


def _classes() -> np.ndarray:
    """Class of a byte that begins a character of the quick way; the letters' first bytes are C3 to C5."""
    out = np.full(256, _MARK, dtype=np.uint8)
    out[[9, 10, 13, 32]] = _BLANK
    out[ord("a") : ord("z") + 1] = out[0xC3:0xC6] = _LETTER
    out[ord("0") : ord("9") + 1] = _DIGIT
    return out


_CLASS = _classes()
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordCache(dict):
    """What ``make`` gives for a word, kept in two bounded generations.

    When the young one is full it becomes the old one; a word found there is young
    again, so frequent words stay.
    """

    def __init__(self, make: Callable[[str], Any], size: int = CACHE_KEYS):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, word: str) -> Any:
        out = self.old.get(word)
        if out is None:
            out = self.make(word)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[word] = out
        return out


def cut(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of lower-cased UTF-8 bytes of the quick way begin and end.

    A word is a run of letters, a digit, a run of marks, or an apostrophe with one of
    the short endings where no mark stands before it.
    """
    kind = _CLASS[raw]
    follows = (raw & 0xC0) == 0x80
    kind[1:][follows[1:]] = kind[:-1][follows[1:]]
    begins = kind != _BLANK
    begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    begins[follows] = False
    quote = np.flatnonzero((raw == _APOSTROPHE) & begins)
    if len(quote):
        ahead = np.concatenate([raw, np.zeros(3, dtype=np.uint8)])
        one, two = ahead[quote + 1], ahead[quote + 2]
        short = np.isin(one, np.frombuffer(b"stmd", dtype=np.uint8))
        wide = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        begins[quote[short | wide] + 1] = False
        rest = np.concatenate([quote[short] + 2, quote[wide] + 3])
        rest = rest[rest < len(raw)]
        begins[rest] = kind[rest] != _BLANK
    edges = np.flatnonzero(begins | (kind == _BLANK))
    of = np.flatnonzero(begins[edges])
    return edges[of], np.append(edges, len(raw))[of + 1]


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places first, first + 1 ... (``count`` of them) of each row, in a row."""
    ends = np.cumsum(count)
    return np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


class Merges:
    """The merges of a vocabulary, applied to many words at once.

    A merge is found by the pair of ids in an open-addressed table.  Each step makes, in
    every word, the leftmost of its pairs with the least rank; words without one are done.
    """

    PAD, NONE = 65_535, 2**31 - 1

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], end: str):
        self.first = np.array([[vocabulary[chr(_BYTE_LETTERS.get(b, b)) + suffix] for b in range(256)] for suffix in ("", end)])  # ids of bytes inside and at the end
        self.made = np.array([vocabulary[a + b] for a, b in merges], dtype=np.int64)
        pairs = np.array([vocabulary[a] << 16 | vocabulary[b] for a, b in merges], dtype=np.int64)
        self.bits = max(4, (len(pairs) * 8).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, self.NONE, dtype=np.int32)
        for rank, (key, at) in enumerate(zip(pairs.tolist(), self._slots(pairs).tolist(), strict=True)):
            while self.keys[at] >= 0 and self.keys[at] != key:
                at = (at + 1) % len(self.keys)
            if self.keys[at] < 0:
                self.keys[at], self.ranks[at] = key, rank

    def _slots(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs = left << 16 | right
        at = self._slots(pairs)
        held = self.keys[at]
        out = np.where(held == pairs, self.ranks[at], self.NONE)
        where = np.nonzero((held != pairs) & (held >= 0))
        while len(where[0]):
            at[where] = (at[where] + 1) % len(self.keys)
            held = self.keys[at[where]]
            out[where] = np.where(held == pairs[where], self.ranks[at[where]], self.NONE)
            more = (held != pairs[where]) & (held >= 0)
            where = tuple(w[more] for w in where)
        return out

    def apply(self, letters: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids in a row, and their number for each word; ``letters`` has a row of bytes for each word."""
        order = np.argsort(sizes, kind="stable")
        counts = np.zeros(len(sizes), dtype=np.int64)
        parts = []
        for at in range(0, len(order), 4096):
            some = order[at : at + 4096]
            ids, counts[some] = self._block(letters[some], sizes[some])
            parts.append(ids)
        flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)
        first = np.zeros(len(sizes), dtype=np.int64)
        first[order] = np.cumsum(counts[order]) - counts[order]
        return flat[ragged(first, counts)], counts

    def _block(self, letters: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, width = np.arange(len(sizes)), int(sizes.max())
        letters = letters[:, :width]
        t = np.where(np.arange(width) < sizes[:, None], self.first[0, letters], self.PAD)
        t[rows, sizes - 1] = self.first[1, letters[rows, sizes - 1]]
        done = np.full((len(sizes), width), self.PAD, dtype=np.int64)
        r = self.rank(t[:, :-1], t[:, 1:])
        while len(rows):
            best = r.min(axis=1, initial=self.NONE)
            go = best < self.NONE
            if not go.all():
                done[rows[~go], : t.shape[1]] = t[~go]
                rows, t, r, best = rows[go], t[go], r[go], best[go]
                if not len(rows):
                    break
            at, every = r.argmin(axis=1), np.arange(len(rows))
            t[every, at] = self.made[best]
            cols = np.arange(t.shape[1] - 1)
            t = np.take_along_axis(t, cols + (cols > at[:, None]), axis=1)
            cols = cols[:-1]
            r = np.take_along_axis(r, cols + (cols >= at[:, None]), axis=1)
            for shift in (-1, 0):  # the pairs on both sides of the new id
                has = (at + shift >= 0) & (at + shift < r.shape[1])
                x, k = every[has], at[has] + shift
                r[x, k] = self.rank(t[x, k], t[x, k + 1])
        kept = done != self.PAD
        return done[kept].astype(np.uint32), kept.sum(axis=1)


class WordTable:
    """Ids of words of up to ``LONG`` bytes, by the bytes themselves as two 64-bit numbers.

    Begun anew, between batches of texts, when it holds ``words``.
    """

    def __init__(self, merges: Merges, words: int = CACHE_WORDS):
        self.merges, self.most = merges, words
        self._clear()

    def make_room(self) -> None:
        if len(self.first) > self.most:
            self._clear()

    def _empty(self, bits: int) -> None:
        self.bits = bits
        self.low, self.high, self.row = np.zeros(1 << bits, dtype=np.uint64), np.zeros(1 << bits, dtype=np.uint64), np.full(1 << bits, -1, dtype=np.int32)

    def _clear(self) -> None:
        self._empty((self.most * 2).bit_length())
        self.first, self.count, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32)

    @staticmethod
    def _mixed(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        x = (low ^ (high * _MIX)) * _MIX
        return (x ^ (x >> np.uint64(32))) * _MIX

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (self._mixed(low, high) >> np.uint64(64 - self.bits)).astype(np.int64)

    def distinct(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word once, or rarely twice, which does no harm."""
        order = np.argsort(self._mixed(low, high))
        low, high = low[order], high[order]
        first = np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]))
        return low[first], high[first]

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """A word's row, or -1."""
        at = self._slots(low, high)
        out = self.row[at]
        left = np.flatnonzero((out >= 0) & ((self.low[at] != low) | (self.high[at] != high)))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.row) - 1)
            x = at[left]
            out[left] = self.row[x]
            left = left[(out[left] >= 0) & ((self.low[x] != low[left]) | (self.high[x] != high[left]))]
        return out

    def add(self, low: np.ndarray, high: np.ndarray) -> None:
        """Words that are not there."""
        letters = np.stack([low, high], axis=1).astype("<u8").view(np.uint8).reshape(-1, LONG)
        ids, count = self.merges.apply(letters, (letters > 0).sum(axis=1))
        row = np.arange(len(low), dtype=np.int32) + np.int32(len(self.first))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
        self.count, self.ids = np.concatenate([self.count, count]), np.concatenate([self.ids, ids])
        if len(self.first) * 4 > len(self.row) * 3:
            held = self.row >= 0
            low, high, row = np.concatenate([self.low[held], low]), np.concatenate([self.high[held], high]), np.concatenate([self.row[held], row])
            self._empty((len(self.first) * 2).bit_length())
        at = self._slots(low, high)
        while len(row):
            # of those that meet in a free slot the first gets it
            free = np.flatnonzero(self.row[at] < 0)
            slot, which = np.unique(at[free], return_index=True)
            won = free[which]
            self.low[slot], self.high[slot], self.row[slot] = low[won], high[won], row[won]
            left = np.ones(len(row), dtype=bool)
            left[won] = False
            low, high, row, at = low[left], high[left], row[left], (at[left] + 1) & (len(self.row) - 1)


def slices(text: str, size: int = SLICE) -> list[str]:
    """The text in parts of about ``size`` characters, cut before white space."""
    out, at = [], 0
    while len(text) - at > size:
        found = _SPACE.search(text, at + size)
        if found is None:
            break
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as bytes."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        plain = model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges", "byte_fallback"))
        split = json.dumps(spec.get("pre_tokenizer"), ensure_ascii=False).replace("\\\\", "\\")
        self.quick = plain and steps == ["NFC", "Replace", "Lowercase"] and _SPLIT in split and len(model["vocab"]) < Merges.PAD
        if self.quick:
            pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
            self.table = WordTable(Merges(model["vocab"], pairs, model.get("end_of_word_suffix") or ""))
        self.model = self.tokenizer.model

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One encoder for each Python worker and file."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: bytes) -> np.ndarray:
        return np.array([t.id for t in self.model.tokenize(word.decode("latin-1").translate(_BYTE_LETTERS))], dtype=np.uint32)

    def _quick(self, parts: list[str]) -> list[bytes]:
        """Ids of lower-cased parts that end at white space."""
        raw = [p.encode() for p in parts]
        buf = np.frombuffer(b" ".join(raw) + bytes(LONG), dtype=np.uint8)
        n = len(buf) - LONG
        begin, end = cut(buf[:n])
        size = end - begin
        eight = np.ndarray((len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
        low, high = eight[begin] & _MASK[np.minimum(size, 8)], eight[begin + 8 * (size > 8)] & _MASK[np.clip(size - 8, 0, 8)]
        row = np.full(len(begin), -1, dtype=np.int64)
        self.table.make_room()
        fits = np.flatnonzero(size <= LONG)
        low, high = low[fits], high[fits]
        row[fits] = self.table.find(low, high)
        new = row[fits] < 0
        if new.any():
            self.table.add(*self.table.distinct(low[new], high[new]))
            row[fits] = self.table.find(low, high)
        first, count = self.table.first, self.table.count
        pool, long = self.table.ids, np.flatnonzero(size > LONG)
        if len(long):
            made: dict[bytes, int] = {}
            extra = []
            for k in long.tolist():
                w = bytes(buf[begin[k] : end[k]])
                if w not in made:
                    made[w] = len(first) + len(extra)
                    extra.append(self._word(w))
                row[k] = made[w]
            more = np.array([len(x) for x in extra])
            first, count = np.concatenate([first, len(pool) + np.cumsum(more) - more]), np.concatenate([count, more])
            pool = np.concatenate([pool, *extra])
        ids = pool[ragged(first[row], count[row])].astype("<u4").tobytes()
        # where each part's words, and so its ids, end
        words = np.searchsorted(begin, np.cumsum([len(r) + 1 for r in raw]))
        ends = (np.concatenate([[0], np.cumsum(count[row])])[words] * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, str]] = []
        size = 0

        def close() -> None:
            nonlocal held, size
            for (k, _), ids in zip(held, self._quick([x for _, x in held]), strict=True):
                out[k].append(ids)
            held, size = [], 0

        for k, text in enumerate(texts):
            if not text:
                continue
            if not self.quick or "<|" in text or _ODD.search(text):
                out[k].append(self._library(text))
                continue
            for part in slices(text.lower()):
                held.append((k, part))
                size += len(part)
                if size >= SLICE:
                    close()
        if held:
            close()
        return [b"".join(x) for x in out]

    def each(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text, a few at a time."""
        group: list[str | None] = []
        size = 0
        for text in texts:
            group.append(text)
            size += len(text or "")
            if size >= SLICE:
                yield from self.encode_all(group)
                group, size = [], 0
        yield from self.encode_all(group)

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]
