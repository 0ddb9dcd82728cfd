"""Toxicity by multiple-instance learning: document labels teach sentence scores.

A sentence's probability is a logistic function of its words; a document is toxic
unless all its sentences are clean (noisy-or).  The weights are fitted to document
labels through that formula, so the model also says which sentence offends.

A sentence's score is what its features add to the fitted background rate: it stays
clean with probability (1 + e^bias) / (1 + e^logit).  Sentences without any weighted
feature add nothing, and sentences with the same weighted features count once.  Clean
sentences that hold weighted features add a little each; in texts with more of these than
any document fitted on, what so many clean ones are likely to add (their mean, and
``SPREAD`` deviations) is taken off.  So neither harmless nor repeated nor many sentences
reject a text for its length.

Fitting uses a bounded sample of labelled documents (``sample_docs``, of texts of at
most ``SAMPLE_CHARS``), taken by the order of a hash of the id; features are hashes of
lower-cased words and of their beginnings.  Scoring reads every whole text.  Labels, language, source and id are never inputs of a score.

A null or empty text, or one without words, has no sentence and scores 0.0.  Rows
keep their other columns, repeated rows score alike, an empty table gives an empty
result, and without any toxic label every score is near 0.  Several labels of one
document count as toxic if one of them is; null labels are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augury.llm.common import filter_rows, map_rows
from augury.llm.tokens import WordCache

#: Documents that the model is fitted on, at most.
SAMPLE_DOCS = 5_000
#: Longer texts, in characters, are not fitted on; they are scored whole like all others.
SAMPLE_CHARS = 32_768
#: Features of fewer distinct toxic sentences are not used.
MIN_SENTENCES = 4
#: Deviations of the clean sentences' sum that a long text is granted.
SPREAD = 4.0
_TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]+")
_ENDS = frozenset(".!?\n")


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float
    #: What a clean sentence with weighted features adds: mean and mean square; and the most such sentences of a document fitted on.
    clean: tuple[float, float] = (0.0, 0.0)
    usual: int = 1 << 62

    def allowance(self, n: int) -> float:
        """What ``n`` distinct clean sentences with weighted features are likely to add, above the usual number of them."""
        mean, square = self.clean
        of = lambda k: mean * k + SPREAD * (square * k) ** 0.5
        return max(0.0, of(n) - of(self.usual)) if n > self.usual else 0.0


def lowered(text: str) -> str:
    """In lower case, sign by sign: only a dotted I would become two."""
    return text.replace("İ", "i").lower()


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(lowered(text))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_sample(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(text, toxic) of at most ``sample_docs`` labelled documents that are not held out; those with long texts are left out."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    texts = docs.select("doc_id", "text").filter(F.length("text") <= SAMPLE_CHARS)
    # at most sample_docs rows of two numbers
    joined = texts.join(F.broadcast(chosen), "doc_id")
    return joined.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.max("text").alias("text")).select("text", "toxic")


def word_features(word: str) -> set[int]:
    """Hashes of the word and of its beginnings of four to six letters."""
    return {zlib.crc32(word.encode("utf-8", "surrogatepass")) or 1} | {zlib.crc32(f"^{word[:k]}".encode("utf-8", "surrogatepass")) or 1 for k in (4, 5, 6) if len(word) > k}


def _bags(rows: list[list]) -> Iterator[tuple]:
    """Per document: its sentences as runs of feature hashes (0 ends one), each sentence and feature once."""
    known: dict[str, set[int]] = {}
    for text, toxic in zip(*rows, strict=True):
        seen, out, sentence = set(), [], set()
        for t in [*tokens(text), "."]:
            if t[0] not in _ENDS:
                sentence.add(t)
            elif sentence:
                if (key := frozenset(sentence)) not in seen:
                    seen.add(key)
                    bag: set[int] = set()
                    for w in key:
                        if w not in known:
                            known[w] = word_features(w)
                        bag |= known[w]
                    out += [*sorted(bag), 0]
                sentence = set()
        yield np.array(out, dtype="<u4").tobytes(), int(toxic > 0)


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, rounds: int = 150, shrink: float = 0.02, rate: float = 0.15) -> Model:
    """Fit the noisy-or by proximal gradient steps (Adam), on the driver, from the bounded sample.

    Features are those that toxic documents' distinct sentences hold clearly more
    often than clean ones'; copies of a sentence count once.  Weights are not negative:
    a sentence offends by what it holds.
    """
    sample = training_sample(docs, labels, sample_docs)
    bags = map_rows(sample, ["text", "toxic"], "bag binary, toxic int", lambda: _bags).collect()  # at most sample_docs rows
    bags = sorted((bytes(b), y) for b, y in bags if b)
    if not bags:
        return Model({}, -6.0)
    # what clean sentences add is measured on those that a model of the other half has not seen
    halves = [[x for x in bags if zlib.crc32(x[0]) % 2 == k] for k in (0, 1)]
    adds = np.concatenate([_clean_adds(_solve(halves[k], rounds, shrink, rate), halves[1 - k], halves[k]) for k in (0, 1)])
    out = _solve(bags, rounds, shrink, rate)
    usual = max((len(np.unique(row)) for row in _heavy(out, bags)), default=0)
    return replace(out, clean=(float(adds.mean()), float((adds**2).mean())) if len(adds) else (0.0, 0.0), usual=usual)


def _sentences(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of a document and the sentence of each."""
    x = np.frombuffer(bag, dtype="<u4")
    ends = x == 0
    return x[~ends], (np.cumsum(ends) - ends)[~ends]


def _weigh(model: Model, words: np.ndarray) -> np.ndarray:
    known = np.array(sorted(model.weights), dtype=np.int64)
    if not len(known):
        return np.zeros(len(words))
    weights = np.array([model.weights[h] for h in known.tolist()])
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    return np.where(known[at] == words, weights[at], 0.0)


def _heavy(model: Model, bags: list[tuple[bytes, int]]) -> Iterator[np.ndarray]:
    """Of each document the sentences of its weighted features."""
    for bag, _ in bags:
        words, sentence = _sentences(bag)
        yield sentence[_weigh(model, words) > 0]


def _keys(words: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    """A hash of each sentence's features."""
    mixed = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    out = np.zeros(int(sentence[-1]) + 1 if len(sentence) else 0, dtype=np.uint64)
    np.add.at(out, sentence, mixed)
    return out


def _clean_adds(model: Model, bags: list[tuple[bytes, int]], seen: list[tuple[bytes, int]]) -> np.ndarray:
    """What distinct sentences with weighted features of clean documents add, without those that are also in ``seen``."""
    known = {k for bag, _ in seen for k in _keys(*_sentences(bag)).tolist()}
    out = []
    for bag, toxic in bags:
        words, sentence = _sentences(bag)
        if toxic or not len(words):
            continue
        z = np.bincount(sentence, weights=_weigh(model, words), minlength=int(sentence[-1]) + 1)
        keys = _keys(words, sentence).tolist()
        for k in np.flatnonzero(z > 0).tolist():
            if keys[k] not in known:
                known.add(keys[k])
                out.append(np.logaddexp(0, min(model.bias + z[k], 30)) - np.logaddexp(0, min(model.bias, 30)))
    return np.array(out)


def _solve(bags: list[tuple[bytes, int]], rounds: int, shrink: float, rate: float) -> Model:
    """Weights and bias by proximal gradient steps."""
    if not bags:
        return Model({}, -6.0)
    flat = [np.frombuffer(b, dtype="<u4") for b, _ in bags]
    y = np.array([t for _, t in bags], dtype=np.float64)
    del bags
    doc_of = np.repeat(np.arange(len(flat), dtype=np.int32), [len(x) for x in flat])
    words = np.concatenate(flat)
    del flat
    ends = words == 0
    sentence_of = (np.cumsum(ends) - ends).astype(np.int32)
    doc_of_sentence = doc_of[ends]
    n_sentences = int(ends.sum())
    words, sentence_of = words[~ends], sentence_of[~ends]
    vocabulary = np.unique(words)
    code = np.searchsorted(vocabulary, words).astype(np.int32)
    # the first of equal sentences stands for all when features are counted
    mixed = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    sums = np.zeros(n_sentences, dtype=np.uint64)
    np.add.at(sums, sentence_of, mixed)
    first = np.zeros(n_sentences, dtype=bool)
    first[np.unique(sums, return_index=True)[1]] = True
    n_words = len(words)
    del mixed, sums, words, doc_of
    toxic_sentence = y[doc_of_sentence] > 0
    chosen = lean = np.zeros(0, dtype=np.int64)
    for once in (True, False):  # where every toxic sentence is a copy, copies count after all
        counted, kept = (first[sentence_of], first) if once else (np.ones(n_words, dtype=bool), np.ones(n_sentences, dtype=bool))
        df = np.bincount(code[counted], minlength=len(vocabulary))
        toxic_df = np.bincount(code[counted & toxic_sentence[sentence_of]], minlength=len(vocabulary))
        n1 = int((kept & toxic_sentence).sum())
        n0 = int(kept.sum()) - n1
        lean = np.log((toxic_df + 0.5) / (n1 + 1)) - np.log((df - toxic_df + 0.5) / (n0 + 1))
        chosen = np.flatnonzero((toxic_df >= MIN_SENTENCES) & (lean > 1.0))
        if len(chosen):
            break
    back = np.full(len(vocabulary), -1)
    back[chosen] = np.arange(len(chosen))
    col = back[code]
    used = col >= 0
    col, row = col[used], sentence_of[used]
    w, b = np.clip(lean[chosen], 0, 4) * 0.5, -5.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, rounds + 1):
        z = b + np.bincount(row, weights=w[col], minlength=n_sentences)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.bincount(doc_of_sentence, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(y))
        off = np.exp(clean)
        # d loss / d z: p for clean documents, -p off / (1 - off) for toxic ones
        pull = np.where(y > 0, -off / np.maximum(1 - off, 1e-9), 1.0)
        g = p * np.clip(pull, -50, 1)[doc_of_sentence] / len(y)
        gw, gb = np.bincount(col, weights=g[row], minlength=len(w)), g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        fix1, fix2 = 1 - 0.9**step, 1 - 0.99**step
        w = np.maximum(w - rate * (m / fix1) / (np.sqrt(v / fix2) + 1e-6) - rate * shrink, 0)
        b = b - rate * (mb / fix1) / (np.sqrt(vb / fix2) + 1e-6)
    return Model({int(h): float(x) for h, x in zip(vocabulary[chosen], w, strict=True) if x > 1e-3}, float(b))


class Scorer:
    def __init__(self, model: Model):
        self.model, self.bias, self.by_hash = model, model.bias, model.weights
        #: A word's weight, the sum over its features; infinite for what ends a sentence.
        self.weights = WordCache(lambda w: np.inf if w[0] in _ENDS else sum(self.by_hash.get(f, 0.0) for f in word_features(w)))

    def logit(self, words: set[str]) -> float:
        """Of a sentence: the bias and each of its features once."""
        found: set[int] = set()
        for w in words:
            found |= word_features(w)
        return self.bias + sum(self.by_hash.get(f, 0.0) for f in found)

    def over_background(self, words: set[str]) -> float:
        """Minus the log of the probability that a sentence is clean."""
        return float(np.logaddexp(0, min(self.logit(words), 30)) - np.logaddexp(0, min(self.bias, 30)))

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, probability) of each sentence with words, in code points."""
        out, start, end, seen = [], -1, 0, set()
        for m in [*_TOKEN.finditer(lowered(text)), None]:
            if m is None or m[0][0] in _ENDS:
                if seen:
                    out.append((start, m.end() if m else end, float(-np.expm1(-self.over_background(seen)))))
                start, seen = -1, set()
            else:
                start, end = (m.start() if start < 0 else start), m.end()
                seen.add(m[0])
        return out

    def score(self, text: str | None) -> float:
        if not text:
            return 0.0
        found = tokens(text)
        w = np.fromiter(map(self.weights.__getitem__, found), dtype=np.float64, count=len(found))
        ends = np.isinf(w)
        heavy = np.flatnonzero((w > 0) & ~ends)
        by: dict[int, set[str]] = {}
        for s, k in zip(np.cumsum(ends)[heavy].tolist(), heavy.tolist(), strict=True):
            by.setdefault(s, set()).add(found[k])
        # equal evidence once: sentences are told apart by their weighted features
        distinct = {frozenset(f for w in words for f in word_features(w) if f in self.by_hash): words for words in by.values()}
        added = sum(map(self.over_background, distinct.values()))
        if len(by) > self.model.usual and added > 0:
            edges = [-1, *np.flatnonzero(ends).tolist(), len(found)]
            added -= self.model.allowance(len({frozenset(found[edges[s] + 1 : edges[s + 1]]) for s in by}))
        return float(-np.expm1(-max(0.0, added)))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, and of documents predicted toxic the worst sentence (worst_start, worst_end)."""

    def make():
        scorer = Scorer(model)

        def run(c):
            for doc_id, text in zip(*c, strict=True):
                s = scorer.score(text)
                worst = max(scorer.sentences(text), key=lambda x: x[2], default=None) if s >= 0.5 else None
                yield doc_id, s, int(s >= 0.5), worst and worst[0], worst and worst[1]

        return run

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs, ["doc_id", "text"], f"doc_id {kind}, score double, predicted int, worst_start int, worst_end int", make)


def locate(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Offending sentences: doc_id, start, end, probability of at least ``least``."""

    def make():
        scorer = Scorer(model)
        return lambda c: ((d, *s) for d, t in zip(*c, strict=True) for s in scorer.sentences(t or "") if s[2] >= least)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs, ["doc_id", "text"], f"doc_id {kind}, start int, end int, probability double", make)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, all columns."""

    def make():
        scorer = Scorer(model)
        return lambda texts: [scorer.score(t) < threshold for t in texts]

    return filter_rows(docs, "text", make)
