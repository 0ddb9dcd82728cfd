"""Removed words against every window of every text, with copies, odd rows, long texts and other lengths."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from augury.llm import substrings

SCHEMA = "doc_id long, text string, xx string"


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def brute(docs, n=50):
    w = [words_of(t) for _, t in docs]
    least = {}
    for (doc, _), x in zip(docs, w, strict=True):
        if doc is not None:
            for i in range(len(x) - n + 1):
                k = tuple(x[i : i + n])
                least[k] = min(least.get(k, doc), doc)
    out = []
    for (doc, _), x in zip(docs, w, strict=True):
        gone = set()
        if doc is not None:
            for i in range(len(x) - n + 1):
                if least[tuple(x[i : i + n])] < doc:
                    gone.update(range(i, i + n))
        kept = " ".join(v for i, v in enumerate(x) if i not in gone)
        out.append((doc, len(x), len(gone), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()))
    return Counter(out)


def found(spark, docs, n=50):
    df = substrings.find(spark.createDataFrame([(*d, "a") for d in docs], SCHEMA).select("doc_id", "text"), n)
    return Counter(tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())


def corpus(seed):
    r = random.Random(seed)
    some = lambda k: [r.choice("abcdefghij") + str(r.randrange(40)) for _ in range(k)]
    shared = [some(k) for k in (49, 50, 51, 75, 120, 300)]
    docs = []
    for k in range(60):
        x = some(r.randrange(0, 120))
        for s in r.sample(shared, r.randrange(0, 4)):
            at = r.randrange(len(x) + 1)
            x[at:at] = s
        docs.append((k, r.choice([" ", "\n", " \t "]).join(x)))
    base = some(400)
    for k in range(60, 80):  # near copies
        x = list(base)
        for _ in range(r.randrange(0, 5)):
            x[r.randrange(len(x))] = "edit"
        docs.append((k, " ".join(x)))
    docs += [(90 + k, "line one two three " * 40) for k in range(3)]  # the same window again and again
    docs += [(100, None), (101, ""), (102, " \n "), (None, " ".join(shared[5])), (None, " ".join(shared[5])), (5, " ".join(shared[5])), (5, " ".join(shared[5])), (103, "\x00é " * 60), (104, "\x00é " * 60), (104, "\x00é " * 60), (-7, " ".join(shared[4]))]
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize("n", [50, 64, 10])
def test_equals_every_window(spark, n):
    docs = corpus(n)
    assert found(spark, docs, n) == brute(docs, n)


def test_short_slices_change_nothing(spark, monkeypatch):
    docs = corpus(3)
    want = [list(substrings.runs(t, 50)) for _, t in docs[:40]]
    whole = [substrings.stand_ins(r[0][1][0], 25, 50) if r and len(r[0][1][0]) >= 50 else np.zeros(0) for r in want]
    monkeypatch.setattr(substrings, "SLICE", 90)
    for (_, t), w in zip(docs[:40], whole, strict=True):
        got = [(at, substrings.stand_ins(h[0], 25, 50)) for at, h, _ in substrings.runs(t, 50) if len(h[0]) >= 50]
        assert np.array_equal(np.concatenate([g for _, g in got]) if got else np.zeros(0), w)
        assert [a for a, _ in got] == np.cumsum([0, *[len(g) for _, g in got]])[:-1].tolist()
        assert [x for p in substrings.pieces(t) for x in p] == [x.encode() for x in words_of(t)]
    starts = [3, 60]
    assert substrings.cut_words("w " * 300, starts, 50)[1] == 100


def test_levels_halve():
    assert substrings.lengths(50) == [25, 50] and substrings.lengths(64) == [16, 32, 64] and substrings.lengths(10) == [10]


def test_stand_ins_are_the_least_of_each_window():
    h = np.random.default_rng(1).integers(0, 2**64, 400, dtype=np.uint64)
    a = substrings.rolled(h, 25, substrings._BASES[0])
    assert np.array_equal(substrings.stand_ins(h, 25, 50), [a[i : i + 26].min() for i in range(351)])
    twice = substrings.rolled(np.concatenate([h, h]), 25, substrings._BASES[0])
    assert np.array_equal(twice[:376], a) and np.array_equal(twice[400:], a)


def test_cut_keeps_rows_and_columns(spark):
    docs = corpus(4)
    out = substrings.cut(spark.createDataFrame([(*d, str(k)) for k, d in enumerate(docs)], SCHEMA)).collect()
    assert len(out) == len(docs) and set(out[0].asDict()) == {"doc_id", "text", "xx"}
    want = {k: (d, t) for k, (d, t) in enumerate(docs)}
    left = {r["xx"]: r for r in out}
    digests = {(d, n, g): h for (d, n, g, h) in brute(docs)}
    for k, (d, t) in want.items():
        r = left[str(k)]
        assert r["doc_id"] == d
        if r["text"] != t:
            n = len(words_of(t))
            gone = n - len(words_of(r["text"]))
            assert digests[(d, n, gone)] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_empty_table(spark):
    assert not found(spark, [])
