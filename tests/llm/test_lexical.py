"""Scores against a plain loop, with items cut and uncut, many blocks, ties and odd rows."""

import math
import random
import re
from collections import Counter

import pytest

from augury.llm import lexical

DOCS, ITEMS = "doc_id long, text string, score string", "item_id long, text string, rank int"


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower)


def brute(docs, items, top=10):
    w = [Counter(terms(t)) for _, t in docs]
    nd, nt = sum(1 for x in w if x), sum(x.total() for x in w)
    df = Counter(t for x in w for t in x)
    out = []
    for item, text in items:
        found = []
        for (doc, _), x in zip(docs, w, strict=True):
            if x:
                m = 100 - 75 + (75 * x.total() * nd) // nt
                s = sum(q * math.floor(1000 * math.log((2 * nd + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * x[t]) // (1000 * x[t] + 8 * m)) for t, q in Counter(terms(text)).items() if t in x)
                if s > 0:
                    found.append((-s, doc is None, doc if doc is not None else 0, doc))
        out += [(item, k + 1, f[3], -f[0]) for k, f in enumerate(sorted(found)[:top])]
    return Counter(out)


def found(spark, docs, items, **more):
    out = lexical.search(spark.createDataFrame([(*d, "x") for d in docs], DOCS), spark.createDataFrame([(*i, 1) for i in items], ITEMS), **more)
    return Counter(tuple(r) for r in out.select("item_id", "rank", "doc_id", "score").collect())


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    words = [f"w{k}" for k in range(60)] + ["Ünï", "x²", "THE", "the"]
    some = lambda n: r.choice([" ", ", ", "\n"]).join(r.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=n))
    docs = [(k, some(r.randrange(1, 60))) for k in range(300)] + [(7, some(20)), (7, some(20)), (None, some(30)), (900, None), (901, ""), (902, " ,. "), (903, some(5000))] + [(950 + k, "w1 w2 the") for k in range(25)]
    items = [(k, some(r.randrange(1, 30))) for k in range(12)] + [(3, some(9)), (None, some(9)), (50, None), (51, ""), (52, "nowhere"), (53, "w1 w2 w2"), (54, " ".join(words))]
    return docs, items


@pytest.mark.parametrize("max_terms", [200_000, 20, 7])
def test_equals_a_plain_loop(spark, corpus, monkeypatch, max_terms):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 500)
    docs, items = corpus
    assert found(spark, docs, items, max_terms=max_terms) == brute(docs, items)


def test_items_in_blocks_of_few_entries(spark, corpus, monkeypatch):
    monkeypatch.setattr(lexical, "MAX_ENTRIES", 40)
    docs, items = corpus
    counted = spark.createDataFrame([(i, t.encode(), q) for i, (_, x) in enumerate(items) for t, q in Counter(terms(x)).items()], "item long, term binary, many long")
    made = list(lexical.blocks(counted, 30))
    assert len(made) > 3 and sorted(i for b in made if b.whole for i, _, _ in b.items) == sorted({i for i, (_, x) in enumerate(items) if 0 < len(set(terms(x))) <= 30})
    assert all(len(b.terms) <= 30 for b in made)
    back = Counter((i, b.terms[t], q) for b in made for i, own, times in b.items for t, q in zip(own.tolist(), times.tolist(), strict=True))
    assert back == Counter((i, t.encode(), q) for i, (_, x) in enumerate(items) for t, q in Counter(terms(x)).items())


def test_long_texts_are_cut_at_gaps(monkeypatch):
    text = "ab cd,ef\n" * 300 + "x" * 50
    monkeypatch.setattr(lexical, "SLICE", 1)
    assert list(lexical.slices(text.encode(), 10)) != [text.encode()] and b"".join(lexical.slices(text.encode(), 10)) == text.encode()
    assert lexical.term_counts(text) == Counter(t.encode() for t in terms(text))


def test_empty_tables(spark, corpus):
    docs, items = corpus
    assert not found(spark, [], items) and not found(spark, docs, []) and not found(spark, [(1, None)], items)
    with pytest.raises(ValueError):
        lexical.search(spark.createDataFrame([("a", "b")], "doc_id string, text string"), spark.createDataFrame([], "item_id long, text string"))
