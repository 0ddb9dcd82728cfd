"""Long tokens, plain secrets, several texts of a template, long and false headers, long clean texts, rare shingles, quantiles."""

import io
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from augury.llm import copies, decontaminate, hilbert, licenses, pii, simhash, token_counts, toxicity, warc
from augury.llm.common import table

# personal data


def test_tokens_of_any_length_and_secrets_without_digits():
    r = random.Random(1)
    for n in (200, 201, 241, 1000, 50_000):
        token = "".join(r.choice("abcdefGHIJK0123456789_-") for _ in range(n - 2)) + "a7"
        text = f"the token = {token}, thanks"
        assert ("secret", 12, 12 + n) in pii.candidates(text), n
    for text, s in (("my password is correcthorsebatterystaple.", "correcthorsebatterystaple"), ('pwd: "opensesame", ok', "opensesame"), ("API key=abcdefghijkl", "abcdefghijkl")):
        assert ("secret", text.index(s), text.index(s) + len(s)) in pii.candidates(text)
    assert not pii.candidates("a secret garden behind the token booth, no password needed")
    assert not pii.candidates("password is: x")
    model = pii.train()
    assert set(model.at_floor) <= set(pii.ADDED_KINDS) and all(model.thresholds[k] == 0.5 for k in model.at_floor)
    found = list(pii._added(['login secret = "correcthorsebatterystaple", bye'], [[]], model))
    assert found == [[("secret", 16, 41)]]


# licences


def test_a_template_may_have_several_texts(spark):
    one = " ".join(f"alpha{k} beta{k}" for k in range(20))
    two = " ".join(f"gamma{k} delta{k}" for k in range(20))
    t = spark.createDataFrame([("L", one), ("L", two), ("L", two), ("M", None)], "template string, text string")
    made = licenses.templates_from(t)
    assert made == sorted([("L", one), ("L", two)])
    docs = spark.createDataFrame([(1, f"x {one} y"), (2, f"{two} z"), (3, "nothing")], "doc_id long, text string")
    assert {(r.doc_id, r.template) for r in licenses.scan_documents(docs, made).collect()} == {(1, "L"), (2, "L")}


# archives


def _good(k):
    return warc.record(k, "http://x/", b"payload", warc.base32_sha1(b"payload"))


def test_a_header_of_100_kb_is_read():
    long = warc.record(7, "http://x/" + "y" * 100_000, b"body", warc.base32_sha1(b"body"))
    out = list(warc.salvage(io.BytesIO(_good(1) + long + _good(2))))
    assert [x[0] for x in out] == ["record"] * 3


@pytest.mark.parametrize("length", [10**9, 40 << 20])
def test_thousands_of_false_headers_take_seconds(length):
    """Lengths beyond the end of the file, and lengths that end inside it."""
    false = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\nno record at all\r\n" % length
    data = _good(1) + false * 5000 + _good(2) + b"z" * (48 << 20 if length < 10**9 else 1 << 20) + _good(3)
    began = time.time()
    out = list(warc.salvage(io.BytesIO(data)))
    assert [x[0] for x in out] == ["record", "gap", "record", "gap", "record"] and time.time() - began < 10
    assert out[1][1:3] == (len(_good(1)), len(_good(1)) + 5000 * len(false))


def test_headers_without_end_stop_at_the_next_version_line():
    data = b"WARC/1.1\r\nWARC-Type: x\r\n" * 20_000 + _good(1)
    began = time.time()
    assert [x[0] for x in warc.salvage(io.BytesIO(data))] == ["gap", "record"] and time.time() - began < 10


# toxicity


def test_long_texts_of_real_clean_sentences_pass(spark):
    """Distinct sentences of documents labelled clean, of sf0.1, 1,000 to all of them; and a toxic text stays toxic."""
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.fit(docs, labels)
    scorer = toxicity.Scorer(model)
    told = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.join(told, "doc_id").select("text", "toxic", toxicity.held_out(F.col("doc_id")).alias("held")).collect()
    pool = sorted({r.text[a:b] for r in rows if not r.toxic for a, b, _ in scorer.sentences(r.text)})
    assert len(pool) > 90_000
    random.Random(1).shuffle(pool)
    for n in (1000, 3000, 10_000, 30_000, len(pool)):
        assert scorer.score(" . ".join(pool[:n])) < 0.5, n
    held = [(r.toxic, scorer.score(r.text) >= 0.5) for r in rows if r.held]
    assert sum(t and s for t, s in held) >= 0.85 * sum(t for t, _ in held) and sum(s and not t for t, s in held) <= 0.02 * sum(not t for t, _ in held)
    assert model.allowance(model.usual) == 0 < model.allowance(10 * model.usual)


# near copies


def _family(n, r):
    """Sets around one common passage: similarity about 0.6; every tenth has an edited twin of about 0.85."""
    common = [f"c{k}" for k in range(300)]
    out = []
    for k in range(n):
        own = [f"w{k}x{j}" for j in range(100)]
        out.append((2 * k, " ".join(common + own)))
        if k % 10 == 0:
            own[r.randrange(5, 95)] = "edit"
            cut = list(common)
            cut[r.randrange(5, 295)] = "other"
            out.append((2 * k + 1, " ".join(cut + own)))
    return out


def test_nodes_around_a_passage_are_compared_by_rare_shingles(spark, monkeypatch):
    """2,000 texts of similarity 0.6 share keys: groups that are compared stay linear in them, and twins are found."""
    rows = _family(2000, random.Random(4))
    seen = []
    real = copies._map_groups

    def counted(df, by, *rest):
        if by == ["key", "i", "j"]:
            seen.append(df.groupBy(*by).count().select((F.col("count") * F.col("count") / 2).alias("p")).agg(F.sum("p")).first()[0] or 0)
        return real(df, by, *rest)

    monkeypatch.setattr(copies, "_map_groups", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in copies.keep_one_of_each(docs, most=64).collect()}
    assert kept == {d for d, _ in rows if d % 2 == 0}
    assert seen and seen[0] < 64 * 32 * len(rows)  # far from the two million pairs for each of many keys


def test_rare_shingles_lose_no_similar_pair(spark):
    r = np.random.default_rng(2)
    pool = r.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.unique(r.choice(pool, r.integers(1, 40), replace=False)) for _ in range(300)]
    rows = [(k, k, len(x), x.astype("<u8").tobytes()) for k, x in enumerate(sets)]
    df = spark.createDataFrame(rows, "node long, root long, n long, shingles binary")
    like = copies.Likeness(least=0.6)
    met = {}
    for x in copies._by_rare_shingles(df, like, 50, []).collect():
        met.setdefault((x.key, x.i, x.j), set()).add(x.node)
    pairs = {(a, b) for g in met.values() for a in g for b in g if a < b}
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if copies.jaccard(sets[a], sets[b]) >= 0.6}
    assert want and want <= pairs


# token counts


def test_quantiles_are_the_least_lengths_that_hold_the_share(spark):
    r = random.Random(3)
    have = sorted(r.choice([0, 5, 9, 2000, 3000, r.randrange(5000)]) for _ in range(400))
    hist = spark.createDataFrame([(x,) for x in have], "n_tokens long").groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    t = token_counts.context_table(hist)
    probs = [0.0, 0.01, 0.5, 0.9, 0.999, 1.0]
    got = {q.prob: q.context_limit for q in token_counts.quantiles(t, probs).collect()}
    assert got == {p: next(x for i, x in enumerate(have) if sum(y <= x for y in have) >= p * len(have)) for p in probs}
    assert all(x.quantile == x.docs_at_most / x.docs_total for x in t.collect())


# sharding: texts as dimensions


@pytest.mark.parametrize("parts", [1, 6])
def test_cut_points_of_whole_texts(spark, parts):
    r = random.Random(3)
    for many in (0, 1, 5, 400):
        texts = [f"https://example.org/{r.randrange(many):04}" for _ in range(many)] + ["https://example.org/hot"] * (many // 2)
        df = spark.createDataFrame([(t,) for t in texts] + [(None,)] * 3, "t string")
        rows = sorted(texts)
        want = sorted({rows[-(-i * len(rows) // 8) - 1] for i in range(1, 8)}) if rows else []
        assert [x.cuts for x in hilbert.text_cuts(df, "t", 3, parts).collect()] == [want]


def test_texts_that_begin_alike_fall_into_different_shards(spark):
    docs = spark.createDataFrame([(k, f"https://example.org/long/common/{k % 8}", "en", "t") for k in range(800)], "doc_id long, source string, lang string, text string")
    got = hilbert.hilbert_order(docs, ["source"], ["doc_id"], bits=3)
    assert got.select("source", "curve").distinct().count() == 8 == got.select("curve").distinct().count()
    ranked = {x.source: (x.a, x.z) for x in got.groupBy("source").agg(F.min("rank").alias("a"), F.max("rank").alias("z")).collect()}
    assert all(z - a == 99 for a, z in ranked.values())


# decontamination: windows that many items share


def test_shared_windows_are_not_multiplied_by_their_items(spark):
    shared = " ".join(f"w{k}" for k in range(40))
    bench = spark.createDataFrame([(f"i{k}", f"{shared} own{k} more{k}") for k in range(50)] + [("alone", " ".join(f"x{k}" for k in range(12)))], "item_id string, text string")
    docs = spark.createDataFrame([(k, f"before {shared} after {k}") for k in range(20)] + [(100, f"{shared} own7 more7"), (101, " ".join(f"x{k}" for k in range(11))), (102, None)], "doc_id long, text string")
    items = decontaminate._item_windows(bench, 10)
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), "text")
    # 31 windows of the passage, 2 more of an item's own, 2 of the other item
    assert decontaminate._places_by_shuffle(rows, items).count() == 21 * 31 + 2 + 2
    assert decontaminate._owners(items).count() == 50 + 50 + 1
    quick, slow = (sorted(map(tuple, decontaminate.scan_documents(docs, bench, max_windows=m).collect())) for m in (500_000, 0))
    assert quick == slow and {x[0]: x[3] for x in slow} == {k: 50 for k in range(20)} | {100: 50, 101: 1, 102: 0}


# joins behind an explode


def test_exploded_rows_are_merged_not_broadcast(spark, monkeypatch):
    """Spark takes an exploded table for as small as the table before, so tables of any size below the threshold were broadcast 32 or 64 times over."""
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    seen, write = [], simhash.materialise
    for module in (simhash, copies):
        monkeypatch.setattr(module, "materialise", lambda df, *made: (seen.append(plan(df)), write(df, *made))[1])
    nodes = spark.range(40).select(F.xxhash64("id").alias("node")).withColumn("f0", F.col("node"))
    found = simhash.links(nodes, simhash.Scheme())
    assert "SortMergeJoin" in plan(found) and "Broadcast" not in plan(found)
    common = " ".join(f"c{k}" for k in range(400))
    docs = spark.createDataFrame([(k, f"{common} d{k}") for k in range(40)], "doc_id long, text string")
    assert copies.keep_one_of_each(docs, most=8).count() == 1
    copied = [p for p in seen if "explode(" in p]
    assert copied and not [p for p in copied if "BroadcastHashJoin [key" in p or "BroadcastHashJoin [seg" in p]
