"""Every operator against brute force, and against nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import io
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from augury.llm import boosting, decontaminate, graph, hilbert, licenses, mpeg, packing, pii, queries, simhash, token_counts, toxicity, tokens, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TABLES = "documents pages benchmark labels".split()
ODD = [
    (None, "a text without an id and some words in it", "en", "s", 41),
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, "word " * 60_000, "en", "s", 300_000),
    (4, "the same words again and again here", "en", "s", 35),
    (5, "the same words again and again here", "en", "s", 35),
    (5, "the same words again and again here", "en", "s", 35),
    (6, "Ünïcödé 日本語 ΣΑΣ   ﬁ İstanbul <|endoftext|> it's we'll 10²", "xx", "", 50),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with extra columns whose names clash with what operators use inside."""
    df = spark.createDataFrame(ODD, DOCS)
    return df.withColumns({c: F.lit("x") for c in ("node", "score", "rank", "key", "hit", "spans", "__row", "length", "u", "v", "__extra_", "f0", "sha1")})


@pytest.fixture(scope="module")
def real(spark, sf_dir):
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}


@pytest.fixture(scope="module")
def texts(real):
    return {r.doc_id: r.text for r in real["documents"].select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def same_as_sql(df, con, sql):
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    want = Counter(tuple(str(v) for _, v in sorted(zip(names, r, strict=True))) for r in found.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert Counter(tuple(str(v) for v in r) for r in df.select(*sorted(names)).collect()) == want


# toxicity


def test_toxicity_learns_from_documents_and_finds_sentences(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    scored = toxicity.score_documents(docs, model).join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id"))).select("score", "toxic").collect()
    pos, neg = [r[0] for r in scored if r[1] == 1], [r[0] for r in scored if r[1] == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.85
    found = toxicity.locate(docs, model).collect()
    assert found and all(0 <= r["start"] < r["end"] for r in found)


def test_toxicity_planted_words(spark):
    bad = ["grzmot", "plugawy"]
    rows = [(i, f"alpha beta w{i % 7}x gamma. " + (f"delta {bad[i % 2]} epsilon. " if i % 4 == 0 else "delta epsilon. ") + "zeta eta.", "en", "s", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    assert all(got[i].predicted == (i % 4 == 0) for i in range(400))
    worst = got[4]
    assert "grzmot" in rows[4][1][worst.worst_start : worst.worst_end]
    assert toxicity.drop_toxic(docs, model).count() == 300
    # noisy-or by hand equals the score
    s = toxicity.Scorer(model)
    for _, t, *_ in rows[:8]:
        assert s.score(t) == pytest.approx(1 - np.prod([1 - p for *_, p in s.sentences(t)]), abs=1e-9)


def test_toxicity_does_not_grow_with_length():
    bad = zlib.crc32(b"plugawy")
    for bias in (-5.0, -8.5):
        s = toxicity.Scorer(toxicity.Model({bad: 12.0, zlib.crc32(b"mild"): 1.0}, bias))
        for n in (10_000, 100_000):
            for clean in (" ".join(f"alpha beta {'abcdefghij'[k % 10]}{chr(0x4E00 + k // 10)} gamma." for k in range(n)), "alpha beta gamma. " * n, "a mild beta. " * n):
                assert s.score(clean) < 0.5
                assert s.score(clean + " delta plugawy epsilon.") > 0.9
        once, twice = "one plugawy. a mild beta.", "one plugawy. a mild beta. plugawy one. a mild beta."
        assert s.score(once) == pytest.approx(s.score(twice), abs=1e-12)


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1, 1), (4, 1, None), (None, 1, 1), (6, 1, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(odd, toxicity.fit(odd, labels)).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.doc_id in (1, 2)} == {0.0}
    empty = odd.limit(0)
    assert toxicity.score_documents(empty, toxicity.fit(empty, labels.limit(0))).count() == 0


# archives


def test_warc_equals_sql(spark, sf_dir, duck):
    same_as_sql(queries.op2_warc(spark, sf_dir), duck, queries.OP2_SQL)


def test_warc_odd_pages(spark):
    rows = [(1, None, None, 9), (2, "http://a\r\nX: y", "", 9), (3, "u", "ünï", 9), (3, "u", "ünï", 9), (4, "u", "ünï", 9), (None, "u", "ünï", 9), (None, None, "alone", 9), (7, "u", "z" * 3_000_000, 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha1 int")
    read = warc.read_archives(spark, warc.write_archives(pages, file_bytes=200)).collect()
    assert {r.status for r in read} == {"record"} and len(read) == len(rows)
    got = Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in read)
    assert got == Counter([("1", "response", None, 0), ("2", "revisit", "1", 0), ("3", "response", None, 5), ("3", "response", None, 5), ("4", "revisit", "3", 5), (None, "revisit", "3", 5), (None, "response", None, 5), ("7", "response", None, 3_000_000)])
    assert warc.read_archives(spark, warc.write_archives(pages.limit(0))).count() == 0
    small = warc.read_archives(spark, warc.write_archives(pages, min_bytes=10)).collect()
    assert {r.record_type for r in small} == {"response"}


def test_warc_salvage():
    one = [warc.record(i, "u", f"payload {i} ".encode() * 50, warc.base32_sha1(f"payload {i} ".encode() * 50)) for i in range(6)]
    for pack in (warc.member, bytes):
        parts = [pack(r) for r in one]
        whole = list(warc.salvage(io.BytesIO(b"".join(parts))))
        assert [k for k, *_ in whole] == ["record"] * 6
        hurt = bytearray(parts[2])
        hurt[len(hurt) // 2] ^= 0xFF
        data = b"junk" + parts[0] + parts[1] + bytes(hurt) + parts[3] + b"\x1f\x8b\x08 no member" + parts[4] + parts[5][:-9]
        got = list(warc.salvage(io.BytesIO(data)))
        ids = [w[0]["warc-record-id"] for k, _, _, w in got if k == "record"]
        assert ids == [f"<urn:x-page:{i}>" for i in (0, 1, 3, 4)]
        assert [k for k, *_ in got] == ["gap", "record", "record", "gap", "record", "gap", "record", "gap"]
        assert got[0][1] == 0 and got[-1][2] == len(data) and all(a[2] == b[1] for a, b in zip(got, got[1:], strict=False))


# licenses


def brute_cover(a, b):
    """Best local alignment without band: (+2, -1)."""
    score = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            score[i, j] = max(0, score[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), score[i - 1, j] - 1, score[i, j - 1] - 1)
    return score.max()


def test_license_scan_finds_planted_templates_with_edits():
    s = licenses.Scanner()
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0"]
    edited = mit.replace("free of charge", "at no cost").replace("publish, ", "")
    text = f"Lorem ipsum dolor.\n{edited}\nmore text here {gpl} end"
    got = {m[0]: m for m in s.scan(text)}
    assert set(got) == {"MIT", "GPL-3.0"}
    assert text[got["GPL-3.0"][1] : got["GPL-3.0"][2]].startswith("This program") and got["GPL-3.0"][5] == 1.0
    assert 0.9 < got["MIT"][5] < 1.0
    assert s.scan(None) == s.scan("") == s.scan("of the software") == []
    for name, t in licenses.TEMPLATES.items():
        assert name in {m[0] for m in s.scan(f"x {t} y {t}")}


def test_license_alignment_equals_brute_force():
    r = np.random.default_rng(0)
    for _ in range(20):
        a = r.integers(1, 9, 12)
        b = np.concatenate([r.integers(1, 9, 3), np.delete(a, 5), r.integers(1, 9, 3)])
        got = licenses.align(a, b, 3, 30)
        want = brute_cover(a, b)
        matched, a0, a1, b0, b1 = got
        gaps = (a1 - a0) + (b1 - b0) - 2 * matched
        assert matched * 2 - gaps <= want <= matched * 2 and want >= 2 * 11 - 1


def test_license_documents(spark, real, odd, texts):
    got = Counter((r.doc_id, r.template) for r in licenses.scan_documents(real["documents"]).collect())
    lines = {k: v for k, v in licenses.TEMPLATES.items() if k.endswith("-line")}
    want = {(d, k) for d, t in texts.items() for k, v in lines.items() if v in (t or "")}
    assert want <= set(got)
    assert licenses.scan_documents(odd).count() == 0


# token counts


def test_encoder_equals_library(texts):
    e = tokens.Encoder(tokens.default_vocabulary())
    assert e.quick
    for t in [*texts.values(), *[r[1] for r in ODD], "İ ﬁ ſ ʼn '' ''s don't 'll!'s", "a\x85b\x1cc\xa0d", "Ünï ß ÿ Ÿ ñÑ ¿que? «x»", "<|startoftext|> x"]:
        assert e.encode(t) == (e._library(t) if t else b"")


def test_token_counts(spark, real, odd, texts):
    e = tokens.Encoder(tokens.default_vocabulary())
    for df, all_texts in ((real["documents"], list(texts.values())), (odd, [r[1] for r in ODD])):
        n = [len(e.encode(t)) // 4 for t in all_texts]
        table = token_counts.context_table(token_counts.histogram(df))
        got = {r.context_limit: r for r in table.collect()}
        assert set(got) == set(n)
        for limit, r in got.items():
            assert r.n_docs == n.count(limit) and r.docs_total == len(n) and r.tokens_total == sum(n)
            assert r.docs_at_least == sum(x >= limit for x in n) and r.tokens_at_least == sum(x for x in n if x >= limit)
            assert r.docs_over == sum(x > limit for x in n) and r.docs_at_most == sum(x <= limit for x in n)
            assert r.truncated_total == sum(min(x, limit) for x in n)
        limits = [0, 1, 7, 100, 1000, 1023, 1024, 1025, 2048, 5000, 10**7, *n[:5]]
        asked = token_counts.truncated_totals(table, spark.createDataFrame([(x,) for x in limits], "context_limit long")).collect()
        assert Counter((r.context_limit, r.truncated_total) for r in asked) == Counter((x, sum(min(v, x) for v in n)) for x in limits)
    assert token_counts.context_table(token_counts.histogram(odd.limit(0))).count() == 0


# decontamination


def test_decontaminate_equals_sql(spark, sf_dir, duck):
    same_as_sql(queries.op5_decontaminate(spark, sf_dir), duck, queries.OP5_SQL)


def test_decontaminate_odd(spark, odd):
    items = [(1, "the SAME, words"), (2, "again and again here"), (3, None), (4, "..."), (None, "word word word word word word word word word word word"), (1, "the same words"), (10, "the same words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    quick = decontaminate.scan_documents(odd, bench)
    slow = decontaminate.scan_documents(odd, bench, max_windows=0)
    key = lambda df: Counter(map(tuple, df.collect()))
    assert key(quick) == key(slow)
    got = {r.doc_id: r for r in quick.collect()}
    assert got[5].n_hit == 7 and got[5].n_items == 3 and got[5].items_sha256 == hashlib.sha256(b"1,10,2").hexdigest()
    assert got[3].n_hit == 60_000 and got[1].n_words == 0 and got[2].n_words == 0
    assert decontaminate.scan_documents(odd, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.scan_documents(odd.limit(0), bench).count() == 0
    kept = decontaminate.decontaminate(odd, bench)
    assert kept.columns == odd.columns and Counter(r.doc_id for r in kept.collect()) == Counter([None, 1, 2, 6])
    assert Counter(r.doc_id for r in decontaminate.decontaminate(odd, bench, max_windows=0).collect()) == Counter([None, 1, 2, 6])
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(odd, bench, "spans").collect()}
    assert cut[4] == "" and cut[6] == ODD[7][1] and cut[1] is None


# packing


def test_decontaminate_ways_agree_on_shared_ids(spark, odd):
    bench = spark.createDataFrame([(1, "the same words"), (2, "again words and"), (3, "in it")], "item_id long, text string")
    more = [(None, "clean and without an id"), (None, "it holds the same words"), (1, "Again, words AND the same words! So."), (1, "clean"), (1, "clean"), (6, None), (6, "")]
    docs = odd.unionByName(spark.createDataFrame([(d, t, "en", "s", 1) for d, t in more], DOCS), allowMissingColumns=True)
    for action in ("documents", "spans"):
        quick, slow = (decontaminate.decontaminate(docs, bench, action, max_windows=m) for m in (500_000, 0))
        assert quick.columns == slow.columns == docs.columns
        rows = Counter(map(tuple, slow.collect()))
        assert rows == Counter(map(tuple, quick.collect()))
        assert sum(r[:2] == (1, "clean") for r in rows.elements()) == 2 and sum(r[:2] == (None, "clean and without an id") for r in rows) == 1
    assert (1, "! So.") in {r[:2] for r in rows} or any(r[0] == 1 and r[1] and r[1].endswith("! So.") for r in rows)


def check_packing(rows, n_docs):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    total = sum(r.length for r in rows)
    least = -(-total // packing.CAPACITY)
    assert len({(r.doc_id, r.piece, r.start) for r in rows if r.piece == 0}) <= n_docs
    return len(by), least


def test_packing_real(spark, real, texts):
    rows = packing.pack_documents(real["documents"]).collect()
    used, least = check_packing(rows, len(texts))
    assert least <= used <= least * 1.02 + 1
    e = tokens.Encoder(tokens.default_vocabulary())
    for r in rows:
        ids = (e.encode(texts[r.doc_id]) + b"\0\0\0\0")[4 * r.start : 4 * (r.start + r.length)]
        assert r.start == r.piece * 2048 and zlib.crc32(ids) == r.ids_crc32 and len(ids) == 4 * r.length


def test_packing_odd(spark, odd):
    rows = packing.pack_documents(odd).collect()
    check_packing(rows, len(ODD))
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r[0] for r in ODD)
    assert [r.length for r in rows if r.doc_id in (1, 2)] == [1, 1]
    assert packing.pack_documents(odd.limit(0)).count() == 0
    whole = packing.sequences(odd).collect()
    assert sum(r.n_tokens for r in whole) == sum(r.length for r in rows) and all(r.n_tokens == len(r.ids) for r in whole)


def test_packing_plan_uses_every_piece_and_is_tight():
    r = np.random.default_rng(1)
    for cap, n in ((20, 60), (64, 400), (2048, 5000)):
        counts = Counter(r.integers(1, cap + 1, n).tolist())
        plan = packing.plan(counts, cap)
        used = Counter()
        for lengths, times in plan:
            assert sum(lengths) <= cap and times > 0
            for x in lengths:
                used[x] += times
        assert used == counts
        least = -(-sum(k * v for k, v in counts.items()) // cap)
        ffd = []
        for x in sorted(counts.elements(), reverse=True):
            k = next((i for i, room in enumerate(ffd) if room >= x), None)
            ffd.append(cap - x) if k is None else ffd.__setitem__(k, ffd[k] - x)
        assert least <= sum(t for _, t in plan) <= len(ffd) + 1
    assert packing.plan({}) == []


# sharding


def brute_hilbert(coords, bits):
    """The curve by recursion over sub-cubes, independent of the bit tricks: neighbours differ by one step."""
    return [sum(abs(a - b) for a, b in zip(x, y, strict=True)) for x, y in zip(coords, coords[1:], strict=False)]


@pytest.mark.parametrize("n,bits", [(1, 3), (2, 1), (2, 4), (3, 3), (4, 2)])
def test_curve_is_a_path_through_all_cells(spark, n, bits):
    cells = spark.range(2 ** (n * bits)).select(*[F.expr(f"shiftrightunsigned(id, {bits * i}) & {2**bits - 1}").alias(f"x{i}") for i in range(n)])
    rows = cells.select("*", hilbert.curve_index([F.col(f"x{i}") for i in range(n)], bits).alias("c")).orderBy("c").collect()
    assert [r.c for r in rows] == list(range(2 ** (n * bits)))
    assert set(brute_hilbert([tuple(r[:-1]) for r in rows], bits)) == {1}


def check_shards(rows, n):
    size = Counter(r.shard for r in rows)
    assert set(size) <= set(range(40)) and max(size.get(s, 0) for s in range(40)) - min(size.get(s, 0) for s in range(40)) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(rows) == n


def test_sharding(spark, sf_dir, texts, odd):
    rows = queries.op7_hilbert_sharding(spark, sf_dir).collect()
    check_shards(rows, len(texts))
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw)
    spans = defaultdict(list)
    for r in rows:
        spans[r.shard].append(r.curve)
    ordered = [v for _, v in sorted(spans.items())]
    assert all(max(a) <= min(b) for a, b in zip(ordered, ordered[1:], strict=False))
    check_shards(hilbert.shard_documents(odd).collect(), len(ODD))
    assert hilbert.shard_documents(odd.limit(0)).count() == 0


# media


def test_mpeg_round_trip(spark, odd, real, texts):
    for df, rows in ((odd, [(r[0], r[1]) for r in ODD]), (real["documents"], list(texts.items()))):
        got = mpeg.read(mpeg.store(df)).collect()
        want = Counter()
        for d, t in rows:
            raw = (t or "").encode()
            p = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
            want[d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
        assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
        assert all(r.verified for r in got)
    assert mpeg.read(mpeg.store(odd.limit(0))).count() == 0


def test_mpeg_resynchronises_and_verifies():
    payload = bytes(range(256)) * 40
    data = mpeg.encode(payload, len(payload))
    s = mpeg.decode(data)
    assert s.payload == payload and s.frames == s.xing_frames and s.samples == 1152 * s.frames and s.duration_us == s.frames * 36_000
    start = data.index(b"\xff\xfa")
    assert len(data) - start == s.xing_bytes and len(s.toc) == 100 and list(s.toc) == sorted(s.toc)
    first = s.seek[0][1]
    # junk between frames is skipped and logged
    torn = mpeg.decode(data[:first] + b"\xff\xfbjunk\xff" + data[first:] + b"TAG" + bytes(125))
    assert torn.payload == payload and torn.skipped == [(first, first + 7)]
    # a damaged checksum is counted and its frame not believed
    hurt = bytearray(data)
    hurt[first + 10] ^= 1
    bad = mpeg.decode(bytes(hurt))
    assert bad.bad_crc == 1 and bad.frames == s.frames and len(bad.payload) < len(payload)
    assert mpeg.decode(None).frames == mpeg.decode(b"\xff" * 999).frames == 0
    # the checksum against bitwise division
    for block in (b"", b"123456789", bytes(34)):
        c = 0xFFFF
        for bit in "".join(f"{b:08b}" for b in block):
            c = (c << 1 ^ (0x8005 if (c >> 15) ^ int(bit) else 0)) & 0xFFFF
        assert mpeg.crc16(block) == c


# near-duplicates


def brute_fingerprint(text, words):
    found = [w for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    if not found:
        return 0
    sh = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, k):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(fps, 2):
        if (a ^ b).bit_count() <= k:
            root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def check_simhash(df, rows):
    fp = [(d, brute_fingerprint(t, 3)) for d, t in rows]
    root = brute_components(list({f for _, f in fp}), 2)
    least = defaultdict(list)
    for d, f in fp:
        if d is not None:
            least[root[f]].append(d)
    want = Counter((d, f"{f:016x}", min(least[root[f]], default=None)) for d, f in fp)
    got = Counter((r.doc_id, r.fp, r.component_id) for r in df.select("doc_id", simhash.hex_fingerprint(F.col("f0")).alias("fp"), "component_id").collect())
    assert got == want


CONTRACT = simhash.Scheme(words=3, lanes=1, segments=2, distance=2)


@pytest.mark.parametrize("most", [16, 1])
def test_simhash_equals_brute_force(spark, real, odd, texts, most):
    check_simhash(simhash.near_duplicates(real["documents"], CONTRACT, most), list(texts.items()))
    check_simhash(simhash.near_duplicates(odd, CONTRACT, most), [(r[0], r[1]) for r in ODD])
    assert simhash.near_duplicates(odd.limit(0), CONTRACT, most).count() == 0


@pytest.mark.parametrize("most,distance", [(16, 2), (2, 2), (0, 2), (2, 1), (0, 0)])
def test_simhash_links_on_planted_fingerprints(spark, most, distance):
    r = np.random.default_rng(5)
    fps = {int(x) for x in r.integers(0, 2**63, 60)}
    for f in list(fps)[:12]:
        for _ in range(12):
            bits = r.choice(64, size=r.integers(1, 4), replace=False)
            fps.add(f ^ sum(1 << int(b) for b in bits))
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    nodes = spark.createDataFrame([(s, s) for s in signed.values()], "node long, f0 long")
    found = simhash.links(nodes, simhash.Scheme(3, 1, 2, distance), most)
    got = {x.node: x.root for x in graph.connected_components(found).collect()}
    root = brute_components(list(fps), distance)
    groups, want = defaultdict(set), defaultdict(set)
    for f in fps:
        groups[got.get(signed[f], signed[f])].add(f)
        want[root[f]].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components(spark):
    r = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(int(a), int(b)) for a, b in r.integers(200, 300, (80, 2))] + [(None, 3), (7, 7)]
    got = {x.node: x.root for x in graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30))
    for a, b in edges:
        if a is not None and a != b:
            assert got[a] == got[b] <= min(a, b)
    assert graph.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_copies_stage(spark, odd):
    r = np.random.default_rng(3)
    word = lambda: "".join(chr(97 + int(x)) for x in r.integers(0, 26, 6))
    rows, base = [], [[word() for _ in range(300)] for _ in range(40)]
    for k, w in enumerate(base):
        rows.append((10 * k, " ".join(w)))
        edited = list(w)
        for at in r.choice(290, size=3, replace=False):
            edited[at] = word()
        rows.append((10 * k + 1, " ".join(edited)))
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], DOCS)
    kept = {x.doc_id for x in simhash.keep_one_of_each(docs).collect()}
    assert {10 * k for k in range(40)} <= kept and len(kept) <= 44  # recall of at least 0.9 at similarity 0.9
    hot = {x.doc_id for x in simhash.keep_one_of_each(docs, most=0).collect()}
    assert {10 * k for k in range(40)} <= hot and len(hot) <= 44
    out = simhash.keep_one_of_each(odd)
    assert out.columns == odd.columns and Counter(x.doc_id for x in out.collect()) == Counter([None, 1, 2, 3, 4, 6])


def edited(r, words, share):
    """``words`` with a share of them replaced by new ones, at random places."""
    out = list(words)
    for at in r.choice(len(words), size=round(share * len(words)), replace=False):
        out[at] = f"x{r.integers(1 << 60):x}"
    return out


def brute_jaccard(a, b):
    a, b = ({" ".join(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(a & b) / len(a | b)


def test_near_copies_equal_brute_force(spark):
    # pairs around similarities of 0.75, 0.8 and 0.85: each is decided by its sets of shingles
    r = np.random.default_rng(11)
    rows, like = [], {}
    for k in range(240):
        a = [f"w{r.integers(1 << 60):x}" for _ in range(400)]
        b = edited(r, a, r.uniform(0.010, 0.040))
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        like[k] = brute_jaccard(*(t for _, t in rows[-2:]))
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], DOCS)
    kept = {x.doc_id for x in simhash.keep_one_of_each(docs).collect()}
    for low, high in ((0.7, 0.8), (0.8, 0.85), (0.85, 0.9)):
        near = [k for k, s in like.items() if low <= s < high]
        assert len(near) > 15 and [k for k in near if (2 * k + 1 not in kept) != (low >= 0.8)] == []


def test_near_copies_judge_rows_by_their_own_text(spark):
    r = np.random.default_rng(12)
    a, b = (" ".join(f"w{r.integers(1 << 60):x}" for _ in range(50)) for _ in range(2))
    rows = [(1, a), (2, a), (2, b), (3, "unlike the others in each word"), (3, "unlike the others in each word")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], DOCS)
    assert Counter((x.doc_id, x.text) for x in simhash.keep_one_of_each(docs).collect()) == Counter([(1, a), (2, b), (3, rows[3][1])])


@pytest.mark.parametrize("n,most", [(20, 2048), (500, 2048), (500, 50), (5000, 2048)])
def test_near_copies_of_one_seed(spark, n, most):
    # each copy was edited on its own: similar to the seed, but hardly to other copies
    r = np.random.default_rng(n)
    seed = [f"w{r.integers(1 << 60):x}" for _ in range(200)]
    texts = [" ".join(seed), *(" ".join(edited(r, seed, 0.02)) for _ in range(n))]
    at_seed = [brute_jaccard(texts[0], t) for t in texts[1:]]
    assert min(at_seed) >= 0.8 and np.mean([brute_jaccard(texts[k], texts[k + 1]) for k in range(1, 20)]) < 0.75
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in enumerate(texts)], DOCS).repartition(8)
    assert [x.doc_id for x in simhash.keep_one_of_each(docs, most=most).collect()] == [0]


# personal data


def brute_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(x) for x in re.findall("[0-9]", m[0])]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.findall("[0-9]", m[0])) <= 15]
    return out


TRICKY = ["a@b.c@d.e f@@g.h x@y.z.", "@a.b", "a@b", "a@b..c", "x" * 2000 + "@" + "y" * 2000, "1.2.3.4.5 999.1.1.1 0001.02.3.255 1.2.3", "4111 1111 1111 1111 4111111111111111", "4111-1111-1111-1111", "+1 (743) 555-3824 +49 +1234567 +12345678", "é4111111111111111ü", "9" * 5000, "a+b@c-d.e_f@g.h"]


def test_pii_base_equals_brute_force(spark, texts):
    for t in [*TRICKY, *(t or "" for t in texts.values())]:
        assert pii.base_spans(t) == brute_base(t), t[:80]


def test_pii_added_spans():
    model = pii.train()
    assert pii.train() is model
    cases = {
        "please call (743) 555-3824 today": "phone",
        "mail me: john (at) mail (dot) com soon": "email",
        "my ssn is 123-45-6789 and": "id",
        "visa card 4111111111111111 4242424242424242": "card",
    }
    for t, kind in cases.items():
        got = pii.added_spans(t, pii.base_spans(t), model)
        assert kind in {k for k, *_ in got}, t
    for t in ("released on 2024-01-05 as version 1.2.3", "order 1234-5678-99 and page 12", "look at the dot on the line", "sum 3.14 of 10 000"):
        assert pii.added_spans(t, [], model) == [], t
    p = model.trees.probability(np.array([pii.features(t, s) for t, s, _ in pii._examples(1500, 99)]))
    y = np.array([v for *_, v in pii._examples(1500, 99)])
    assert np.mean((p >= 0.5) == y) > 0.9


def test_pii_documents(spark, odd, real, texts):
    got = {r.doc_id: r for r in pii.find(real["documents"]).collect()}
    for d, t in texts.items():
        base = brute_base(t or "")
        assert [got[d].n_email, got[d].n_ip, got[d].n_card, got[d].n_phone] == [sum(s[0] == k for s in base) for k in pii.BASE_KINDS]
        assert got[d].base_sha256 == hashlib.sha256(pii.listed(base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(got[d].spans.split(","))
    assert pii.find(odd).count() == len(ODD) and pii.find(odd.limit(0)).count() == 0
    out = pii.redact(real["documents"])
    assert out.columns == real["documents"].columns
    for r in out.collect():
        assert r.text is None or (brute_base(r.text) == [] or r.text == texts[r.doc_id] or "[" in r.text)
        if got[r.doc_id].spans == "":
            assert r.text == texts[r.doc_id]
        assert r.n_chars is None or r.n_chars == len(r.text or "")
    odd_out = pii.redact(odd)
    assert odd_out.columns == odd.columns and odd_out.count() == len(ODD)


def test_boosting_and_isotonic():
    r = np.random.default_rng(0)
    x = r.random((900, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    assert np.mean((boosting.fit(x, y).probability(x) > 0.5) == y) > 0.85
    xs, ys = boosting.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0, 1, 0, 1]))
    assert list(ys) == sorted(ys) and list(xs) == sorted(xs)


# pipeline


def test_pipeline(spark, sf_dir, texts, real):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "near_copies", "benchmark_leaks", "personal_data", "packing"]
    docs = real["documents"]
    for _, stage in p.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns
        assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
        docs = after.cache()
    assert 0.4 * len(texts) < docs.count() < len(texts)
    out = p.run(spark, sf_dir).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in docs.select("doc_id").collect()}
    check_packing(out, len(texts))


def test_pipeline_odd(spark, odd, tmp_path):
    import corpus_pipeline as p

    odd.select("doc_id", F.lit(1).alias("toxic"), F.lit(1).alias("quality")).limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (odd, odd.limit(0)):
        docs = start
        for _, stage in p.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd.columns
        p.STAGES[-1][1](spark, docs, str(tmp_path)).count()
