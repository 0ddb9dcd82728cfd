"""The manifest against a plain recursion, on odd rows, hot ids and many groups."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from augury.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, root string, grp int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]])


def tree(digests):
    """(top, [(place, siblings) per level] for each) of a row of digests."""
    ways, at, now = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(now) > 1:
        runs = [now[i : i + 16] for i in range(0, len(now), 16)]
        for k, p in enumerate(at):
            run, i = runs[p // 16], p % 16
            ways[k].append((i, run[:i] + run[i + 1 :]))
        at, now = [p // 16 for p in at], [h(*r) for r in runs]
    return (now[0] if now else h()), ways


def brute(rows):
    told = lambda r: (*r[:4], None if r[4] is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r
    groups = {}
    for r in rows:
        groups.setdefault(b"" if r[1] is None else b"1" + r[1].encode(), []).append(r)
    names = sorted(groups)
    sorted_rows = {n: sorted(groups[n], key=lambda r: (-(2**63) if r[0] is None else r[0], leaf(r))) for n in names}
    trees = {n: tree([leaf(r) for r in sorted_rows[n]]) for n in names}
    root, tops = tree([trees[n][0] for n in names])
    out = []
    for n, top in zip(names, tops, strict=True):
        for r, way in zip(sorted_rows[n], trees[n][1], strict=True):
            acc = leaf(told(r))
            for i, sibs in [*way, *top]:
                acc = h(*sibs[:i], acc, *sibs[i:])
            out.append((r[0], leaf(r), trees[n][0], root, h(*[x for _, s in [*way, *top] for x in s]), acc, acc == root))
    return out


def found(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    told = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))
    out = merkle.proofs(merkle.build(docs, told={"text": told}))
    return [tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_odd_rows(spark):
    rows = [
        (None, None, None, None, None), (None, None, None, None, ""), (-(2**63), None, "en", 3, "ABC"), (2**63 - 1, "a", "en", 3, "Été Ä"), (0, "a", None, 0, ""), (-1, "a", None, 0, "X" * 200_000), (5, "", "en", 1, "lone"),
        *[(7, "a", "en", 1, "Same")] * 40, *[(8, "a", "en", k, f"Text {k}") for k in range(300)], (9, "ß", "de", 1, "q"), (9, "z", "de", 1, "q"),
    ]
    random.Random(1).shuffle(rows)
    same(found(spark, rows), brute(rows))


@pytest.mark.parametrize("n", [1, 2, 16, 17, 300])
def test_many_groups_of_all_sizes(spark, n):
    r = random.Random(n)
    rows = [(r.randrange(-50, 10**r.randrange(1, 12)), f"s{g}", "en", 1, f"T{r.random()}") for g in range(n) for _ in range(r.choice([1, 1, 2, 15, 16, 17, 40] if n > 1 else [700]))]
    same(found(spark, rows), brute(rows))


def test_runs_of_equal_rows_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RUN", 8)
    rows = [(1, "a", "en", 1, "Same")] * 77 + [(k, "a", "en", 1, "B") for k in range(30)]
    same(found(spark, rows), brute(rows))


def test_empty_table_and_text_ids(spark):
    m = merkle.build(spark.createDataFrame([], SCHEMA))
    assert m.root == h() and merkle.proofs(m).count() == 0
    merkle.forget(m)
    with pytest.raises(ValueError):
        merkle.build(spark.createDataFrame([("a", "b")], "doc_id string, source string"), columns=("doc_id",))


def test_no_window_or_group_is_larger_than_its_bound(spark):
    """Digits: of a dense id range a parent has 256 children at most, a node 16."""
    counts = spark.range(70_000).select(F.lit("g").alias("grp"), F.col("id").alias("key"), F.lit(1).cast("long").alias("n"))
    out = merkle.rank_starts(counts, ["grp"], "key", 17, ["key"])
    assert out.filter("start <> key or size <> 70000").count() == 0
    assert out.groupBy(F.shiftright("key", 8)).count().agg(F.max("count")).first()[0] <= 256
