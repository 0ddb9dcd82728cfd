"""Ranked lexical search: every item against all documents, as a blocked sparse matrix product.

An item is a row of term multiplicities, a document a column of impacts, both integers; a
score is their product.  Items come in blocks of a bounded number of different terms, and
the terms of a block are numbered.  Of each document the numbered terms and their counts
are written down once; over these, the documents that hold each term are counted, and the
product is taken: a task holds a block of documents as rows of the term matrix (sorted by
term), merges for each item the rows of its terms into one dense row of sums (Gustavson's
order), and keeps the best documents of each item, block after block.  Best rows of tasks
meet by item, first in several parts, then in one.

An item with more terms than a block may hold is cut into blocks of its terms; such blocks
give all sums above 0, which are added up by item and document before the best are taken.

Terms are the maximal runs of ASCII letters and digits and of other signs from U+0080 on,
only A-Z in lower case, of whole texts of any length.  A null or empty text has no terms:
such items have no rows, such documents count nowhere.  Each row of items is an item and
each row of documents a document, whatever its id; equal scores go by ascending document
id, null ids last.  Other columns take no part; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from augury.llm.common import discard, map_rows, materialise

TOP = 10
#: Different terms of a block of items, which every task holds; about 20 MB of words.
MAX_TERMS = 200_000
#: Items' terms of a block, equal ones of several items counted for each.
MAX_ENTRIES = 2_000_000
#: Terms of documents in a block of them, about; a document is never cut.
BLOCK_TERMS = 1_000_000
#: Parts in which an item's best rows meet first.
PARTS = 32
#: Bytes of a text that are cut into words at once.
SLICE = 1 << 22
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")


def slices(raw: bytes, size: int = SLICE) -> Iterator[bytes]:
    """``raw`` in pieces of about ``size`` that end where no word goes on."""
    at = 0
    while len(raw) - at > size:
        gap = _GAP.search(raw, at + size)
        if not gap:
            break
        yield raw[at : gap.start()]
        at = gap.start()
    yield raw[at:]


def term_counts(text: str | None) -> Counter:
    out: Counter = Counter()
    if text:
        for piece in slices(text.encode("utf-8", "surrogatepass").lower()):
            out.update(_WORD.findall(piece))
    return out


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass
class Block:
    """terms: the numbered words; items: (item row, places of its terms, multiplicities); whole: its item is not cut."""

    terms: list[bytes]
    items: list[tuple[int, np.ndarray, np.ndarray]]
    whole: bool = True


def _item(item: int, number: dict[bytes, int], part: list[tuple[bytes, int]]) -> tuple[int, np.ndarray, np.ndarray]:
    return item, np.array([number.setdefault(t, len(number)) for t, _ in part], dtype=np.int64), np.array([q for _, q in part], dtype=np.int64)


def blocks(counted: DataFrame, max_terms: int = MAX_TERMS) -> Iterator[Block]:
    """Blocks of the items' terms (item, term, many): the driver holds one block at a time."""
    rows = counted.repartition("item").sortWithinPartitions("item").toLocalIterator()
    number: dict[bytes, int] = {}
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    entries = 0
    for item, group in groupby(rows, key=lambda r: r["item"]):
        group = ((bytes(r["term"]), r["many"]) for r in group)
        part, more = list(islice(group, max_terms)), list(islice(group, max_terms))
        if more:
            while part:
                own: dict[bytes, int] = {}
                cut = _item(item, own, part)
                yield Block(list(own), [cut], False)
                part, more = more, list(islice(group, max_terms))
            continue
        if held and (len(number) + sum(t not in number for t, _ in part) > max_terms or entries + len(part) > MAX_ENTRIES):
            yield Block(list(number), held)
            number, held, entries = {}, [], 0
        held.append(_item(item, number, part))
        entries += len(part)
    if held:
        yield Block(list(number), held)


def _rows_of_terms(c):
    for item, text in zip(*c, strict=True):
        yield from ((item, term, many) for term, many in term_counts(text).items())


def postings(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """Of each document (__row, doc_id, text) with any terms: n (all, with repeats), the numbered ones it holds, and their counts."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def make():
        number = {w: k for k, w in enumerate(sent.value)}

        def run(c):
            for row, doc_id, text in zip(*c, strict=True):
                counts = term_counts(text)
                if counts:
                    known = sorted((number[w], k) for w, k in counts.items() if w in number)
                    # a text is shorter than 2^31 bytes
                    yield row, doc_id, counts.total(), np.array([t for t, _ in known], dtype="<i4").tobytes(), np.array([k for _, k in known], dtype="<i4").tobytes()

        return run

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs, ["__row", "doc_id", "text"], f"row long, doc_id {kind}, n long, terms binary, counts binary", make)


def frequencies(found: DataFrame, n_terms: int) -> np.ndarray:
    """In how many documents each numbered term stands."""

    class Count:
        def __init__(self):
            self.df = np.zeros(n_terms, dtype=np.int64)

        def __call__(self, c):
            terms = np.frombuffer(b"".join(c[0]), dtype="<i4")
            self.df += np.bincount(terms, minlength=n_terms)
            return ()

        def finish(self):
            return [(int(t), int(self.df[t])) for t in np.flatnonzero(self.df)]

    out = np.zeros(n_terms, dtype=np.int64)
    # a row for each numbered term, of which a block has MAX_TERMS at most
    for term, df in map_rows(found, ["terms"], "term int, df long", Count).groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[term] = df
    return out


@dataclass
class Plan:
    """What each task gets for a block: items with their terms, the terms' weights, and the totals."""

    items: list[tuple[int, np.ndarray, np.ndarray]]
    weights: np.ndarray
    n_docs: int
    n_terms: int
    top: int
    whole: bool


class Product:
    """Takes documents (row, doc_id, n, terms, counts) by the batch, blocks of them times the items; gives (item, row, doc_id, score)."""

    def __init__(self, plan: Plan):
        self.plan = plan
        self.waiting: list[tuple] = []
        self.held = 0
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in plan.items]

    def __call__(self, c):
        for r in zip(*c, strict=True):
            if not r[3]:
                continue
            self.waiting.append(r)
            self.held += len(r[3]) // 4
            if self.held >= BLOCK_TERMS:
                yield from self._block()

    def finish(self):
        yield from self._block()
        if self.plan.whole:
            for (item, _, _), (ids, scores) in zip(self.plan.items, self.best, strict=True):
                yield from ((item, 0, None if i == _LAST else i, s) for i, s in zip(ids.tolist(), scores.tolist(), strict=True))

    def _block(self) -> Iterator[tuple]:
        p, rows, self.waiting, self.held = self.plan, self.waiting, [], 0
        if not rows:
            return
        ids = np.array([_LAST if r[1] is None else r[1] for r in rows], dtype=np.int64)
        length = np.array([100 - 75 + (75 * r[2] * p.n_docs) // p.n_terms for r in rows], dtype=np.int64)
        terms = np.frombuffer(b"".join(r[3] for r in rows), dtype="<i4")
        counts = np.frombuffer(b"".join(r[4] for r in rows), dtype="<i4").astype(np.int64)
        doc = np.repeat(np.arange(len(rows)), [len(r[3]) // 4 for r in rows])
        order = np.argsort(terms, kind="stable")
        terms, counts, doc = terms[order], counts[order], doc[order]
        impact = p.weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 8 * length[doc]))
        starts = np.searchsorted(terms, np.arange(len(p.weights) + 1)).tolist()
        sums = np.zeros(len(rows), dtype=np.int64)
        for k, (item, own, times) in enumerate(p.items):
            sums[:] = 0
            for t, q in zip(own.tolist(), times.tolist(), strict=True):
                a, b = starts[t], starts[t + 1]
                if a < b:
                    sums[doc[a:b]] += q * impact[a:b]  # a document stands once in a term's row
            if p.whole:
                self._merge(k, ids, sums)
            else:
                hit = np.flatnonzero(sums).tolist()
                yield from ((item, rows[i][0], rows[i][1], int(sums[i])) for i in hit)

    def _merge(self, k: int, ids: np.ndarray, sums: np.ndarray) -> None:
        old_ids, old = self.best[k]
        floor = old[-1] if len(old) == self.plan.top else 1
        hit = np.flatnonzero(sums >= floor)
        if len(hit) > 4 * self.plan.top:  # the least score that can still count
            hit = hit[sums[hit] >= np.partition(sums[hit], len(hit) - self.plan.top)[len(hit) - self.plan.top]]
        if len(hit):
            all_ids, scores = np.concatenate([old_ids, ids[hit]]), np.concatenate([old, sums[hit]])
            first = np.lexsort((all_ids, -scores))[: self.plan.top]
            self.best[k] = all_ids[first], scores[first]


#: Stands for a null id inside a task: it comes last among equal scores.
_LAST = 2**63 - 1


def search(docs: DataFrame, items: DataFrame, top: int = TOP, max_terms: int = MAX_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` best documents (doc_id, an integer, and text) of each row of ``items`` (item_id, text)."""
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise ValueError("doc_id must be an integer")
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    rows = materialise(items.select("item_id", "text").withColumn("__item", F.monotonically_increasing_id()))
    counted = materialise(map_rows(rows, ["__item", "text"], "item long, term binary, many long", lambda: _rows_of_terms))
    docs = docs.select(F.lit(0).cast("long").alias("__row"), "doc_id", "text")
    if counted.groupBy("item").count().filter(F.col("count") > max_terms).head(1):
        # sums of an item's blocks meet by the document's row
        docs = materialise(docs.withColumn("__row", F.monotonically_increasing_id()))
    schema = f"item long, row long, doc_id {kind.simpleString()}, score long"
    parts: dict[bool, list[DataFrame]] = {True: [], False: []}
    for block in blocks(counted, max_terms):
        made: list[str] = []
        found = materialise(postings(docs, block.terms), made)
        n_docs, n_terms = found.agg(F.count("*"), F.sum("n")).first()
        if n_docs:
            df = frequencies(found, len(block.terms))
            sent = spark.sparkContext.broadcast(Plan(block.items, np.array([weight(n_docs, int(x)) for x in df], dtype=np.int64), n_docs, n_terms, top, block.whole))
            parts[block.whole].append(materialise(map_rows(found, ["row", "doc_id", "n", "terms", "counts"], schema, lambda sent=sent: Product(sent.value))))
        discard(spark, made)
    scores = _union(parts[True], spark.createDataFrame([], schema))
    if parts[False]:
        scores = scores.unionByName(_union(parts[False], scores).groupBy("item", "row", "doc_id").agg(F.sum("score").alias("score")))
    best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = W.partitionBy("item", F.pmod(F.xxhash64("doc_id", "row"), F.lit(PARTS))).orderBy(*best)
    some = scores.filter("score > 0").withColumn("r", F.row_number().over(part)).filter(F.col("r") <= top).drop("r")
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*best))).filter(F.col("rank") <= top)
    return ranked.join(rows.select(F.col("__item").alias("item"), "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _union(parts: list[DataFrame], none: DataFrame) -> DataFrame:
    out = parts[0] if parts else none
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
