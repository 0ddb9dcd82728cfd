"""The registered queries of this package: one per operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augury.llm import decontaminate, hilbert, lexical, licenses, merkle, mpeg, packing, pii, simhash, substrings, token_counts, toxicity, warc
from augury.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score_documents(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "worst_start", "worst_end")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    read = warc.read_archives(spark, warc.write_archives(pages), with_payload=False)
    return read.filter("status = 'record'").select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.context_table(token_counts.histogram(table(spark, sf_dir, "documents")))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hilbert.shard_documents(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op8_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.read(mpeg.store(table(spark, sf_dir, "documents")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), simhash.Scheme(words=3, lanes=1, segments=2, distance=2))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("f0")).alias("fingerprint"), "component_id")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy with some texts in lower case against the manifest of the originals."""
    told = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))
    found = merkle.proofs(merkle.build(table(spark, sf_dir, "documents"), told={"text": told}))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.find(table(spark, sf_dir, "documents")).drop("xx")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = (op1_toxicity, op2_warc, op3_license_scan, op4_token_counts, op5_decontaminate, op6_packing, op7_hilbert_sharding, op8_mpeg_audio, op9_simhash, op10_pii, op11_merkle, op12_lexical_search, op13_substring_dedup)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


_B32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {1 + 5 * g}, 5))::BIGINT >> {s}) & 31)::INTEGER + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))

OP2_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
     d AS (SELECT page_id, strlen(t)::BIGINT AS payload_bytes, sha1(t) AS h FROM p),
     f AS (SELECT h, min(page_id) AS first FROM d GROUP BY h)
SELECT page_id, payload_bytes, {_B32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d JOIN f USING (h)
"""

_SPLIT = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP5_SQL = f"""
WITH b AS (SELECT item_id, {_SPLIT.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
     bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
            FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
     ns AS (SELECT DISTINCT n FROM bw),
     d AS (SELECT doc_id, row_number() OVER () AS r, coalesce({_SPLIT.format("text")}, []) AS w FROM documents),
     dw AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
            FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
     m AS (SELECT r, i, dw.n AS n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
     hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM m) GROUP BY r),
     own AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN own USING (r)
"""


_LEAF = " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "{0}"))
_BYTES = "flatten([[ascii(c)::BIGINT] || [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[] for c in string_split(doc_id::VARCHAR, '')])"
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END), 4294967295::BIGINT)"


def _climb_sql(below: str, name: str, levels: int) -> str:
    """Levels of nodes over {below} (g, n, pos, h): each has g, n, pos, h, and the siblings' place and digests of each node below."""
    out, last = [], below
    for k in range(1, levels + 1):
        up = f"{name}{k}"
        out.append(
            f"{up}k AS (SELECT *, string_agg(h, '' ORDER BY pos) OVER (PARTITION BY g, pos // 16 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS kids, row_number() OVER (PARTITION BY g, pos // 16 ORDER BY pos) - 1 AS at FROM {last} WHERE ceil(n / power(16.0, {k - 1})) > 1),"
            f" {up} AS (SELECT g, n, pos // 16 AS pos, sha256(any_value(kids)) AS h FROM {up}k GROUP BY 1, 2, 3)"
        )
        last = up
    return ", ".join(out)


_LEVELS, _ROOT_LEVELS = 6, 3


def _fold_sql(steps: list[tuple[str, str]], acc: str, table: str, keep: str) -> str:
    """Subqueries that fold ``acc`` through the steps (at, kids) one after another; a step without kids changes nothing."""
    out = f"SELECT *, {acc} AS acc0 FROM {table}"
    for k, (at, kids) in enumerate(steps):
        out = f"SELECT *, CASE WHEN {kids} IS NULL THEN acc{k} ELSE sha256(left({kids}, 64 * {at}::INT) || acc{k} || substr({kids}, 64 * {at}::INT + 65)) END AS acc{k + 1} FROM ({out})"
    return f"SELECT {keep}, acc{len(steps)} AS folded FROM ({out})"


def _merkle_sql() -> str:
    own = [(f"a{k}", f"k{k}") for k in range(1, _LEVELS + 1)] + [(f"ra{k}", f"rk{k}") for k in range(1, _ROOT_LEVELS + 1)]
    joins = " ".join(f"LEFT JOIN t{k}k ON t{k}k.g = l.g AND t{k}k.pos = l.pos // {16 ** (k - 1)}" for k in range(1, _LEVELS + 1)) + " "
    joins += " ".join(f"LEFT JOIN r{k}k ON r{k}k.pos = s.pos // {16 ** (k - 1)}" for k in range(1, _ROOT_LEVELS + 1))
    picked = ", ".join([f"t{k}k.at AS a{k}, t{k}k.kids AS k{k}" for k in range(1, _LEVELS + 1)] + [f"r{k}k.at AS ra{k}, r{k}k.kids AS rk{k}" for k in range(1, _ROOT_LEVELS + 1)])
    sibs = " || ".join(f"coalesce(left({kids}, 64 * {at}::INT) || substr({kids}, 64 * {at}::INT + 65), '')" for at, kids in own)
    tops = " UNION ALL ".join([f"SELECT g, h FROM leaves WHERE n = 1"] + [f"SELECT g, h FROM t{k} WHERE ceil(n / power(16.0, {k})) <= 1" for k in range(1, _LEVELS + 1)])
    rtops = " UNION ALL ".join(["SELECT h FROM subs WHERE n = 1"] + [f"SELECT h FROM r{k} WHERE ceil(n / power(16.0, {k})) <= 1" for k in range(1, _ROOT_LEVELS + 1)])
    return f"""
WITH d AS (SELECT doc_id, coalesce('1' || source, '0') AS g, sha256({_LEAF.format("text")}) AS h,
                  sha256({_LEAF.format("CASE WHEN coalesce(" + _CRC + ", 1) % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END")}) AS told FROM documents),
     leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
     {_climb_sql("leaves", "t", _LEVELS)},
     tops AS ({tops}),
     subs AS (SELECT '' AS g, g AS name, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM tops),
     {_climb_sql("subs", "r", _ROOT_LEVELS)},
     rtops AS ({rtops}),
     j AS (SELECT l.doc_id, l.h AS leaf, l.told, s.h AS subroot, (SELECT h FROM rtops) AS root, {picked} FROM leaves l JOIN subs s ON s.name = l.g {joins}),
     f AS ({_fold_sql(own, "told", "(SELECT *, sha256(" + sibs + ") AS proof_sha256 FROM j)", "doc_id, leaf, subroot, root, proof_sha256")})
SELECT doc_id, leaf, subroot, root, proof_sha256, folded AS folded_root, folded = root AS verified FROM f
"""


_TERMS = "coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), [])"

OP12_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS} AS w FROM documents),
     t AS (SELECT count(*)::BIGINT AS nd, sum(len(w))::BIGINT AS nt FROM d WHERE len(w) > 0),
     b AS (SELECT i, item_id, term, count(*) AS q FROM (SELECT i, item_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS w FROM benchmark)) GROUP BY ALL),
     p AS (SELECT r, n, term, count(*) AS tf FROM (SELECT r, len(w) AS n, unnest(w) AS term FROM d) SEMI JOIN b USING (term) GROUP BY ALL),
     x AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, t GROUP BY term, nd),
     s AS (SELECT i, item_id, r, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // nt))))::BIGINT AS score FROM b JOIN p USING (term) JOIN x USING (term), t GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM s JOIN d USING (r) WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) <= 10
"""


OP13_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
     x AS (SELECT doc_id, r, i, sha256(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
     f AS (SELECT h, min(doc_id) AS least FROM x GROUP BY h HAVING min(doc_id) < max(doc_id)),
     g AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS j FROM x JOIN f USING (h) WHERE doc_id > least),
     v AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
     k AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS kept FROM v ANTI JOIN g USING (r, j) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    out = {"op2_warc": OP2_SQL, "op5_decontaminate": OP5_SQL, "op11_merkle": _merkle_sql(), "op12_lexical_search": OP12_SQL, "op13_substring_dedup": OP13_SQL}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
