"""Queries of the training-data operators over the test tables, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, exact_dedup, html_extract, licences, merkle, mixing, periodic, pii, quality, simhash, sketch,
               substring_dedup, warc)
from .common import documents

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> str:
    """Where the public byte-level vocabulary lies on this machine."""
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assignments(documents(spark, sf_dir))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.protect(documents(spark, sf_dir))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_and_decode(documents(spark, sf_dir), vocabulary()))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(documents(spark, sf_dir))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(documents(spark, sf_dir))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(documents(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.neighbours(documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(periodic.runs(periodic.with_tails(documents(spark, sf_dir))))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.convert_pages(documents(spark, sf_dir, "pages"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    chosen = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0  # the contract's rule
    return merkle.verify(docs, chosen)


QUERIES: dict[str, Query] = {
    "op1_quality": op1_quality,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_pii": op3_pii,
    "op4_bpe": op4_bpe,
    "op5_licences": op5_licences,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_html_extract": op7_html_extract,
    "op8_simhash": op8_simhash,
    "op9_fingerprints": op9_fingerprints,
    "op10_mixing": op10_mixing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_warc": op12_warc,
    "op13_merkle": op13_merkle,
}


def _nibble(x: int) -> int:
    for _ in range(4):
        x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
    return x


def _crc32_sql(value: str) -> str:
    """The unsigned CRC-32 of an integer's decimal digits in DuckDB, four bits at a time."""
    table = [_nibble(i) for i in range(16)]
    digits = f"list_transform(string_split(CAST({value} AS VARCHAR), ''), lambda s: [ascii(s)::BIGINT, 0::BIGINT])"
    step = f"xor(({table}::BIGINT[])[(xor(c, v) & 15) + 1], xor(c, v) >> 4)"
    return f"xor(list_reduce(flatten([[4294967295::BIGINT]] || {digits}), lambda c, v: {step}), 4294967295::BIGINT)"


def _leaf_sql(text: str) -> str:
    parts = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
             for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"

ORACLE: dict[str, str] = {
    "op2_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS c,
                          length(coalesce(text, '')) AS n FROM documents),
             g AS (SELECT doc_id, sha256(c) AS text_sha256, count(*) OVER (PARTITION BY c) AS group_size,
                          first_value(doc_id) OVER (PARTITION BY c ORDER BY n DESC, doc_id NULLS LAST) AS keep_id FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
    "op12_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
             g AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest,
                          first_value(page_id) OVER w AS best, row_number() OVER w AS k
                   FROM p WINDOW w AS (PARTITION BY h ORDER BY page_id NULLS LAST))
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN k > 1 AND payload_bytes >= 100 THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN k > 1 AND payload_bytes >= 100 THEN best END AS refers_to, true AS intact FROM g""",
    "op13_merkle": f"""
        WITH RECURSIVE leaves AS (
            SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                   count(*) OVER (PARTITION BY t) AS n
            FROM (SELECT doc_id, coalesce('=' || source, '-') AS t, {_leaf_sql("text")} AS leaf,
                         CASE WHEN {_crc32_sql("doc_id")} % 5 = 0
                              THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
                         END AS now FROM documents)),
        low AS (SELECT t, 0 AS level, pos, leaf AS h, n FROM leaves
                UNION ALL
                SELECT t, level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16
                FROM low WHERE n > 1 GROUP BY t, level, pos // 16, n),
        subs AS (SELECT t, h AS subroot, row_number() OVER (ORDER BY t) - 1 AS pos, count(*) OVER () AS n
                 FROM low WHERE n = 1),
        high AS (SELECT '^' AS t, 0 AS level, pos, subroot AS h, n FROM subs
                 UNION ALL
                 SELECT t, level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16
                 FROM high WHERE n > 1 GROUP BY t, level, pos // 16, n),
        nodes AS (SELECT * FROM low UNION ALL SELECT * FROM high),
        sides AS (SELECT a.t, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
                         coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
                  FROM nodes a JOIN nodes b ON a.t = b.t AND a.level = b.level AND a.pos // 16 = b.pos // 16
                  WHERE a.n > 1 GROUP BY a.t, a.level, a.pos),
        path AS (SELECT t, pos AS leaf_pos, 0 AS level, pos, coalesce(now, leaf) AS f, '' AS proof FROM leaves
                 UNION ALL
                 SELECT p.t, p.leaf_pos, p.level + 1, p.pos // 16, sha256(s.l || p.f || s.r), p.proof || s.l || s.r
                 FROM path p JOIN sides s ON s.t = p.t AND s.level = p.level AND s.pos = p.pos),
        arrived AS (SELECT t, leaf_pos, max_by(f, level) AS f, max_by(proof, level) AS proof FROM path GROUP BY t, leaf_pos),
        rest AS (SELECT a.t, a.leaf_pos, 0 AS level, s.pos, a.f, a.proof FROM arrived a JOIN subs s ON a.t = s.t
                 UNION ALL
                 SELECT p.t, p.leaf_pos, p.level + 1, p.pos // 16, sha256(s.l || p.f || s.r), p.proof || s.l || s.r
                 FROM rest p JOIN sides s ON s.t = '^' AND s.level = p.level AND s.pos = p.pos),
        done AS (SELECT t, leaf_pos, max_by(f, level) AS f, max_by(proof, level) AS proof FROM rest GROUP BY t, leaf_pos),
        top AS (SELECT h AS root FROM high WHERE n = 1)
        SELECT l.doc_id, l.leaf, s.subroot, (SELECT root FROM top) AS root, sha256(d.proof) AS proof_sha256,
               d.f AS folded_root, d.f = (SELECT root FROM top) AS verified
        FROM leaves l JOIN subs s ON l.t = s.t JOIN done d ON d.t = l.t AND d.leaf_pos = l.pos""",
}
