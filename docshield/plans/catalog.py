"""Registered queries: one per operator of SURVEY §2, each with its DuckDB twin.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> SQL``.  Column names
and types agree on both sides (integers as BIGINT, fractions as DOUBLE).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docshield.functions import guard as G
from docshield.operators import guarding, policy_index
from docshield.plans import bindings as B
from docshield.plans import sqlgen as Q
from docshield.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _prepared(fn):
    """Every registered query runs with the session zone at UTC (test timestamps are
    TIMESTAMP_NTZ; two queries turn them into instants) and a checkpoint folder set."""
    import functools

    @functools.wraps(fn)
    def run(spark, sf):
        from docshield.session import bound_batches, ensure_checkpoint_dir, ship_package
        if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        ensure_checkpoint_dir(spark)
        bound_batches(spark)
        ship_package(spark)
        return fn(spark, sf)
    return run


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = _prepared(fn)
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _requests(spark, sf):
    return B.requests(table(spark, sf, "conversations"))


def _answers(spark, sf):
    return B.answers(table(spark, sf, "conversations"))


# --------------------------------------------------------------------------- guardrails
ALL_PATTERNS = list(dict.fromkeys(
    [p for t in G.TIER_ORDER for p in G.TIER_INPUT_PATTERNS[t] + G.TIER_OUTPUT_PATTERNS[t]]))


@register("g1_pattern_match", f"""
WITH {B.REQUESTS_SQL[1:]}
SELECT ord, pattern, n_rows FROM (
  SELECT {", ".join(f"CAST(count_if({Q.matches('question', p)}) AS BIGINT) AS c{i}" for i, p in enumerate(ALL_PATTERNS))}
  FROM requests) w
CROSS JOIN LATERAL (VALUES {", ".join(f"({i}, {B.sql_str(p)}, c{i})" for i, p in enumerate(ALL_PATTERNS))}) v(ord, pattern, n_rows)
""")
def g1_pattern_match(spark, sf):
    return guarding.pattern_hit_counts(_requests(spark, sf), "question", ALL_PATTERNS) \
        .select(F.col("ord").cast("int").alias("ord"), "pattern", F.col("n_rows").cast("bigint"))


@register("g2_jailbreak", f"""
WITH {B.REQUESTS_SQL[1:]}
SELECT conv_id, turn, {Q.jailbreak_hit('question')} IS NOT NULL AS jailbreak,
       {Q.jailbreak_hit('question')} AS phrase
FROM requests
""")
def g2_jailbreak(spark, sf):
    r = _requests(spark, sf)
    hit = G.jailbreak_hit(F.col("question"))
    return r.select("conv_id", "turn", hit.isNotNull().alias("jailbreak"), hit.alias("phrase"))


_IN = Q.check("question", "tier", "enabled", "custom_rules", "in")


@register("g3_input_check", f"""
WITH {B.REQUESTS_SQL[1:]}
SELECT conv_id, turn, tier, {_IN['message']} IS NOT NULL AS blocked,
       {_IN['kind']} AS rule_kind, {_IN['rule']} AS rule, {_IN['message']} AS message
FROM requests
""")
def g3_input_check(spark, sf):
    r = guarding.check_input(_requests(spark, sf))
    return r.select("conv_id", "turn", "tier", F.col("in_message").isNotNull().alias("blocked"),
                    F.col("in_kind").alias("rule_kind"), F.col("in_rule").alias("rule"),
                    F.col("in_message").alias("message"))


_OUT = Q.check("answer", "tier", "enabled", "custom_rules", "out")


@register("g4_output_check", f"""
WITH {B.ANSWERS_SQL[1:]}
SELECT conv_id, turn, tier, {_OUT['message']} IS NOT NULL AS blocked,
       {_OUT['kind']} AS rule_kind, {_OUT['rule']} AS rule, {_OUT['message']} AS message
FROM answers
""")
def g4_output_check(spark, sf):
    r = guarding.check_output(_answers(spark, sf))
    return r.select("conv_id", "turn", "tier", F.col("out_message").isNotNull().alias("blocked"),
                    F.col("out_kind").alias("rule_kind"), F.col("out_rule").alias("rule"),
                    F.col("out_message").alias("message"))


_IN_FB = Q.check("question", "tier", "TRUE", None, "in")
_IN_INT = Q.check("question", "'Internal'", "TRUE", None, "in")


@register("g5_unknown_tier_fallback", f"""
WITH {B.REQUESTS_SQL[1:]}
SELECT conv_id, turn, tier, {_IN_FB['rule']} AS rule, {_IN_FB['message']} AS message,
       coalesce({_IN_FB['rule']}, '') = coalesce({_IN_INT['rule']}, '') AS same_as_internal
FROM requests
WHERE tier NOT IN ('Public', 'Internal', 'Confidential', 'Restricted')
""")
def g5_unknown_tier_fallback(spark, sf):
    r = _requests(spark, sf).filter(~F.col("tier").isin(*G.TIER_ORDER))
    got = G.check_input(F.col("question"), F.col("tier"), F.lit(True), None)
    internal = G.check_input(F.col("question"), F.lit("Internal"), F.lit(True), None)
    return r.select("conv_id", "turn", "tier", got.rule.alias("rule"), got.message.alias("message"),
                    (F.coalesce(got.rule, F.lit("")) == F.coalesce(internal.rule, F.lit("")))
                    .alias("same_as_internal"))


@register("g6_custom_rules", f"""
WITH {B.REQUESTS_SQL[1:]}
SELECT conv_id, turn, CAST(len(custom_rules) AS BIGINT) AS n_rules,
       {Q.custom_hit('question', 'custom_rules')} AS custom_rule
FROM requests
""")
def g6_custom_rules(spark, sf):
    r = _requests(spark, sf)
    return r.select("conv_id", "turn", F.size("custom_rules").cast("bigint").alias("n_rules"),
                    G.custom_hit(F.col("question"), F.col("custom_rules")).alias("custom_rule"))


def _violations_sql(source_cte: str, src: str, text: str, direction: str) -> str:
    pol = G.Policy.default()
    parts = []
    if direction == "in":
        for i, p in enumerate(G.JAILBREAK_PHRASES):
            parts.append(f"SELECT conv_id, turn, 'jailbreak' AS kind, {i} AS ord, {B.sql_str(p)} AS pattern "
                         f"FROM {src} WHERE contains(lower({text}), {B.sql_str(p)})")
    eff = (f"(CASE WHEN tier IN ('Public', 'Internal', 'Confidential', 'Restricted') "
           f"THEN tier ELSE 'Internal' END)")
    for t in G.TIER_ORDER:
        for i, p in enumerate(pol.patterns(t, direction)):
            parts.append(f"SELECT conv_id, turn, 'tier' AS kind, {i} AS ord, {B.sql_str(p)} AS pattern "
                         f"FROM {src} WHERE {eff} = {B.sql_str(t)} AND {Q.matches(text, p)}")
    return f"WITH {source_cte[1:]}\nSELECT conv_id, turn, kind, CAST(ord AS INTEGER) AS ord, pattern FROM (\n" + \
        "\nUNION ALL\n".join(parts) + "\n) v"


@register("g7_violations", _violations_sql(B.REQUESTS_SQL, "requests", "question", "in"))
def g7_violations(spark, sf):
    return guarding.violations(_requests(spark, sf), "question", "tier", "in",
                               keep=["conv_id", "turn"])


@register("g7_output_violations", _violations_sql(B.ANSWERS_SQL, "answers", "answer", "out"))
def g7_output_violations(spark, sf):
    return guarding.violations(_answers(spark, sf), "answer", "tier", "out",
                               keep=["conv_id", "turn"])


_G7_CUSTOM = f"""
SELECT conv_id, turn, 'custom' AS kind, CAST(i - 1 AS INTEGER) AS ord, rule AS pattern
FROM (SELECT conv_id, turn, question, enabled, unnest(custom_rules) AS rule, generate_subscripts(custom_rules, 1) AS i FROM requests)
WHERE {Q.matches_col('question', 'rule')}"""


@register("g7_all_violations", f"""
{_violations_sql(B.REQUESTS_SQL, "requests", "question", "in").replace(") v", "UNION ALL" + _G7_CUSTOM + ") v")}
WHERE (conv_id, turn) IN (SELECT (conv_id, turn) FROM requests WHERE coalesce(enabled, TRUE))
""")
def g7_all_violations(spark, sf):
    """G7 with the rows' own rules and switch."""
    return guarding.violations(_requests(spark, sf), "question", "tier", "in", keep=["conv_id", "turn"],
                               enabled="enabled", rules="custom_rules")


@register("g12_status_light", f"""
WITH {B.REQUESTS_SQL[1:]}, l AS (
  SELECT conv_id, turn, tier, enabled,
         CASE WHEN NOT enabled OR tier = 'Public' THEN 'green'
              WHEN tier IN ('Internal', 'Confidential') THEN 'orange'
              WHEN tier = 'Restricted' THEN 'red' END AS light
  FROM requests)
SELECT conv_id, turn, tier, enabled, light,
       CASE light WHEN 'green' THEN 'SAFE' WHEN 'orange' THEN 'PROTECTED' WHEN 'red' THEN 'STRICT' END AS label
FROM l
""")
def g12_status_light(spark, sf):
    r = _requests(spark, sf)
    s = G.status_light(F.col("tier"), F.col("enabled"))
    return r.select("conv_id", "turn", "tier", "enabled", s.light.alias("light"),
                    s.label.alias("label"))


@register("g15_sticky_rules", f"""
WITH {B.REQUESTS_SQL[1:]}
SELECT conv_id, turn,
       coalesce(last(CASE WHEN len(custom_rules) > 0 THEN array_to_string(custom_rules, '|') END IGNORE NULLS)
                OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '')
         AS effective_rules
FROM requests
""")
def g15_sticky_rules(spark, sf):
    r = guarding.sticky_rules(_requests(spark, sf))
    return r.select("conv_id", "turn", F.array_join("effective_rules", "|").alias("effective_rules"))


# --------------------------------------------------------------------------- redaction
from docshield.functions import redact as R  # noqa: E402
from docshield.operators import redaction  # noqa: E402

# Fixed manual-redaction word list of the R6 query (our own; exercises the C++ quirk).
MANUAL_WORDS = ["the", "und", "C++", "des", "", "el"]


def _docs(spark, sf):
    from docshield.operators.sizing import spread
    return spread(table(spark, sf, "documents"))


@register("r1_redact_typed", f"""
SELECT doc_id, {Q.redact('text')} AS text_redacted FROM documents
""")
def r1_redact_typed(spark, sf):
    return redaction.redact(_docs(spark, sf), "text", out="text_redacted").select("doc_id", "text_redacted")


@register("r2_redact_names", f"""
SELECT doc_id, {Q.redact('text', names=True)} AS text_redacted FROM documents
""")
def r2_redact_names(spark, sf):
    return redaction.redact(_docs(spark, sf), "text", names=True, out="text_redacted") \
        .select("doc_id", "text_redacted")


_R3_DOCS = "docs AS (SELECT source AS collection, doc_id, text FROM documents)"


@register("r3_token_map", f"""
WITH {_R3_DOCS}, {Q.occurrences_cte('docs', 'collection', 'doc_id', 'text')}, {Q.token_map_ctes()}
SELECT * FROM tmap
""")
def r3_token_map(spark, sf):
    docs = _docs(spark, sf).select(F.col("source").alias("collection"), "doc_id", "text")
    _, mapping = redaction.tokenize_pii(docs)
    return mapping


@register("r3_tokenized_text", f"""
WITH {_R3_DOCS}, {Q.occurrences_cte('docs', 'collection', 'doc_id', 'text')}, {Q.token_map_ctes()},
{Q.apply_map_ctes('occ', 'tmap', 'docs', 'collection', 'doc_id', 'text')}
SELECT doc_id, text_tokens FROM tokenized
""")
def r3_tokenized_text(spark, sf):
    docs = _docs(spark, sf).select(F.col("source").alias("collection"), "doc_id", "text")
    tok, _ = redaction.tokenize_pii(docs)
    return tok.select("doc_id", "text_tokens")


@register("r4_rehydrate_roundtrip", f"""
WITH {_R3_DOCS}, {Q.occurrences_cte('docs', 'collection', 'doc_id', 'text')}, {Q.token_map_ctes()},
{Q.apply_map_ctes('occ', 'tmap', 'docs', 'collection', 'doc_id', 'text')},
back AS (
  SELECT t.doc_id, t.text, t.text_tokens,
         coalesce(list_reduce((SELECT list({{'token': m.token, 'original': m.original}})
                                FROM tmap m WHERE m.collection = t.collection
                                 AND list_contains(regexp_extract_all(t.text_tokens, {B.sql_str(R.TOKEN_RE)}), m.token)),
                              lambda acc, x: replace(acc, x.token, x.original), t.text_tokens), t.text_tokens) AS text_back
  FROM tokenized t)
SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(text_tokens, {B.sql_str(R.TOKEN_RE)}))) AS BIGINT) AS n_tokens,
       text_back = text AS roundtrip_ok
FROM back
""")
def r4_rehydrate_roundtrip(spark, sf):
    docs = _docs(spark, sf).select(F.col("source").alias("collection"), "doc_id", "text")
    tok, mapping = redaction.tokenize_pii(docs)
    back = redaction.rehydrate(tok, mapping, "collection", "doc_id", "text_tokens", "text_back")
    return back.select(
        "doc_id",
        F.size(F.array_distinct(F.regexp_extract_all("text_tokens", F.lit(R.TOKEN_RE), 0))).cast("bigint")
        .alias("n_tokens"),
        (F.col("text_back") == F.col("text")).alias("roundtrip_ok"))


@register("r5_extend_map", f"""
WITH old_docs AS (SELECT source AS collection, doc_id, text FROM documents WHERE lang = 'en'),
new_docs AS (SELECT source AS collection, doc_id, text FROM documents WHERE lang <> 'en'),
{Q.occurrences_cte('old_docs', 'collection', 'doc_id', 'text', 'occ_old')}, {Q.token_map_ctes('occ_old', 'tmap_old')},
{Q.occurrences_cte('new_docs', 'collection', 'doc_id', 'text', 'occ_new')},
fresh AS (SELECT * FROM occ_new o WHERE NOT EXISTS (
  SELECT 1 FROM tmap_old m WHERE m.collection = o.collection AND m.entity_type = o.entity_type AND m.original = o.value)),
base AS (SELECT collection, entity_type, max(ord) AS base FROM tmap_old GROUP BY 1, 2),
{Q.token_map_ctes('fresh', 'tmap_new', 'base')}
SELECT * FROM tmap_new
""")
def r5_extend_map(spark, sf):
    d = _docs(spark, sf).select(F.col("source").alias("collection"), "doc_id", "text", "lang")
    _, old_map = redaction.tokenize_pii(d.filter(F.col("lang") == "en"))
    return redaction.extend_map(old_map, d.filter(F.col("lang") != "en"), "collection", "doc_id", "text")


@register("r6_manual_words", f"""
SELECT doc_id, {Q.redact_words('text', MANUAL_WORDS)} AS text_redacted FROM documents
""")
def r6_manual_words(spark, sf):
    return redaction.redact_words(_docs(spark, sf), MANUAL_WORDS).select("doc_id", F.col("text").alias("text_redacted"))


_WS = "[ \\t\\n\\v\\r\\f]"


@register("r7_parse_words", f"""
WITH w AS (
  SELECT doc_id, list_filter(list_transform(string_split(text, ','),
                 lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x <> '') AS words
  FROM documents)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, md5(array_to_string(words, '|')) AS words_md5 FROM w
""")
def r7_parse_words(spark, sf):
    words = R.parse_words(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.size(words).cast("bigint").alias("n_words"),
                                   F.md5(F.array_join(words, "|")).alias("words_md5"))


@register("r8_pii_profile", f"""
WITH per_doc AS (SELECT source, lang, {", ".join(f"{Q.count_type('text', t)} AS n_{t.name.lower()}" for t in R.PII_TYPES)}
                 FROM documents)
SELECT source, lang, CAST(count(*) AS BIGINT) AS n_docs,
       {", ".join(f"CAST(sum(n_{t.name.lower()}) AS BIGINT) AS n_{t.name.lower()}" for t in R.PII_TYPES)}
FROM per_doc GROUP BY ROLLUP (source, lang)
""")
def r8_pii_profile(spark, sf):
    return redaction.pii_profile(_docs(spark, sf), ["source", "lang"])


# --------------------------------------------------------------------------- chunking
from docshield.operators import chunking  # noqa: E402

CHUNK_SIZE, CHUNK_OVERLAP = 1000, 200
_DOC_COLS = "doc_id, source, lang"
_WIN = Q.window_chunks_cte("documents", "text", CHUNK_SIZE, CHUNK_OVERLAP, _DOC_COLS)


def _windows(spark, sf, size=CHUNK_SIZE, overlap=CHUNK_OVERLAP):
    return chunking.chunk_windows(_docs(spark, sf).select("doc_id", "source", "lang", "text"),
                                  "text", size, overlap)


@register("c1_recursive_chunks", f"""
WITH RECURSIVE {Q.recursive_chunks_ctes("documents", "text", CHUNK_SIZE, CHUNK_OVERLAP, "doc_id, source")}
SELECT doc_id, source, chunk_idx, CAST(length(chunk_text) AS BIGINT) AS n_chars, md5(chunk_text) AS chunk_md5 FROM chunks
""")
def c1_recursive_chunks(spark, sf):
    """The recursive character splitter (Arrow batch job)."""
    ch = chunking.chunk(_docs(spark, sf).select("doc_id", "source", "text"), "text",
                        CHUNK_SIZE, CHUNK_OVERLAP)
    return ch.select("doc_id", "source", "chunk_idx",
                     F.length("chunk_text").cast("bigint").alias("n_chars"),
                     F.md5("chunk_text").alias("chunk_md5"))


@register("c1b_window_chunks", f"""
WITH {_WIN}
SELECT doc_id, chunk_idx, chunk_start, CAST(length(chunk_text) AS BIGINT) AS n_chars, md5(chunk_text) AS chunk_md5
FROM chunks
""")
def c1b_window_chunks(spark, sf):
    return _windows(spark, sf).select("doc_id", "chunk_idx", F.col("chunk_start").cast("int"),
                                      F.length("chunk_text").cast("bigint").alias("n_chars"),
                                      F.md5("chunk_text").alias("chunk_md5"))


@register("c2_chunk_metadata", f"""
WITH {_WIN}
SELECT doc_id, chunk_idx, source, lang FROM chunks
""")
def c2_chunk_metadata(spark, sf):
    return _windows(spark, sf).select("doc_id", "chunk_idx", "source", "lang")


@register("c3_chunk_stats", f"""
WITH {_WIN}
SELECT source, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs, CAST(count(*) AS BIGINT) AS n_chunks,
       round(avg(length(chunk_text)), 4) AS avg_chars, CAST(max(length(chunk_text)) AS BIGINT) AS max_chars
FROM chunks GROUP BY source
""")
def c3_chunk_stats(spark, sf):
    return chunking.chunk_stats(_windows(spark, sf), "source", "doc_id")


@register("c4_load_batches", f"""
WITH {_WIN}, n AS (
  SELECT source AS collection, row_number() OVER (PARTITION BY source ORDER BY doc_id, chunk_idx) AS rn FROM chunks)
SELECT collection, CAST(floor((rn - 1) / 100) AS BIGINT) AS batch, CAST(count(*) AS BIGINT) AS n_chunks
FROM n GROUP BY ALL
""")
def c4_load_batches(spark, sf):
    ch = _windows(spark, sf).withColumnRenamed("source", "collection")
    return (chunking.load_batches(ch, "collection").groupBy("collection", "batch")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_chunks")))


# --------------------------------------------------------------------------- vectors
from docshield.functions import vectors as V  # noqa: E402
from docshield.operators import embedding, search  # noqa: E402


@register("e1_hash_embed", f"""
WITH {Q.hash_counts_cte('documents', 'doc_id', 'text', 'hc')}
SELECT d.doc_id, CAST(coalesce(sum(cnt), 0) AS BIGINT) AS n_tokens, CAST(count(b) AS BIGINT) AS nnz,
       CAST(coalesce(sum(cnt * cnt), 0) AS BIGINT) AS norm2
FROM documents d LEFT JOIN hc USING (doc_id) GROUP BY d.doc_id
""")
def e1_hash_embed(spark, sf):
    e = embedding.hashing_embed(_docs(spark, sf).select("doc_id", "text"), "text", "vec")
    return e.select("doc_id",
                    F.aggregate("vec", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_tokens"),
                    F.size(F.filter("vec", lambda x: x > 0)).cast("bigint").alias("nnz"),
                    F.col("vec_norm2").cast("bigint").alias("norm2"))


def _centroids(spark, sf):
    emb = table(spark, sf, "embeddings")
    dim = 64
    agg = emb.groupBy("label").agg(*[F.avg(F.col("embedding")[i].cast("double")).alias(f"d{i}")
                                     for i in range(dim)])
    return agg.select("label", V.l2_normalize(F.array(*[F.col(f"d{i}") for i in range(dim)])).alias("centroid"))


_CENTROIDS_SQL = """centroids0 AS (
  SELECT label, list(avg_v ORDER BY pos) AS v FROM (
    SELECT label, pos, avg(CAST(x AS DOUBLE)) AS avg_v FROM (
      SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
    GROUP BY label, pos) GROUP BY label),
centroids AS (
  SELECT label, CASE WHEN n = 0 THEN v ELSE list_transform(v, lambda x: x / n) END AS centroid
  FROM (SELECT label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM centroids0))"""


@register("e2_l2_normalize", f"""
WITH {_CENTROIDS_SQL}
SELECT label, CAST(pos AS INTEGER) AS pos, round(x, 6) AS value FROM (
  SELECT label, unnest(centroid) AS x, generate_subscripts(centroid, 1) - 1 AS pos FROM centroids)
""")
def e2_l2_normalize(spark, sf):
    c = _centroids(spark, sf)
    return c.select("label", F.posexplode("centroid").alias("pos", "x")) \
        .select("label", F.col("pos").cast("int"), F.round("x", 6).alias("value"))


@register("v1_topk_label_centroids", f"""
WITH {_CENTROIDS_SQL}, s AS (
  SELECT c.label, e.vec_id, list_dot_product(c.centroid, CAST(e.embedding AS DOUBLE[])) AS score
  FROM centroids c, embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s)
SELECT CAST(label AS BIGINT) AS label, vec_id, CAST(rank AS INTEGER) AS rank, round(score, 4) AS score
FROM r WHERE rank <= 4
""")
def v1_topk_label_centroids(spark, sf):
    q = _centroids(spark, sf).select(F.col("label").cast("bigint").alias("label"), "centroid")
    idx = table(spark, sf, "embeddings").select("vec_id", "embedding")
    hits = search.topk(q, idx, 4, q_id="label", q_vec="centroid", i_id="vec_id", i_vec="embedding")
    return hits.select("label", "vec_id", "rank", F.round("score", 4).alias("score"))


@register("v1_knn_self", f"""
WITH s AS (
  SELECT a.vec_id AS qid, b.vec_id, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s)
SELECT qid, vec_id, CAST(rank AS INTEGER) AS rank, round(score, 4) AS score FROM r WHERE rank <= 4
""")
def v1_knn_self(spark, sf):
    emb = table(spark, sf, "embeddings")
    hits = search.topk(emb.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")),
                       emb.select("vec_id", "embedding"), 4, i_id="vec_id", i_vec="embedding",
                       exclude_self=True)
    return hits.select("qid", "vec_id", "rank", F.round("score", 4).alias("score"))


_K_SQL = ("(CASE WHEN " + " OR ".join(
    [f"contains(lower(coalesce(host, '')), {B.sql_str(h)})" for h in V.CLOUD_HOSTS] +
    [f"contains(lower(coalesce(model, '')), {B.sql_str(m)})" for m in V.CLOUD_MODEL_MARKERS]) +
    f" THEN {V.K_CLOUD} ELSE {V.K_LOCAL} END)")


@register("v2_k_by_request", f"""
WITH {B.REQUESTS_SQL[1:]}
SELECT conv_id, turn, model, host, CAST({_K_SQL} AS INTEGER) AS k FROM requests
""")
def v2_k_by_request(spark, sf):
    r = _requests(spark, sf)
    return r.select("conv_id", "turn", "model", "host", V.k_for(F.col("host"), F.col("model")).cast("int").alias("k"))


@register("v3_similarity_score", f"""
WITH {_CENTROIDS_SQL}
SELECT e.vec_id, round(list_dot_product(CAST(e.embedding AS DOUBLE[]), c.centroid), 4) AS score
FROM embeddings e JOIN centroids c USING (label)
""")
def v3_similarity_score(spark, sf):
    emb = table(spark, sf, "embeddings")
    c = _centroids(spark, sf)
    return emb.join(c, "label").select("vec_id", V.score(F.col("embedding"), F.col("centroid")).alias("score"))


# --------------------------------------------------------------------------- flagship turn
from docshield.plans import turns  # noqa: E402


def _index(spark, sf, docs=None):
    """The index of the documents, one collection a source, stored as E3 stores it."""
    from docshield.sources import stores
    from docshield.streaming import streams
    d = docs if docs is not None else table(spark, sf, "documents").select(
        F.col("source").alias("collection"), "doc_id", "source", "text")
    path = streams.scratch_dir(spark, "index") + "/index"
    stores.write_index(turns.build_index(d, CHUNK_SIZE, CHUNK_OVERLAP, dealt=True), path, dealt=True)
    return stores.read_index(spark, path)


_TURN_IN = Q.check("question", "tier", "enabled", "custom_rules", "in")
_TURN_OUT = Q.check("answer", "tier", "enabled", "custom_rules", "out")

_TURN_HEAD = f"""
{B.REQUESTS_SQL[1:]},
req AS (SELECT r.*, {_TURN_IN['message']} AS in_message, {Q.k_for('host', 'model')} AS k FROM requests r),
docs AS (SELECT source AS collection, doc_id, source, {Q.redact('text')} AS text FROM documents),
clean AS (SELECT * FROM req WHERE in_message IS NULL)"""

_WINDOWS = Q.window_chunks_cte("docs", "text", CHUNK_SIZE, CHUNK_OVERLAP, "collection, doc_id, source")
_PIECES = Q.recursive_chunks_ctes("docs", "text", CHUNK_SIZE, CHUNK_OVERLAP, "collection, doc_id, source")
_TURN_SEARCH = f"""
ch AS (SELECT *, row_number() OVER (ORDER BY collection, doc_id, chunk_idx) AS chunk_id,
              doc_id || ':' || chunk_idx AS chunk_key FROM chunks),
{Q.hash_counts_cte('ch', 'chunk_id', 'chunk_text', 'cvec')},
cn AS (SELECT chunk_id, sum(cnt * cnt) AS n2 FROM cvec GROUP BY chunk_id),
hist AS (SELECT c.conv_id, c.turn,
                (SELECT CAST(count(*) AS BIGINT) FROM conversations m
                 WHERE m.conv_id = c.conv_id AND m.turn < c.turn AND m.role IN ('user', 'assistant')) AS n_history
         FROM clean c),
{Q.hash_counts_cte('clean', 'conv_id, turn', 'question', 'qvec')},
qn AS (SELECT conv_id, turn, sum(cnt * cnt) AS n2 FROM qvec GROUP BY ALL),
cand AS (SELECT r.conv_id, r.turn, r.k, ch.chunk_id, ch.chunk_key, ch.source, ch.chunk_text, ch.chunk_start
         FROM clean r JOIN ch ON ch.collection = r.collection),
dots AS (SELECT q.conv_id, q.turn, c.chunk_id, sum(q.cnt * c.cnt) AS d FROM qvec q JOIN cvec c ON c.b = q.b GROUP BY ALL),
scored AS (
  SELECT a.*, CASE WHEN coalesce(qn.n2, 0) * coalesce(cn.n2, 0) > 0
                   THEN CAST(coalesce(d.d, 0) AS DOUBLE) / sqrt(CAST(qn.n2 * cn.n2 AS DOUBLE)) ELSE 0.0 END AS score
  FROM cand a LEFT JOIN dots d USING (conv_id, turn, chunk_id) LEFT JOIN qn USING (conv_id, turn)
  LEFT JOIN cn USING (chunk_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, chunk_id) AS rank FROM scored),
hits AS (SELECT * FROM ranked WHERE rank <= k),
per_q AS (
  SELECT conv_id, turn, list({{'id': chunk_key, 'source': source, 'text': chunk_text, 'score': round(score, 4),
                               'start': chunk_start}} ORDER BY rank) AS cites
  FROM hits GROUP BY ALL),
ans AS (
  SELECT c.*, h.n_history, p.cites, {Q.best_sentence('c.question', 'list_transform(p.cites, lambda x: x.text)')} AS answer
  FROM clean c LEFT JOIN hist h USING (conv_id, turn) LEFT JOIN per_q p USING (conv_id, turn))"""

TURN_CTES = f"""{_TURN_HEAD},
{_PIECES},{_TURN_SEARCH},
outc AS (SELECT a.*, {_TURN_OUT['message']} AS out_message FROM ans a),
resp AS (
  SELECT conv_id, turn, collection, k, n_history, out_message IS NOT NULL AS blocked,
         CASE WHEN out_message IS NULL THEN 'llm' ELSE 'output_guard' END AS source,
         coalesce(out_message, answer) AS answer,
         CASE WHEN out_message IS NULL THEN coalesce(cites, []) ELSE [] END AS cites,
         question AS question_used, coalesce(out_message, answer) AS stored_answer
  FROM outc
  UNION ALL
  SELECT conv_id, turn, collection, k, CAST(NULL AS BIGINT), TRUE, 'input_guard', in_message, [],
         question, CAST(NULL AS VARCHAR)
  FROM req WHERE in_message IS NOT NULL)"""

G11_SQL = f"""
WITH RECURSIVE {TURN_CTES}
SELECT conv_id, turn, collection, CAST(k AS INTEGER) AS k, n_history, blocked, source, answer,
       CAST(len(cites) AS BIGINT) AS n_citations,
       array_to_string(list_transform(cites, lambda x: CAST(x.id AS VARCHAR)), '|') AS citation_ids,
       array_to_string(list_transform(cites, lambda x: coalesce(x.source, 'Unknown')), '|') AS citation_sources,
       CASE WHEN len(cites) > 0 THEN cites[1].score END AS top_score,
       CASE WHEN len(cites) > 0 THEN cites[len(cites)].score END AS last_score
FROM resp
"""


@register("g11_guarded_turn", G11_SQL)
def g11_guarded_turn(spark, sf):
    """Flagship: every user turn answered end to end under its tier's guardrails."""
    conv = table(spark, sf, "conversations")
    resp = turns.run_turns(B.requests(conv), _index(spark, sf), conv, requests_are_turns=True)
    return turns.summarize_responses(resp)


def _back_sql(text: str, row: str) -> str:
    """Tokens in ``text`` back to originals, by the map as of the row; literal tokens last."""
    return (f"coalesce(list_reduce((SELECT list({{'token': m.token, 'original': m.original}} ORDER BY m.entity_type = '{R.LITERAL}') "
            f"FROM versions m WHERE m.collection = {row}.collection AND (m.since IS NULL OR m.since <= {row}.came) "
            f"AND list_contains(regexp_extract_all({text}, {B.sql_str(R.TOKEN_RE)}), m.token)), "
            f"lambda acc, y: replace(acc, y.token, y.original), {text}), {text})")


PRIVATE_CTES = f"""
{B.PRIVATE_SQL[1:]},
req AS (SELECT r.*, {_TURN_IN['message']} AS in_message, {Q.k_for('host', 'model')} AS k,
               {{'c': conv_id, 't': turn}} AS came FROM private r),
raw AS (SELECT source AS collection, doc_id, source, text FROM documents),
{Q.occurrences_cte('raw', 'collection', 'doc_id', 'text', 'occ0')}, {Q.token_map_ctes('occ0', 'tmap0')},
{Q.apply_map_ctes('occ0', 'tmap0', 'raw', 'collection', 'doc_id', 'text', 'known')},
docs AS (SELECT collection, doc_id, source, text_tokens AS text FROM known),
asked AS (SELECT * FROM req WHERE in_message IS NULL),
{Q.occurrences_cte('asked', 'collection', 'came', 'question', 'occ1', names=True)},
fresh AS (SELECT * FROM occ1 o WHERE NOT EXISTS (SELECT 1 FROM tmap0 m WHERE m.collection = o.collection
            AND m.entity_type = o.entity_type AND m.original = o.value)),
base AS (SELECT collection, entity_type, max(ord) AS base FROM tmap0 GROUP BY 1, 2),
{Q.token_map_ctes('fresh', 'tmap1', 'base')},
versions AS (SELECT *, CAST(NULL AS STRUCT(c BIGINT, t BIGINT)) AS since FROM tmap0
             UNION ALL SELECT m.*, f.doc_ord FROM tmap1 m JOIN tmap1_first f
               ON f.collection = m.collection AND f.entity_type = m.entity_type AND f.value = m.original),
{Q.apply_map_ctes('occ1', 'versions', 'asked', 'collection', 'came', 'question', 'named')},
clean AS (SELECT * REPLACE (text_tokens AS question) FROM named),
{_WINDOWS},{_TURN_SEARCH},
shown AS (SELECT a.* RENAME (answer AS raw_answer), {_back_sql('a.answer', 'a')} AS answer FROM ans a),
outc AS (SELECT a.*, {_TURN_OUT['message']} AS out_message FROM shown a),
told AS (SELECT o.conv_id, o.turn, c.i, {_back_sql('c.x.text', 'o')} AS text,
                coalesce(CAST(CASE WHEN d.lang = 'fr' THEN least(c.x.start // 1800, length(d.text) // 1800) + 1 END AS VARCHAR), '-') AS page
         FROM outc o JOIN (SELECT conv_id, turn, unnest(generate_series(1, len(cites))) AS i, unnest(cites) AS x FROM outc) c
         ON c.conv_id = o.conv_id AND c.turn = o.turn
         JOIN documents d ON d.doc_id = CAST(split_part(c.x.id, ':', 1) AS BIGINT)),
contents AS (SELECT conv_id, turn, md5(string_agg(text, '|' ORDER BY i)) AS contents_md5, string_agg(page, '|' ORDER BY i) AS pages
             FROM told GROUP BY ALL)"""


def _private_responses(spark, sf):
    from docshield.streaming import streams
    conv, docs = table(spark, sf, "conversations"), table(spark, sf, "documents")
    texts = docs.select(F.col("source").alias("collection"), "doc_id", "source", "text")
    index, mapping = turns.build_private_index(texts, streams.scratch_dir(spark, "private"), CHUNK_SIZE, CHUNK_OVERLAP)
    return turns.run_turns(B.private_requests(conv, docs), index, conv, mapping=mapping, requests_are_turns=True,
                           pages=B.page_starts(docs))


@register("g11_private_turn", f"""
WITH {PRIVATE_CTES}
SELECT conv_id, turn, collection, CAST(k AS INTEGER) AS k, out_message IS NOT NULL AS blocked,
       CASE WHEN out_message IS NULL THEN 'llm' ELSE 'output_guard' END AS source, question AS question_used,
       coalesce(out_message, answer) AS answer, coalesce(out_message, raw_answer) AS stored_answer,
       CASE WHEN out_message IS NULL THEN array_to_string(list_transform(cites, lambda x: x.id), '|') ELSE '' END AS citation_ids,
       CASE WHEN out_message IS NULL THEN coalesce(pages, '') ELSE '' END AS citation_pages,
       CASE WHEN out_message IS NULL THEN coalesce(contents_md5, md5('')) ELSE md5('') END AS contents_md5
FROM outc LEFT JOIN contents USING (conv_id, turn)
UNION ALL
SELECT conv_id, turn, collection, CAST(k AS INTEGER), TRUE, 'input_guard', NULL, in_message, NULL, '', '', md5('')
FROM req WHERE in_message IS NOT NULL
""")
def g11_private_turn(spark, sf):
    """G11 with reversible redaction: documents are tokenised before they are indexed, each question
    with the tokens known when it came (R5), answers and citations are shown with originals (R4) and
    with page numbers (V4)."""
    resp = _private_responses(spark, sf)
    c = F.col("citations")
    return resp.select(
        "conv_id", "turn", "collection", F.col("k").cast("int").alias("k"), "blocked", "source", "question_used", "answer",
        "stored_answer", F.array_join("citations.id", "|").alias("citation_ids"),
        F.array_join(F.transform(c, lambda x: F.coalesce(x["page"].cast("string"), F.lit("-"))), "|").alias("citation_pages"),
        F.md5(F.array_join("citations.text", "|")).alias("contents_md5"))


_TWICE = "(SELECT source, doc_id, text FROM documents UNION ALL SELECT 'src' || ((CAST(substr(source, 4) AS INT) + 7) % 20), doc_id, text FROM documents)"


@register("g11_shared_documents", G11_SQL.replace("AS text FROM documents)", f"AS text FROM {_TWICE})"))
def g11_shared_documents(spark, sf):
    """G11 over an index in which every document stands in two collections under one id."""
    conv = table(spark, sf, "conversations")
    d = table(spark, sf, "documents").select("source", "doc_id", "text")
    other = F.concat(F.lit("src"), ((F.substring("source", 4, 9).cast("int") + 7) % 20).cast("string"))
    both = d.unionByName(d.withColumn("source", other)).withColumn("collection", F.col("source"))
    return turns.summarize_responses(turns.run_turns(B.requests(conv), _index(spark, sf, both), conv, requests_are_turns=True))


# --------------------------------------------------------------------------- conversation (H*)
from docshield.functions import chat as CH  # noqa: E402
from docshield.operators import chat  # noqa: E402


def _responses(spark, sf):
    conv = table(spark, sf, "conversations")
    return turns.run_turns(B.requests(conv), _index(spark, sf), conv, requests_are_turns=True)


@register("h1_history", """
SELECT conv_id, turn, role AS hist_role,
       CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS hist_pos
FROM conversations WHERE role IN ('user', 'assistant')
""")
def h1_history(spark, sf):
    h = chat.history(table(spark, sf, "conversations"))
    return h.select("conv_id", "turn", "hist_role", "hist_pos")


@register("h1_history_cli_roles", """
SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS hist_role,
       CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS hist_pos
FROM conversations
""")
def h1_history_cli_roles(spark, sf):
    h = chat.history(table(spark, sf, "conversations"), other_roles="assistant")
    return h.select("conv_id", "turn", "hist_role", "hist_pos")


@register("h2_retrieval_query", f"""
WITH {B.REQUESTS_SQL[1:]}
SELECT r.conv_id, r.turn,
       (SELECT CAST(count(*) AS BIGINT) FROM conversations m
        WHERE m.conv_id = r.conv_id AND m.turn < r.turn AND m.role IN ('user', 'assistant')) AS n_history,
       question AS retrieval_query
FROM requests r
""")
def h2_retrieval_query(spark, sf):
    conv = table(spark, sf, "conversations")
    r = chat.retrieval_query(chat.has_history(B.requests(conv), conv))
    return r.select("conv_id", "turn", "n_history", "retrieval_query")


_CTX_SQL = ("array_to_string(list_transform(cites, lambda x: '[Source Document: ' || coalesce(x.source, 'Unknown') "
            "|| ']' || chr(10) || x.text), chr(10) || chr(10))")


@register("h3_context", f"""
WITH RECURSIVE {TURN_CTES}
SELECT conv_id, turn, {_CTX_SQL} AS context FROM ans
""")
def h3_context(spark, sf):
    conv = table(spark, sf, "conversations")
    req = B.requests(conv)
    idx = _index(spark, sf)
    inp = G.check_input(F.col("question"), F.col("tier"), F.col("enabled"), F.col("custom_rules"))
    clean = req.where(inp.message.isNull()).withColumn("k", V.k_for(F.col("host"), F.col("model")))
    hits = turns.retrieve(clean, idx, "question")
    ctx = chat.context(hits, turns.TURN_KEY)
    return clean.select(*turns.TURN_KEY).join(ctx, turns.TURN_KEY, "left").select(
        "conv_id", "turn", F.coalesce("context", F.lit("")).alias("context"))


@register("h4_prompts", f"""
WITH RECURSIVE {TURN_CTES},
past AS (SELECT c.conv_id, c.turn, string_agg(m.role || ': ' || m.text, chr(10) ORDER BY m.turn) AS told
         FROM clean c JOIN conversations m ON m.conv_id = c.conv_id AND m.turn < c.turn AND m.role IN ('user', 'assistant')
         GROUP BY ALL)
SELECT conv_id, turn, CAST(n_history + 2 AS BIGINT) AS n_messages,
       coalesce(nullif(system_prompt, ''), {B.sql_str(CH.DEFAULT_SYSTEM_PROMPT)}) || {B.sql_str(CH.CONTEXT_HEADER)}
         || {_CTX_SQL} AS system_content,
       md5(coalesce(told, '')) AS history_md5, question AS user_content
FROM ans LEFT JOIN past USING (conv_id, turn)
""")
def h4_prompts(spark, sf):
    """H4: the whole prompt of every clean request; the history as a digest of all its messages."""
    conv = table(spark, sf, "conversations")
    ctx = h3_context(spark, sf)
    req = B.requests(conv)
    inp = G.check_input(F.col("question"), F.col("tier"), F.col("enabled"), F.col("custom_rules"))
    clean = chat.prior_messages(req.where(inp.message.isNull()), conv)
    p = chat.prompts(clean.join(ctx, ["conv_id", "turn"], "left"))
    past = F.slice("messages", 2, F.size("messages") - 2)
    return p.select("conv_id", "turn", F.size("messages").cast("bigint").alias("n_messages"),
                    F.col("messages")[0]["content"].alias("system_content"),
                    F.md5(F.array_join(F.transform(past, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")).alias("history_md5"),
                    F.element_at("messages", -1)["content"].alias("user_content"))


@register("h5_append_turns", f"""
WITH RECURSIVE {TURN_CTES},
last AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id),
r AS (SELECT resp.*, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM resp WHERE source <> 'input_guard')
SELECT r.conv_id, CAST(coalesce(l.last, -1) + 1 + r.i * 2 AS BIGINT) AS turn, 'user' AS role, r.question_used AS text
FROM r LEFT JOIN last l USING (conv_id)
UNION ALL
SELECT r.conv_id, CAST(coalesce(l.last, -1) + 2 + r.i * 2 AS BIGINT), 'assistant', r.stored_answer
FROM r LEFT JOIN last l USING (conv_id)
""")
def h5_append_turns(spark, sf):
    conv = table(spark, sf, "conversations")
    return chat.new_turns(conv, _responses(spark, sf))


@register("h5_private_turns", f"""
WITH {PRIVATE_CTES},
last AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM outc)
SELECT r.conv_id, CAST(coalesce(l.last, -1) + 1 + r.i * 2 AS BIGINT) AS turn, 'user' AS role, r.question AS text
FROM r LEFT JOIN last l USING (conv_id)
UNION ALL
SELECT r.conv_id, CAST(coalesce(l.last, -1) + 2 + r.i * 2 AS BIGINT), 'assistant', coalesce(r.out_message, r.raw_answer)
FROM r LEFT JOIN last l USING (conv_id)
""")
def h5_private_turns(spark, sf):
    """H5 of private turns: sessions keep the tokenised question and the answer before rehydration."""
    return chat.new_turns(table(spark, sf, "conversations"), _private_responses(spark, sf))


@register("h6_clear_sessions", f"""
WITH {B.REQUESTS_SQL[1:]},
blocked AS (SELECT DISTINCT conv_id FROM requests WHERE {_IN['message']} IS NOT NULL)
SELECT conv_id, turn, role FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM blocked b WHERE b.conv_id = c.conv_id)
""")
def h6_clear_sessions(spark, sf):
    conv = table(spark, sf, "conversations")
    ids = guarding.check_input(B.requests(conv)).where(F.col("in_message").isNotNull()).select("conv_id")
    return chat.clear(conv, ids).select("conv_id", "turn", "role")


@register("h7_parse_questions", f"""
WITH {B.MODEL_OUTPUTS_SQL[1:]}, p AS (SELECT conv_id, turn, form, {Q.parse_questions('output')} AS qs FROM model_outputs)
SELECT conv_id, turn, CAST(form AS INTEGER) AS form, CAST(len(qs) AS BIGINT) AS n_questions,
       qs[1] AS q1, qs[2] AS q2, qs[3] AS q3
FROM p
""")
def h7_parse_questions(spark, sf):
    mo = B.model_outputs(table(spark, sf, "conversations"))
    qs = CH.parse_questions(F.col("output"))
    return mo.select("conv_id", "turn", F.col("form").cast("int"), F.size(qs).cast("bigint").alias("n_questions"),
                     F.get(qs, 0).alias("q1"), F.get(qs, 1).alias("q2"), F.get(qs, 2).alias("q3"))


@register("h8_rehydrate_suggestions", f"""
WITH {_R3_DOCS}, {Q.occurrences_cte('docs', 'collection', 'doc_id', 'text')}, {Q.token_map_ctes()},
{Q.apply_map_ctes('occ', 'tmap', 'docs', 'collection', 'doc_id', 'text')},
lines AS (SELECT collection, doc_id, list_filter(string_split(text_tokens, chr(10)),
                 lambda l: regexp_matches(l, {B.sql_str(R.TOKEN_RE)})) AS ls FROM tokenized),
maps AS (SELECT collection, list({{'token': token, 'original': original}}) AS m FROM tmap GROUP BY collection),
back AS (
  SELECT l.doc_id, l.ls,
         list_transform(l.ls, lambda x: coalesce(list_reduce(mp.m, lambda acc, y: replace(acc, y.token, y.original), x), x)) AS restored
  FROM lines l LEFT JOIN maps mp USING (collection))
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, md5(array_to_string(restored, chr(10))) AS restored_md5
FROM back
""")
def h8_rehydrate_suggestions(spark, sf):
    docs = _docs(spark, sf).select(F.col("source").alias("collection"), "doc_id", "text")
    tok, mapping = redaction.tokenize_pii(docs)
    lines = tok.select("collection", "doc_id", F.filter(F.split("text_tokens", "\n"),
                                                        lambda x: x.rlike(R.TOKEN_RE)).alias("ls"))
    back = redaction.rehydrate_array(lines, mapping, "collection", "doc_id", "ls", "restored")
    empty = F.array().cast("array<string>")
    return back.select("doc_id", F.size("ls").cast("bigint").alias("n_lines"),
                       F.md5(F.array_join(F.coalesce("restored", empty), "\n")).alias("restored_md5"))


DEFAULT_HOST = "http://localhost:11434"


@register("h9_setting_changes", f"""
WITH {B.REQUESTS_SQL[1:]},
r AS (SELECT conv_id, turn, model, regexp_replace(coalesce(nullif(host, ''), {B.sql_str(DEFAULT_HOST)}), '/+$', '') AS host,
             system_prompt FROM requests)
SELECT conv_id, turn, coalesce(
   (lag(model) OVER w IS NOT NULL AND model IS DISTINCT FROM lag(model) OVER w)
   OR (lag(host) OVER w IS NOT NULL AND host IS DISTINCT FROM lag(host) OVER w)
   OR (lag(system_prompt) OVER w IS NOT NULL AND system_prompt IS DISTINCT FROM lag(system_prompt) OVER w), FALSE) AS rebuild
FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""")
def h9_setting_changes(spark, sf):
    r = _requests(spark, sf).withColumn("host", CH.resolve_host(F.col("host"), DEFAULT_HOST))
    return chat.setting_changes(r).select("conv_id", "turn", "rebuild")


@register("h10_resolve_host", f"""
WITH {B.REQUESTS_SQL[1:]}
SELECT conv_id, turn, regexp_replace(coalesce(nullif(host, ''), {B.sql_str(DEFAULT_HOST)}), '/+$', '') AS resolved_host
FROM requests
""")
def h10_resolve_host(spark, sf):
    r = _requests(spark, sf)
    return r.select("conv_id", "turn", CH.resolve_host(F.col("host"), DEFAULT_HOST).alias("resolved_host"))


@register("h11_answer_extractive", f"""
WITH RECURSIVE {TURN_CTES}
SELECT conv_id, turn, answer FROM ans
""")
def h11_answer_extractive(spark, sf):
    """H11 built-in answer (before the output guard) for every clean request."""
    return _raw_answers(spark, sf, table(spark, sf, "conversations"))


def _raw_answers(spark, sf, conv):
    req = B.requests(conv)
    idx = _index(spark, sf)
    inp = G.check_input(F.col("question"), F.col("tier"), F.col("enabled"), F.col("custom_rules"))
    clean = req.where(inp.message.isNull()).withColumn("k", V.k_for(F.col("host"), F.col("model")))
    hits = turns.retrieve(clean, idx, "question")
    top = hits.groupBy(*turns.TURN_KEY).agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_text"))).alias("hits"))
    rows = clean.select(*turns.TURN_KEY, "question").join(top, turns.TURN_KEY, "left").withColumn("texts", F.col("hits.chunk_text"))
    return chat.answer(rows).select("conv_id", "turn", "answer")


@register("v4_citations", f"""
WITH RECURSIVE {TURN_CTES}
SELECT r.conv_id, r.turn, CAST(c.i AS INTEGER) AS rank, c.x.id AS chunk_id, coalesce(c.x.source, 'Unknown') AS source,
       c.x.score AS score
FROM resp r, (SELECT unnest(generate_series(1, len(r2.cites))) AS i, r2.conv_id, r2.turn, unnest(r2.cites) AS x FROM resp r2) c
WHERE r.conv_id = c.conv_id AND r.turn = c.turn
""")
def v4_citations(spark, sf):
    resp = _responses(spark, sf)
    return resp.select("conv_id", "turn", F.posexplode("citations").alias("p", "c")).select(
        "conv_id", "turn", (F.col("p") + 1).cast("int").alias("rank"), F.col("c.id").alias("chunk_id"),
        F.coalesce(F.col("c.source"), F.lit("Unknown")).alias("source"), F.col("c.score").alias("score"))


# Fixed value: the overview query of the suggestion flow.
OVERVIEW_QUERY = "summary overview main topics highlights key findings timeline requirements"


@register("v5_representative_chunks", f"""
WITH RECURSIVE docs AS (SELECT source AS collection, doc_id, source, {Q.redact('text')} AS text FROM documents),
{_PIECES},
ch AS (SELECT *, row_number() OVER (ORDER BY collection, doc_id, chunk_idx) AS chunk_id,
              doc_id || ':' || chunk_idx AS chunk_key FROM chunks),
{Q.hash_counts_cte('ch', 'chunk_id', 'chunk_text', 'cvec')},
cn AS (SELECT chunk_id, sum(cnt * cnt) AS n2 FROM cvec GROUP BY chunk_id),
q AS (SELECT 1 AS one, {B.sql_str(OVERVIEW_QUERY)} AS text),
{Q.hash_counts_cte('q', 'one', 'text', 'qvec')},
qn AS (SELECT sum(cnt * cnt) AS n2 FROM qvec),
dots AS (SELECT c.chunk_id, sum(q.cnt * c.cnt) AS d FROM qvec q JOIN cvec c ON c.b = q.b GROUP BY ALL),
scored AS (SELECT ch.collection, ch.chunk_id, ch.chunk_key,
                  CASE WHEN (SELECT n2 FROM qn) * coalesce(cn.n2, 0) > 0
                       THEN CAST(coalesce(d.d, 0) AS DOUBLE) / sqrt(CAST((SELECT n2 FROM qn) * cn.n2 AS DOUBLE)) ELSE 0.0 END AS score
           FROM ch LEFT JOIN dots d USING (chunk_id) LEFT JOIN cn USING (chunk_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY score DESC, chunk_id) AS rank FROM scored)
SELECT collection, CAST(rank AS INTEGER) AS rank, chunk_key AS chunk_id, round(score, 4) AS score FROM r WHERE rank <= 3
""")
def v5_representative_chunks(spark, sf):
    from docshield.plans.turns import representative_chunks
    idx = _index(spark, sf)
    return representative_chunks(idx, OVERVIEW_QUERY, V.K_SUGGEST).select(
        "collection", "rank", "chunk_id", F.round("score", 4).alias("score"))


@register("h8_suggestions", f"""
WITH raw AS (SELECT source AS collection, doc_id, source, text FROM documents),
{Q.occurrences_cte('raw', 'collection', 'doc_id', 'text', 'occ0')}, {Q.token_map_ctes('occ0', 'tmap0')},
{Q.apply_map_ctes('occ0', 'tmap0', 'raw', 'collection', 'doc_id', 'text', 'known')},
docs AS (SELECT collection, doc_id, source, text_tokens AS text FROM known),
{_WINDOWS},
ch AS (SELECT *, row_number() OVER (ORDER BY collection, doc_id, chunk_idx) AS chunk_id FROM chunks),
{Q.hash_counts_cte('ch', 'chunk_id', 'chunk_text', 'cvec')},
cn AS (SELECT chunk_id, sum(cnt * cnt) AS n2 FROM cvec GROUP BY chunk_id),
q AS (SELECT 1 AS one, {B.sql_str(OVERVIEW_QUERY)} AS text),
{Q.hash_counts_cte('q', 'one', 'text', 'qvec')},
qn AS (SELECT sum(cnt * cnt) AS n2 FROM qvec),
dots AS (SELECT c.chunk_id, sum(q.cnt * c.cnt) AS d FROM qvec q JOIN cvec c ON c.b = q.b GROUP BY ALL),
scored AS (SELECT ch.*, CASE WHEN coalesce(cn.n2, 0) > 0 THEN CAST(coalesce(d.d, 0) AS DOUBLE) / sqrt(CAST((SELECT n2 FROM qn) * cn.n2 AS DOUBLE))
                             ELSE 0.0 END AS score
           FROM ch LEFT JOIN dots d USING (chunk_id) LEFT JOIN cn USING (chunk_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY score DESC, chunk_id) AS rank FROM scored),
asked AS (SELECT collection, list({Q.strip_ws("regexp_extract(chunk_text, '[^.!?' || chr(10) || ']+', 0)")} || '?' ORDER BY rank) AS qs
          FROM best WHERE rank <= 3 GROUP BY collection),
maps AS (SELECT collection, list({{'token': token, 'original': original}}) AS m FROM tmap0 GROUP BY collection),
shown AS (SELECT a.collection, list_transform(a.qs, lambda x: coalesce(list_reduce(mp.m, lambda acc, y: replace(acc, y.token, y.original), x), x)) AS qs
          FROM asked a LEFT JOIN maps mp USING (collection)),
wanted AS (SELECT DISTINCT source AS collection FROM documents UNION SELECT 'none' || r_regionkey FROM region)
SELECT collection, coalesce(array_to_string(qs, ' | '), {B.sql_str(' | '.join(CH.FALLBACK_QUESTIONS))}) AS questions
FROM wanted LEFT JOIN shown USING (collection)
""")
def h8_suggestions(spark, sf):
    """The suggestion flow over a tokenised index: representative chunks (V5), questions parsed from the
    model's output (H7), shown with originals (H8); five collections have no index."""
    docs = table(spark, sf, "documents")
    texts = docs.select(F.col("source").alias("collection"), "doc_id", "source", "text")
    index, mapping = turns.build_private_index(texts, streams.scratch_dir(spark, "suggest"), CHUNK_SIZE, CHUNK_OVERLAP)
    wanted = texts.select("collection").unionByName(
        table(spark, sf, "region").select(F.concat(F.lit("none"), F.col("r_regionkey").cast("string")).alias("collection")))
    out = turns.suggestions(wanted, index, OVERVIEW_QUERY, mapping)
    return out.select("collection", F.array_join("questions", " | ").alias("questions"))


# --------------------------------------------------------------------------- sources (S*)
from docshield.operators import fingerprint as FP  # noqa: E402
from docshield.sources import documents as SD  # noqa: E402


def _files(spark, sf):
    return B.files(_docs(spark, sf))


@register("s1_document_scan", f"""
WITH {B.FILES_SQL[1:]}
SELECT doc_id, string_split(path, '/')[-1] AS source, CAST(length(text) AS BIGINT) AS n_chars,
       CAST(strlen(text) AS BIGINT) AS n_bytes
FROM files
""")
def s1_document_scan(spark, sf):
    f = _files(spark, sf)
    return f.select("doc_id", SD.base_name(F.col("path")).alias("source"),
                    F.length("text").cast("bigint").alias("n_chars"),
                    F.octet_length("text").cast("bigint").alias("n_bytes"))


_EXT_SQL = "lower(regexp_extract(ltrim(name, '.'), '(\\.[^./]*)$', 1))"


@register("s2_extension_allow_list", f"""
WITH {B.FILES_SQL[1:]}
SELECT {_EXT_SQL} AS ext, {_EXT_SQL} IN ('.pdf', '.txt', '.doc', '.docx') AS supported,
       CAST(count(*) AS BIGINT) AS n_files
FROM files GROUP BY ALL
""")
def s2_extension_allow_list(spark, sf):
    f = _files(spark, sf)
    kept = SD.split_supported(f, "skip").select("doc_id").withColumn("supported", F.lit(True))
    return (f.join(kept, "doc_id", "left")
             .groupBy(SD.extension(F.col("name")).alias("ext"),
                      F.coalesce(F.col("supported"), F.lit(False)).alias("supported"))
             .agg(F.count(F.lit(1)).cast("bigint").alias("n_files")))


@register("s3_dedup_incoming", f"""
WITH {B.FILES_SQL[1:]},
existing AS (SELECT name, doc_id FROM files WHERE length(collection) = 4),
incoming AS (SELECT name, doc_id FROM files WHERE length(collection) <> 4)
SELECT name, doc_id FROM existing
UNION ALL
SELECT name, doc_id FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.name = i.name)
""")
def s3_dedup_incoming(spark, sf):
    # existing uploads: collections src0..src9; incoming: src10..src19
    f = _files(spark, sf).select("name", "doc_id", "collection")
    existing = f.where(F.length("collection") == 4).drop("collection")
    incoming = f.where(F.length("collection") != 4).drop("collection")
    return SD.dedup_incoming(existing, incoming)


@register("s4_union_documents", """
SELECT doc_id, CAST(CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS INTEGER) AS batch_ord
FROM documents WHERE lang IN ('en', 'fr', 'de', 'es')
""")
def s4_union_documents(spark, sf):
    d = _docs(spark, sf).select("doc_id", "lang")
    parts = [d.where(F.col("lang") == lg).select("doc_id") for lg in ("en", "fr", "de", "es")]
    return SD.union_documents(*parts).select("doc_id", F.col("batch_ord").cast("int"))


@register("s5_empty_check", f"""
WITH {_WIN}
SELECT d.source AS collection, CAST(count(DISTINCT d.doc_id) AS BIGINT) AS n_docs,
       CAST(count(c.chunk_idx) AS BIGINT) AS n_chunks, count(c.chunk_idx) = 0 AS empty
FROM documents d LEFT JOIN chunks c ON c.doc_id = d.doc_id GROUP BY d.source
""")
def s5_empty_check(spark, sf):
    docs = SD.assert_non_empty(_docs(spark, sf))
    ch = _windows(spark, sf)
    per = docs.groupBy(F.col("source").alias("collection")).agg(F.count(F.lit(1)).cast("bigint").alias("n_docs"))
    nch = ch.groupBy(F.col("source").alias("collection")).agg(F.count(F.lit(1)).cast("bigint").alias("n_chunks"))
    out = per.join(nch, "collection", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)).cast("bigint"))
    empty = SD.empty_collections(per, nch).withColumn("empty", F.lit(True))
    return out.join(empty, "collection", "left").select(
        "collection", "n_docs", "n_chunks", F.coalesce("empty", F.lit(False)).alias("empty"))


PAGE_CHARS = 3000


@register("s6_display_page", f"""
WITH {_WIN}
SELECT doc_id, chunk_idx, CAST(CASE WHEN lang = 'fr' THEN floor(chunk_start / {PAGE_CHARS}) + 1 END AS BIGINT) AS page
FROM chunks
""")
def s6_display_page(spark, sf):
    ch = _windows(spark, sf)
    stored = F.when(F.col("lang") == "fr", F.floor(F.col("chunk_start") / PAGE_CHARS))
    return ch.select("doc_id", "chunk_idx", SD.display_page(stored).cast("bigint").alias("page"))


# --------------------------------------------------------------------------- fingerprints (F*)
def _merkle_sql(src: str, coll: str, ord_: str, text: str) -> str:
    return f"""l0 AS (SELECT {coll} AS c, {ord_} AS o, md5({text}) AS h FROM {src}),
l1 AS (SELECT c, o2 AS o, md5(string_agg(h, '' ORDER BY o)) AS h FROM (SELECT *, CAST(floor(o / 1024) AS BIGINT) AS o2 FROM l0) GROUP BY c, o2),
l2 AS (SELECT c, o2 AS o, md5(string_agg(h, '' ORDER BY o)) AS h FROM (SELECT *, CAST(floor(o / 1024) AS BIGINT) AS o2 FROM l1) GROUP BY c, o2),
l3 AS (SELECT c, o2 AS o, md5(string_agg(h, '' ORDER BY o)) AS h FROM (SELECT *, CAST(floor(o / 1024) AS BIGINT) AS o2 FROM l2) GROUP BY c, o2)"""


@register("f1_collection_key", f"""
WITH {B.FILES_SQL[1:]}, {_merkle_sql('files', 'collection', 'ord', 'text')}
SELECT c AS collection, h || '_1000_200_Raw_Offline' AS db_id FROM l3
""")
def f1_collection_key(spark, sf):
    return FP.collection_key(_files(spark, sf), 1000, 200, False)


@register("f1_collection_key_exact", f"""
WITH {B.FILES_SQL[1:]}
SELECT collection, md5(string_agg(text, '' ORDER BY ord)) || '_1000_200_Redacted_Offline' AS db_id
FROM files GROUP BY collection
""")
def f1_collection_key_exact(spark, sf):
    return FP.collection_key_exact(_files(spark, sf), 1000, 200, True)


@register("f2_cache_hits", f"""
WITH {B.FILES_SQL[1:]}, {_merkle_sql('files', 'collection', 'ord', 'text')},
new AS (SELECT c AS collection, h || '_1000_200_Raw_Offline' AS db_id FROM l3
        UNION ALL SELECT c, h || '_600_100_Raw_Offline' FROM l3),
idx AS (SELECT h || '_1000_200_Raw_Offline' AS db_id FROM l3)
SELECT collection, db_id, db_id IN (SELECT db_id FROM idx) AS cached FROM new
""")
def f2_cache_hits(spark, sf):
    f = _files(spark, sf)
    a = FP.collection_key(f, 1000, 200, False)
    b = FP.collection_key(f, 600, 100, False)
    build, there = FP.pending(a.unionByName(b), a.select("db_id"))
    return build.withColumn("cached", F.lit(False)).unionByName(there.withColumn("cached", F.lit(True)))


@register("f3_upload_session_id", f"""
WITH {B.FILES_SQL[1:]}
SELECT collection, substr(md5(string_agg(name, '|' ORDER BY name) || 'gemma3:1b' || '1000' || '200' || 'False' || 'secret, ACME'), 1, 16) AS session_id
FROM files GROUP BY collection
""")
def f3_upload_session_id(spark, sf):
    return FP.session_key(_files(spark, sf), "gemma3:1b", 1000, 200, False, "secret, ACME")


@register("f4_reload_session_id", f"""
WITH {B.REQUESTS_SQL[1:]}
SELECT conv_id, turn, substr(md5('db_' || collection || model || regexp_replace(coalesce(nullif(host, ''), {B.sql_str(DEFAULT_HOST)}), '/+$', '')), 1, 16) AS session_id
FROM requests
""")
def f4_reload_session_id(spark, sf):
    r = _requests(spark, sf)
    host = CH.resolve_host(F.col("host"), DEFAULT_HOST)
    return r.select("conv_id", "turn", FP.reload_session_key(F.concat(F.lit("db_"), F.col("collection")),
                                                             F.col("model"), host).alias("session_id"))


# --------------------------------------------------------------------------- library (L*)
from docshield.operators import audit, library  # noqa: E402


def _library_log(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.concat(F.lit("db_"), F.col("o_custkey").cast("string")).alias("db_id"),
                    F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("version"),
                    F.col("o_orderpriority").alias("model"), F.lit(1000).alias("chunk_size"),
                    F.lit(200).alias("chunk_overlap"), (F.col("o_orderstatus") == "F").alias("redact_pii"))


def _library(spark, sf):
    log = _library_log(spark, sf)
    empty = log.limit(0)
    return library.register(empty, log, "db_id", "created_at", "version")


def _index_keys(spark, sf):
    c = table(spark, sf, "customer")
    return c.where(F.col("c_mktsegment") != "BUILDING").select(
        F.concat(F.lit("db_"), F.col("c_custkey").cast("string")).alias("db_id"))


_LIB_SQL = """lib AS (
  SELECT db_id, created_at, version, model, chunk_size, chunk_overlap, redact_pii FROM (
    SELECT 'db_' || CAST(o_custkey AS VARCHAR) AS db_id, o_orderdate AS created_at, o_orderkey AS version,
           o_orderpriority AS model, 1000 AS chunk_size, 200 AS chunk_overlap, o_orderstatus = 'F' AS redact_pii,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
    FROM orders) WHERE rn = 1),
idx AS (SELECT 'db_' || CAST(c_custkey AS VARCHAR) AS db_id FROM customer WHERE c_mktsegment <> 'BUILDING')"""


@register("l1_register_library", f"""
WITH {_LIB_SQL}
SELECT db_id, epoch_us(created_at) AS created_us, version, model, redact_pii FROM lib
""")
def l1_register_library(spark, sf):
    lib = _library(spark, sf)
    return lib.select("db_id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_us"),
                      "version", "model", "redact_pii")


@register("l2_list_library", f"""
WITH {_LIB_SQL}
SELECT l.db_id, coalesce(l.model, 'unknown') AS model, CAST(l.chunk_size AS INTEGER) AS chunk_size,
       CAST(l.chunk_overlap AS INTEGER) AS chunk_overlap, coalesce(l.redact_pii, FALSE) AS redact_pii,
       EXISTS (SELECT 1 FROM idx WHERE idx.db_id = l.db_id) AS available
FROM lib l
""")
def l2_list_library(spark, sf):
    out = library.list_library(_library(spark, sf), _index_keys(spark, sf))
    return out.select("db_id", "model", F.col("chunk_size").cast("int"), F.col("chunk_overlap").cast("int"),
                      "redact_pii", "available")


@register("l3_resolve_collection", f"""
WITH {_LIB_SQL}
SELECT 'db_' || CAST(c_custkey AS VARCHAR) AS db_id,
       CASE WHEN NOT EXISTS (SELECT 1 FROM lib WHERE lib.db_id = 'db_' || CAST(c_custkey AS VARCHAR)) THEN 'not_in_library'
            WHEN NOT EXISTS (SELECT 1 FROM idx WHERE idx.db_id = 'db_' || CAST(c_custkey AS VARCHAR)) THEN 'index_missing'
            ELSE 'ok' END AS status
FROM customer
""")
def l3_resolve_collection(spark, sf):
    req = table(spark, sf, "customer").select(F.concat(F.lit("db_"), F.col("c_custkey").cast("string")).alias("db_id"))
    return library.resolve(req, _library(spark, sf), _index_keys(spark, sf)).select("db_id", "status")


@register("l4_delete_collection", f"""
WITH {_LIB_SQL},
ids AS (SELECT db_id FROM lib WHERE model = '1-URGENT'
        UNION SELECT 'db_' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal < 0)
SELECT db_id, CASE WHEN db_id IN (SELECT db_id FROM ids) THEN 'deleted' ELSE 'kept' END AS outcome FROM lib
UNION ALL
SELECT db_id, 'unknown' FROM ids WHERE db_id NOT IN (SELECT db_id FROM lib)
UNION ALL
SELECT db_id, 'index_kept' FROM idx WHERE db_id NOT IN (SELECT db_id FROM ids)
""")
def l4_delete_collection(spark, sf):
    lib = _library(spark, sf)
    idx = _index_keys(spark, sf)
    ids = lib.where(F.col("model") == "1-URGENT").select("db_id").unionByName(
        table(spark, sf, "customer").where(F.col("c_acctbal") < 0)
        .select(F.concat(F.lit("db_"), F.col("c_custkey").cast("string")).alias("db_id")))
    lib_after, idx_after, unknown = library.delete(lib, idx, ids)
    kept = lib_after.select("db_id", F.lit("kept").alias("outcome"))
    deleted = lib.join(lib_after.select("db_id"), "db_id", "left_anti").select("db_id", F.lit("deleted").alias("outcome"))
    return kept.unionByName(deleted).unionByName(unknown.select("db_id", F.lit("unknown").alias("outcome"))) \
        .unionByName(idx_after.select("db_id", F.lit("index_kept").alias("outcome")))


@register("l5_session_info", f"""
WITH {B.REQUESTS_SQL[1:]}
SELECT substr(md5(CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)), 1, 16) AS session_id,
       'db_' || collection AS db_id, 0::BIGINT AS n_files,
       coalesce(CASE WHEN turn % 3 = 0 THEN NULL ELSE model END, 'gemma3:1b') AS model,
       coalesce(CASE WHEN tier = 'UnknownLevel' THEN NULL ELSE tier END, 'Internal') AS sensitivity_level,
       coalesce(CASE WHEN turn % 2 = 0 THEN NULL ELSE enabled END, TRUE) AS enable_guardrails,
       coalesce(system_prompt, '') AS system_prompt,
       coalesce(CASE WHEN host = '' THEN NULL ELSE host END, '') AS ollama_host,
       array_to_string(coalesce(custom_rules, []), '|') AS custom_rules
FROM requests
""")
def l5_session_info(spark, sf):
    r = _requests(spark, sf)
    sess = r.select(
        F.substring(F.md5(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))), 1, 16)
        .alias("session_id"),
        F.concat(F.lit("db_"), F.col("collection")).alias("db_id"),
        F.lit(None).cast("array<string>").alias("files"),
        F.when(F.col("turn") % 3 == 0, F.lit(None)).otherwise(F.col("model")).alias("model"),
        F.when(F.col("tier") == "UnknownLevel", F.lit(None)).otherwise(F.col("tier")).alias("sensitivity_level"),
        F.when(F.col("turn") % 2 == 0, F.lit(None)).otherwise(F.col("enabled")).alias("enable_guardrails"),
        "system_prompt", F.nullif(F.col("host"), F.lit("")).alias("ollama_host"), "custom_rules")
    info = library.session_info(sess)
    return info.select("session_id", "db_id", F.size("files").cast("bigint").alias("n_files"), "model",
                       "sensitivity_level", "enable_guardrails", "system_prompt", "ollama_host",
                       F.array_join("custom_rules", "|").alias("custom_rules"))


@register("l6_display_names", f"""
WITH {B.FILES_SQL[1:]},
j AS (SELECT collection, count(*) AS n, arg_min(name, ord) AS first, string_agg(name, ', ' ORDER BY ord) AS joined
      FROM files GROUP BY collection)
SELECT collection, CAST(n AS BIGINT) AS n_files,
       CASE WHEN n > 1 THEN first || ' (+' || CAST(n - 1 AS VARCHAR) || ' more)' ELSE first END AS active_name,
       CASE WHEN length(joined) > 34 THEN substring(joined, 1, 34) || '…' ELSE joined END AS card_name
FROM j
""")
def l6_display_names(spark, sf):
    return library.display_names(_files(spark, sf))


# --------------------------------------------------------------------------- audit (A*)
@register("a1_audit_events", f"""
WITH RECURSIVE {TURN_CTES},
ev AS (
  SELECT r.conv_id, r.turn,
         CASE WHEN r.source = 'llm' THEN 'retrieval' ELSE 'safety_alert' END AS event_type,
         CASE WHEN r.source = 'input_guard' THEN 'Input question blocked by ' || q.tier || ' policy.'
              WHEN r.source = 'output_guard' THEN 'LLM output blocked and redacted under ' || q.tier || ' policy.'
              ELSE 'Successfully completed RAG query in 0.000s' END AS message,
         CAST(CASE WHEN r.source = 'input_guard' THEN 1 WHEN r.source = 'output_guard' THEN 0 ELSE 3 END AS BIGINT) AS n_details,
         CASE WHEN r.source = 'output_guard' THEN NULL ELSE q.question END AS details_question
  FROM resp r JOIN requests q USING (conv_id, turn))
SELECT * FROM ev
""")
def a1_audit_events(spark, sf):
    conv = table(spark, sf, "conversations")
    req = B.requests(conv)
    resp = turns.run_turns(req, _index(spark, sf), conv, requests_are_turns=True)
    rows = resp.join(req.select("conv_id", "turn", "tier", "question"), ["conv_id", "turn"]) \
        .withColumn("n_citations", F.size("citations"))
    ev = audit.turn_events(rows)
    return ev.select("conv_id", "turn", "event_type", "message", F.size("details").cast("bigint").alias("n_details"),
                     F.col("details")["question"].alias("details_question"))


@register("a1_private_audit", f"""
WITH {PRIVATE_CTES}
SELECT conv_id, turn, 'redaction' AS event_type, 'Redacted user query before LLM processing.' AS message,
       CAST(0 AS BIGINT) AS n_details, CAST(NULL AS VARCHAR) AS citations_count, CAST(NULL AS VARCHAR) AS details_question FROM outc
UNION ALL
SELECT o.conv_id, o.turn, CASE WHEN out_message IS NULL THEN 'retrieval' ELSE 'safety_alert' END,
       CASE WHEN out_message IS NULL THEN 'Successfully completed RAG query in 0.000s'
            ELSE 'LLM output blocked and redacted under ' || o.tier || ' policy.' END,
       CASE WHEN out_message IS NULL THEN 3 ELSE 0 END, CASE WHEN out_message IS NULL THEN CAST(coalesce(len(cites), 0) AS VARCHAR) END,
       CASE WHEN out_message IS NULL THEN p.question END
FROM outc o JOIN private p USING (conv_id, turn)
UNION ALL
SELECT conv_id, turn, 'safety_alert', 'Input question blocked by ' || tier || ' policy.', 1, NULL, question
FROM req WHERE in_message IS NOT NULL
""")
def a1_private_audit(spark, sf):
    """A1 of private turns: a redaction event beside the outcome of every question that was answered."""
    req = B.private_requests(table(spark, sf, "conversations"), table(spark, sf, "documents"))
    rows = _private_responses(spark, sf).join(req.select("conv_id", "turn", "tier", "question"), ["conv_id", "turn"])
    ev = audit.turn_events(rows.withColumn("n_citations", F.size("citations")), redacted=True)
    return ev.select("conv_id", "turn", "event_type", "message", F.size("details").cast("bigint").alias("n_details"),
                     F.col("details")["citations_count"].alias("citations_count"), F.col("details")["question"].alias("details_question"))


@register("a1_upload_events", f"""
WITH {B.FILES_SQL[1:]},
u AS (SELECT collection AS db_id, count(*) AS n, max(ord) AS last FROM files GROUP BY collection)
SELECT db_id, 'upload' AS event_type, 'Indexed ' || n || ' file(s) into database ' || db_id AS message,
       CASE WHEN last % 2 = 0 THEN 'llama3' ELSE 'gemma3:1b' END AS model, CAST(500 + last % 3 * 250 AS VARCHAR) AS chunk_size,
       CASE WHEN last % 5 < 3 THEN 'true' ELSE 'false' END AS redact_pii
FROM u
""")
def a1_upload_events(spark, sf):
    """A1: one event per uploaded collection, with the settings of its index."""
    last = F.col("last")
    up = _files(spark, sf).groupBy(F.col("collection").alias("db_id")).agg(F.count(F.lit(1)).alias("n_files"), F.max("ord").alias("last"))
    up = up.select("db_id", "n_files", F.when(last % 2 == 0, "llama3").otherwise("gemma3:1b").alias("model"),
                   (500 + last % 3 * 250).alias("chunk_size"), (last % 5 < 3).alias("redact_pii"))
    ev = audit.upload_events(up)
    return ev.select("db_id", "event_type", "message", *[F.col("details")[c].alias(c) for c in ("model", "chunk_size", "redact_pii")])


@register("a2_retain_newest", """
SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 200
""")
def a2_retain_newest(spark, sf):
    return audit.retain(table(spark, sf, "events"), 200).select("event_id")


@register("a2_retain_per_user", """
SELECT user_id, event_id FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
WHERE r <= 5
""")
def a2_retain_per_user(spark, sf):
    return audit.retain(table(spark, sf, "events"), 5, per="user_id").select("user_id", "event_id")


@register("a3_audit_view", """
SELECT event_id, strftime(ts, '%H:%M:%S') AS time, upper(event_type) AS type FROM events
""")
def a3_audit_view(spark, sf):
    return audit.audit_view(table(spark, sf, "events")).select("event_id", "time", "type")


@register("a4_turn_metrics", """
SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean_value,
       round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
       CAST(count(*) FILTER (WHERE value > 10.0) AS BIGINT) AS n_slow
FROM events GROUP BY event_type
""")
def a4_turn_metrics(spark, sf):
    return audit.turn_metrics(table(spark, sf, "events"))


# --------------------------------------------------------------------------- policy / profiles
def _policy_values_sql() -> str:
    pol = G.Policy.default()
    vals = []
    for t in pol.tiers():
        for d, tbl in (("in", pol.inputs), ("out", pol.outputs)):
            for i, p in enumerate(tbl.get(t, [])):
                vals.append(f"({B.sql_str(t)}, '{d}', {i}, {B.sql_str(p)})")
    return "policy AS (SELECT * FROM (VALUES " + ", ".join(vals) + ") v(tier, direction, ord, pattern))"


@register("g9_upsert_tier", f"""
WITH {_policy_values_sql()},
edits AS (SELECT 'Restricted' AS tier, 'in' AS direction,
                 CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS ord, event_type AS pattern
          FROM (SELECT DISTINCT event_type FROM events))
SELECT tier, direction, CAST(ord AS INTEGER) AS ord, pattern FROM policy WHERE tier NOT IN (SELECT tier FROM edits)
UNION ALL SELECT * FROM edits
""")
def g9_upsert_tier(spark, sf):
    """The Restricted tier's input patterns replaced by the event types of the log.  The edit
    is a table made by Spark (one row per distinct type), nothing passes through the driver."""
    from docshield.operators.ordinal import ordinal_in_groups
    types = table(spark, sf, "events").select(F.lit("Restricted").alias("tier"), F.lit("in").alias("direction"),
                                              F.col("event_type").alias("pattern")).distinct()
    edits = ordinal_in_groups(types, ["tier", "direction"], ["pattern"]).withColumn("ord", (F.col("ord") - 1).cast("int"))
    return guarding.upsert_tier(guarding.policy_rows(spark), edits)


_SETTINGS_SQL = f"""settings AS (
  SELECT conv_id, turn, ([1000, 600, 800])[(turn % 3) + 1] AS chunk_size, ([200, 100])[(conv_id % 2) + 1] AS chunk_overlap,
         tier AS sensitivity, enabled AS guardrails FROM requests)"""


@register("g9_upsert_profiles", f"""
WITH tiers AS (SELECT * FROM (VALUES {", ".join(f"({B.sql_str(t)}, {B.sql_str(G.TIER_DESCRIPTIONS[t])}, {B.sql_str(G.TIER_BADGES[t])})" for t in G.TIER_ORDER)}) v(tier, description, badge)),
edits AS (SELECT CASE WHEN r_regionkey = 0 THEN 'Restricted' ELSE r_name END AS tier, 'Rules of ' || r_name AS description,
                 CAST(r_regionkey AS VARCHAR) AS badge FROM region)
SELECT * FROM tiers WHERE tier NOT IN (SELECT tier FROM edits) UNION ALL SELECT * FROM edits
""")
def g9_upsert_profiles(spark, sf):
    """Description and badge of the Restricted tier replaced, and a tier added per further region."""
    r = table(spark, sf, "region")
    edits = r.select(F.when(F.col("r_regionkey") == 0, "Restricted").otherwise(F.col("r_name")).alias("tier"),
                     F.concat(F.lit("Rules of "), "r_name").alias("description"), F.col("r_regionkey").cast("string").alias("badge"))
    return guarding.upsert_tier(guarding.tiers_frame(spark), edits)


@register("g13_match_profile", f"""
WITH {B.REQUESTS_SQL[1:]}, {_SETTINGS_SQL},
profiles AS (SELECT * FROM (VALUES {", ".join(f"({B.sql_str(k)}, {B.sql_str(n)}, {i}, {cs}, {co}, {B.sql_str(s)}, {str(g).upper()})" for i, (k, n, cs, co, s, g, _r) in enumerate(guarding.UI_PROFILES))})
             v(key, name, ord, chunk_size, chunk_overlap, sensitivity, guardrails))
SELECT s.conv_id, s.turn, (SELECT p.name FROM profiles p WHERE p.chunk_size = s.chunk_size AND p.chunk_overlap = s.chunk_overlap
                           AND p.sensitivity = s.sensitivity AND p.guardrails = s.guardrails ORDER BY p.ord LIMIT 1) AS profile
FROM settings s
""")
def g13_match_profile(spark, sf):
    r = _requests(spark, sf)
    st = r.select("conv_id", "turn",
                  F.element_at(F.array(F.lit(1000), F.lit(600), F.lit(800)), (F.pmod("turn", F.lit(3)) + 1).cast("int"))
                  .alias("chunk_size"),
                  F.element_at(F.array(F.lit(200), F.lit(100)), (F.pmod("conv_id", F.lit(2)) + 1).cast("int"))
                  .alias("chunk_overlap"),
                  F.col("tier").alias("sensitivity"), F.col("enabled").alias("guardrails"))
    out = guarding.match_profile(st, guarding.ui_profiles(spark))
    return out.select("conv_id", "turn", "profile")


@register("g14_merge_profiles", f"""
WITH base AS (SELECT * FROM (VALUES {", ".join(f"({B.sql_str(k)}, {B.sql_str(n)}, {cs}, {co}, {B.sql_str(s)})" for (k, n, cs, co, s, g, _r) in guarding.UI_PROFILES)})
              v(key, name, chunk_size, chunk_overlap, sensitivity)),
custom AS (SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN 'fast' ELSE lower(c_mktsegment) END AS key,
                  'Custom ' || c_mktsegment AS name, CAST(400 + 100 * (count(*) % 5) AS INTEGER) AS chunk_size,
                  100 AS chunk_overlap, 'Internal' AS sensitivity
           FROM customer GROUP BY c_mktsegment)
SELECT key, name, CAST(chunk_size AS INTEGER) AS chunk_size, CAST(chunk_overlap AS INTEGER) AS chunk_overlap, sensitivity
FROM base WHERE key NOT IN (SELECT key FROM custom)
UNION ALL SELECT * FROM custom
""")
def g14_merge_profiles(spark, sf):
    base = guarding.ui_profiles(spark).select("key", "name", "chunk_size", "chunk_overlap", "sensitivity")
    seg = F.col("c_mktsegment")
    custom = (table(spark, sf, "customer").groupBy(seg).agg(F.count(F.lit(1)).alias("n"))
              .select(F.when(seg == "MACHINERY", F.lit("fast")).otherwise(F.lower(seg)).alias("key"),
                      F.concat(F.lit("Custom "), seg).alias("name"),
                      (F.lit(400) + F.lit(100) * F.pmod(F.col("n"), F.lit(5))).cast("int").alias("chunk_size"),
                      F.lit(100).cast("int").alias("chunk_overlap"), F.lit("Internal").alias("sensitivity")))
    return guarding.merge_profiles(base, custom)


# --------------------------------------------------------------------------- streaming (T*)
from docshield.streaming import streams  # noqa: E402


#: Files that one micro-batch of the stream fixtures takes at most (a part is one micro-batch).
MICRO_BATCH_FILES = 100_000


@register("t1_stream_ingest", f"""
WITH RECURSIVE docs AS (SELECT source AS collection, doc_id, source, {Q.redact('text')} AS text FROM documents),
{_PIECES},
ch AS (SELECT *, row_number() OVER (ORDER BY collection, doc_id, chunk_idx) AS chunk_id,
              doc_id || ':' || chunk_idx AS chunk_key FROM chunks),
{Q.hash_counts_cte('ch', 'chunk_id', 'chunk_text', 'cvec')},
cn AS (SELECT chunk_id, sum(cnt * cnt) AS n2 FROM cvec GROUP BY chunk_id)
SELECT ch.chunk_key AS chunk_id, ch.collection, CAST(coalesce(cn.n2, 0) AS BIGINT) AS n2
FROM ch LEFT JOIN cn USING (chunk_id)
""")
def t1_stream_ingest(spark, sf):
    """Documents arrive in four parts, one micro-batch each; the last one delivers every
    document of the first again."""
    docs = table(spark, sf, "documents").withColumn("collection", F.col("source"))
    base = streams.scratch_dir(spark, "ingest")

    def start():
        src = streams.read_stream(spark, base + "/in/*", docs, max_files=MICRO_BATCH_FILES)
        return streams.stream_ingest(spark, src, base + "/index", base + "/ckpt", CHUNK_SIZE, CHUNK_OVERLAP)

    streams.deliver([docs.where(F.pmod("doc_id", F.lit(3)) == part) for part in (0, 1, 2, 0)], base + "/in", start)
    idx = spark.read.parquet(base + "/index")
    return idx.select("chunk_id", "collection", F.col("vec_norm2").cast("bigint").alias("n2"))


@register("t2_stream_guard", ORACLE["g3_input_check"])
def t2_stream_guard(spark, sf):
    """The input guard as a stateless stream over conversation turns."""
    like = table(spark, sf, "conversations")
    # a glob, since the table is a file or a folder of files
    src = streams.read_stream(spark, f"{sf.rstrip('/')}/{{conversations.parquet}}", like, "*", max_files=MICRO_BATCH_FILES)
    guarded = streams.stream_guard(B.requests(src))
    out = streams.scratch_dir(spark, "guard")
    streams.run_to_parquet(guarded.select("conv_id", "turn", "tier", "blocked", "rule_kind", "rule", "message"),
                           out)
    return spark.read.parquet(out)


_T2_IN = Q.check("question", "tier", "enabled", "custom_rules", "in")
_T2_OUT = Q.check("answer", "tier", "enabled", "custom_rules", "out")


@register("t2_stream_turns", f"""
WITH {B.REQUESTS_SQL[1:]}, {B.ANSWERS_SQL[1:]},
q AS (SELECT r.*, a.answer FROM requests r LEFT JOIN answers a ON a.conv_id = r.conv_id AND a.turn = r.turn + 1),
c AS (SELECT q.*, {_T2_IN['message']} AS in_message, {_T2_IN['rule']} AS in_rule,
             {_T2_OUT['message']} AS out_message, {_T2_OUT['rule']} AS out_rule FROM q)
SELECT conv_id, turn,
       CASE WHEN in_message IS NOT NULL THEN 'input_guard' WHEN out_message IS NOT NULL THEN 'output_guard' ELSE 'llm' END AS source,
       coalesce(in_message, out_message, answer) AS shown,
       CASE WHEN in_message IS NOT NULL THEN in_rule ELSE out_rule END AS rule,
       CASE WHEN in_message IS NOT NULL THEN 'safety_alert: Input question blocked by ' || tier || ' policy.'
            WHEN out_message IS NOT NULL THEN 'safety_alert: LLM output blocked and redacted under ' || tier || ' policy.'
            ELSE 'retrieval: Successfully completed RAG query in 0.000s' END AS event
FROM c
""")
def t2_stream_turns(spark, sf):
    """T2 whole: questions and answers arrive in three parts; both guards and the audit log run in
    each micro-batch, and only whole epochs are read."""
    rows = B.answered_requests(table(spark, sf, "conversations"))
    base = streams.scratch_dir(spark, "turns")

    def start():
        src = streams.read_stream(spark, base + "/in/*", rows, max_files=MICRO_BATCH_FILES)
        return streams.stream_turns(src, base + "/out", base + "/ckpt")

    streams.deliver([rows.where(F.pmod("conv_id", F.lit(3)) == k) for k in range(3)], base + "/in", start)
    told = streams.read_epochs(spark, base + "/out", "responses").select("conv_id", "turn", "source", "shown", "rule")
    events = streams.read_epochs(spark, base + "/out", "audit")
    return told.join(events.select("conv_id", "turn", F.concat_ws(": ", "event_type", "message").alias("event")), ["conv_id", "turn"])


@register("t2_session_settings", f"""
WITH g15 AS ({ORACLE["g15_sticky_rules"]}), h9 AS ({ORACLE["h9_setting_changes"]})
SELECT conv_id, turn, effective_rules, rebuild FROM g15 JOIN h9 USING (conv_id, turn)
""")
def t2_session_settings(spark, sf):
    """T2 state: requests, a minute from turn to turn, arrive in five parts by turn, the last one a second delivery of the first;
    sticky rules (G15) and setting changes (H9) are carried across the micro-batches."""
    rows = _requests(spark, sf).withColumn("host", CH.resolve_host(F.col("host"), DEFAULT_HOST)) \
        .withColumn("at", F.timestamp_seconds(946_684_800 + F.col("turn") * 60))
    base = streams.scratch_dir(spark, "settings")

    def start():
        src = streams.read_stream(spark, base + "/in/*", rows, max_files=MICRO_BATCH_FILES)
        return streams.start_to_parquet(streams.session_settings(src, time="at", lateness="1 day"), base + "/out")

    part = F.least(F.floor(F.col("turn") / 2), F.lit(3))
    streams.deliver([rows.where(part == k) for k in (0, 1, 2, 3, 0)], base + "/in", start)
    return spark.read.parquet(base + "/out").select("conv_id", "turn", F.array_join("effective_rules", "|").alias("effective_rules"), "rebuild")


@register("t3_stream_audit_rollup", """
SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n,
       round(sum(value), 6) AS total_value
FROM events GROUP BY ALL
""")
def t3_stream_audit_rollup(spark, sf):
    """Hourly event counts per type, append mode, 10-minute watermark.  Events arrive in three
    parts by time; then comes a copy of the first event, far too late, which must not count; a last
    event two days on lets the watermark pass all windows of the log."""
    events = table(spark, sf, "events")
    times = events.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), [0.33, 0.67], 10_000).alias("cut"),
                       F.min("ts").alias("first"), F.max("ts").alias("last")).first()
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = times["cut"]
    moved = F.col("ts") + F.expr("INTERVAL 2 DAYS")
    base = streams.scratch_dir(spark, "rollup")
    parts = [events.where(at <= low), events.where((at > low) & (at <= high)), events.where(at > high),
             events.where(F.col("ts") == times["first"]), events.where(F.col("ts") == times["last"]).withColumn("ts", moved)]

    def start():
        src = streams.read_stream(spark, base + "/in/*", events, max_files=MICRO_BATCH_FILES)
        return streams.start_to_parquet(streams.stream_audit_rollup(src, "1 hour", "10 minutes"), base + "/out")

    streams.deliver(parts, base + "/in", start)
    r = spark.read.parquet(base + "/out")
    return r.select(F.unix_micros("window_start").alias("window_start"), "event_type",
                    F.col("n").cast("bigint").alias("n"), F.round("total_value", 6).alias("total_value"))


# --------------------------------------------------------------------------- stores
from docshield.sources import stores  # noqa: E402


@register("e3_e4_index_roundtrip", f"""
WITH RECURSIVE docs AS (SELECT source AS collection, doc_id, source, {Q.redact('text')} AS text FROM documents),
{_PIECES},
ch AS (SELECT *, row_number() OVER (ORDER BY collection, doc_id, chunk_idx) AS chunk_id,
              doc_id || ':' || chunk_idx AS chunk_key FROM chunks),
{Q.hash_counts_cte('ch', 'chunk_id', 'chunk_text', 'cvec')},
cn AS (SELECT chunk_id, sum(cnt * cnt) AS n2 FROM cvec GROUP BY chunk_id)
SELECT ch.collection, CAST(count(*) AS BIGINT) AS n_chunks, CAST(sum(coalesce(cn.n2, 0)) AS BIGINT) AS sum_n2
FROM ch LEFT JOIN cn USING (chunk_id)
WHERE ch.collection IN (SELECT DISTINCT source FROM documents WHERE lang = 'de')
GROUP BY ch.collection
""")
def e3_e4_index_roundtrip(spark, sf):
    """E3 write (partitioned by collection, dynamic overwrite) then E4 pruned read of the
    collections that hold German documents."""
    path = streams.scratch_dir(spark, "index") + "/index"
    d = table(spark, sf, "documents").select(F.col("source").alias("collection"), "doc_id", "source", "text")
    stores.write_index(turns.build_index(d, CHUNK_SIZE, CHUNK_OVERLAP, dealt=True), path, dealt=True)
    wanted = table(spark, sf, "documents").where(F.col("lang") == "de").select(F.col("source").alias("collection"))
    idx = stores.read_index_for(spark, path, wanted)
    return idx.groupBy("collection").agg(F.count(F.lit(1)).cast("bigint").alias("n_chunks"),
                                         F.sum(F.aggregate("vec", F.lit(0).cast("bigint"), lambda a, x: a + x * x))
                                         .cast("bigint").alias("sum_n2"))  # from the stored vectors


@register("l4_delete_index", f"""
WITH {Q.window_chunks_cte("documents", "text", CHUNK_SIZE, CHUNK_OVERLAP, "source AS collection, doc_id")}
SELECT collection, CAST(count(*) AS BIGINT) AS n_chunks FROM chunks
WHERE CAST(substr(collection, 4) AS INTEGER) % 3 <> 0 OR collection = 'src6' GROUP BY collection
""")
def l4_delete_index(spark, sf):
    """L4 on disk: every third collection is taken off the stored index, one of them is built again;
    what a reader then sees."""
    docs = table(spark, sf, "documents").select(F.col("source").alias("collection"), "doc_id", "text")
    chunks = chunking.chunk_windows(docs, "text", CHUNK_SIZE, CHUNK_OVERLAP)
    path = streams.scratch_dir(spark, "deleted") + "/index"
    stores.write_index(chunks, path)
    gone = docs.where(F.substring("collection", 4, 9).cast("int") % 3 == 0).select("collection")
    stores.delete_collections(spark, path, gone)
    stores.write_index(chunks.where(F.col("collection") == "src6"), path)
    return stores.read_index(spark, path).groupBy("collection").agg(F.count(F.lit(1)).cast("bigint").alias("n_chunks"))


# A stored policy whose Restricted tier gained two words that occur in the test texts.
G8_EXTRA = ["ouen", "heitlich"]


def _g8_policy():
    p = G.Policy.default()
    p.inputs["Restricted"] = p.inputs["Restricted"] + G8_EXTRA
    return p


def _g8_sql():
    from docshield.plans import sqlgen
    pol = _g8_policy()
    hit = sqlgen.tier_hit("question", "tier", "in", pol)
    return f"""
WITH {B.REQUESTS_SQL[1:]}
SELECT conv_id, turn, tier, {hit} AS rule FROM requests
"""


@register("g8_policy_store_roundtrip", _g8_sql())
def g8_policy_store_roundtrip(spark, sf):
    """Save an edited policy, load it back, and check every request with it."""
    path = streams.scratch_dir(spark, "policy")
    stores.save_policy(spark, _g8_policy(), path)
    pol = stores.load_policy(spark, path)
    return guarding.tier_hits(_requests(spark, sf), "question", "tier", pol, "in").select("conv_id", "turn", "tier", "rule")


_PASSAGE_HITS = f"""
WITH {B.REQUESTS_SQL[1:]}, {B.PASSAGE_POLICY_SQL[1:]},
cleaned AS (SELECT tier, ord, pattern, lower(trim(pattern)) AS p, lower(trim(pattern)) SIMILAR TO '[a-z]+' AS word FROM policy),
hits AS (SELECT r.conv_id, r.turn, p.ord, p.pattern FROM requests r JOIN cleaned p
  ON p.tier = CASE WHEN r.tier = 'UnknownLevel' THEN 'Internal' ELSE r.tier END AND p.p <> ''
  WHERE contains(lower(r.question), p.p) AND (NOT p.word OR regexp_matches(lower(r.question),
    {B.sql_str(Q.WB_L)} || p.p || 's?' || {B.sql_str(Q.WB_R)})))
"""


def _passage_policy(spark, sf):
    """A policy of the words and word pairs of ``benchmark``, saved and read back as tables."""
    path = streams.scratch_dir(spark, "policy-tables")
    stores.save_policy_tables(policy_index.PolicyTables(B.passage_policy(table(spark, sf, "benchmark")), guarding.tiers_frame(spark)), path)
    return policy_index.load_policy_tables(spark, path)


@register("g1_policy_tables", _PASSAGE_HITS + "SELECT conv_id, turn, ord, pattern FROM hits")
def g1_policy_tables(spark, sf):
    """G1/G7 by the pattern index: every pattern of a policy that stays a table, for every request."""
    return policy_index.violations(_requests(spark, sf), "question", "tier", _passage_policy(spark, sf), "in", ["conv_id", "turn"])


_G8T = Q.check("question", "tier", "enabled", "custom_rules", "in", "first_rule")


@register("g8_policy_tables", _PASSAGE_HITS + f"""
SELECT conv_id, turn, tier, {_G8T["kind"]} AS kind, {_G8T["rule"]} AS rule, {_G8T["message"]} AS message
FROM requests LEFT JOIN (SELECT conv_id, turn, arg_min(pattern, ord) AS first_rule FROM hits GROUP BY conv_id, turn) USING (conv_id, turn)
""")
def g8_policy_tables(spark, sf):
    """A stored policy as long as the data checks every request without being collected."""
    checked = guarding.check_input(_requests(spark, sf), policy=_passage_policy(spark, sf), prefix="")
    return checked.select("conv_id", "turn", "tier", "kind", "rule", "message")


@register("g10_profiles_per_request", f"""
WITH {B.REQUESTS_SQL[1:]},
tiers AS (SELECT * FROM (VALUES {", ".join(f"({B.sql_str(t)}, {B.sql_str(G.TIER_DESCRIPTIONS[t])}, {B.sql_str(G.TIER_BADGES[t])})" for t in G.TIER_ORDER)}) v(tier, description, badge))
SELECT r.conv_id, r.turn, r.tier, t.description, t.badge FROM requests r LEFT JOIN tiers t USING (tier)
""")
def g10_profiles_per_request(spark, sf):
    """The profile listing (tier -> description, badge) attached to each request."""
    tiers = guarding.tiers_frame(spark)
    from docshield.operators.sizing import broadcast_if_small
    return _requests(spark, sf).join(broadcast_if_small(tiers, 10_000), "tier", "left") \
        .select("conv_id", "turn", "tier", "description", "badge")
