"""Collection library (L1-L6) and UI profiles (G13/G14 live in guarding).

The library is a table keyed by ``db_id``.  Parquet has no MERGE, so an upsert is a union
with the log of registrations and a ``row_number() = 1`` per key, newest first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Listing defaults and display rules.
DEFAULTS = {"model": "unknown", "chunk_size": 1000, "chunk_overlap": 200, "redact_pii": False}
DISPLAY_CUT = 34
ELLIPSIS = "…"


def register(library: DataFrame, entries: DataFrame, key: str = "db_id", ts: str = "created_at",
             tiebreak: str | None = None) -> DataFrame:
    """L1: upsert by key, last write wins (ties by ``tiebreak`` desc).

    The newest row per key is a max over a struct (partial aggregation: a hot key is
    combined map-side, never sorted in one task)."""
    both = library.unionByName(entries, allowMissingColumns=True)
    order = [F.col(ts)] + ([F.col(tiebreak)] if tiebreak else [])
    others = [c for c in both.columns if c != key]
    best = both.groupBy(key).agg(F.max(F.struct(*order, *[F.col(c).alias("_v_" + c) for c in others])).alias("_b"))
    return best.select(key, *[F.col("_b._v_" + c).alias(c) for c in others])


def list_library(library: DataFrame, index_keys: DataFrame, key: str = "db_id") -> DataFrame:
    """L2: defaults for missing fields, ``available`` = an index exists, newest first."""
    avail = index_keys.select(key).distinct().withColumn("available", F.lit(True))
    for c, t in (("files", "array<string>"), ("model", "string"), ("chunk_size", "int"),
                 ("chunk_overlap", "int"), ("redact_pii", "boolean"),
                 ("manual_redactions", "array<string>"), ("created_at", "string")):
        if c not in library.columns:  # missing field in the stored entry -> default below
            library = library.withColumn(c, F.lit(None).cast(t))
    out = library.join(avail, key, "left")
    return (out.select(
        key,
        F.coalesce(F.col("files"), F.array().cast("array<string>")).alias("files"),
        F.coalesce(F.col("model"), F.lit(DEFAULTS["model"])).alias("model"),
        F.coalesce(F.col("chunk_size"), F.lit(DEFAULTS["chunk_size"])).alias("chunk_size"),
        F.coalesce(F.col("chunk_overlap"), F.lit(DEFAULTS["chunk_overlap"])).alias("chunk_overlap"),
        F.coalesce(F.col("redact_pii"), F.lit(DEFAULTS["redact_pii"])).alias("redact_pii"),
        F.coalesce(F.col("manual_redactions"), F.array().cast("array<string>")).alias("manual_redactions"),
        F.coalesce(F.col("created_at").cast("string"), F.lit("")).alias("created_at"),
        F.coalesce(F.col("available"), F.lit(False)).alias("available"))
        .orderBy(F.col("created_at").desc()))


def resolve(requests: DataFrame, library: DataFrame, index_keys: DataFrame, key: str = "db_id") -> DataFrame:
    """L3: ``not_in_library`` / ``index_missing`` / ``ok`` per load request."""
    lib = library.select(key).distinct().withColumn("_lib", F.lit(True))
    idx = index_keys.select(key).distinct().withColumn("_idx", F.lit(True))
    out = requests.join(lib, key, "left").join(idx, key, "left")
    status = (F.when(F.col("_lib").isNull(), F.lit("not_in_library"))
              .when(F.col("_idx").isNull(), F.lit("index_missing")).otherwise(F.lit("ok")))
    return out.withColumn("status", status).drop("_lib", "_idx")


def delete(library: DataFrame, index: DataFrame, ids: DataFrame, key: str = "db_id"):
    """L4: remove collections from index and library; ids not in the library are errors
    (returned as a third table rather than raised, so a batch reports all of them)."""
    ids = ids.select(key).distinct()
    unknown = ids.join(library.select(key), key, "left_anti")
    return (library.join(ids, key, "left_anti"), index.join(ids, key, "left_anti"), unknown)


def session_info(sessions: DataFrame) -> DataFrame:
    """Session fields with the reference's defaults."""
    return sessions.select(
        "session_id", "db_id",
        F.coalesce(F.col("files"), F.array().cast("array<string>")).alias("files"),
        F.coalesce(F.col("model"), F.lit("gemma3:1b")).alias("model"),
        F.coalesce(F.col("sensitivity_level"), F.lit("Internal")).alias("sensitivity_level"),
        F.coalesce(F.col("enable_guardrails"), F.lit(True)).alias("enable_guardrails"),
        F.coalesce(F.col("system_prompt"), F.lit("")).alias("system_prompt"),
        F.coalesce(F.col("ollama_host"), F.lit("")).alias("ollama_host"),
        F.coalesce(F.col("custom_rules"), F.array().cast("array<string>")).alias("custom_rules"))


def display_names(files: DataFrame, group: str = "collection", name: str = "name",
                  ord_col: str = "ord") -> DataFrame:
    """``first (+n more)`` and the joined names cut at 34 characters + ``…``.

    Only the first names can reach the cut (every name, an empty or missing one too, adds at least
    its separator of 2 characters), so a bounded top-N per group (window group limit) replaces a
    full list."""
    files = files.withColumn(name, F.coalesce(name, F.lit("")))
    need = DISPLAY_CUT // 2 + 2
    stats = files.groupBy(group).agg(F.count(F.lit(1)).alias("n"),
                                     F.min_by(F.col(name), F.col(ord_col)).alias("first"))
    w = Window.partitionBy(group).orderBy(ord_col)
    head = (files.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= need)
                 .groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_r", name))).alias("_h")))
    joined = F.array_join(F.transform("_h", lambda x: x[name]), ", ")
    out = stats.join(head, group)
    active = F.when(F.col("n") > 1, F.concat(F.col("first"), F.lit(" (+"), (F.col("n") - 1).cast("string"),
                                             F.lit(" more)"))).otherwise(F.col("first"))
    card = F.when(F.length(joined) > DISPLAY_CUT, F.concat(F.substring(joined, 1, DISPLAY_CUT), F.lit(ELLIPSIS))) \
        .otherwise(joined)
    return out.select(group, F.col("n").cast("bigint").alias("n_files"), active.alias("active_name"),
                      card.alias("card_name"))
