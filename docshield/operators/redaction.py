"""Redaction operators over tables.

Token maps are tables ``(collection, entity_type, token, original, ord)``.  Equal values of
one collection share one token across documents; tokens are numbered per (collection,
type) by first occurrence (document order, then position).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docshield.functions import redact as R
from docshield.operators.ordinal import ordinal_in_groups
from docshield.operators.sizing import mark_matches
from docshield.session import cut_lineage

MAP_COLUMNS = ["collection", "entity_type", "token", "original", "ord"]


def redact(df: DataFrame, col: str = "text", names: bool = False, out: str | None = None) -> DataFrame:
    """Typed placeholders; a pure projection (no shuffle)."""
    return df.withColumn(out or col, R.redact(F.col(col), names))


def redact_words(df: DataFrame, words: list[str], col: str = "text") -> DataFrame:
    """Manual whole-word redaction, words in list order."""
    return df.withColumn(col, R.redact_words(F.col(col), words))


def cut_texts(docs: DataFrame, collection: str, doc_ord: str, text: str, names: bool = True) -> DataFrame:
    """(collection, doc_ord, segs) of the rows that hold an entity, found once and written, since
    both the map and the texts are made of it."""
    cut = docs.select(F.col(collection).alias("collection"), F.col(doc_ord).alias("doc_ord"),
                      R.segments(F.coalesce(F.col(text), F.lit("")), names).alias("segs"))
    return cut_lineage(cut.where(F.exists("segs", lambda x: x["t"] != R.PLAIN)))


def occurrences(cut: DataFrame) -> DataFrame:
    """One row per entity occurrence: (collection, doc_ord, pos, type_ord, entity_type, value)."""
    return (cut.select("collection", "doc_ord", F.posexplode("segs").alias("pos", "x")).where(F.col("x.t") != R.PLAIN)
               .select("collection", "doc_ord", "pos", F.col("x.t").alias("type_ord"),
                       R.span_type(F.col("x.t")).alias("entity_type"), F.col("x.s").alias("value")))


def token_map(occ: DataFrame, start: DataFrame | None = None, since: bool = False) -> DataFrame:
    """R3 map from occurrences: first occurrence per value (partial min aggregation), then a
    dense number per (collection, type) that never funnels a hot collection into one task.
    ``since`` adds the order value of the first text that holds the original."""
    first = (occ.groupBy("collection", "entity_type", "value")
                .agg(F.min(F.struct("doc_ord", "pos")).alias("first")))
    numbered = ordinal_in_groups(first, ["collection", "entity_type"],
                                 [F.col("first.doc_ord"), F.col("first.pos"), F.col("value")])
    if start is not None:
        numbered = (numbered.join(start, ["collection", "entity_type"], "left")
                            .withColumn("ord", F.col("ord") + F.coalesce(F.col("base"), F.lit(0)))
                            .drop("base"))
    return numbered.select(
        "collection", "entity_type",
        F.concat(F.lit("["), F.col("entity_type"), F.lit("_"), F.col("ord").cast("string"),
                 F.lit("]")).alias("token"),
        F.col("value").alias("original"), F.col("ord").cast("bigint").alias("ord"),
        *([F.col("first.doc_ord").alias("since")] if since else []))


def apply_map(docs: DataFrame, cut: DataFrame, mapping: DataFrame, collection: str,
              doc_ord: str, text: str, out: str) -> DataFrame:
    """Put tokens in place of the spans.  A document's text is put together again from its own
    segments, so a value is replaced where it was found and nowhere else.  Rows without an entity
    keep their text and are not shuffled, but for the few that ``mark_matches`` can not tell."""
    tokens = (occurrences(cut).join(mapping.select("collection", "entity_type", F.col("original").alias("value"), "token"),
                                    ["collection", "entity_type", "value"])
              .groupBy("collection", "doc_ord")
              .agg(F.map_from_entries(F.collect_list(F.struct("pos", "token"))).alias("tokens")))
    made = cut.join(tokens, ["collection", "doc_ord"]).select(
        F.col("collection").alias("_c"), F.col("doc_ord").alias("_d"),
        F.array_join(F.transform("segs", lambda x, i: F.coalesce(F.try_element_at(F.col("tokens"), i), x["s"])), "").alias("_made"))
    keyed = docs.withColumn("_c", F.col(collection)).withColumn("_d", F.col(doc_ord))
    marked = mark_matches(keyed, cut.select(F.col("collection").alias("_c"), F.col("doc_ord").alias("_d")), ["_c", "_d"], "_held")
    joined = marked.where("_held").join(made, ["_c", "_d"], "left").withColumn(out, F.coalesce(F.col("_made"), F.col(text)))
    plain = marked.where("not _held").withColumn(out, F.col(text))
    return plain.drop("_c", "_d", "_held").unionByName(joined.drop("_c", "_d", "_held", "_made"))


def tokenize_pii(docs: DataFrame, collection: str = "collection", doc_ord: str = "doc_id",
                 text: str = "text", out: str = "text_tokens", names: bool = True) -> tuple[DataFrame, DataFrame]:
    """(documents with ``out`` tokenised text, token map)."""
    cut = cut_texts(docs, collection, doc_ord, text, names)
    mapping = token_map(occurrences(cut))
    return apply_map(docs, cut, mapping, collection, doc_ord, text, out), mapping


def _back(text: Column, pairs: Column) -> Column:
    """A text with its tokens looked up where they stand: an original that looks like a token is
    not read again, and a token without a pair stays."""
    gaps, found = F.split(text, R.TOKEN_RE, -1), F.regexp_extract_all(text, F.lit(R.TOKEN_RE), F.lit(0))
    return F.array_join(F.zip_with(gaps, found, lambda g, t: F.concat(
        g, F.coalesce(F.try_element_at(pairs, F.coalesce(t, F.lit(""))), t, F.lit("")))), "")


def _with_pairs(df: DataFrame, mapping: DataFrame, collection: str, row_key: str, found: Column,
                asof: str | None) -> DataFrame:
    """Adds ``_pairs`` (token -> original) of the tokens ``found`` in a row; only rows that hold a
    token are shuffled.  ``asof``: the row's order value; a token counts if the mapping has it from
    the start (``since`` null) or since then at the latest."""
    at = [F.col(asof).alias("_asof")] if asof else []
    held = df.select(F.col(collection).alias("_c"), F.col(row_key).alias("_k"), *at, F.explode(F.array_distinct(found)).alias("_t"))
    names = mapping.select("collection", "token", "original", *(["since"] if asof else []))
    cond = (F.col("_c") == F.col("collection")) & (F.col("_t") == F.col("token"))
    if asof:
        cond = cond & (F.col("since").isNull() | (F.col("since") <= F.col("_asof")))
    pairs = held.join(names, cond).groupBy("_c", "_k").agg(
        F.map_from_entries(F.collect_list(F.struct("token", "original"))).alias("_pairs"))
    keyed = df.withColumn("_c", F.col(collection)).withColumn("_k", F.col(row_key))
    return keyed.join(pairs, ["_c", "_k"], "left").drop("_c", "_k")


def rehydrate(df: DataFrame, mapping: DataFrame, collection: str, row_key: str, text: str,
              out: str, asof: str | None = None) -> DataFrame:
    """Tokens in ``text`` -> originals of the row's collection; unknown tokens stay."""
    paired = _with_pairs(df, mapping, collection, row_key, F.regexp_extract_all(F.col(text), F.lit(R.TOKEN_RE), F.lit(0)), asof)
    return paired.withColumn(out, F.when(F.col("_pairs").isNotNull(), _back(F.col(text), F.col("_pairs")))
                             .otherwise(F.col(text))).drop("_pairs")


def extend_map(mapping: DataFrame, texts: DataFrame, collection: str, doc_ord: str,
               text: str, names: bool = True) -> DataFrame:
    """Entities of new texts not yet in the map get the next numbers of their
    (collection, type); returns only the new map rows."""
    return _extension(mapping, cut_texts(texts, collection, doc_ord, text, names))


def _extension(mapping: DataFrame, cut: DataFrame, since: bool = False) -> DataFrame:
    fresh = occurrences(cut).join(mapping.select("collection", "entity_type", F.col("original").alias("value")),
                                  ["collection", "entity_type", "value"], "left_anti")
    base = mapping.groupBy("collection", "entity_type").agg(F.max("ord").alias("base"))
    return token_map(fresh, start=base, since=since)


def tokenize_asof(texts: DataFrame, mapping: DataFrame, collection: str, arrival: list[str], text: str,
                  out: str, names: bool = True) -> tuple[DataFrame, DataFrame]:
    """R5 for a table of later texts, as if they came one after the other by ``arrival`` (a total
    order): each is tokenised with the tokens known when it came and adds its own new values.

    A value keeps the token of its first occurrence, so the token that a text sees is the same in
    every later state of the map; the map is therefore built once, each row with the arrival
    (``since``) of the text that brought it, null for the tokens of ``mapping``.  Returns the texts
    with ``out`` and ``_arrival``, and that versioned map, for ``rehydrate(..., asof="_arrival")``."""
    rows = texts.withColumn("_arrival", F.struct(*arrival))
    cut = cut_texts(rows, collection, "_arrival", text, names)
    first = F.lit(None).cast(rows.schema["_arrival"].dataType).alias("since")
    known = mapping.select(*MAP_COLUMNS, first)
    versioned = cut_lineage(known.unionByName(_extension(mapping, cut, since=True)))
    return apply_map(rows, cut, versioned, collection, "_arrival", text, out), versioned


def pii_profile(docs: DataFrame, dims: list[str]) -> DataFrame:
    """Entity counts by type, rolled up over ``dims`` (partial aggregation, one shuffle)."""
    cut = docs.select(*dims, R.segments(F.coalesce(F.col("text"), F.lit("")), names=False).alias("segs"))
    def count(name: str) -> Column:
        i = R.SPAN_ORDER.index(name)
        return F.size(F.filter("segs", lambda x: x["t"] == i)).alias(f"n_{name.lower()}")

    counts = [count(t.name) for t in R.PII_TYPES]
    per_doc = cut.select(*dims, *counts)
    aggs = [F.count(F.lit(1)).alias("n_docs")] + \
        [F.sum(f"n_{t.name.lower()}").cast("bigint").alias(f"n_{t.name.lower()}") for t in R.PII_TYPES]
    return per_doc.rollup(*dims).agg(*aggs)


def rehydrate_array(df: DataFrame, mapping: DataFrame, collection: str, row_key: str, arr: str,
                    out: str, asof: str | None = None) -> DataFrame:
    """R4 over every element of an array column (H8, V4), in place: one map of tokens a row."""
    found = F.flatten(F.transform(F.col(arr), lambda x: F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(R.TOKEN_RE), F.lit(0))))
    paired = _with_pairs(df, mapping, collection, row_key, found, asof)
    return paired.withColumn(out, F.when(F.col("_pairs").isNotNull(), F.transform(
        F.col(arr), lambda x: _back(x, F.col("_pairs")))).otherwise(F.col(arr))).drop("_pairs")
