"""Exact de-duplication by skew-safe combining (DataFrame functions only).

Texts are equal when identical after deleting ASCII white space.  Combining has three steps,
and each compares full content, because content is part of every grouping key:

1. local: the partial aggregate of a map task merges equal texts of that task;
2. salted: (digest, salt, content) groups merge across tasks, so a group that holds a third of
   all rows is spread over ``salts`` tasks;
3. global: the salt winners of a (digest, content) group, at most ``salts`` rows, merge.

The winner has the most code points in its original text, then the smallest id (null last).
Members then find their group by two digests of the content (SHA-256 and MD5); a group table in
which two different contents share both stops the job instead of merging them.

Defined results: null text counts as empty, and empty texts are equal to each other; a null id
loses against any id; rows repeated under one id with equal length share one ``kept`` flag, and
``survivors`` returns one of them; an empty table gives an empty table; extra columns of any
name pass through ``survivors`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, joined, pack, pick, text_of

#: Deleted before comparison (fixed by the contract).
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
SALTS = 16
KEYS = ["sha", "md5"]


def normalised(text: Column) -> Column:
    for ch in BLANKS:
        text = F.replace(text, F.lit(ch), F.lit(""))
    return text


def _digested(rows: DataFrame) -> DataFrame:
    """Adds content and its digests to rows with a ``text`` column, and drops the text."""
    rows = rows.withColumn("content", normalised(F.col("text")))
    return (rows.withColumn("sha", F.sha2("content", 256)).withColumn("md5", F.md5("content"))
            .withColumn("length", F.length("text").cast("long")))


def _rank(length: str, doc: str) -> Column:
    """Orders candidates: longest, then smallest id; a null id comes last."""
    return F.struct(F.col(length).alias("length"), F.col(doc).isNotNull().alias("named"), (-F.col(doc)).alias("minus"))


def groups(docs: DataFrame, text: str = "text", doc: str = "doc_id", salts: int = SALTS) -> DataFrame:
    """One row per distinct content: sha, md5, keep_id, keep_length, group_size."""
    rows = _digested(pick(docs, doc=docs[doc].cast("long"), text=text_of(docs, text))).drop("text")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int"))
    salted = rows.groupBy("sha", "salt", "content").agg(
        F.count(F.lit(1)).alias("n"), F.max(_rank("length", "doc")).alias("best"))
    merged = salted.groupBy("sha", "content").agg(F.sum("n").alias("group_size"), F.max("best").alias("best"))
    named = merged.select("sha", F.md5("content").alias("md5"), "group_size", "best")
    return named.groupBy(*KEYS).agg(
        F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("different contents share SHA-256 and MD5")).cast("long"))
        .otherwise(F.sum("group_size")).alias("group_size"),
        F.max("best").alias("best")).select(
        *KEYS, "group_size", (-F.col("best.minus")).alias("keep_id"), F.col("best.length").alias("keep_length"))


def assignments(docs: DataFrame, text: str = "text", doc: str = "doc_id", salts: int = SALTS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = _digested(pick(docs, doc=docs[doc].cast("long"), text=text_of(docs, text))).drop("text", "content")
    out = joined(rows, groups(docs, text, doc, salts), KEYS, "inner")
    kept = F.col("doc").eqNullSafe(F.col("keep_id")) & (F.col("length") == F.col("keep_length"))
    return out.select(F.col("doc").alias("doc_id"), "keep_id", "group_size", kept.alias("kept"),
                      F.col("sha").alias("text_sha256"))


def survivors(docs: DataFrame, text: str = "text", doc: str = "doc_id", salts: int = SALTS) -> DataFrame:
    """The rows that stay, with the input's columns.  The join key holds the winner's id and
    length, so the copies of a large group meet nothing and are not gathered in one task; the same
    key then tells repeated rows, without a further shuffle."""
    who = F.coalesce(F.col("doc").cast("string"), F.lit(""))  # a null id equals a null id
    rows = _digested(pack(docs, doc=docs[doc].cast("long"), text=text_of(docs, text))).drop("text", "content")
    best = groups(docs, text, doc, salts).select(
        *KEYS, F.col("keep_id").alias("doc"), F.col("keep_length").alias("length"))
    keys = [*KEYS, "who", "length"]
    rows, best = rows.withColumn("who", who).drop("doc"), best.withColumn("who", who).drop("doc")
    return rows.join(best, keys).dropDuplicates(keys).select(f"{ROW}.*")
