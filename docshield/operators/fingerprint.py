"""Collection keys and session ids.

A collection's key is an MD5.  The default is a Merkle digest: MD5 of each file, then levels of
MD5 over ordered groups of at most ``fanout`` child digests (three, or as many as the highest file
number needs).  Every group is bounded, so no task ever holds a whole (possibly hot) collection.

The exact forms are MD5 over the concatenated texts (F1) or sorted names (F3).  MD5 can not be
merged, so a group's rows pass through one task in order; they are sorted by Spark, which spills,
and read as a stream: the task holds one Arrow batch and the digest's state, whatever the group's
size (``streamed_md5``).  No group is too large, but a hot one takes one task's time: where that
matters, the Merkle key is the one to use.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FANOUT = 1024
LEVELS = 3


def settings_suffix(size, overlap, redact) -> F.Column:
    """``_{size}_{overlap}`` + ``_Redacted``/``_Raw`` + ``_Offline``."""
    return F.concat(F.lit("_"), F.lit(str(size)) if not isinstance(size, F.Column) else size.cast("string"),
                    F.lit("_"), F.lit(str(overlap)) if not isinstance(overlap, F.Column) else overlap.cast("string"),
                    F.lit("_Redacted" if redact else "_Raw"), F.lit("_Offline"))


def merkle_digest(files: DataFrame, collection: str = "collection", ord_col: str = "ord",
                  text: str = "text", fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(collection, digest): ordered Merkle MD5 of the files of each collection."""
    cur = files.select(F.col(collection).alias("c"), F.col(ord_col).cast("long").alias("o"),
                       F.md5(F.col(text)).alias("h"))
    for _ in range(levels):
        cur = (cur.groupBy("c", F.floor(F.col("o") / fanout).alias("o"))
                  .agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "h"))),
                                                      lambda x: x["h"]), "")).alias("h")))
    # after ``levels`` levels each collection with ord < fanout**levels has one node (o == 0)
    return cur.select(F.col("c").alias(collection), F.col("h").alias("digest"))


def collection_key(files: DataFrame, size: int, overlap: int, redact: bool,
                   collection: str = "collection", ord_col: str = "ord", text: str = "text") -> DataFrame:
    """F1 (scalable form): Merkle digest + settings suffix."""
    top = files.agg(F.max(ord_col).alias("m")).first()["m"] or 0
    levels = LEVELS
    while top >= FANOUT ** levels:
        levels += 1
    d = merkle_digest(files, collection, ord_col, text, levels=levels)
    return d.select(collection, F.concat(F.col("digest"), settings_suffix(size, overlap, redact)).alias("db_id"))


def streamed_md5(rows: DataFrame, group: str, order: list[str], text: str, sep: str = "",
                 tail: str | None = None) -> DataFrame:
    """(group, digest): MD5 over the texts of each group in order, joined by ``sep``, then ``tail``
    (equal on all rows of a group).  Null texts count as empty.  The state is carried from one Arrow
    batch to the next, since a group's sorted rows lie in one partition."""
    end = F.col(tail).cast("string") if tail else F.lit("")
    src = rows.select(F.col(group).alias("g"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
                      F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("t"),
                      F.coalesce(end, F.lit("")).cast("binary").alias("tail"))
    kind = src.schema["g"].dataType.simpleString()
    keys = [f"o{i}" for i in range(len(order))]
    sorted_rows = src.repartition("g").sortWithinPartitions("g", *keys, "t")
    between = sep.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group_type, state, now, last = None, None, None, b""

        def done() -> pa.RecordBatch:
            state.update(last)
            return pa.RecordBatch.from_arrays([pa.array([now], group_type), pa.array([state.hexdigest()], pa.string())], ["g", "digest"])

        for batch in batches:
            group_type = batch.column("g").type
            for g, t, end in zip(batch.column("g"), batch.column("t"), batch.column("tail")):
                g = g.as_py()
                if state is not None and g == now:
                    state.update(between)
                else:
                    if state is not None:
                        yield done()
                    state, now = hashlib.md5(usedforsecurity=False), g
                state.update(t.as_buffer())
                last = end.as_py()
        if state is not None:
            yield done()

    made = sorted_rows.select("g", "t", "tail").mapInArrow(run, f"g {kind}, digest string")
    return made.select(F.col("g").alias(group), "digest")


def collection_key_exact(files: DataFrame, size: int, overlap: int, redact: bool,
                         collection: str = "collection", ord_col: str = "ord", text: str = "text") -> DataFrame:
    """F1 (exact form): MD5 over the concatenated texts in order, of collections of any size."""
    g = streamed_md5(files, collection, [ord_col], text)
    return g.select(collection, F.concat(F.col("digest"), settings_suffix(size, overlap, redact)).alias("db_id"))


def pending(new: DataFrame, index_keys: DataFrame, key: str = "db_id") -> tuple[DataFrame, DataFrame]:
    """(to build, already there) by anti / semi join on the key."""
    keys = index_keys.select(key).distinct()
    return new.join(keys, key, "left_anti"), new.join(keys, key, "left_semi")


def py_bool(c) -> F.Column:
    return F.when(c, F.lit("True")).otherwise(F.lit("False"))


def session_key(files: DataFrame, model, size, overlap, redact, manual, group: str = "collection",
                name: str = "name") -> DataFrame:
    """first 16 hex of MD5(sorted names joined by '|' + model + size + overlap + bool
    text + raw manual-redaction string), for upload batches of any size."""
    lit = lambda v: v if isinstance(v, F.Column) else F.lit(v)
    tail = F.concat(lit(model), lit(size).cast("string"), lit(overlap).cast("string"), py_bool(lit(redact)), lit(manual))
    g = streamed_md5(files.where(F.col(name).isNotNull()).withColumn("_tail", tail), group, [name], name, "|", "_tail")
    return g.select(group, F.substring("digest", 1, 16).alias("session_id"))


def reload_session_key(db_id, model, host) -> F.Column:
    """first 16 hex of MD5(db_id + model + host)."""
    return F.substring(F.md5(F.concat(db_id, model, host)), 1, 16)
