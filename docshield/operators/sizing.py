"""Size checks before broadcasting.

A side is broadcast only when a bound is proven: its row count is counted (an aggregate,
nothing is collected) and compared with a limit.  Beyond the limit the caller's plan falls
back to a shuffle join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_count(df: DataFrame, limit: int) -> int | None:
    """Row count if it is <= limit, else None.  Reads at most limit + 1 rows."""
    n = df.limit(limit + 1).count()
    return n if n <= limit else None


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only when the row count is proven <= max_rows; else plain df."""
    return F.broadcast(df) if bounded_count(df, max_rows) is not None else df


def collect_bounded(df: DataFrame, max_rows: int, what: str = "table"):
    """Collect a config-sized table to the driver, refusing anything over the bound."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what} has more than {max_rows} rows; refusing to collect it")
    return rows


#: Words of 64 bits that are broadcast at most, to tell rows that a join has no match for.
WORDS_BROADCAST = 1 << 19


def mark_matches(df: DataFrame, wanted: DataFrame, on: list[str], out: str) -> DataFrame:
    """Adds ``out``: whether ``wanted`` may hold the row's key.  It is true for all keys that it holds and
    for the few others whose hash meets one of those.  The hashes are the bits of at most
    ``WORDS_BROADCAST`` words, which are broadcast, so the bound holds for any number of keys, and rows
    that can not match need not be shuffled."""
    place = F.pmod(F.xxhash64(*[F.col(c).cast(df.schema[c].dataType) for c in on]), F.lit(WORDS_BROADCAST * 64))
    word, bit = F.floor(F.col("_place") / 64), F.expr("shiftleft(1L, cast(_place % 64 as int))")
    words = wanted.select(place.alias("_place")).groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    met = df.withColumn("_place", place).join(F.broadcast(words), word == F.col("_word"), "left")
    return met.withColumn(out, F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_place", "_word", "_bits")


def spread(df: DataFrame, factor: int = 2) -> DataFrame:
    """Round-robin the rows over ``factor x`` the cluster's cores when the input arrives in
    fewer partitions than cores (a small file with one row group), so CPU-heavy row-local
    work (regex, splitting, embedding) uses the whole cluster.  Large inputs already come in
    many partitions and are left alone: the check reads the plan, runs no job."""
    par = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < par:
        return df.repartition(par * factor)
    return df
