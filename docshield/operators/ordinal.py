"""Dense numbering 1..n inside groups, without putting a hot group into one task.

``row_number()`` over ``partitionBy(group)`` sends every row of a group to one task.  When
the largest group is over a bound, rows are instead range-partitioned on (group, order):
range boundaries split a hot group over many tasks.  Each task numbers its rows locally
(``monotonically_increasing_id`` is consecutive inside a partition), a small table of
per-(partition, group) counts gives every slice its offset, and the two are joined on
(partition, group) -- a key that is itself spread out, so no task gets the hot group.
The numbered slice is checkpointed first so both uses see the same ids.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docshield.session import cut_lineage

DEFAULT_GROUP_BOUND = 2_000_000


def max_group_rows(df: DataFrame, groups: list[str]) -> int:
    row = df.groupBy(*groups).count().agg(F.max("count").alias("m")).first()
    return int(row["m"] or 0)


def ordinal_in_groups(df: DataFrame, groups: list[str], order: list, out: str = "ord",
                      bound: int = DEFAULT_GROUP_BOUND, force_split: bool = False,
                      group_max: int | None = None) -> DataFrame:
    """Add ``out`` = 1-based rank of each row in its group by ``order`` (must be a total order).

    ``group_max``: a known upper bound of the largest group (skips the sizing job)."""
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    if group_max is None and not force_split:
        # the sizing job fills the cache, so the numbering does not recompute the input
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        group_max = max_group_rows(df, groups)
    if not force_split and group_max <= bound:
        w = Window.partitionBy(*groups).orderBy(*order_cols)
        return df.withColumn(out, F.row_number().over(w).cast("bigint"))

    keys = [F.col(g) for g in groups] + order_cols
    parts = max(df.sparkSession.sparkContext.defaultParallelism,
                int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sliced = (df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_mid", F.monotonically_increasing_id()))
    sliced = cut_lineage(sliced)
    stats = sliced.groupBy("_pid", *groups).agg(F.min("_mid").alias("_first"),
                                                 F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    joined = sliced.join(stats.drop("_n"), ["_pid", *groups])
    return (joined.withColumn(out, (F.col("_before") + F.col("_mid") - F.col("_first") + 1).cast("bigint"))
                  .drop("_pid", "_mid", "_first", "_before"))


def running_last(df: DataFrame, groups: list[str], order: list, value, out: str,
                 block_rows: int = 4096, group_max: int | None = None) -> DataFrame:
    """Latest non-null ``value`` at or before each row of its group (a running ``last``).

    Two-level scan, so no task holds a whole group: rows get their ordinal, a running max of
    ``struct(ordinal, value)`` inside blocks of ``block_rows`` (bounded windows), a prefix max
    over the per-block maxima (one row per block), and the greater of the two."""
    n = ordinal_in_groups(df, groups, order, out="_o", group_max=group_max)
    n = n.withColumn("_b", F.floor((F.col("_o") - 1) / block_rows)) \
         .withColumn("_s", F.when(value.isNotNull(), F.struct(F.col("_o").alias("o"), value.alias("v"))))
    w_in = Window.partitionBy(*groups, "_b").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    n = n.withColumn("_in", F.max("_s").over(w_in))
    summ = n.groupBy(*groups, "_b").agg(F.max("_s").alias("_bm"))
    w_pre = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.withColumn("_before", F.max("_bm").over(w_pre)).drop("_bm")
    j = n.join(summ, [*groups, "_b"], "left")
    best = F.when(F.col("_in").isNull(), F.col("_before")).when(F.col("_before").isNull(), F.col("_in")) \
        .otherwise(F.greatest("_in", "_before"))
    return j.withColumn(out, best["v"]).drop("_o", "_b", "_s", "_in", "_before")


def previous_row(df: DataFrame, groups: list[str], order: list, cols: list[str],
                 prefix: str = "prev_", group_max: int | None = None) -> DataFrame:
    """``lag`` by one row inside groups as an equi-join of ordinal o to o - 1; the join key
    (group, ordinal) spreads a hot group over all tasks."""
    n = ordinal_in_groups(df, groups, order, out="_o", group_max=group_max)
    prev = n.select(*groups, (F.col("_o") + 1).alias("_o"), *[F.col(c).alias(prefix + c) for c in cols])
    return n.join(prev, [*groups, "_o"], "left").drop("_o")
