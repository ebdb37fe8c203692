"""Shared helpers of the training-data operators."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docshield.session import cut_lineage, ship_package

__all__ = ["WORD", "ROW", "cut_lineage", "documents", "joined", "pack", "pick", "prepare", "text_of"]

#: A word: a run of characters other than ASCII white space (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"

#: The column that carries a caller's whole row, so that none of its names can clash.
ROW = "_row"


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))


#: Rows that a Python worker gets at a time; texts of a web page's size then stay under a few MB.
BATCH_ROWS = 1000


def prepare(df: DataFrame) -> DataFrame:
    """Ship the package to Python workers, and bound the rows of an Arrow batch where the session
    leaves more; for operators that run Python in tasks."""
    spark = df.sparkSession
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    ship_package(spark)
    return df


def text_of(df: DataFrame, name: str) -> Column:
    """The text column, null read as empty."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def pick(df: DataFrame, **cols: Column | str) -> DataFrame:
    """Project to exactly the named internal columns (extra input columns cannot clash)."""
    return df.select(*[(df[c] if isinstance(c, str) else c).alias(k) for k, c in cols.items()])


def pack(df: DataFrame, **cols: Column | str) -> DataFrame:
    """The caller's row in one struct column ``_row``, plus internal columns."""
    whole = F.struct(*[df[c] for c in df.columns]).alias(ROW)
    return df.select(whole, *[(df[c] if isinstance(c, str) else c).alias(k) for k, c in cols.items()])


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on equal key names, null equal to null; the right side's keys are dropped."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])
