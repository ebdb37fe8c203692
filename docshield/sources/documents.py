"""Document sources.

A *file* is a row ``(collection, ord, path, name, ext, text)``.  ``read_documents`` scans a
folder of text files (one row per file, whole text, UTF-8); parquet tables of documents
are read with ``spark.read.parquet`` and mapped to the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the extension allow-list.
ALLOWED_EXT = [".pdf", ".txt", ".doc", ".docx"]


def base_name(path) -> F.Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name) -> F.Column:
    """Lower-cased last suffix including the dot; '' when there is none, as for a name that only
    begins with dots (``.pdf``)."""
    return F.lower(F.regexp_extract(F.ltrim(name, F.lit(".")), r"(\.[^./]*)$", 1))


def read_documents(spark: SparkSession, path: str, collection: str | None = None) -> DataFrame:
    """Whole-text scan of a folder of files; ``source`` = base name of the file."""
    df = spark.read.text(path, wholetext=True)
    # Spark gives the path URL-encoded, with a plus sign as itself
    src = F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")))
    out = df.select(F.col("value").alias("text"), src.alias("path"))
    out = out.withColumn("name", base_name(F.col("path"))).withColumn("ext", extension(F.col("name")))
    out = out.withColumn("source", F.col("name"))
    if collection is not None:
        out = out.withColumn("collection", F.lit(collection))
    return out


def split_supported(files: DataFrame, mode: str = "skip", name: str = "name") -> DataFrame:
    """Keep files with an allowed extension.

    ``skip``: drop the others (library).  ``fail``: raise when any file is unsupported
    (API; counted by an aggregate, nothing collected).  ``warn``: drop and log a count (UI).
    """
    ok = extension(F.col(name)).isin(ALLOWED_EXT)
    if mode == "fail":
        bad = files.where(~ok).limit(1).count()
        if bad:
            raise ValueError("Unsupported file type in batch")
    elif mode == "warn":
        n = files.where(~ok).count()
        if n:
            print(f"{n} file(s) skipped (unsupported format)")
    return files.where(ok)


def dedup_incoming(existing: DataFrame, incoming: DataFrame, name: str = "name") -> DataFrame:
    """S3: a later file whose name is already present is dropped (first wins); duplicates
    inside one incoming batch are kept, as the name set is taken before the batch."""
    fresh = incoming.join(existing.select(name).distinct(), name, "left_anti")
    return existing.unionByName(fresh)


def union_documents(*dfs: DataFrame) -> DataFrame:
    """Union in list order; ``batch_ord`` records the position of each input."""
    out = None
    for i, d in enumerate(dfs):
        d = d.withColumn("batch_ord", F.lit(i))
        out = d if out is None else out.unionByName(d)
    return out


def assert_non_empty(df: DataFrame, what: str = "documents") -> DataFrame:
    """Error when nothing was loaded (``isEmpty`` reads at most one row)."""
    if df.isEmpty():
        raise ValueError(f"No {what} were successfully loaded.")
    return df


def empty_collections(requested: DataFrame, produced: DataFrame, key: str = "collection") -> DataFrame:
    """S5 per-collection form: requested collections that produced nothing."""
    return requested.select(key).distinct().join(produced.select(key).distinct(), key, "left_anti")


def display_page(page) -> F.Column:
    """Stored pages are zero-based; shown as page + 1; null stays null."""
    return page + 1
