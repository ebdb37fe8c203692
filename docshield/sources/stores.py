"""Index and policy stores.

The index is a parquet table partitioned by ``collection``; writes use dynamic partition
overwrite so re-building one collection replaces only its folder, and reads prune to the
requested collections.  The policy is a small parquet table ``(tier, direction, ord,
pattern)`` plus ``(tier, description, badge)``; a saved policy replaces the whole default
set.  ``delete_collections`` takes collections off the index on disk (L4): the manifest, a table of
the live collections, is replaced by one atomic step, then their folders are dropped.  Readers go by
the manifest, so a collection is there or gone, also when the dropping was cut short.  Only an absent, empty or corrupt store falls back to the defaults, with a warning; any other
failure to read is raised, so that a policy never vanishes.
"""

from __future__ import annotations

import uuid
import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docshield.functions import guard as G
from docshield.session import shuffles_dropped


#: What Spark says of a folder that is not there or holds no readable table.
ABSENT = {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "FAILED_READ_FILE.CANNOT_READ_FILE_FOOTER", "CANNOT_READ_FILE_FOOTER"}


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None where there is none yet; other errors are raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ABSENT:
            raise
        return None


def _store(spark: SparkSession, path: str):
    """(file system, function from a name under ``path`` to a Hadoop path)."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, lambda name: jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/" + name)


MANIFEST = "_manifest"


def _version(spark: SparkSession, path: str) -> int:
    """The newest manifest of a store; 0 if it has none."""
    fs, at = _store(spark, path)
    if not fs.exists(at(MANIFEST)):
        return 0
    names = [f.getPath().getName() for f in fs.listStatus(at(MANIFEST))]
    return max((int(n.split(".")[0]) for n in names if n.endswith(".current")), default=0)


def live(spark: SparkSession, path: str) -> DataFrame | None:
    """The live collections (one column); None for a store that never had one deleted."""
    n = _version(spark, path)
    if not n:
        return None
    folder = spark.read.text(f"{path}/{MANIFEST}/{n}.current").first()[0]
    return spark.read.parquet(f"{path}/{MANIFEST}/{folder}")


def _commit(spark: SparkSession, path: str, keys: DataFrame) -> None:
    """Makes ``keys`` the live collections.  The list is written first; the file that names it is
    created only if it is not there yet, so of two writers one fails and nothing is half done."""
    n = _version(spark, path) + 1
    folder = f"{n}-{uuid.uuid4().hex}"
    keys.coalesce(1).write.parquet(f"{path}/{MANIFEST}/{folder}")  # one name a collection
    fs, at = _store(spark, path)
    marker = fs.create(at(f"{MANIFEST}/{n}.current"), False)
    marker.write(bytearray(folder.encode()))
    marker.close()


def delete_collections(spark: SparkSession, path: str, ids: DataFrame, partition: str = "collection", drop: bool = True) -> None:
    """L4 on disk: from here on no reader sees the collections ``ids``; their folders are dropped.
    A call that is cut short after its first step leaves folders that nobody reads; the next call,
    or ``vacuum``, drops them."""
    there = live(spark, path)
    if there is None:
        there = read_index(spark, path).select(partition).distinct()
    keys = ids.select(F.col(partition).cast(there.schema[partition].dataType).alias(partition)).distinct()
    _commit(spark, path, there.join(keys, partition, "left_anti"))
    if drop:
        vacuum(spark, path, partition)


def vacuum(spark: SparkSession, path: str, partition: str = "collection") -> int:
    """Drops the folders of collections that are not live; how many there were."""
    keep = live(spark, path)
    if keep is None:  # nothing was ever deleted
        return 0
    fs, at = _store(spark, path)
    unescape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    lead = partition + "="
    folders = [f.getPath().getName() for f in fs.listStatus(at("")) if f.getPath().getName().startswith(lead)]
    named = spark.createDataFrame([(n, unescape(n[len(lead):])) for n in folders], f"folder string, {partition} string")
    gone = named.join(keep.select(F.col(partition).cast("string").alias(partition)), partition, "left_anti")
    dropped = 0
    for row in gone.toLocalIterator():
        fs.delete(at(row["folder"]), True)
        dropped += 1
    return dropped


def deal(df: DataFrame, parts: list[str]) -> DataFrame:
    """One writer per part of a collection: few files, and a hot collection is split.

    Under adaptive execution the rows go to their collection's writer and a hot collection's are
    split by size once they are there (``rebalance``), so ``df`` is computed once; the range
    partitioning that stands in without it (in a stream) computes ``df`` a second time to sample it."""
    if df.sparkSession.conf.get("spark.sql.adaptive.enabled").lower() == "true":
        return df.hint("rebalance", *[F.col(c) for c in parts])
    return df.repartitionByRange(*[c for c in (*parts, "doc_id", "chunk_idx") if c in df.columns])


def write_index(df: DataFrame, path: str, partition: str | list[str] = "collection", dealt: bool = False) -> None:
    """Write chunk vectors; only the partitions present in ``df`` are replaced.  In a store with a
    manifest they are live from when they are whole.  ``dealt``: the rows stand as ``deal`` puts them."""
    parts = [partition] if isinstance(partition, str) else list(partition)
    vacuum(df.sparkSession, path, parts[0])  # leftovers of a deletion must not come back with a new part of it
    rows = df if dealt else deal(df, parts)
    with shuffles_dropped(df.sparkSession):
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
           .partitionBy(*parts).parquet(path))
    there = live(df.sparkSession, path)
    if there is not None:
        new = df.select(F.col(parts[0]).cast(there.schema[parts[0]].dataType).alias(parts[0])).distinct()
        _commit(df.sparkSession, path, there.unionByName(new).distinct())


def _living(spark: SparkSession, path: str, partition: str) -> DataFrame | None:
    """The stored rows of live collections; None where there is no store."""
    df, there = read_if_there(spark, path), live(spark, path)
    if df is None or there is None:
        return df
    return df.join(there.withColumn(partition, F.col(partition).cast(df.schema[partition].dataType)), partition, "left_semi")


def read_index(spark: SparkSession, path: str, collections: list[str] | None = None,
               partition: str = "collection") -> DataFrame:
    """Read the index (partition-pruned to ``collections``); a missing key is an error."""
    df = _living(spark, path, partition)
    if df is None:
        raise FileNotFoundError(f"No stored index at {path}")
    if collections is None:
        return df
    df = df.where(F.col(partition).isin(collections))
    found = {r[0] for r in df.select(partition).distinct().limit(len(collections) + 1).collect()}
    missing = [c for c in collections if c not in found]
    if missing:
        raise FileNotFoundError(f"No stored index for db_id: {missing[0]}")
    return df


def read_index_for(spark: SparkSession, path: str, wanted: DataFrame,
                   partition: str = "collection") -> DataFrame:
    """E4 for a *table* of wanted collections: a left-semi join on the partition column
    (dynamic partition pruning skips the other folders); a wanted key without an index is
    an error, found by an anti join (nothing is collected)."""
    df = _living(spark, path, partition)
    if df is None:
        raise FileNotFoundError(f"No stored index at {path}")
    keys = wanted.select(F.col(partition)).distinct()
    missing = keys.join(df.select(partition).distinct(), partition, "left_anti").limit(1).collect()
    if missing:
        raise FileNotFoundError(f"No stored index for db_id: {missing[0][0]}")
    return df.join(keys, partition, "left_semi")


def save_policy(spark: SparkSession, policy: G.Policy, path: str) -> None:
    """G8 save: the whole policy replaces what was stored."""
    from docshield.operators.guarding import policy_rows, tiers_frame
    policy_rows(spark, policy).write.mode("overwrite").parquet(f"{path}/patterns")
    tiers_frame(spark, policy).write.mode("overwrite").parquet(f"{path}/tiers")


def save_policy_tables(policy, path: str) -> None:
    """G8 save of a policy that is a table already (``policy_index.PolicyTables``)."""
    policy.patterns.select("tier", "direction", "ord", "pattern").write.mode("overwrite").parquet(f"{path}/patterns")
    policy.tiers.write.mode("overwrite").parquet(f"{path}/tiers")


def load_policy(spark: SparkSession, path: str) -> G.Policy:
    """G8 load: stored policy, or the defaults when there is none or its files are no tables."""
    from docshield.operators.guarding import policy_from_rows
    try:
        rows = spark.read.parquet(f"{path}/patterns")
        tiers = spark.read.parquet(f"{path}/tiers")
    except AnalysisException as e:
        if e.getCondition() not in ABSENT:
            raise
        warnings.warn(f"no policy stored at {path} ({e.getCondition()}): the default policy is used", stacklevel=2)
        return G.Policy.default()
    if tiers.isEmpty():
        warnings.warn(f"the policy stored at {path} is empty: the default policy is used", stacklevel=2)
        return G.Policy.default()
    return policy_from_rows(rows, tiers)
