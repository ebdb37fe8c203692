"""Spark session helpers.

The cluster decides ``spark.checkpoint.dir`` (a shared folder).  We only read it; a local
folder is set when it is missing and the master is local, as in tests, and refused on a cluster.
"""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

BASE_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Arrow batches of the embedder / splitter; bounded memory per Python worker.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    # Text work is CPU-bound per row (regex, splitting, hashing): smaller file splits give
    # more, shorter tasks and bounded memory per task.
    "spark.sql.files.maxPartitionBytes": "64m",
}


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to the sizes that the operators are made for; smaller ones
    that somebody set stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2048),
                      ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        now = str(spark.conf.get(key)).rstrip("b")
        if not now.isdecimal() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "docshield", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder named by the cluster; set a local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return conf_dir
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    # Only reached when no cluster exists (tests, local runs).
    local = tempfile.mkdtemp(prefix="docshield-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return local


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """What is written inside drops its shuffle files once it is done; otherwise they stay until the
    driver happens to collect its garbage, beside all that comes after."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut_lineage(df, drop: bool = False):
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss).  ``drop``: the
    shuffle files that it was made of are dropped (``shuffles_dropped``)."""
    ensure_checkpoint_dir(df.sparkSession)
    if not drop:
        return df.checkpoint(eager=True)
    with shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan of its own, made under the setting


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``docshield`` importable in Python workers (UDFs, Arrow jobs): zip the package
    once per application and add it with ``addPyFile``, Spark's usual code distribution."""
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    path = os.path.join(tempfile.mkdtemp(prefix="docshield-pkg-"), "docshield.zip")
    with zipfile.ZipFile(path, "w") as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(app)
