"""Session construction and shared-storage helpers.

Everything that must survive an executor loss (stream checkpoints, staged
tables, lineage cuts) is written below the shared folder the cluster names in
``spark.checkpoint.dir``.  We only pick our own folder when that setting is
unset, which is the case in local tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Defaults tuned for the cluster: AQE re-plans joins/partition counts from
# runtime statistics, splits skewed shuffle partitions, and coalesces the tiny
# ones.  ``shuffle_partitions`` is the upper bound AQE coalesces down from.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    # AQE converts a sort-merge join to broadcast only when the *measured*
    # shuffle output of one side is below this bound.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.sources.partitionOverwriteMode": "static",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "stratum", extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with the engine's defaults applied.

    Shuffle partitions: on a cluster start from a high ceiling (4096) that
    AQE coalesces down to ~128 MB partitions, so a 100 TB shuffle does not
    produce multi-GB tasks; in local mode use the number of cores.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(CLUSTER_CONF)
    local = (master or "").startswith("local")
    if shuffle_partitions is None:
        shuffle_partitions = 8 if local else 4096
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if not local:
        # size partitions by bytes, not by keeping every core busy
        conf["spark.sql.adaptive.coalescePartitions.parallelismFirst"] = "false"
    conf.setdefault("spark.driver.memory", os.environ.get("STRATUM_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; created under /tmp only when unset."""
    sc = spark.sparkContext
    base = sc.getCheckpointDir()
    if not base:
        base = sc.getConf().get("spark.checkpoint.dir", None)
        if not base:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="stratum-ckpt-")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir() or base
    return base


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    had = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, had)


def shuffles_removed(spark: SparkSession):
    """Shuffle files of a query go when it ends, not when the driver's JVM next collects:
    for runs of many steps that each write their result."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def variants_whole(spark: SparkSession):
    """Variants are written as they are, not shredded into a column per field: for tables
    whose readers take whole values, which shredding takes apart and reading joins again."""
    return _setting(spark, "spark.sql.variant.inferShreddingSchema", "false")


def many_writers(spark: SparkSession, folders: int):
    """A task keeps a file open in each of so many folders and need not sort its rows by folder."""
    return _setting(spark, "spark.sql.maxConcurrentOutputFileWriters", str(folders))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder for one job's output."""
    base = shared_dir(spark).rstrip("/")
    return f"{base}/stratum/{name}-{uuid.uuid4().hex[:12]}"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder; none where it does not exist."""
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def set_file_times(spark: SparkSession, paths: list[str]) -> None:
    """Give files that were written at once modification times a second apart, the last
    one now: file streams read them in this order."""
    import time
    now = int(time.time() * 1000)
    for i, path in enumerate(paths):
        fs, p = _fs(spark, path)
        fs.setTimes(p, now - 1000 * (len(paths) - 1 - i), -1)


def move_path(spark: SparkSession, path: str, to: str) -> None:
    """Move a folder to a place that does not exist yet."""
    fs, p = _fs(spark, path)
    target = _fs(spark, to)[1]
    fs.mkdirs(target.getParent())
    if fs.exists(target) or not fs.rename(p, target):
        raise OSError(f"{path} could not be moved to {to}")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of our own below the shared one."""
    if f"{shared_dir(spark).rstrip('/')}/" not in path:
        raise ValueError(f"{path} is not below the shared folder")
    fs, p = _fs(spark, path)
    fs.delete(p, True)
