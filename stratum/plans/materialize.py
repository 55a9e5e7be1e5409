"""Materialisations: views, partitioned tables, writes, retention, seeding.

Tables are parquet directories in the shared folder (or catalog tables when a
name is given).  Partitioned writes go through a ``rebalance`` on the
partition column: AQE makes write partitions of the advisory size, so a
month holding a third of the rows is split over many writers while small
months do not produce one file per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def materialize_view(df: DataFrame, name: str) -> DataFrame:
    """View materialisation: nothing is computed, readers inline the plan."""
    df.createOrReplaceTempView(name)
    return df


def materialize_table(df: DataFrame, path: str, partition_by: Sequence[str] = (),
                      order_by: Sequence[str] = (), mode: str = "overwrite",
                      files_per_partition_hint: int | None = None) -> DataFrame:
    """Write a table partitioned by ``partition_by`` and clustered by
    ``order_by`` inside each file (parquet min/max stats then prune row
    groups); returns the table read back (a fresh, short lineage)."""
    out = df
    if partition_by and not files_per_partition_hint:
        # AQE-sized write partitions per partition value: small months are
        # coalesced into one file, a hot month is split over several writers.
        out = out.hint("rebalance", *partition_by)
    if files_per_partition_hint:
        # Spread each partition value over N writers by a hash of the order key.
        salt = F.abs(F.hash(*[F.col(c) for c in (order_by or df.columns[:1])])) \
            % F.lit(files_per_partition_hint)
        out = out.repartition(*[F.col(c) for c in partition_by], salt)
    if partition_by or order_by:
        out = out.sortWithinPartitions(*partition_by, *order_by)
    # static: a replaced table loses the partitions that the new rows do not have
    w = out.write.mode(mode).option("partitionOverwriteMode", "static")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.parquet(path)


def write(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Replace (``overwrite``) or ``append`` a table."""
    if mode not in ("overwrite", "append"):
        raise ValueError(mode)
    df.write.mode(mode).option("partitionOverwriteMode", "static").parquet(path)


def create_as(spark: SparkSession, name: str, df: DataFrame, kind: str = "view",
              path: str | None = None) -> DataFrame:
    """CREATE VIEW / TABLE AS SELECT for an ad-hoc query."""
    if kind == "view":
        return materialize_view(df, name)
    if kind == "table":
        if path is None:
            raise ValueError("a table needs a path")
        df.write.mode("overwrite").parquet(path)
        t = spark.read.parquet(path)
        t.createOrReplaceTempView(name)
        return t
    raise ValueError(kind)


def save_table(df: DataFrame, name: str, path: str, partition_by: Sequence[str] = (),
               order_by: Sequence[str] = (), mode: str = "overwrite") -> DataFrame:
    """Catalog table stored at ``path`` (external: dropping the table keeps files)."""
    out = df.hint("rebalance", *partition_by) if partition_by else df
    if partition_by or order_by:
        out = out.sortWithinPartitions(*partition_by, *order_by)
    w = (out.write.mode(mode).option("path", path).option("partitionOverwriteMode", "static")
            .format("parquet"))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.saveAsTable(name)
    return df.sparkSession.table(name)


def seed_if_empty(df: DataFrame, name: str, path: str) -> bool:
    """Append ``df`` only when the table is missing or has no rows.

    Emptiness is probed with a one-row ``limit`` (not a count).  Returns True
    when rows were written."""
    spark = df.sparkSession
    if spark.catalog.tableExists(name) and not spark.table(name).limit(1).isEmpty():
        return False
    if spark.catalog.tableExists(name):
        df.write.mode("append").insertInto(name)
    else:
        save_table(df, name, path)
    return True


def verify_source(df: DataFrame, sample: int = 5) -> bool:
    """True when the source yields at least one of ``sample`` probed rows."""
    return not df.limit(sample).isEmpty()


def partition_values(spark: SparkSession, name: str, column: str) -> list[str]:
    """Partition values from the catalog (metadata only, no data read)."""
    rows = spark.sql(f"SHOW PARTITIONS {name}").collect()
    out = []
    for r in rows:
        for kv in r[0].split("/"):
            k, v = kv.split("=", 1)
            if k == column:
                out.append(v)
    return out


def drop_partitions(spark: SparkSession, name: str, column: str, values: Sequence) -> int:
    """``ALTER TABLE .. DROP PARTITION`` for each value (whole folders go;
    no data file is read or rewritten)."""
    for v in values:
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({column} = {int(v)})")
    return len(values)


def retain(spark: SparkSession, name: str, column: str, keep_from: int) -> int:
    """Retention: drop every ``column=value`` partition older than ``keep_from``."""
    old = [v for v in partition_values(spark, name, column) if int(v) < int(keep_from)]
    return drop_partitions(spark, name, column, old)
