"""A partitioned table that is replaced by whole versions.

Data lies in ``<path>/data/v=<n>/<partition>=<value>/``; the manifest of
version n lists, for each partition value, the version whose files hold it.  A
write adds a folder and then its manifest, which is what readers look up: they
see the table before or after the write, never half of it, and a partition
that lost its last row is simply not listed any more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import child_names


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, partition: str):
        self.spark, self.path, self.partition = spark, path.rstrip("/"), partition

    def version(self) -> int | None:
        """The newest complete version, or None."""
        done = [int(c[2:]) for c in child_names(self.spark, f"{self.path}/manifest")
                if c.startswith("v=") and "_SUCCESS" in child_names(self.spark, f"{self.path}/manifest/{c}")]
        return max(done, default=None)

    def manifest(self) -> dict[int, int]:
        """Partition value -> version of its files (a row per partition: bounded)."""
        n = self.version()
        if n is None:
            return {}
        rows = self.spark.read.parquet(f"{self.path}/manifest/v={n}").collect()
        return {r["value"]: r["version"] for r in rows}

    def read(self) -> DataFrame:
        """The table; each version's listed partitions are read, nothing else."""
        listed = self.manifest()
        cond = F.lit(False)
        for v in sorted(set(listed.values())):
            values = [p for p, at in listed.items() if at == v]
            cond = cond | ((F.col("v") == v) & F.col(self.partition).isin(values))
        return self.spark.read.parquet(f"{self.path}/data").where(cond).drop("v")

    def _write(self, df: DataFrame, order_by: Sequence[str], kept: dict[int, int]) -> DataFrame:
        versions = [int(c[2:]) for c in child_names(self.spark, f"{self.path}/data") if c.startswith("v=")]
        n = max(versions, default=-1) + 1
        out = f"{self.path}/data/v={n}"
        (df.hint("rebalance", self.partition).sortWithinPartitions(self.partition, *order_by)
           .write.partitionBy(self.partition).parquet(out))
        new = {int(c.split("=", 1)[1]): n for c in child_names(self.spark, out) if c.startswith(self.partition + "=")}
        rows = [(p, v) for p, v in sorted((kept | new).items())]
        (self.spark.createDataFrame(rows, "value int, version int").coalesce(1)
             .write.parquet(f"{self.path}/manifest/v={n}"))
        return self.read()

    def replace(self, df: DataFrame, order_by: Sequence[str] = ()) -> DataFrame:
        """The table becomes ``df``."""
        return self._write(df, order_by, {})

    def replace_partitions(self, df: DataFrame, values: Sequence[int], order_by: Sequence[str] = ()) -> DataFrame:
        """The listed partitions become ``df`` (which has rows of no other); the rest stays."""
        gone = set(values)
        return self._write(df, order_by, {p: v for p, v in self.manifest().items() if p not in gone})
