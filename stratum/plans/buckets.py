"""The latest version per key, kept up by batches: only touched buckets are rewritten.

Rows lie in ``bucket=<hash of the key>/``.  A batch is reduced to its newest row
per key first and written by bucket; the folders it has name the buckets it
touches.  Those alone are read, merged, written and swapped in as folders, so the
work follows the batch and the buckets it meets, not the log.  A bucket is the
remainder of the hash that Spark deals keys by, and the number of shuffle partitions
is a multiple of that of the buckets: the tasks that find the newest rows hold
whole buckets and write them, without a second shuffle (with another number of
partitions the rows are the same, in more files).

A replaced bucket is written to the shared folder before the table changes, and
a pointer ``_pending`` names it.  If the driver dies while folders are swapped,
the next call moves the rest from there; the merge itself gives the same
rows however often a batch is applied.  One writer at a time.

Defined cases: NULL keys are a key like any other, repeated rows and ties go by
``tiebreak``, an empty batch changes nothing; a table that has had no row has no
schema either, and reading it is refused by name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.latest import latest_by_key
from ..session import child_names, drop_path, move_path, path_exists, scratch_path

BUCKET = "bucket"
PARTITIONS = "spark.sql.shuffle.partitions"


class BucketedLatest:
    """``buckets`` is fixed by the first call for a path and must stay: choose it
    so that a bucket holds some hundred MB (latest rows, so hot keys do not count)."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], version: str,
                 tiebreak: Sequence[str] = (), buckets: int = 256):
        self.spark, self.path = spark, path.rstrip("/")
        self.keys, self.version, self.tiebreak, self.buckets = list(keys), version, list(tiebreak), buckets
        layout = spark.createDataFrame([(buckets, ",".join(self.keys), "hash")], "buckets int, keys string, place string")
        if not path_exists(spark, f"{self.path}/_layout/_SUCCESS"):
            layout.write.mode("overwrite").parquet(f"{self.path}/_layout")
        elif spark.read.parquet(f"{self.path}/_layout").first() != layout.first():
            raise ValueError(f"{path} has another number of buckets or other keys")

    def _latest(self, df: DataFrame) -> DataFrame:
        return latest_by_key(df, self.keys, self.version, self.tiebreak)

    def _by_bucket(self, source: DataFrame | str, path: str, mode: str) -> None:
        """``static``: the newest rows of ``source`` are written by bucket; ``dynamic``: the
        buckets of the folder ``source`` replace those of the table."""
        if mode == "dynamic":
            for n in self._names(source):
                drop_path(self.spark, f"{path}/{BUCKET}={n}")
                move_path(self.spark, f"{source}/{BUCKET}={n}", f"{path}/{BUCKET}={n}")
            return
        had = self.spark.conf.get(PARTITIONS)
        self.spark.conf.set(PARTITIONS, str(-(-int(had) // self.buckets) * self.buckets))
        try:
            place = F.pmod(F.hash(*self.keys), F.lit(self.buckets)).cast("int")
            (self._latest(source).withColumn(BUCKET, place).sortWithinPartitions(BUCKET, *self.keys)
                 .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(BUCKET).parquet(path))
        finally:
            self.spark.conf.set(PARTITIONS, had)

    def _names(self, path: str) -> list[int]:
        return sorted(int(c.split("=")[1]) for c in child_names(self.spark, path) if c.startswith(f"{BUCKET}="))

    def _swap(self) -> None:
        """Replace the buckets that ``_pending`` points at, if there is one."""
        pointer = f"{self.path}/_pending"
        if path_exists(self.spark, f"{pointer}/_SUCCESS"):
            merged = self.spark.read.parquet(pointer).first()["path"]
            self._by_bucket(merged, self.path, "dynamic")
            drop_path(self.spark, pointer)
            drop_path(self.spark, merged)

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The table, or the listed buckets of it (a partition filter)."""
        self._swap()
        if not self._names(self.path):
            raise ValueError(f"{self.path} has had no rows yet")
        df = self.spark.read.parquet(self.path)
        if buckets is not None:
            df = df.where(F.col(BUCKET).isin(list(buckets)))
        return df

    def merge(self, batch: DataFrame) -> list[int]:
        """Apply a batch of versions; returns the buckets it rewrote."""
        self._swap()
        merged = incoming = scratch_path(self.spark, "incoming")
        self._by_bucket(batch, incoming, "static")
        touched = self._names(incoming)
        there = sorted(set(touched) & set(self._names(self.path)))
        if there:
            merged = scratch_path(self.spark, "merged")
            rows = self.spark.read.parquet(incoming).unionByName(self.read(there))
            self._by_bucket(rows.drop(BUCKET), merged, "static")
        if touched:
            (self.spark.createDataFrame([(merged,)], "path string").coalesce(1)
                 .write.mode("overwrite").parquet(f"{self.path}/_pending"))
            self._swap()
        drop_path(self.spark, incoming)
        return touched
