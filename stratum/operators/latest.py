"""Latest version per key (the "replacing table, read FINAL" semantics).

Batch form: ``row_number() over (partition by keys order by version desc,
tiebreak desc) = 1``.  Catalyst plans this with a *partial* WindowGroupLimit
below the shuffle, so every map task already keeps only its local winner per
key: a key that holds a third of all rows ships at most one row per input
split, and the hash exchange stays balanced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def _order(version: str, tiebreak: Sequence[str]) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in [version, *tiebreak]]


def latest_by_key(df: DataFrame, keys: Sequence[str], version: str,
                  tiebreak: Sequence[str] = ()) -> DataFrame:
    """Keep the newest row per ``keys``; ties on ``version`` go to ``tiebreak``.

    ``tiebreak`` should make the order total (e.g. the arrival offset), so the
    answer does not depend on input order.
    """
    w = Window.partitionBy(*keys).orderBy(*_order(version, tiebreak))
    return (df.withColumn("__rn", F.row_number().over(w))
              .where(F.col("__rn") == 1)
              .drop("__rn"))


def live(df: DataFrame, deleted_col: str = "_is_deleted") -> DataFrame:
    """Soft-delete filter.  Apply *after* ``latest_by_key``: filtering first
    would resurrect the version preceding a delete."""
    return df.where(F.col(deleted_col) == 0)


def compact(df: DataFrame, keys: Sequence[str], version: str,
            tiebreak: Sequence[str] = (), path: str | None = None,
            partition_by: Sequence[str] = ()) -> str:
    """Rewrite a version log keeping only the newest row per key.

    Writes to a fresh staging path in the shared folder and returns it; the
    caller swaps its table pointer to the new path (plain parquet has no
    MERGE, and a key may span several partitions, so per-partition in-place
    rewrites would be wrong).
    """
    out = path or scratch_path(df.sparkSession, "compact")
    latest = latest_by_key(df, keys, version, tiebreak)
    # Files clustered by key (parquet min/max on the key prunes point
    # lookups); partitioned writes are rebalanced so a hot partition value is
    # split over several writers.
    if partition_by:
        latest = latest.hint("rebalance", *partition_by)
    latest = latest.sortWithinPartitions(*partition_by, *keys)
    w = latest.write.mode("overwrite").option("partitionOverwriteMode", "static")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(out)
    return out
