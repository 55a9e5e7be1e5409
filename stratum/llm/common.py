"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, shuffles_removed

#: ASCII white space (Java regex) as the digest columns define it.
WS = r"[\x20\x09-\x0D]+"
NOT_WS = r"[^\x20\x09-\x0D]+"


def text_or_empty(name: str = "text") -> Column:
    """A null text counts as the empty one."""
    return F.coalesce(F.col(name), F.lit(""))


def id_order(name: str = "doc_id") -> list[Column]:
    """Sort keys for an id: ascending, null ids last."""
    return [F.col(name).isNull(), F.col(name)]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage: after an executor loss later steps start from these files.  So nothing
    reads the shuffle files of the write again, and they go with it.
    """
    path = scratch_path(df.sparkSession, f"llm-{name}")
    with shuffles_removed(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch that goes to a Python task.
BATCH_BYTES = 4 << 20


def batches_by_bytes(spark: SparkSession, limit: int = BATCH_BYTES) -> None:
    """Bounds the Arrow batches of this session's Python tasks by bytes too (a batch holds a row at least).

    By default they are bounded by 10,000 rows, whatever the texts' lengths are.  A smaller bound
    that the session names stays.  Plans made from now on use it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)))
    if not 0 < size <= limit:
        spark.conf.set(key, str(limit))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
