"""Streaming ingestion: bronze sink, streaming latest-version, incremental runs.

``latest_stream`` keeps the newest row per key in streaming state with
``max_by(struct(row), struct(version, tiebreak))`` (update output mode; keys
stay grouping columns so key predicates still push down).  Each micro-batch's
changed keys are appended under ``<path>/_batch_id=<n>``; re-running a batch
after a failure overwrites the same directory, so the sink is idempotent.
Readers resolve the newest batch per key with :func:`read_latest`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.latest import latest_by_key
from ..session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb_state(spark: SparkSession) -> None:
    """Large keyed state (one row per key) belongs off-heap in RocksDB; with
    changelog checkpointing a micro-batch commits only its changes instead of
    snapshotting the whole store.  Changes compress with zstd; a checkpoint from
    before goes on with the codec that its offset log names."""
    for key, value in (
            ("spark.sql.streaming.stateStore.providerClass", ROCKSDB),
            ("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true"),
            ("spark.sql.streaming.stateStore.compression.codec", "zstd")):
        spark.conf.set(key, value)


def latest_stream(stream: DataFrame, keys: Sequence[str], version: str,
                  tiebreak: Sequence[str] = ()) -> DataFrame:
    cols = [c for c in stream.columns if c not in keys]
    order = F.struct(*[F.col(c) for c in [version, *tiebreak]])
    return (stream.groupBy(*keys)
                  .agg(F.max_by(F.struct(*cols), order).alias("__r"))
                  .select(*keys, "__r.*"))


def _batch_writer(path: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.write.mode("overwrite")
              .parquet(f"{path}/_batch_id={batch_id}"))
    return write


def write_versions(stream: DataFrame, path: str, checkpoint: str | None = None,
                   available_now: bool = True, output_mode: str = "update") -> StreamingQuery:
    """Start the stream; every micro-batch lands in its own batch directory."""
    spark = stream.sparkSession
    ckpt = checkpoint or scratch_path(spark, "ckpt")
    w = (stream.writeStream.outputMode(output_mode).foreachBatch(_batch_writer(path))
               .option("checkpointLocation", ckpt))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()


def read_latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Newest emitted row per key across all micro-batch directories."""
    df = spark.read.parquet(path)
    return latest_by_key(df, list(keys), "_batch_id").drop("_batch_id")


def write_bronze(stream: DataFrame, path: str, checkpoint: str | None = None,
                 available_now: bool = True) -> StreamingQuery:
    """Exactly-once append of unwrapped change rows to the bronze log (file sink)."""
    spark = stream.sparkSession
    ckpt = checkpoint or scratch_path(spark, "ckpt-bronze")
    w = (stream.writeStream.format("parquet").outputMode("append")
               .option("path", path).option("checkpointLocation", ckpt))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()


def await_done(q: StreamingQuery, timeout_s: int | None = None) -> None:
    """Wait for a stream that ends by itself.  The time it needs follows its input,
    so there is no limit unless the caller sets one."""
    q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
        raise TimeoutError(f"stream {q.id} did not finish in {timeout_s}s")
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
