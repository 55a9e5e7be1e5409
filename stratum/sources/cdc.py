"""Change-data-capture source: read, route, unwrap, quarantine.

Records look like a message-broker topic: ``topic, partition, offset, key,
value (JSON envelope or NULL tombstone), timestamp``.  The envelope carries
``before``, ``after``, ``op`` (c / u / d / r) and ``ts_ms``.  The same
functions work on a batch DataFrame or a streaming one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (IntegerType, LongType, StringType, StructField, StructType,
                               TimestampType)

RECORD_SCHEMA = StructType([
    StructField("topic", StringType()),
    StructField("partition", IntegerType()),
    StructField("offset", LongType()),
    StructField("key", StringType()),
    StructField("value", StringType()),
    StructField("timestamp", TimestampType()),
])

ALL_OPS = ("c", "u", "d", "r")


def envelope_schema(row: StructType) -> StructType:
    return StructType([
        StructField("before", row),
        StructField("after", row),
        StructField("op", StringType()),
        StructField("ts_ms", LongType()),
        StructField("source", StructType([StructField("table", StringType())])),
    ])


def read_changes(spark: SparkSession, fmt: str, options: dict | None = None,
                 path: str | None = None, streaming: bool = False) -> DataFrame:
    """Open a change feed.  ``fmt="kafka"`` uses the broker source (binary
    key/value cast to text); file formats (``json``/``parquet``) read records
    already in :data:`RECORD_SCHEMA` shape."""
    reader = spark.readStream if streaming else spark.read
    reader = reader.format(fmt).options(**(options or {}))
    if fmt == "kafka":
        raw = reader.load()
        return raw.select("topic", "partition", "offset",
                          F.col("key").cast("string").alias("key"),
                          F.col("value").cast("string").alias("value"),
                          F.col("timestamp"))
    reader = reader.schema(RECORD_SCHEMA)
    return reader.load(path) if path else reader.load()


def table_of(topic_col="topic") -> F.Column:
    """``<prefix>.<schema>.<table>`` -> table."""
    return F.element_at(F.split(F.col(topic_col), r"\."), -1)


def route(changes: DataFrame, tables: Sequence[str]) -> DataFrame:
    """Keep the records of the listed tables (one topic per table)."""
    return changes.withColumn("table", table_of()).where(F.col("table").isin(list(tables)))


def parse(changes: DataFrame, row: StructType, key: Sequence[str] = ("id",)) -> DataFrame:
    """Adds ``env`` (the envelope), ``image`` (the row it carries: ``before`` of
    a delete, else ``after``) and ``bad``: a value that is no envelope, has an
    unknown ``op``, lacks the row image of its op, or whose image has no key.

    The envelope comes out of a generator of one row: filters on it stay above,
    so the optimizer does not copy the parser into each of them.
    """
    deleted = F.col("env.op") == "d"
    env = F.from_json("value", envelope_schema(row))
    p = changes.select("*", F.explode(F.array(env)).alias("env"))
    p = p.withColumn("image", F.when(deleted, F.col("env.before")).otherwise(F.col("env.after")))
    missing = F.lit(False)
    for k in key:
        missing = missing | F.col(f"image.{k}").isNull()
    good = F.col("env.op").isin(list(ALL_OPS)) & F.col("image").isNotNull() & ~missing
    return p.withColumn("bad", F.col("value").isNotNull() & ~F.coalesce(good, F.lit(False)))


def unwrap(changes: DataFrame, row: StructType, ops: Sequence[str] = ALL_OPS,
           drop_tombstones: bool = True, delete_mode: str = "soft",
           key: Sequence[str] = ("id",)) -> DataFrame:
    """Flatten envelopes into table rows.

    * ``after`` for c/u/r, ``before`` for d (which may hold the key alone);
    * tombstones (NULL value) are dropped (``drop_tombstones``);
    * broken records are left out - see :func:`quarantine`;
    * ``delete_mode="soft"`` keeps deletes flagged ``_is_deleted = 1``,
      ``"drop"`` discards them (the sink's behaviour).
    Adds ``op, ts_ms, _offset, _is_deleted, _synced_at``.
    """
    p = parse(changes, row, key)
    if drop_tombstones:
        p = p.where(F.col("value").isNotNull())
    p = p.where(~F.col("bad") & F.col("env.op").isin(list(ops)))
    if delete_mode == "drop":
        p = p.where(F.col("env.op") != "d")
    elif delete_mode != "soft":
        raise ValueError("delete_mode must be 'soft' or 'drop'")
    return p.select(
        F.col("image").alias("r"),
        F.col("env.op").alias("op"),
        F.col("env.ts_ms").alias("ts_ms"),
        F.col("offset").alias("_offset"),
        (F.col("env.op") == "d").cast("int").alias("_is_deleted"),
        F.col("timestamp").cast("timestamp_ntz").alias("_synced_at"),
    ).select("r.*", "op", "ts_ms", "_offset", "_is_deleted", "_synced_at")


def with_version(rows: DataFrame, version: str = "updated_at") -> DataFrame:
    """The version of a change: the row's own stamp, or the time the source
    made the change where the row has none (tables without such a column, and
    deletes that carry the key alone)."""
    made = F.timestamp_millis(F.col("ts_ms"))
    if version not in rows.columns:
        return rows.withColumn(version, made.cast("timestamp_ntz"))
    kind = rows.schema[version].dataType.simpleString()
    return rows.withColumn(version, F.coalesce(F.col(version), made.cast(kind)))


def quarantine(changes: DataFrame, row: StructType, key: Sequence[str] = ("id",)) -> DataFrame:
    """Records that :func:`unwrap` leaves out because they are broken."""
    return parse(changes, row, key).where("bad").drop("env", "image", "bad")
