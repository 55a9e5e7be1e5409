"""Table sources: snapshots, named data sources, catalog listing, golden sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# name -> reader(spark, table) ; "default" reads catalog tables.
_SOURCES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "default": lambda spark, t: spark.table(t),
}


def register_source(name: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    """Add a named data source (e.g. a second database reached over JDBC)."""
    _SOURCES[name] = reader


def jdbc_source(url: str, properties: dict | None = None,
                partition_column: str | None = None, lower: int = 0, upper: int = 0,
                num_partitions: int = 1) -> Callable[[SparkSession, str], DataFrame]:
    """Reader for an OLTP database; a numeric partition column splits the
    snapshot into ``num_partitions`` parallel range queries."""
    def read(spark: SparkSession, table: str) -> DataFrame:
        r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
        for k, v in (properties or {}).items():
            r = r.option(k, v)
        if partition_column:
            r = (r.option("partitionColumn", partition_column).option("lowerBound", lower)
                  .option("upperBound", upper).option("numPartitions", num_partitions))
        return r.load()
    return read


def table(spark: SparkSession, name: str, data_source: str = "default") -> DataFrame:
    """``SELECT * FROM name`` on a named data source (column pruning and
    filters still push down to the scan)."""
    if data_source not in _SOURCES:
        raise KeyError(f"unknown data source {data_source!r}")
    return _SOURCES[data_source](spark, name)


def read_snapshot(spark: SparkSession, location: str, fmt: str = "parquet",
                  options: dict | None = None) -> DataFrame:
    """Full snapshot of an operational table (parquet/ORC/CSV/JSON files, or
    ``fmt="jdbc"`` with ``location`` as the table name and url in options)."""
    r = spark.read.format(fmt).options(**(options or {}))
    if fmt == "jdbc":
        return r.option("dbtable", location).load()
    return r.load(location)


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Tables of a database as a DataFrame (catalog metadata, bounded)."""
    rows = [(t.database or database, t.name, t.tableType, bool(t.isTemporary))
            for t in spark.catalog.listTables(database)]
    return spark.createDataFrame(rows, "database string, name string, table_type string, "
                                       "is_temporary boolean")


GOLDEN_SCHEMA = "query string, expected_sql string"


def read_golden_sets(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Question -> SQL example files; rows lacking either key are dropped.

    ``multi_line=True`` reads files holding one JSON array each; ``False``
    reads JSON lines."""
    df = spark.read.schema(GOLDEN_SCHEMA).option("multiLine", multi_line).json(path)
    return df.where(F.col("query").isNotNull() & F.col("expected_sql").isNotNull())
