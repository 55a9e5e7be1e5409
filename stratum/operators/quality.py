"""Data-quality checks and the publish gate.

Every check returns rows ``(table, check, column, failures)`` so results of
different checks union into one report.  Row-level checks (not-null,
accepted values, range) of one table share a scan through ``table_checks``, or
are counted by the table's write through ``ObservedChecks``; ``unique`` needs a
grouping per column (partial aggregation first, so a hot value costs one row
per map task in the shuffle).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

REPORT_SCHEMA = "table string, check string, column string, failures bigint"


class QualityGateError(RuntimeError):
    pass


def _rows(df: DataFrame, table: str, specs: list[tuple[str, str, F.Column]]) -> DataFrame:
    """One aggregation computing every ``count_if`` then unpivoted to rows."""
    agg = df.agg(*[F.count_if(cond).alias(f"c{i}") for i, (_, _, cond) in enumerate(specs)])
    stacked = F.explode(F.array(*[
        F.struct(F.lit(table).alias("table"), F.lit(chk).alias("check"),
                 F.lit(col).alias("column"), F.col(f"c{i}").cast("long").alias("failures"))
        for i, (chk, col, _) in enumerate(specs)]))
    return agg.select(stacked.alias("r")).select("r.*")


def null_spec(col: str):
    return "not_null", col, F.col(col).isNull()


def accepted_spec(col: str, values: Iterable):
    """Non-NULL values outside the accepted list."""
    return "accepted_values", col, F.col(col).isNotNull() & ~F.col(col).isin(list(values))


def range_spec(col: str, lo=None, hi=None):
    cond = F.lit(False)
    if lo is not None:
        cond = cond | (F.col(col) < F.lit(lo))
    if hi is not None:
        cond = cond | (F.col(col) > F.lit(hi))
    return "in_range", col, F.coalesce(cond, F.lit(False))


def table_checks(df: DataFrame, table: str, *specs) -> DataFrame:
    """All row-level checks of one table in one scan and one aggregation."""
    return _rows(df, table, list(specs))


class ObservedChecks:
    """Row-level checks that a table's own write counts: no scan of their own.

    ``attach`` must be the last step before the write.  There the metrics are
    those of the write's final tasks, each counted once however often it ran;
    below an exchange a lost executor's repeated tasks would count again.
    """

    def __init__(self, table: str, *specs):
        self.table, self.specs, self._seen = table, list(specs), Observation()

    def attach(self, df: DataFrame) -> DataFrame:
        return df.observe(self._seen, *[F.count_if(cond).alias(f"c{i}") for i, (_, _, cond) in enumerate(self.specs)])

    def report(self, spark: SparkSession) -> DataFrame:
        """The counts of the finished write (a row per check)."""
        seen = self._seen.get
        return spark.createDataFrame([(self.table, check, column, seen.get(f"c{i}", 0))
                                      for i, (check, column, _) in enumerate(self.specs)], REPORT_SCHEMA)


def not_null(df: DataFrame, cols: Sequence[str], table: str = "table") -> DataFrame:
    return _rows(df, table, [null_spec(c) for c in cols])


def accepted_values(df: DataFrame, col: str, values: Iterable, table: str = "table") -> DataFrame:
    return _rows(df, table, [accepted_spec(col, values)])


def in_range(df: DataFrame, col: str, lo=None, hi=None, table: str = "table") -> DataFrame:
    return _rows(df, table, [range_spec(col, lo, hi)])


def unique(df: DataFrame, cols: Sequence[str], table: str = "table") -> DataFrame:
    """Number of distinct non-NULL values that occur more than once, per column."""
    parts = []
    for c in cols:
        dup = (df.where(F.col(c).isNotNull()).groupBy(c).count().where(F.col("count") > 1)
                 .agg(F.count(F.lit(1)).alias("failures")))
        parts.append(dup.select(F.lit(table).alias("table"), F.lit("unique").alias("check"),
                                F.lit(c).alias("column"), F.col("failures").cast("long")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def references(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None,
               table: str = "table") -> DataFrame:
    """Orphan count: child keys with no parent row (``left_anti`` join)."""
    from .joins import check_references
    orphans = check_references(child, parent, key, parent_key)
    return orphans.agg(F.count(F.lit(1)).cast("long").alias("failures")).select(
        F.lit(table).alias("table"), F.lit("relationships").alias("check"),
        F.lit(key).alias("column"), "failures")


def report(*results: DataFrame) -> DataFrame:
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def gate(results: DataFrame, severity: str = "error",
         severities: dict[tuple[str, ...], str] | None = None) -> DataFrame:
    """Raise when a failed check is at error severity; return the report.

    ``severity`` is the default level of every check; ``severities`` maps
    ``(check, column)``, or ``(table, check, column)`` for one table, to
    ``"warn"`` or ``"error"`` (warn-level failures are reported, not
    blocking).  Levels are applied in the DataFrame, before anything is
    brought to the driver; the message names the first 100 failures and says
    how many there are.
    """
    level = F.lit(severity)
    for key, value in sorted((severities or {}).items(), key=lambda kv: len(kv[0])):
        *table, check, column = key
        cond = (F.col("check") == check) & (F.col("column") == column)
        if table:
            cond = cond & (F.col("table") == table[0])
        level = F.when(cond, value).otherwise(level)
    blocking = results.where((F.col("failures") > 0) & (level == "error"))
    shown = blocking.limit(100).collect()
    if shown:
        detail = ", ".join(f"{r['table']}.{r['column']} {r['check']}={r['failures']}" for r in shown)
        raise QualityGateError(f"quality gate failed, {blocking.count()} checks: {detail}")
    return results
