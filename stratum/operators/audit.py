"""Tool-access decisions and the audit log report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import args_json
from .joins import bounded_broadcast

# Which role may call which tool.
ROLE_PERMISSIONS = {
    "admin": ("list_dashboards", "get_dashboard_info", "list_datasets"),
    "analyst": ("list_dashboards", "get_dashboard_info"),
}

GRANTED = "GRANTED"
DENIED = "DENIED - RBAC"

AUDIT_SCHEMA = "timestamp timestamp, user_name string, tool_name string, arguments string, status string"


def grants_frame(spark: SparkSession, permissions: dict = ROLE_PERMISSIONS) -> DataFrame:
    rows = [(r, t) for r, tools in permissions.items() for t in tools]
    return spark.createDataFrame(rows, "role string, tool_name string")


def authorize(requests: DataFrame, grants: DataFrame, role: str = "role",
              tool: str = "tool_name", max_grant_rows: int = 1_000_000) -> DataFrame:
    """Add ``status``: GRANTED when (role, tool) is in ``grants``, else DENIED.

    The grant table is deduplicated (so the left join cannot multiply
    requests) and broadcast only after a bounded size check.
    """
    g = grants.select(F.col(role).alias("__role"), F.col(tool).alias("__tool")).distinct() \
              .withColumn("__ok", F.lit(True))
    g = bounded_broadcast(g, max_grant_rows)
    j = requests.join(g, (requests[role] == g["__role"]) & (requests[tool] == g["__tool"]), "left")
    return (j.withColumn("status", F.when(F.col("__ok"), F.lit(GRANTED)).otherwise(F.lit(DENIED)))
             .drop("__role", "__tool", "__ok"))


def audit_rows(decisions: DataFrame, ts: str | None = "timestamp") -> DataFrame:
    """Audit-log shape; the server time stamps rows that arrive without one."""
    stamp = F.coalesce(F.col(ts).cast("timestamp"), F.current_timestamp()) if ts \
        else F.current_timestamp()
    return decisions.select(stamp.alias("timestamp"), "user_name", "tool_name",
                            args_json(decisions, "arguments").alias("arguments"), "status")


def append_audit(decisions: DataFrame, path: str) -> None:
    """Append decisions to the audit log (a DataFrame write, never SQL text)."""
    audit_rows(decisions).write.mode("append").parquet(path)


def audit_recent(log: DataFrame, n: int = 50, ts: str = "timestamp",
                 tiebreak: tuple[str, ...] = ()) -> DataFrame:
    """Newest ``n`` entries: planned as a top-k (TakeOrderedAndProject), no full sort."""
    order = [F.col(ts).desc()] + [F.col(c).desc() for c in tiebreak]
    return log.orderBy(*order).limit(n)


def audit_total(log: DataFrame) -> DataFrame:
    return log.agg(F.count(F.lit(1)).alias("total"))


def audit_by_status(log: DataFrame) -> DataFrame:
    return log.groupBy("status").agg(F.count(F.lit(1)).alias("count"))
