"""Silver models: latest version -> soft-delete filter -> clean + type.

Each model is a function DataFrame -> DataFrame; nothing is materialised, so
Catalyst sees through the model into the bronze scan (column pruning, key
predicate pushdown below the top-1 window).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators.latest import latest_by_key, live

# The accepted order statuses (anything else -> 'unknown').
ORDER_STATUSES = ("completed", "cancelled", "pending", "refunded")


def stg_orders(bronze: DataFrame, keys=("id",), version: str = "updated_at",
               tiebreak=(), tz: str | None = None) -> DataFrame:
    latest = live(latest_by_key(bronze, list(keys), version, tiebreak))
    od = S.to_business_date("order_date", tz)
    return (latest
            .where((F.col("amount") > 0) & F.col("order_date").isNotNull())
            .select(
                F.col("id").alias("order_id"),
                "user_id",
                "product_id",
                S.normalize_category("status", ORDER_STATUSES).alias("order_status"),
                S.to_money("amount").alias("amount_usd"),
                od.alias("order_date"),
                S.month_start(od).alias("order_month"),
                S.year_of(od).alias("order_year"),
                S.week_start(od).alias("order_week_start"),
                F.col(version).alias("source_updated_at"),
                F.col("_synced_at").alias("replicated_at"),
            ))


def stg_products(bronze: DataFrame, version: str = "updated_at", tiebreak=()) -> DataFrame:
    latest = live(latest_by_key(bronze, ["id"], version, tiebreak))
    return latest.select(
        F.col("id").alias("product_id"),
        S.clean("name").alias("product_name"),
        S.clean("category").alias("category"),
        S.to_money("price").alias("price_usd"),
        F.col(version).alias("source_updated_at"),
        F.col("_synced_at").alias("replicated_at"),
    )


def stg_users(bronze: DataFrame, version: str = "updated_at", tiebreak=(),
              tz: str | None = None) -> DataFrame:
    latest = live(latest_by_key(bronze, ["id"], version, tiebreak))
    signup = S.to_business_date("created_at", tz)
    return (latest
            .where(F.col("email") != "")
            .select(
                F.col("id").alias("user_id"),
                S.clean("name").alias("user_name"),
                S.clean_lower("email").alias("email"),
                S.clean("country").alias("country"),
                signup.alias("signup_date"),
                S.month_start(signup).alias("signup_month"),
                S.year_of(signup).alias("signup_year"),
                F.col(version).alias("source_updated_at"),
                F.col("_synced_at").alias("replicated_at"),
            ))


def stg_support_tickets(bronze: DataFrame, version: str = "updated_at", tiebreak=()) -> DataFrame:
    """Tickets have no silver model upstream: ingest + latest version only."""
    return live(latest_by_key(bronze, ["id"], version, tiebreak))
