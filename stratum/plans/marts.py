"""Gold models: the sales fact table and the product dimension.

Join strategy: the fact side (orders) is the big input; products and users
are dimensions keyed uniquely after ``latest_by_key``, so the left joins never
fan out.  Catalyst broadcasts a dimension only when its estimated size is
under ``spark.sql.autoBroadcastJoinThreshold``; otherwise it plans a
sort-merge join and AQE re-checks the measured shuffle size at runtime
(converting to broadcast, or splitting a hot product/user partition with
skew-join handling).  ``broadcast_rows`` forces a broadcast only after an
explicit, bounded row-count check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators.joins import bounded_broadcast, fill_unmatched
from ..operators.latest import latest_by_key

FCT_SALES_ORDER = ("order_date", "category", "country")


def build_fct_sales(orders: DataFrame, products: DataFrame, users: DataFrame,
                    unmatched: str = "null", include_load_ts: bool = True,
                    broadcast_rows: int | None = None) -> DataFrame:
    """stg_orders LEFT JOIN stg_products LEFT JOIN stg_users, valid status only.

    ``unmatched="null"`` keeps SQL-standard NULLs for orphan rows;
    ``"default"`` fills type defaults ('' / 0) the way a warehouse with
    non-nullable columns does, so an orphan's margin is its full amount.
    """
    o = orders.where(F.col("order_status") != "unknown")
    p = products.select("product_id", "product_name", "category",
                        F.col("price_usd").alias("unit_price_usd"))
    u = users.select("user_id", "user_name", "email", "country", "signup_date")
    if broadcast_rows is not None:
        p = bounded_broadcast(p, broadcast_rows)
        u = bounded_broadcast(u, broadcast_rows)
    j = o.join(p, "product_id", "left").join(u, "user_id", "left")
    if unmatched == "default":
        j = fill_unmatched(j, ["product_name", "category", "unit_price_usd",
                               "user_name", "email", "country", "signup_date"])
    elif unmatched != "null":
        raise ValueError("unmatched must be 'null' or 'default'")
    cols = [
        "order_id", "user_id", "product_id", "product_name", "category", "unit_price_usd",
        "user_name", "email", "country", "signup_date", "order_status", "amount_usd",
        (F.col("amount_usd") - F.col("unit_price_usd")).alias("gross_margin_usd"),
        "order_date", "order_month", "order_year", "order_week_start",
        S.iso_weekday("order_date").alias("day_of_week"),
        S.day_of_month("order_date").alias("day_of_month"),
        S.flag("order_status", "completed").alias("is_completed"),
        S.flag("order_status", "cancelled").alias("is_cancelled"),
        F.col("replicated_at").alias("data_replicated_at"),
    ]
    if include_load_ts:
        cols.append(S.now_ts().alias("loaded_at"))
    return j.select(*cols)


def build_dim_products(products_bronze: DataFrame, version: str = "updated_at",
                       tiebreak=()) -> DataFrame:
    """Latest product row per id (dimension table shape)."""
    latest = latest_by_key(products_bronze, ["id"], version, tiebreak)
    return latest.where(F.col("_is_deleted") == 0).select(
        F.col("id").alias("product_id"),
        S.clean("name").alias("name"),
        S.clean("category").alias("category"),
        S.to_money("price", 10, 2).alias("price"),
        F.col(version).alias("updated_at"),
    )
