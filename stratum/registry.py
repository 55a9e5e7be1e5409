"""Named queries: one per operator of the inventory.

Each entry is ``fn(spark, sf_dir) -> DataFrame`` and reads the shared test
tables through :mod:`stratum.fixtures`.  Output decimals are cast to DOUBLE
(exact for 2-digit values) so the independent SQL check compares numbers,
not decimal renderings.  ``stratum.oracle`` holds the matching SQL.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from . import fixtures as fx
from .plans import marts, semantic, staging
from .plans.rollup import Rollup, build_rollup, match_rollup, rollup_frame
from .plans.rollup_choice import Question, choose_rollups
from .plans.semantic import ORDERS, PRODUCTS, query
from .operators.latest import latest_by_key
from .operators.series import staged
from .streaming.rates import rate_grid

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    """Add ``fn`` under ``name``.  Queries compare zone-less wall-clock values
    and connector micros, so the session zone is pinned to UTC first."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
                spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        REGISTRY[name] = run
        return fn
    return deco


def as_double(df: DataFrame) -> DataFrame:
    """Cast every decimal output column to double."""
    return df.select(*[F.col(f.name).cast("double").alias(f.name)
                       if isinstance(f.dataType, DecimalType) else F.col(f.name)
                       for f in df.schema.fields])


# ----------------------------------------------------------- shared models
def silver(spark: SparkSession, d: str):
    o = staging.stg_orders(fx.bronze_orders(spark, d), tiebreak=fx.ORDER_TIEBREAK)
    p = staging.stg_products(fx.bronze_products(spark, d))
    u = staging.stg_users(fx.bronze_users(spark, d))
    return o, p, u


def fct_sales(spark: SparkSession, d: str, include_load_ts: bool = False,
              unmatched: str = "null", products=None) -> DataFrame:
    o, p, u = silver(spark, d)
    return marts.build_fct_sales(o, products if products is not None else p, u,
                                 unmatched=unmatched, include_load_ts=include_load_ts)


# ------------------------------------------------------------------ step 1
@register("latest_by_key")
def q_latest_by_key(spark, d):
    return latest_by_key(fx.bronze_orders(spark, d), ["id"], "updated_at", fx.ORDER_TIEBREAK)


@register("latest_composite_key")
def q_latest_composite_key(spark, d):
    return latest_by_key(fx.bronze_orders(spark, d), ["id", "order_date"], "updated_at",
                         fx.ORDER_TIEBREAK)


@register("stg_orders")
def q_stg_orders(spark, d):
    return as_double(silver(spark, d)[0])


@register("stg_products")
def q_stg_products(spark, d):
    return as_double(silver(spark, d)[1])


@register("stg_users")
def q_stg_users(spark, d):
    return as_double(silver(spark, d)[2])


@register("fct_sales")
def q_fct_sales(spark, d):
    return as_double(fct_sales(spark, d))


@register("dim_products")
def q_dim_products(spark, d):
    return as_double(marts.build_dim_products(fx.bronze_products(spark, d)))


@register("join_default_fill")
def q_join_default_fill(spark, d):
    p = staging.stg_products(fx.bronze_products_with_gaps(spark, d))
    return as_double(fct_sales(spark, d, unmatched="default", products=p))


# ------------------------------------------------------------------ step 2
@register("orders_by_status")
def q_orders_by_status(spark, d):
    return as_double(query(fct_sales(spark, d), ORDERS, ["count", "totalAmount"], ["status"]))


@register("sales_by_category_month")
def q_sales_by_category_month(spark, d):
    return as_double(query(fct_sales(spark, d), ORDERS,
                           ["count", "totalAmount", "avgOrderValue", "grossMargin"],
                           ["category"], ("orderDate", "month")))


@register("sales_by_country_week")
def q_sales_by_country_week(spark, d):
    return as_double(query(fct_sales(spark, d), ORDERS, ["count", "totalAmount"],
                           ["country"], ("orderDate", "week")))


@register("avg_price_by_category")
def q_avg_price_by_category(spark, d):
    return as_double(query(silver(spark, d)[1], PRODUCTS, ["count", "avgPrice"], ["category"]))


@register("margin_ratio_having")
def q_margin_ratio_having(spark, d):
    return as_double(query(fct_sales(spark, d), ORDERS, ["totalAmount", "marginRatio"],
                           ["category", "status"],
                           filters=[("marginRatio", "gt", [0.982])]))


@register("top_product")
def q_top_product(spark, d):
    return as_double(query(fct_sales(spark, d), ORDERS, ["totalAmount"], ["productId"],
                           order=[("totalAmount", "desc"), ("productId", "asc")], limit=1))


@register("drill_orders")
def q_drill_orders(spark, d):
    return semantic.drill(fct_sales(spark, d), ORDERS, "count",
                          filters=[("status", "equals", ["completed"]),
                                   ("country", "equals", ["NATION_7"])], limit=100)


@register("rls_orders")
def q_rls_orders(spark, d):
    policy = fx.rls_policy(spark, d)
    return as_double(query(fct_sales(spark, d), ORDERS, ["count", "totalAmount"], ["country"],
                           rls=(policy, "EUROPE", "country")))


@register("rls_drill")
def q_rls_drill(spark, d):
    """The rows behind a protected number, as the principal may see them."""
    return semantic.drill(fct_sales(spark, d), ORDERS, "count", filters=[("status", "equals", ["completed"])],
                          rls=(fx.rls_policy(spark, d), "ASIA", "country", "country"))


@register("rls_sql_view")
def q_rls_sql_view(spark, d):
    """SQL on the principal's own view of the cube."""
    semantic.register_cube(fct_sales(spark, d), ORDERS, rls=(fx.rls_policy(spark, d), "AFRICA", "country"),
                           name="Orders_africa")
    return semantic.sql(spark, "SELECT country, count(*) AS n, CAST(sum(totalAmount) AS DOUBLE) AS total "
                               "FROM Orders_africa GROUP BY country")


@register("param_sql")
def q_param_sql(spark, d):
    semantic.register_cube(fct_sales(spark, d), ORDERS)
    text = ("SELECT status, count(*) AS n, CAST(sum(totalAmount) AS DOUBLE) AS total "
            "FROM Orders WHERE country = :country AND orderDate >= :since GROUP BY status")
    return semantic.sql(spark, text, {"country": "NATION_3", "since": datetime.date(1998, 1, 1)})


# ------------------------------------------------------------------ step 3
DAY_CATEGORY = Rollup("day_category",
                      measures=("count", "totalAmount", "avgOrderValue", "grossMargin",
                                "marginRatio"),
                      dimensions=("category", "status"),
                      time_dimension="orderDate", granularity="day")


@register("rollup_day_category")
def q_rollup_day_category(spark, d):
    return as_double(rollup_frame(fct_sales(spark, d), ORDERS, DAY_CATEGORY))


@register("rollup_answer_month")
def q_rollup_answer_month(spark, d):
    fct = fct_sales(spark, d)
    table = build_rollup(fct, ORDERS, DAY_CATEGORY)
    return as_double(query(fct, ORDERS, ["count", "totalAmount", "avgOrderValue", "marginRatio"],
                           ["category"], ("orderDate", "month"), rollups=[table]))


# a log of questions on sales: (name, question)
SALES_LOG = [("by category and month", Question(("count", "totalAmount"), ("category",), ("orderDate", "month"), asked=30)),
             ("by category", Question(("totalAmount",), ("category",), asked=10)),
             ("by status and day", Question(("count",), ("status",), ("orderDate", "day"), asked=5)),
             ("by country and year", Question(("avgOrderValue",), ("country",), ("orderDate", "year"), asked=2))]


def _staged_facts(spark, d, *columns: str) -> DataFrame:
    """The named columns of the facts, computed once for several rollups of them."""
    return staged(fct_sales(spark, d).select(*columns))


@register("rollup_choice")
def q_rollup_choice(spark, d):
    """Of three rollups, the one that answers each question of a log, with its rows."""
    fct = _staged_facts(spark, d, "category", "order_status", "order_date", "amount_usd")
    kept = ("count", "totalAmount", "avgOrderValue")
    tables = [build_rollup(fct, ORDERS, Rollup(n, kept, dims, "orderDate", g)) for n, dims, g in
              (("wide", ("category", "status"), "day"), ("narrow", ("category",), "month"), ("states", ("status",), "day"))]
    found = [(name, match_rollup(tables, ORDERS, q.measures, q.dimensions, q.time_dimension, [])) for name, q in SALES_LOG]
    return spark.createDataFrame([(n, t and t.spec.name, t and t.row_count()) for n, t in found],
                                 "question string, rollup string, rollup_rows long")


@register("rollup_selection")
def q_rollup_selection(spark, d):
    """The two rollups that save the log most rows, as the greedy rule takes them."""
    chosen = choose_rollups(fct_sales(spark, d), ORDERS, [q for _, q in SALES_LOG], 2)
    return spark.createDataFrame([(i, c.rollup.name, c.rows, c.saved) for i, c in enumerate(chosen, 1)],
                                 "step int, rollup string, rollup_rows long, saved_rows long")


@register("rollup_other_cube_ignored")
def q_rollup_other_cube_ignored(spark, d):
    """A rollup of another cube with members of the same names never answers."""
    fct, users = fct_sales(spark, d), silver(spark, d)[2]
    other = build_rollup(users, semantic.USERS, Rollup("by_country", ("count",), ("country",)))
    return query(fct, ORDERS, ["count"], ["country"], rollups=[other])


@register("rollup_empty_count")
def q_rollup_empty_count(spark, d):
    """No row matches and nothing is grouped: a count of 0, as from the facts."""
    fct = fct_sales(spark, d)
    table = build_rollup(fct, ORDERS, DAY_CATEGORY)
    return as_double(query(fct, ORDERS, ["count", "totalAmount"], filters=[("category", "equals", ["no such"])],
                           rollups=[table]))


# a cube with a conditional count, for E5
STATUS_COUNTS = semantic.Cube(
    name="OrderStatus", source="fct_sales",
    measures={"count": semantic.Measure("count"),
              "completed": semantic.Measure("count_if", "is_completed = 1"),
              "large": semantic.Measure("count_if", "amount_usd > 50000")},
    dimensions={"country": semantic.Dimension("country"), "orderDate": semantic.Dimension("order_date", "time")})


@register("count_if_measure")
def q_count_if_measure(spark, d):
    return query(fct_sales(spark, d), STATUS_COUNTS, ["count", "completed", "large"], ["country"], ("orderDate", "quarter"))


# ------------------------------------------------------------------ step 4
from .operators import quality as Q  # noqa: E402


@register("check_not_null")
def q_check_not_null(spark, d):
    return Q.report(
        Q.not_null(fx.bronze_orders(spark, d), ["id", "amount"], "orders"),
        Q.not_null(fx.bronze_products(spark, d), ["id", "price"], "products"),
        Q.not_null(fx.bronze_users(spark, d), ["id", "email"], "users"))


@register("check_unique")
def q_check_unique(spark, d):
    o, p, u = silver(spark, d)
    return Q.report(
        Q.unique(fx.bronze_orders(spark, d), ["id"], "bronze_orders"),
        Q.unique(o, ["order_id"], "stg_orders"),
        Q.unique(p, ["product_id"], "stg_products"),
        Q.unique(u, ["user_id"], "stg_users"))


@register("check_references")
def q_check_references(spark, d):
    from .operators.joins import check_references
    o = silver(spark, d)[0]
    parents = staging.stg_products(fx.bronze_products_with_gaps(spark, d))
    return check_references(o.select("order_id", "product_id"), parents, "product_id")


@register("check_accepted")
def q_check_accepted(spark, d):
    o = silver(spark, d)[0]
    return Q.accepted_values(o, "order_status", staging.ORDER_STATUSES, "stg_orders")


@register("check_range")
def q_check_range(spark, d):
    o = silver(spark, d)[0]
    return Q.in_range(o, "order_date", datetime.date(1995, 1, 1), datetime.date(2000, 12, 31),
                      "stg_orders")


@register("quality_report")
def q_quality_report(spark, d):
    """Silver orders are staged once; the row-level checks of a table share one scan."""
    o, p, u = silver(spark, d)
    o = MZ.materialize_table(o, scratch_path(spark, "checked-orders"))
    parents = staging.stg_products(fx.bronze_products_with_gaps(spark, d))
    return Q.report(
        Q.table_checks(o, "stg_orders", Q.null_spec("order_id"), Q.null_spec("amount_usd"),
                       Q.accepted_spec("order_status", staging.ORDER_STATUSES),
                       Q.range_spec("order_date", datetime.date(1995, 1, 1), datetime.date(2000, 12, 31))),
        Q.unique(o, ["order_id"], "stg_orders"),
        Q.references(o, parents, "product_id", table="stg_orders"),
        Q.table_checks(u, "stg_users", Q.null_spec("email")))


# ------------------------------------------------------------------ step 5
from .sources import cdc  # noqa: E402
from .streaming import latest_stream as LS  # noqa: E402
from .session import drop_path, many_writers, move_path, path_exists, scratch_path, shuffles_removed, variants_whole  # noqa: E402

CDC_COLS = ["id", "user_id", "product_id", "supp_key", "status", "amount", "quantity",
            "discount", "tax", "order_date", "updated_at", "op", "ts_ms", "_offset",
            "_is_deleted", "_synced_at"]


def unwrapped_orders(changes: DataFrame) -> DataFrame:
    routed = cdc.route(changes, ["orders"])
    rows = fx.typed_orders(cdc.unwrap(routed, fx.order_row_schema()))
    return cdc.with_version(rows).select(*CDC_COLS)


@register("cdc_unwrap")
def q_cdc_unwrap(spark, d):
    return unwrapped_orders(fx.change_log(spark, d))


@register("cdc_quarantine")
def q_cdc_quarantine(spark, d):
    return cdc.quarantine(fx.change_log(spark, d), fx.order_row_schema()).select(
        "topic", "key", "value")


@register("cdc_soft_delete_latest")
def q_cdc_soft_delete_latest(spark, d):
    rows = unwrapped_orders(fx.change_log(spark, d))
    return latest_by_key(rows, ["id"], "updated_at", ["_offset"]).where("_is_deleted = 0")


@register("cdc_drop_deletes")
def q_cdc_drop_deletes(spark, d):
    routed = cdc.route(fx.change_log(spark, d), ["orders"])
    rows = cdc.with_version(fx.typed_orders(cdc.unwrap(routed, fx.order_row_schema(), delete_mode="drop")))
    return rows.select(*CDC_COLS)


@register("decode_envelope_values")
def q_decode_envelope_values(spark, d):
    return unwrapped_orders(fx.change_log(spark, d)).select(
        "id", "_offset", "amount", "order_date", "updated_at", "ts_ms")


@register("cdc_key_only_delete")
def q_cdc_key_only_delete(spark, d):
    """Deletes that name the key alone win by the source's change time."""
    rows = unwrapped_orders(fx.change_log_key_only_deletes(spark, d))
    return latest_by_key(rows, ["id"], "updated_at", ["_offset"]).where("_is_deleted = 0")


@register("cdc_bad_field_quarantine")
def q_cdc_bad_field_quarantine(spark, d):
    log = fx.change_log_with_broken_fields(spark, d)
    return cdc.quarantine(cdc.route(log, ["orders"]), fx.order_row_schema()).select("topic", "key", "value")


def _drifting_bronze(spark, d) -> DataFrame:
    from .sources import drift
    log = drift.variant_bronze(fx.change_log_drifting(spark, d))
    with variants_whole(spark), shuffles_removed(spark):
        return MZ.materialize_table(log, scratch_path(spark, "variant-bronze"))


@register("cdc_variant_rows")
def q_cdc_variant_rows(spark, d):
    """Rows of a drifting source: known fields typed, unknown ones kept as JSON."""
    from .sources import drift
    return drift.conform(_drifting_bronze(spark, d), fx.order_row_schema()).select(
        "id", "user_id", "product_id", "status", "quantity", "discount", "tax", "op", "_offset", "rest", "retyped")


@register("cdc_drift_report")
def q_cdc_drift_report(spark, d):
    from .sources import drift
    return drift.drift_report(_drifting_bronze(spark, d), fx.order_row_schema())


@register("cdc_products_latest")
def q_cdc_products_latest(spark, d):
    """A table without updated_at: the source's change time is the version."""
    from .functions.envelope import decode_decimal
    log = cdc.route(fx.products_change_log(spark, d), ["products"])
    rows = cdc.with_version(cdc.unwrap(log, fx.row_schema(fx.ROW_SCHEMAS["products"])))
    latest = latest_by_key(rows, ["id"], "updated_at", ["_offset"]).where("_is_deleted = 0")
    return latest.select("id", "name", "category", decode_decimal("price", 2, 10).cast("double").alias("price"),
                         "updated_at", "op")


def _users_rows(changes: DataFrame) -> DataFrame:
    from .functions.envelope import decode_micros
    rows = cdc.with_version(cdc.unwrap(cdc.route(changes, ["users"]), fx.row_schema(fx.ROW_SCHEMAS["users"])))
    return rows.withColumn("created_at", decode_micros("created_at"))


@register("cdc_users_latest")
def q_cdc_users_latest(spark, d):
    rows = latest_by_key(_users_rows(fx.users_change_log(spark, d)), ["id"], "updated_at", ["_offset"])
    return rows.where("_is_deleted = 0").select("id", "name", "email", "country", "created_at", "updated_at", "op")


CHANGE_FILES = 4


def _land(changes: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Append change records to a landing folder as compressed JSON files of bounded rows."""
    (changes.write.mode("append").option("maxRecordsPerFile", 1_000_000).option("compression", "gzip")
     .partitionBy(*by).json(path))


def _stream_change_files(spark, d) -> str:
    """Change records dealt out over files of a bounded size, by key and arrival number:
    versions of one key land in different micro-batches in arbitrary order (the streaming
    latest state must not depend on arrival order).  A task keeps a file open for each of
    the micro-batches, so dealing takes no shuffle and no sort; the files' names and times
    then put those of one micro-batch beside each other."""
    from .session import child_names, set_file_times
    spool, path = scratch_path(spark, "spool"), scratch_path(spark, "changes")
    slot = F.pmod(F.hash("key") + F.coalesce("offset", F.lit(0)), F.lit(CHANGE_FILES))
    with many_writers(spark, CHANGE_FILES), shuffles_removed(spark):
        _land(fx.change_log(spark, d).withColumn("slot", slot.cast("int")), spool, ("slot",))
    names = []
    for n in range(CHANGE_FILES):
        for c in child_names(spark, f"{spool}/slot={n}"):
            if c.startswith("part-"):
                names.append(f"{path}/part-{n}-{c.removeprefix('part-')}")
                move_path(spark, f"{spool}/slot={n}/{c}", names[-1])
    drop_path(spark, spool)
    set_file_times(spark, names)
    return path


def _files_per_batch(spark, path: str, batches: int = CHANGE_FILES) -> str:
    """``maxFilesPerTrigger`` that reads the folder in about ``batches`` micro-batches."""
    from .session import child_names
    return str(max(1, -(-sum(c.startswith("part-") for c in child_names(spark, path)) // batches)))


@register("stream_latest")
def q_stream_latest(spark, d):
    """Change files -> streaming unwrap -> keyed latest state -> batch dirs."""
    LS.use_rocksdb_state(spark)
    out, ckpt = scratch_path(spark, "stream-latest"), scratch_path(spark, "ckpt")
    with shuffles_removed(spark):
        src = _stream_change_files(spark, d)
        stream = cdc.read_changes(spark, "json", {"maxFilesPerTrigger": _files_per_batch(spark, src)}, path=src,
                                  streaming=True)
        rows = unwrapped_orders(stream)
        LS.await_done(LS.write_versions(LS.latest_stream(rows, ["id"], "updated_at", ["_offset"]), out, ckpt))
    for done in (src, ckpt):
        drop_path(spark, done)
    return LS.read_latest(spark, out, ["id"]).where("_is_deleted = 0").select(*CDC_COLS)


@register("stream_bronze_sink")
def q_stream_bronze_sink(spark, d):
    """Exactly-once file sink of unwrapped changes (the bronze log)."""
    src = _stream_change_files(spark, d)
    stream = cdc.read_changes(spark, "json", {"maxFilesPerTrigger": _files_per_batch(spark, src)}, path=src,
                              streaming=True)
    out = scratch_path(spark, "bronze")
    LS.await_done(LS.write_bronze(unwrapped_orders(stream), out))
    return spark.read.parquet(out).select(*CDC_COLS)


# ------------------------------------------------------------------ step 6
from .operators import monitor as M  # noqa: E402

SERIES = ["metric", "series_id"]
FIXED_NOW = datetime.datetime(2002, 1, 1)


@register("counter_rate")
def q_counter_rate(spark, d):
    r = M.counter_rate(fx.metric_samples(spark, d), SERIES, 300, tiebreak=["event_id"])
    return r.select("ts", "metric", "series_id", "event_id",
                    F.col("value").cast("double").alias("value"),
                    F.col("delta").cast("double").alias("delta"),
                    F.col("increase").cast("double").alias("increase"),
                    (F.col("increase").cast("double") / F.lit(300.0)).alias("rate"))


@register("alert_intervals")
def q_alert_intervals(spark, d):
    g = fx.gauge_samples(spark, d)
    return M.alert_intervals(g, ["series_id"], F.col("value") > 30, 60,
                             tiebreak=["event_id"]).select(
        "series_id", "start_ts", "end_ts", "n_samples", "duration_s", "fired_at")


@register("resample_grid")
def q_resample_grid(spark, d):
    return M.resample(fx.gauge_samples(spark, d), SERIES, step_s=15, lookback_s=300,
                      tiebreak=["event_id"])


@register("last_not_null")
def q_last_not_null(spark, d):
    return M.last_not_null(fx.gauge_samples(spark, d), SERIES, tiebreak=["event_id"])


@register("threshold_step")
def q_threshold_step(spark, d):
    e = fx.read(spark, d, "events")
    return e.select("event_id", "value",
                    M.threshold_step("value", [(None, "green"), (100, "yellow"), (300, "red")])
                    .alias("colour"))


@register("label_match")
def q_label_match(spark, d):
    g = fx.gauge_samples(spark, d)
    m = M.match_labels(g, {"user": ("=~", "1[0-9]"), "image": ("=", "")})
    return m.select("event_id", "metric", F.element_at("labels", "user").alias("user"))


@register("time_range")
def q_time_range(spark, d):
    g = fx.gauge_samples(spark, d)
    return M.time_range(g, "ts", 6 * 3600, now=datetime.datetime(2024, 1, 15, 12, 0)).select(
        "event_id", "ts", "metric", "value")


@register("replication_lag")
def q_replication_lag(spark, d):
    parts = [fx.bronze_orders(spark, d).select(F.lit("orders").alias("table"), "_synced_at"),
             fx.bronze_products(spark, d).select(F.lit("products").alias("table"), "_synced_at"),
             fx.bronze_users(spark, d).select(F.lit("users").alias("table"), "_synced_at")]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return M.replication_lag(u, ["table"], now=FIXED_NOW)


@register("rate_limit")
def q_rate_limit(spark, d):
    e = fx.read(spark, d, "events")
    return M.rate_limit_violations(e, ["user_id"], limit=2, window="1 hour")


def _landing_in_time_order(df: DataFrame, ts: str, slices: int, *tiebreak: str) -> str:
    """Write ``df`` to a landing folder as ``slices`` files in event-time order,
    the way a live feed arrives (the file source reads oldest first).

    Slices hold about equally many rows, so a burst is spread over several;
    rows of one time stay together unless ``tiebreak`` orders them.  All slices
    are written at once; the files' times then say their order."""
    from .session import child_names, set_file_times
    spark = df.sparkSession
    path = scratch_path(spark, "landing")
    samples = scratch_path(spark, "samples")
    df = staged(df, samples)     # counted, sampled for its ranges and dealt, computed once
    df.where(F.col(ts).isNull()).coalesce(1).write.mode("append").parquet(path)  # no time: first
    untimed = {c for c in child_names(spark, path) if c.startswith("part-")}
    timed = df.where(F.col(ts).isNotNull())
    rows = timed.count()
    if not rows:
        drop_path(spark, samples)
        return path
    # a slice is one file of one writer, so the number of slices grows with the rows
    slices = max(slices, -(-rows // 1_000_000))
    timed.repartitionByRange(slices, ts, *tiebreak).write.mode("append").parquet(path)
    drop_path(spark, samples)
    names = [c for c in child_names(spark, path) if c.startswith("part-")]
    names.sort(key=lambda c: (c not in untimed, int(c.split("-")[1])))
    set_file_times(spark, [f"{path}/{c}" for c in names])
    return path


def _landing_batches(spark, landing: str) -> tuple[int, str]:
    """Micro-batches in which a landing folder is read, and ``maxFilesPerTrigger``:
    a file each, or in a large folder its next files in time order."""
    from .session import child_names
    files = sum(c.startswith("part-") for c in child_names(spark, landing))
    per_batch = max(1, -(-files // LANDING_BATCHES))
    return -(-files // per_batch), str(per_batch)


def _landing_stream(spark, landing: str, schema) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", _landing_batches(spark, landing)[1])
            .parquet(landing))


LANDING_BATCHES = 16


@register("rate_limit_stream")
def q_rate_limit_stream(spark, d):
    """Same check on the event stream: watermark bounds the window state;
    update mode emits every changed window, the newest emission per window wins."""
    events = fx.read(spark, d, "events")
    landing = _landing_in_time_order(events, "ts", 4, "event_id")
    src = _landing_stream(spark, landing, events.schema)
    src = src.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "2 hours")
    counts = (src.groupBy("user_id", F.window("ts", "1 hour").alias("w"))
                 .agg(F.count(F.lit(1)).alias("requests"))
                 .select("user_id", F.col("w.start").alias("window_start"),
                         F.col("w.end").alias("window_end"), "requests"))
    out = scratch_path(spark, "rate-limit")
    LS.use_rocksdb_state(spark)
    LS.await_done(LS.write_versions(counts, out))
    latest = latest_by_key(spark.read.parquet(out), ["user_id", "window_start"], "_batch_id")
    return (latest.where(F.col("requests") > 2)
                  .select("user_id",
                          F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                          F.col("window_end").cast("timestamp_ntz").alias("window_end"),
                          "requests"))


# ------------------------------------------------------------------ step 7
from .operators import audit as AU  # noqa: E402
from .operators import forecast as FC  # noqa: E402
from .operators.retrieval import nearest_examples  # noqa: E402
from .sources import tables as T  # noqa: E402


def _decisions(spark, d):
    return AU.authorize(fx.audit_requests(spark, d), AU.grants_frame(spark))


@register("authorize")
def q_authorize(spark, d):
    return _decisions(spark, d).select("request_id", "user_name", "role", "tool_name", "status")


def _audit_log(spark, d):
    return AU.audit_rows(_decisions(spark, d)).withColumn(
        "timestamp", F.col("timestamp").cast("timestamp_ntz"))


@register("audit_recent")
def q_audit_recent(spark, d):
    return AU.audit_recent(_audit_log(spark, d), 50, tiebreak=("user_name", "tool_name"))


@register("audit_total")
def q_audit_total(spark, d):
    return AU.audit_total(_audit_log(spark, d))


@register("audit_by_status")
def q_audit_by_status(spark, d):
    return AU.audit_by_status(_audit_log(spark, d))


@register("audit_append")
def q_audit_append(spark, d):
    """Decisions appended in two writes to one log, read back whole."""
    path = scratch_path(spark, "audit-log")
    dec = _decisions(spark, d)
    AU.append_audit(dec.where(F.col("request_id") % 2 == 0), path)
    AU.append_audit(dec.where(F.col("request_id") % 2 == 1), path)
    return spark.read.parquet(path).withColumn(
        "timestamp", F.col("timestamp").cast("timestamp_ntz"))


def _fit_out(df: DataFrame) -> DataFrame:
    """Coefficients to 6 digits (half-even), as the check compares them."""
    return df.withColumns({"slope": FC.round_half_even(F.col("slope"), 6),
                           "intercept": FC.round_half_even(F.col("intercept"), 6)})


@register("forecast_next")
def q_forecast_next(spark, d):
    return _fit_out(FC.forecast_next(fx.monthly_history(spark, d), "historico_mes",
                                     "ventas_reales"))


@register("forecast_by_segment")
def q_forecast_by_segment(spark, d):
    return _fit_out(FC.forecast_next(fx.monthly_history_by_segment(spark, d), "historico_mes",
                                     "ventas_reales", groups=["segment"]))


@register("forecast_table")
def q_forecast_table(spark, d):
    fc = FC.forecast_next(fx.monthly_history(spark, d), "historico_mes", "ventas_reales")
    return FC.prediction_table(fc, run_date=datetime.date(2024, 1, 31))


@register("golden_sets")
def q_golden_sets(spark, d):
    """Pairs written as JSON lines (plus rows missing a key), read back."""
    path = scratch_path(spark, "golden")
    c = fx.read(spark, d, "conversations")
    pairs = fx.golden_pairs(spark, d).select("query", "expected_sql")
    partial = c.where(F.col("role") == "system").select(F.col("text").alias("query"))
    pairs.unionByName(partial, allowMissingColumns=True).write.mode("overwrite").json(path)
    return T.read_golden_sets(spark, path, multi_line=False)


@register("nearest_examples")
def q_nearest_examples(spark, d):
    queries, examples = fx.example_vectors(spark, d)
    nn = nearest_examples(queries, examples, k=5)
    labels = examples.select(F.col("vec_id").alias("example_id"), "label")
    return (nn.join(labels, "example_id")
              .select("query_id", "example_id", "label", "rank",
                      F.round("score", 6).alias("score")))


# ------------------------------------------------------------------ step 8
from .plans import materialize as MZ  # noqa: E402
from .plans import medallion as MD  # noqa: E402
from .functions.scalar import yyyymm  # noqa: E402
import uuid as _uuid  # noqa: E402


def _table_name(prefix: str) -> str:
    return f"{prefix}_{_uuid.uuid4().hex[:10]}"


def _kept(spark, name: str, answer: DataFrame) -> DataFrame:
    """``answer`` in the shared folder; the catalog table it came from goes."""
    kept = MZ.materialize_table(answer, scratch_path(spark, f"{name}-answer"))
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return kept


@register("materialize_partitioned")
def q_materialize_partitioned(spark, d):
    fct = fct_sales(spark, d).withColumn("order_ym", yyyymm("order_date"))
    t = MZ.materialize_table(fct, scratch_path(spark, "fct"), partition_by=["order_ym"],
                             order_by=list(marts.FCT_SALES_ORDER), files_per_partition_hint=2)
    return as_double(t)


@register("retention")
def q_retention(spark, d):
    name = _table_name("fct_sales_ret")
    fct = fct_sales(spark, d).withColumn("order_ym", yyyymm("order_date"))
    MZ.save_table(fct, name, scratch_path(spark, name), partition_by=["order_ym"],
                  order_by=list(marts.FCT_SALES_ORDER))
    MZ.retain(spark, name, "order_ym", 199901)
    return _kept(spark, name, spark.table(name).groupBy("order_ym")
                 .agg(F.count(F.lit(1)).alias("rows"),
                      F.sum("amount_usd").cast("double").alias("amount")))


@register("compact")
def q_compact(spark, d):
    from .operators.latest import compact
    log = fx.bronze_orders(spark, d).withColumn("order_ym", yyyymm("order_date"))
    path = compact(log, ["id"], "updated_at", fx.ORDER_TIEBREAK, partition_by=["order_ym"])
    return spark.read.parquet(path).select(*fx.bronze_orders(spark, d).columns)


@register("compact_touched")
def q_compact_touched(spark, d):
    """The log applied in two batches; the second, its last days, rewrites only the buckets it meets."""
    from .plans.buckets import BucketedLatest
    log = fx.bronze_orders(spark, d)
    # any cut gives the same table: the days are those of the lines, whether they have an order or not
    lo, hi = fx.read(spark, d, "lineitem").agg(F.min("l_shipdate"), F.max("l_shipdate")).first()
    cut = F.lit((lo + (hi - lo) * 0.98).isoformat(sep=" ")).cast("timestamp_ntz")
    early = F.coalesce(F.col("updated_at") < cut, F.lit(True))
    table = BucketedLatest(spark, scratch_path(spark, "bucketed"), ["id"], "updated_at", fx.ORDER_TIEBREAK, buckets=64)
    table.merge(log.where(early))
    table.merge(log.where(~early))
    return table.read().select(*log.columns)


@register("seed_if_empty")
def q_seed_if_empty(spark, d):
    name = _table_name("ventas_historicas")
    path = scratch_path(spark, name)
    hist = fx.monthly_history(spark, d)
    first = MZ.seed_if_empty(hist, name, path)
    second = MZ.seed_if_empty(hist, name, path)      # no-op: table has rows
    if not first or second:
        raise AssertionError("seed_if_empty wrote twice or not at all")
    return _kept(spark, name, as_double(spark.table(name)))


@register("run_medallion")
def q_run_medallion(spark, d):
    res = MD.run_medallion(spark, fx.bronze_orders(spark, d), fx.bronze_products(spark, d),
                           fx.bronze_users(spark, d), order_tiebreak=fx.ORDER_TIEBREAK)
    return as_double(query(res.gold, ORDERS, ["count", "totalAmount", "avgOrderValue",
                                              "grossMargin"], ["category"],
                           ("orderDate", "month")))


def _spooled_halves(spark, d) -> list[str]:
    """The change log written once, in landing files: those of its earlier half of time
    (and without a time) and those of its later half; a half without records has no folder."""
    times = (fx.bronze_orders(spark, d).select("_synced_at")
             .unionByName(fx.bronze_products(spark, d).select("_synced_at")).select(F.col("_synced_at").cast("timestamp").alias("t")))
    lo, hi = times.agg(F.min("t"), F.max("t")).first()
    late = F.lit(False)
    if lo is not None:
        mid = F.lit((lo + (hi - lo) / 2).isoformat(sep=" ")).cast("timestamp")
        late = F.coalesce(F.col("timestamp") >= mid, F.lit(False))
    spool = scratch_path(spark, "spool-inc")
    with shuffles_removed(spark):
        _land(fx.change_log(spark, d).withColumn("half", late.cast("int")), spool, ("half",))
    return [f"{spool}/half={n}" for n in (0, 1)]


def _incremental_runs(spark, d, products=(None, None), after=lambda run, res: None):
    """Two runs, with the later half of the changes landing in between: the
    second applies only them and writes only the months they touch."""
    landing, bronze, ckpt, gold = (scratch_path(spark, n) for n in ("landing-inc", "bronze-inc", "ckpt-inc", "gold-inc"))
    halves = _spooled_halves(spark, d)
    with shuffles_removed(spark):
        for run, half in enumerate(halves):
            if path_exists(spark, half):
                move_path(spark, half, f"{landing}/{run}")
            stream = cdc.read_changes(spark, "json", path=f"{landing}/*", streaming=True)
            known = products[run] if products[run] is not None else fx.bronze_products(spark, d)
            res = MD.run_incremental(spark, stream, bronze, unwrapped_orders, known, fx.bronze_users(spark, d), ckpt, gold)
            after(run, res)
    return res


@register("run_incremental")
def q_run_incremental(spark, d):
    return as_double(query(_incremental_runs(spark, d).gold, ORDERS, ["count", "totalAmount"], ["status"]))


@register("incremental_dimension_change")
def q_incremental_dimension_change(spark, d):
    """Categories and prices change between two runs, and nobody says which: the
    second run finds them and corrects the orders that name them."""
    now = fx.bronze_products(spark, d)
    before = (now.withColumn("category", F.when(F.col("id") % 3 == 0, F.lit("old category")).otherwise(F.col("category")))
              .withColumn("price", F.when(F.col("id") % 5 == 0, F.col("price") + 1).otherwise(F.col("price"))))
    res = _incremental_runs(spark, d, products=(before, now))
    return as_double(query(res.gold, ORDERS, ["count", "totalAmount", "grossMargin"], ["category"], ("orderDate", "year")))


@register("rollup_signed_deltas")
def q_rollup_signed_deltas(spark, d):
    """A rollup built by the first run and kept up by the second one's change of
    gold: old versions count -1, new ones +1, merged into the touched months."""
    from .plans.rollup_deltas import MaintainedRollup
    kept = MaintainedRollup(spark, ORDERS, DAY_CATEGORY)

    def follow(run, res):
        if run == 0:
            kept.build(res.gold)
        else:
            kept.apply(res.added, res.retracted)

    _incremental_runs(spark, d, after=follow)
    return as_double(kept.rollup().df)


@register("sales_by_business_day")
def q_sales_by_business_day(spark, d):
    """The same pipeline on order instants, with the calendar of Mexico City."""
    instants = fx.bronze_orders(spark, d).withColumn("order_date", F.col("updated_at").cast("timestamp"))
    res = MD.run_medallion(spark, instants, fx.bronze_products(spark, d), fx.bronze_users(spark, d),
                           order_tiebreak=fx.ORDER_TIEBREAK, tz="America/Mexico_City")
    return as_double(query(res.gold, ORDERS, ["count", "totalAmount"], [], ("orderDate", "day")))


@register("replace_write_partitioned")
def q_replace_write_partitioned(spark, d):
    """A month-partitioned table replaced by rows of fewer months."""
    fct, path = fct_sales(spark, d).withColumn("order_ym", yyyymm("order_date")), scratch_path(spark, "replaced")
    table = MZ.materialize_table(fct, path, partition_by=["order_ym"])
    # staged, as a table cannot be read while it is replaced; the facts are not computed again
    kept = MZ.materialize_table(table.where(F.col("order_ym") >= 199901), scratch_path(spark, "replacing"))
    t = MZ.materialize_table(kept, path, partition_by=["order_ym"])
    return t.groupBy("order_ym").agg(F.count(F.lit(1)).alias("rows"), F.sum("amount_usd").cast("double").alias("amount"))


# ------------------------------------------------- streaming alert (J5)
@register("alert_stream")
def q_alert_stream(spark, d):
    """Gauge samples arrive in event-time order; stateful per-series alert."""
    from .streaming.alerts import alert_stream
    g = fx.gauge_samples(spark, d).select("ts", "series_id", "event_id", "value")
    landing = _landing_in_time_order(g, "ts", 4, "event_id")
    stream = _landing_stream(spark, landing, g.schema)
    alerts = alert_stream(stream, "series_id", "ts", "value", 30, 60, tiebreak="event_id",
                          idle_timeout_s=None)
    out = scratch_path(spark, "alerts")
    LS.use_rocksdb_state(spark)
    LS.await_done(LS.write_versions(alerts, out, output_mode="append"))
    return spark.read.parquet(out).drop("_batch_id")


# --------------------------------------------- semantic layer, more cubes
from .plans.semantic import SALES_FORECAST, SALES_HISTORY, USERS  # noqa: E402
from .plans.rollup import refresh_rollups  # noqa: E402


@register("users_by_country_month")
def q_users_by_country_month(spark, d):
    return query(silver(spark, d)[2], USERS, ["count"], ["country"], ("createdAt", "month"))


@register("sales_history_cube")
def q_sales_history_cube(spark, d):
    hist = fx.monthly_history(spark, d)
    return as_double(query(hist, SALES_HISTORY, ["count", "totalVentas", "promedioVentas"],
                           ["historicoMes"]))


def _forecast_rows(spark, d):
    fc = FC.forecast_next(fx.monthly_history_by_segment(spark, d), "historico_mes",
                          "ventas_reales", groups=["segment"])
    return FC.prediction_table(fc, run_date=datetime.date(2024, 1, 31)).withColumn(
        "modelo_version", F.concat(F.lit(FC.MODEL_VERSION + "-"), F.col("mes_simulado")))


@register("forecast_cube")
def q_forecast_cube(spark, d):
    return query(_forecast_rows(spark, d), SALES_FORECAST,
                 ["count", "totalPrediccion", "promedioPrediccion"], ["modeloVersion"])


@register("forecast_cube_drill")
def q_forecast_cube_drill(spark, d):
    return semantic.drill(_forecast_rows(spark, d), SALES_FORECAST, "count")


@register("format_currency")
def q_format_currency(spark, d):
    out = query(fct_sales(spark, d), ORDERS, ["count", "totalAmount", "avgOrderValue"],
                ["category"])
    return semantic.format_measures(out, ORDERS)


@register("capped_result")
def q_capped_result(spark, d):
    """A 5,000-row result cap over a detail query (ordered, so the cap is stable)."""
    fct = fct_sales(spark, d).select("order_id", "category", "amount_usd")
    page, cut = semantic.capped(fct.orderBy("order_id"), 5000)
    return as_double(page.withColumn("truncated", F.lit(cut)))


@register("refresh_rollups")
def q_refresh_rollups(spark, d):
    fct = _staged_facts(spark, d, "category", "order_status", "order_date", "amount_usd", "gross_margin_usd",
                        "data_replicated_at")
    t = build_rollup(fct, ORDERS, DAY_CATEGORY, version_col="data_replicated_at")
    same = refresh_rollups(fct, ORDERS, [t], force=False, version_col="data_replicated_at")
    if same[0] is not t:
        raise AssertionError("unchanged source must not rebuild")
    forced = refresh_rollups(fct, ORDERS, [t], force=True, version_col="data_replicated_at")
    return as_double(query(fct, ORDERS, ["count", "totalAmount"], ["status"],
                           ("orderDate", "year"), rollups=forced))


@register("run_forecast")
def q_run_forecast(spark, d):
    """Seed (if empty) -> verify source -> fit -> overwrite prediction table -> refresh rollup."""
    name, out = _table_name("ventas_historicas"), scratch_path(spark, "ml_prediccion_ventas")
    result = FC.run_forecast(spark, fx.monthly_history(spark, d), name, scratch_path(spark, name), out,
                             run_date=datetime.date(2024, 1, 31))
    return _kept(spark, name, result.predictions)


@register("forecast_double")
def q_forecast_double(spark, d):
    """The trend of a DOUBLE series with very small values."""
    hist = fx.monthly_history(spark, d).select(
        "historico_mes", (F.col("ventas_reales").cast("double") / F.lit(1e15)).alias("y"))
    fit = FC.fit_line(hist, "historico_mes", "y")
    return fit.select("n", F.round(F.col("slope") * 1e12, 4).alias("slope_e12"),
                      F.round(F.col("intercept") * 1e9, 4).alias("intercept_e9"), "max_x")


@register("forecast_rollup")
def q_forecast_rollup(spark, d):
    """A question on the predictions, answered by the rollup that the flow refreshes."""
    from .plans.rollup import FORECAST_ROLLUP
    rows = _forecast_rows(spark, d)
    table = build_rollup(rows, SALES_FORECAST, FORECAST_ROLLUP)
    return query(rows, SALES_FORECAST, ["count", "totalPrediccion"], ["modeloVersion"], rollups=[table])


@register("named_source_scan")
def q_named_source_scan(spark, d):
    """A second named data source (operational snapshot files) read by name."""
    T.register_source("legacy_files",
                      lambda s, t: T.read_snapshot(s, f"{d.rstrip('/')}/{t}.parquet"))
    part = T.table(spark, "part", data_source="legacy_files")
    return (part.groupBy("p_brand")
                .agg(F.count(F.lit(1)).alias("parts"),
                     (F.sum(F.col("p_retailprice").cast("decimal(18,2)")).cast("double")
                      / F.count("p_retailprice")).alias("avg_price")))


@register("create_as")
def q_create_as(spark, d):
    """CREATE TABLE AS (written to the shared folder) then a view over it."""
    fct = fct_sales(spark, d)
    t_name, v_name = _table_name("ctas_sales"), _table_name("cvas_sales")
    MZ.create_as(spark, t_name, fct.select("order_id", "country", "amount_usd"), "table",
                 path=scratch_path(spark, t_name))
    MZ.create_as(spark, v_name, spark.table(t_name).where(F.col("amount_usd") > 50000), "view")
    return as_double(spark.table(v_name).groupBy("country").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("amount_usd").alias("amount")))


@register("counter_rate_extrapolated")
def q_counter_rate_extrapolated(spark, d):
    r = M.counter_rate(fx.metric_samples(spark, d), SERIES, 3600, tiebreak=["event_id"],
                       extrapolate=True)
    return r.select("ts", "metric", "series_id", "event_id", "increase", "rate")


@register("counter_rate_double")
def q_counter_rate_double(spark, d):
    """A DOUBLE counter (in 64ths, so that its sums are exact in any order) over an hour."""
    s = fx.metric_samples(spark, d).withColumn("value", (F.col("value") * 100).cast("long") / F.lit(64.0))
    r = M.counter_rate(s, SERIES, 3600, tiebreak=["event_id"])
    return r.select("ts", "metric", "series_id", "event_id", "value", "delta", "increase", "rate")


@register("business_day_events")
def q_business_day_events(spark, d):
    """Event instants (UTC) counted per calendar day in the business zone."""
    from .functions.scalar import to_business_date
    e = fx.read(spark, d, "events")
    return (e.groupBy(to_business_date(F.col("ts").cast("timestamp"),
                                       "America/Mexico_City").alias("business_date"))
             .agg(F.count(F.lit(1)).alias("events")))


@register("cdc_publication_ops")
def q_cdc_publication_ops(spark, d):
    """A publication that replicates inserts and updates only."""
    routed = cdc.route(fx.change_log(spark, d), ["orders"])
    rows = cdc.with_version(fx.typed_orders(cdc.unwrap(routed, fx.order_row_schema(), ops=("c", "u"))))
    return rows.select(*CDC_COLS)


def _synced_rows(spark, d) -> DataFrame:
    return (fx.bronze_orders(spark, d).select(F.lit("orders").alias("table"), "_synced_at")
              .unionByName(fx.bronze_products(spark, d)
                             .select(F.lit("products").alias("table"), "_synced_at"))
              .unionByName(fx.bronze_users(spark, d)
                             .select(F.lit("users").alias("table"), "_synced_at")))


@register("replication_lag_series")
def q_replication_lag_series(spark, d):
    return M.lag_series(_synced_rows(spark, d), ["table"], window="1 day")


@register("lag_series_gap")
def q_lag_series_gap(spark, d):
    """The series with its silent days: a stalled table's lag grows."""
    return M.complete_lag_series(M.lag_series(_synced_rows(spark, d), ["table"], window="1 day"), ["table"], 86400)


@register("lag_series_gap_stream")
def q_lag_series_gap_stream(spark, d):
    return M.complete_lag_series(q_replication_lag_stream(spark, d), ["table"], 86400)


@register("replication_lag_stream")
def q_replication_lag_stream(spark, d):
    """The same series over the arriving rows: watermark bounds window state,
    update mode + newest emission per window gives the final values."""
    rows = _synced_rows(spark, d)
    landing = _landing_in_time_order(rows, "_synced_at", 4)
    src = (_landing_stream(spark, landing, rows.schema)
                .withColumn("_synced_at", F.col("_synced_at").cast("timestamp"))
                .withWatermark("_synced_at", "2 days"))
    series = M.lag_series(src, ["table"], window="1 day")
    out = scratch_path(spark, "lag-series")
    LS.use_rocksdb_state(spark)
    LS.await_done(LS.write_versions(series, out))
    latest = latest_by_key(spark.read.parquet(out), ["table", "window_start"], "_batch_id")
    return latest.select("table",
                         F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                         F.col("window_end").cast("timestamp_ntz").alias("window_end"),
                         F.col("last_synced_at").cast("timestamp_ntz").alias("last_synced_at"),
                         "rows", "lag_seconds")


@register("sales_date_range_pruned")
def q_sales_date_range_pruned(spark, d):
    """Date-range question on the stored, month-partitioned gold table: the
    compiler adds the implied order_ym predicate, so only touched months are read."""
    gold = MZ.materialize_table(fct_sales(spark, d).withColumn("order_ym", yyyymm("order_date")),
                                scratch_path(spark, "gold"), partition_by=["order_ym"],
                                order_by=list(marts.FCT_SALES_ORDER))
    return as_double(query(gold, ORDERS, ["count", "totalAmount"], ["country"],
                           ("orderDate", "week"),
                           filters=[("orderDate", "inDateRange", ["1997-03-15", "1997-06-10"])]))


@register("support_tickets_latest")
def q_support_tickets_latest(spark, d):
    """Tickets have bronze but no silver model: ingest + latest version only."""
    return staging.stg_support_tickets(fx.bronze_support_tickets(spark, d),
                                       tiebreak=["_offset"]).drop("_is_deleted")


@register("cube_named_source")
def q_cube_named_source(spark, d):
    """A cube read through its named data source (the catalog's fct_sales)."""
    fct_sales(spark, d).createOrReplaceTempView("fct_sales")
    return as_double(query(semantic.load_cube(spark, ORDERS), ORDERS,
                           ["count", "avgOrderValue"], ["status", "country"]))


@register("forecast_cube_named_source")
def q_forecast_cube_named_source(spark, d):
    """The forecast cube read from its own, second data source."""
    rows = _forecast_rows(spark, d)
    T.register_source(SALES_FORECAST.data_source, lambda s, t: {SALES_FORECAST.source: rows}[t])
    return query(semantic.load_cube(spark, SALES_FORECAST), SALES_FORECAST,
                 ["count", "totalPrediccion", "promedioPrediccion"], ["modeloVersion"])


@register("rate_limit_stream_append")
def q_rate_limit_stream_append(spark, d):
    """Append mode: a window is emitted once, when the watermark (max event
    time - 2 h) has passed its end; later windows stay in state."""
    events = fx.read(spark, d, "events")
    landing = _landing_in_time_order(events, "ts", 4, "event_id")
    src = (_landing_stream(spark, landing, events.schema)
                .withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "2 hours"))
    v = M.rate_limit_violations(src, ["user_id"], limit=2, window="1 hour")
    out = scratch_path(spark, "rate-limit-append")
    LS.await_done(LS.write_versions(v, out, output_mode="append"))
    return (spark.read.parquet(out).drop("_batch_id")
                 .select("user_id",
                         F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                         F.col("window_end").cast("timestamp_ntz").alias("window_end"),
                         "requests"))


def _rate_grid_columns(df: DataFrame) -> DataFrame:
    return df.select(*SERIES, F.col("eval_ts").cast("timestamp_ntz").alias("eval_ts"), "samples",
                     F.col("increase").cast("double").alias("increase"), "rate")


@register("rate_grid")
def q_rate_grid(spark, d):
    """Counter rates over five minutes, every 15 seconds."""
    return _rate_grid_columns(rate_grid(fx.metric_samples(spark, d), SERIES, tiebreak=["event_id"]))


@register("rate_grid_stream")
def q_rate_grid_stream(spark, d):
    """The same on the stream of samples, up to the watermark (max event time - 1 minute)."""
    LS.use_rocksdb_state(spark)
    out, ckpt = scratch_path(spark, "rate-grid"), scratch_path(spark, "ckpt")
    samples = fx.metric_samples(spark, d).drop("labels")
    with shuffles_removed(spark):
        landing = _landing_in_time_order(samples, "ts", 4, "event_id")
        src = (_landing_stream(spark, landing, samples.schema)
                    .withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 minute"))
        LS.await_done(LS.write_versions(rate_grid(src, SERIES, tiebreak=["event_id"]), out, ckpt, output_mode="append"))
    for done in (landing, ckpt):
        drop_path(spark, done)
    return _rate_grid_columns(spark.read.parquet(out))


@register("stream_resume_exactly_once")
def q_stream_resume_exactly_once(spark, d):
    """Two runs of one availableNow ingest stream sharing a checkpoint, with
    more change files landing in between: the bronze log must hold every
    change exactly once (the second run reads only the new files)."""
    landing, bronze, ckpt = (scratch_path(spark, n) for n in ("landing-resume", "bronze-resume", "ckpt-resume"))
    # the malformed record has no timestamp: it arrives with the first files
    for run, half in enumerate(_spooled_halves(spark, d)):
        arrived = f"{landing}/{run}"
        if path_exists(spark, half):
            move_path(spark, half, arrived)
        stream = cdc.read_changes(spark, "json", {"maxFilesPerTrigger": _files_per_batch(spark, arrived)},
                                  path=f"{landing}/*", streaming=True)
        LS.await_done(LS.write_bronze(unwrapped_orders(stream), bronze, ckpt))
    return spark.read.parquet(bronze).select(*CDC_COLS)


def _lag_samples(spark, d) -> DataFrame:
    """One lag sample per applied change: seconds from the change to its sync.
    The whole table is one series - the hot-series case."""
    b = fx.bronze_orders(spark, d)
    lag = F.expr("timestampdiff(SECOND, updated_at, _synced_at)").cast("double")
    return b.select(F.lit("orders").alias("table"), F.col("_synced_at").alias("ts"),
                    lag.alias("lag_seconds"), "id", *fx.ORDER_TIEBREAK)


@register("replication_lag_alerts")
def q_replication_lag_alerts(spark, d):
    """Lag above a threshold held for 1 minute, over the table's single lag
    series.  Per-change lags here span 0-89 s within a day, so the rule's
    30 s threshold can never hold for 60 s; 10 s makes islands that do."""
    s = _lag_samples(spark, d)
    return M.alert_intervals(s, ["table"], F.col("lag_seconds") > 10, 60,
                             tiebreak=["id", *fx.ORDER_TIEBREAK])


@register("replication_lag_alert_stream")
def q_replication_lag_alert_stream(spark, d):
    """The same rule evaluated by the stateful stream as changes arrive."""
    from .streaming.alerts import alert_stream
    s = _lag_samples(spark, d).select("table", "ts", "lag_seconds", "id")
    landing = _landing_in_time_order(s, "ts", 4, "id")
    stream = _landing_stream(spark, landing, s.schema)
    alerts = alert_stream(stream, "table", "ts", "lag_seconds", 10, 60, tiebreak="id",
                          idle_timeout_s=None)
    out = scratch_path(spark, "lag-alerts")
    LS.use_rocksdb_state(spark)
    LS.await_done(LS.write_versions(alerts, out, output_mode="append"))
    return spark.read.parquet(out).drop("_batch_id")


@register("alert_intervals_stale")
def q_alert_intervals_stale(spark, d):
    """Held-condition islands where a 6-hour silence marks the series stale."""
    g = fx.gauge_samples(spark, d)
    return M.alert_intervals(g, ["series_id"], F.col("value") > 30, 60, tiebreak=["event_id"],
                             max_gap_s=6 * 3600).select(
        "series_id", "start_ts", "end_ts", "n_samples", "duration_s", "fired_at")


@register("alert_stream_stale")
def q_alert_stream_stale(spark, d):
    """The stateful alert with a 6-hour idle time (streak break + state eviction)."""
    from .streaming.alerts import alert_stream
    g = fx.gauge_samples(spark, d).select("ts", "series_id", "event_id", "value")
    landing = _landing_in_time_order(g, "ts", 4, "event_id")
    stream = _landing_stream(spark, landing, g.schema)
    alerts = alert_stream(stream, "series_id", "ts", "value", 30, 60, tiebreak="event_id",
                          idle_timeout_s=6 * 3600)
    out = scratch_path(spark, "alerts-stale")
    LS.use_rocksdb_state(spark)
    LS.await_done(LS.write_versions(alerts, out, output_mode="append"))
    return spark.read.parquet(out).drop("_batch_id")


@register("alert_stream_silent")
def q_alert_stream_silent(spark, d):
    """Every series falls silent at the end of the data: a heartbeat stream moves
    the watermark, and streaks that are still on fire at start + hold."""
    from .streaming.alerts import alert_stream
    g = fx.gauge_samples(spark, d).select("ts", "series_id", "event_id", "value")
    landing, beats = _landing_in_time_order(g, "ts", 4, "event_id"), scratch_path(spark, "heartbeat")
    ends = staged(g.agg(F.min("ts").cast("timestamp").alias("lo"), F.max("ts").cast("timestamp").alias("hi")))
    # a beat per trigger; the one that passes the last sample comes after all of them
    n = _landing_batches(spark, landing)[0]
    for i in range(n + 3):
        late = F.col("hi") + F.expr(f"INTERVAL {5000 + i} DAYS")
        ends.select((F.col("lo") if i <= n else late).alias("ts")).coalesce(1).write.mode("append").parquet(beats)

    heartbeat = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).parquet(beats)
    # a delay longer than the data, so that only the heartbeat can pass a sample's time
    alerts = alert_stream(_landing_stream(spark, landing, g.schema), "series_id", "ts", "value", 30, 60, tiebreak="event_id", idle_timeout_s=None,
                          watermark="4000 days", fire_when_silent=True, heartbeat=heartbeat)
    out = scratch_path(spark, "alerts-silent")
    LS.await_done(LS.write_versions(alerts, out, output_mode="append"))
    return spark.read.parquet(out).drop("_batch_id")
