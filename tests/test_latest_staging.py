import datetime as dt
import random

from pyspark.sql import functions as F

from stratum.functions import scalar as S
from stratum.operators.latest import latest_by_key, live
from stratum.plans import marts, staging

T = dt.datetime


def _bronze(spark, rows):
    return spark.createDataFrame(rows, "id long, user_id long, product_id long, status string, "
                                       "amount double, order_date date, updated_at timestamp_ntz, "
                                       "_synced_at timestamp_ntz, _is_deleted int, off long")


def test_latest_takes_newest_and_breaks_ties(spark):
    rows = [
        (1, 1, 1, "pending", 10.0, dt.date(2020, 1, 1), T(2020, 1, 1), T(2020, 1, 1), 0, 1),
        (1, 1, 1, "completed", 11.0, dt.date(2020, 1, 1), T(2020, 1, 2), T(2020, 1, 2), 0, 2),
        # same version stamp as the previous row: arrival offset decides
        (1, 1, 1, "refunded", 12.0, dt.date(2020, 1, 1), T(2020, 1, 2), T(2020, 1, 2), 0, 3),
        (2, 1, 1, "pending", 5.0, dt.date(2020, 1, 1), T(2020, 1, 1), T(2020, 1, 1), 0, 1),
    ]
    out = latest_by_key(_bronze(spark, rows), ["id"], "updated_at", ["off"]).orderBy("id").collect()
    assert [(r.id, r.status) for r in out] == [(1, "refunded"), (2, "pending")]


def test_latest_is_input_order_independent(spark):
    rows = [(k, 1, 1, "pending", float(v), dt.date(2020, 1, 1), T(2020, 1, 1 + v % 5),
             T(2020, 1, 1), v % 2, v) for k in range(5) for v in range(8)]
    expect = None
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = _bronze(spark, rows).repartition(3)
        got = sorted(tuple(r) for r in latest_by_key(df, ["id"], "updated_at", ["off"]).collect())
        expect = expect or got
        assert got == expect
        # idempotent: applying twice changes nothing
        again = latest_by_key(latest_by_key(df, ["id"], "updated_at", ["off"]), ["id"],
                              "updated_at", ["off"])
        assert sorted(tuple(r) for r in again.collect()) == expect


def test_dedup_before_delete_filter(spark):
    # delete is the newest version: the key must disappear, not fall back
    rows = [
        (7, 1, 1, "pending", 10.0, dt.date(2020, 1, 1), T(2020, 1, 1), T(2020, 1, 1), 0, 1),
        (7, 1, 1, "pending", 10.0, dt.date(2020, 1, 1), T(2020, 1, 3), T(2020, 1, 3), 1, 2),
        # delete then re-insert: the re-insert is live again
        (8, 1, 1, "pending", 10.0, dt.date(2020, 1, 1), T(2020, 1, 1), T(2020, 1, 1), 1, 1),
        (8, 1, 1, "pending", 10.0, dt.date(2020, 1, 1), T(2020, 1, 5), T(2020, 1, 5), 0, 2),
    ]
    df = _bronze(spark, rows)
    right = live(latest_by_key(df, ["id"], "updated_at", ["off"]))
    assert sorted(r.id for r in right.collect()) == [8]
    wrong = latest_by_key(live(df), ["id"], "updated_at", ["off"])
    assert sorted(r.id for r in wrong.collect()) == [7, 8]


def test_stg_orders_cleaning(spark):
    rows = [
        (1, 1, 1, " Completed", 10.005, dt.date(2021, 1, 3), T(2021, 1, 3), T(2021, 1, 3), 0, 1),
        (2, 1, 1, "PENDING ", 5.0, dt.date(2021, 1, 4), T(2021, 1, 4), T(2021, 1, 4), 0, 1),
        (3, 1, 1, "weird", 5.0, dt.date(2021, 1, 4), T(2021, 1, 4), T(2021, 1, 4), 0, 1),
        (4, 1, 1, None, 5.0, dt.date(2021, 1, 4), T(2021, 1, 4), T(2021, 1, 4), 0, 1),
        (5, 1, 1, "pending", 0.0, dt.date(2021, 1, 4), T(2021, 1, 4), T(2021, 1, 4), 0, 1),
        (6, 1, 1, "pending", 3.0, None, T(2021, 1, 4), T(2021, 1, 4), 0, 1),
    ]
    out = {r.order_id: r for r in staging.stg_orders(_bronze(spark, rows), tiebreak=["off"]).collect()}
    assert set(out) == {1, 2, 3, 4}
    assert out[1].order_status == "completed" and out[2].order_status == "pending"
    assert out[3].order_status == "unknown" and out[4].order_status == "unknown"
    # 2021-01-03 is a Sunday: ISO week starts Monday 2020-12-28, year of the date is 2021
    assert out[1].order_week_start == dt.date(2020, 12, 28)
    assert out[1].order_month == dt.date(2021, 1, 1) and out[1].order_year == 2021


def test_calendar_functions(spark):
    df = spark.createDataFrame([(dt.date(2021, 1, 3),), (dt.date(2021, 1, 4),)], "d date")
    r = df.select(S.iso_weekday("d").alias("w"), S.yyyymm("d").alias("ym"),
                  S.day_of_month("d").alias("dom")).collect()
    assert [x.w for x in r] == [7, 1]
    assert r[0].ym == 202101 and r[0].dom == 3


def test_fct_sales_unmatched_modes(spark):
    o = spark.createDataFrame(
        [(1, 10, 100, "completed", 50.0, dt.date(2021, 1, 4))],
        "order_id long, user_id long, product_id long, order_status string, amount_usd double, "
        "order_date date").select(
        "order_id", "user_id", "product_id", "order_status",
        F.col("amount_usd").cast("decimal(18,2)").alias("amount_usd"), "order_date",
        S.month_start("order_date").alias("order_month"), S.year_of("order_date").alias("order_year"),
        S.week_start("order_date").alias("order_week_start"),
        F.lit(None).cast("timestamp_ntz").alias("replicated_at"))
    p = spark.createDataFrame([], "product_id long, product_name string, category string, "
                                  "price_usd decimal(18,2)")
    u = spark.createDataFrame([], "user_id long, user_name string, email string, country string, "
                                  "signup_date date")
    null_row = marts.build_fct_sales(o, p, u, include_load_ts=False).first()
    assert null_row.gross_margin_usd is None and null_row.category is None
    dflt = marts.build_fct_sales(o, p, u, unmatched="default", include_load_ts=False).first()
    assert dflt.category == "" and float(dflt.gross_margin_usd) == 50.0
    assert dflt.is_completed == 1 and dflt.is_cancelled == 0 and dflt.day_of_week == 1
