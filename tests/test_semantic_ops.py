import datetime as dt

from pyspark.sql import functions as F

from stratum.operators import monitor as M
from stratum.plans import semantic as SEM
from stratum.plans.semantic import ORDERS, query


def _fct(spark):
    rows = [(1, "completed", "Books", "FR", dt.date(2021, 1, 31), 10.0, 1.0),
            (2, "pending", "Books", None, dt.date(2021, 2, 1), 20.0, 2.0),
            (3, "completed", "Toys", "DE", dt.date(2021, 2, 15), 30.5, -1.0),
            (4, "cancelled", "Toy Cars", "FR", dt.date(2021, 3, 1), 1234.565, 0.0)]
    return spark.createDataFrame(rows, "order_id long, order_status string, category string, "
                                       "country string, order_date date, a double, m double") \
        .select("order_id", "order_status", "category", "country", "order_date",
                F.col("a").cast("decimal(18,2)").alias("amount_usd"),
                F.col("m").cast("decimal(18,2)").alias("gross_margin_usd"),
                F.lit(1).alias("product_id"))


def _ids(df):
    return sorted(r.id for r in df.collect())


def test_filter_operators(spark):
    fct = _fct(spark)

    def ids(*filters):
        return _ids(query(fct, ORDERS, ["count"], ["id"], filters=list(filters)))

    assert ids(("country", "notEquals", ["FR"])) == [2, 3]          # NULL kept
    assert ids(("country", "notIn", ["FR", "DE"])) == [2]
    assert ids(("country", "notSet", [])) == [2]
    assert ids(("category", "contains", ["toy"])) == [3, 4]
    assert ids(("orderDate", "inDateRange", ["2021-02-01", "2021-02-28"])) == [2, 3]
    assert ids(("orderDate", "beforeDate", ["2021-02-01"])) == [1]
    assert ids(("orderDate", "afterDate", ["2021-02-15"])) == [4]
    assert ids(("status", "equals", ["completed"]), ("country", "set", [])) == [1, 3]


def test_time_granularities(spark):
    fct = _fct(spark)
    weeks = query(fct, ORDERS, ["count"], [], ("orderDate", "week")).collect()
    # 2021-01-31 is a Sunday: its ISO week starts Monday 2021-01-25
    assert {r.orderDate_week: r["count"] for r in weeks} == {
        dt.date(2021, 1, 25): 1, dt.date(2021, 2, 1): 1, dt.date(2021, 2, 15): 1,
        dt.date(2021, 3, 1): 1}
    q = query(fct, ORDERS, ["count"], [], ("orderDate", "quarter")).collect()
    assert [(r.orderDate_quarter, r["count"]) for r in q] == [(dt.date(2021, 1, 1), 4)]


def test_drill_format_cap_order(spark):
    fct = _fct(spark)
    d = SEM.drill(fct, ORDERS, "count", filters=[("status", "equals", ["completed"])], limit=1)
    assert [r.id for r in d.collect()] == [1]
    f = SEM.format_measures(query(fct, ORDERS, ["totalAmount"], ["status"],
                                  filters=[("status", "equals", ["cancelled"])]), ORDERS)
    assert f.first().totalAmount == "$1,234.57"
    top = query(fct, ORDERS, ["totalAmount"], ["category"],
                order=[("totalAmount", "desc"), ("category", "asc")], limit=1).first()
    assert top.category == "Toy Cars"
    assert SEM.capped(fct, 3)[1] and not SEM.capped(fct, 4)[1]
    assert SEM.capped(fct, 2)[0].count() == 2


def test_ratio_is_ratio_of_sums(spark):
    fct = _fct(spark)
    r = query(fct, ORDERS, ["marginRatio"], ["category"],
              filters=[("category", "equals", ["Books"])]).first()
    assert abs(r.marginRatio - 3.0 / 30.0) < 1e-15        # not avg(1/10, 2/20)


def test_time_range_and_lag(spark):
    now = dt.datetime(2024, 1, 1, 12, 0)
    rows = [(now - dt.timedelta(minutes=m), "t1") for m in (0, 30, 59, 61, 600)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, tbl string")
    assert M.time_range(df, "ts", 3600, now=now).count() == 3
    lag = M.replication_lag(df.withColumnRenamed("ts", "_synced_at"), ["tbl"],
                            now=now + dt.timedelta(seconds=45)).first()
    assert lag.lag_seconds == 45.0
