"""Plan-shape checks: the skew and pushdown properties the design relies on."""

import contextlib
import io


from stratum import fixtures as fx
from stratum.operators import monitor as M
from stratum.operators.latest import latest_by_key
from stratum.plans.semantic import ORDERS, query
from stratum.registry import fct_sales

from stratum_test_data import SF_SMALL


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_latest_prunes_before_shuffle(spark):
    df = latest_by_key(fx.bronze_orders(spark, SF_SMALL), ["id"], "updated_at",
                       fx.ORDER_TIEBREAK)
    p = _plan(df)
    assert "WindowGroupLimit" in p and "Partial" in p


def test_semantic_query_partial_aggregation_and_pruning(spark):
    q = query(fct_sales(spark, SF_SMALL), ORDERS, ["count", "totalAmount"], ["status"])
    p = _plan(q)
    assert p.count("HashAggregate") >= 2          # partial + final
    # the order-line scan reads only the columns the models need
    li = [line for line in p.splitlines() if line.startswith("ReadSchema") and "l_orderkey" in line]
    assert li and all("l_linestatus" not in line for line in li)


def test_series_windows_partition_by_bucket(spark):
    g = fx.gauge_samples(spark, SF_SMALL)
    r = M.counter_rate(g, ["metric", "series_id"], 300, tiebreak=["event_id"])
    p = _plan(r)
    assert "__bucket" in p or "hb" in p


def test_month_partition_pruning(spark):
    from stratum.functions.scalar import yyyymm
    from stratum.plans.materialize import materialize_table
    from stratum.session import scratch_path
    fct = fct_sales(spark, SF_SMALL).withColumn("order_ym", yyyymm("order_date"))
    t = materialize_table(fct, scratch_path(spark, "t"), partition_by=["order_ym"],
                          order_by=["order_date", "category", "country"])
    p = _plan(t.where("order_ym = 199806").select("order_id"))
    assert "PartitionFilters: [isnotnull(order_ym" in p and "199806" in p


def test_date_filter_prunes_month_partitions(spark):
    from stratum.functions.scalar import yyyymm
    from stratum.plans.materialize import materialize_table
    from stratum.session import scratch_path
    fct = fct_sales(spark, SF_SMALL).withColumn("order_ym", yyyymm("order_date"))
    gold = materialize_table(fct, scratch_path(spark, "g"), partition_by=["order_ym"])
    q = query(gold, ORDERS, ["count"], ["status"],
              filters=[("orderDate", "inDateRange", ["1997-03-15", "1997-06-10"])])
    p = _plan(q)
    assert "PartitionFilters" in p and "199703" in p and "199706" in p


def test_key_filter_pushes_below_latest_but_value_filter_does_not(spark, tmp_path):
    import datetime as dt
    from pyspark.sql import functions as F
    rows = [(k, dt.datetime(2024, 1, 1 + v), f"s{v}", v) for k in range(20) for v in range(3)]
    path = str(tmp_path / "bronze")
    spark.createDataFrame(rows, "id long, updated_at timestamp_ntz, status string, off long") \
         .write.parquet(path)
    latest = latest_by_key(spark.read.parquet(path), ["id"], "updated_at", ["off"])
    key_plan = _plan(latest.where(F.col("id") == 7))
    assert "EqualTo(id,7)" in key_plan                  # reaches the scan
    value_q = latest.where(F.col("status") == "s0")
    assert "EqualTo(status,s0)" not in _plan(value_q)   # would resurrect old versions
    assert value_q.count() == 0                         # s0 is never the newest version


def test_envelope_is_parsed_once(spark):
    from stratum.registry import unwrapped_orders
    rows = latest_by_key(unwrapped_orders(fx.change_log(spark, SF_SMALL)), ["id"], "updated_at", ["_offset"])
    plan = rows.where("_is_deleted = 0")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
