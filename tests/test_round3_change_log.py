"""The order change log is made once, and keys are sliced only where a block of ids is hot."""
from pyspark.sql import functions as F

from stratum import fixtures as fx
from stratum.registry import unwrapped_orders
from stratum_test_data import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cold_log_is_numbered_by_one_window(spark):
    plan = _plan(fx.numbered_orders(spark, SF_SMALL))
    assert plan.count("lineitem.parquet") == 1 and "LeftAnti" not in plan
    assert "LeftAnti" in _plan(fx.numbered_orders(spark, SF_SMALL, hot_rows=400))


def test_broken_records_come_beside_theirs(spark):
    log, all_ = fx.change_log(spark, SF_SMALL), fx.change_log_with_broken_fields(spark, SF_SMALL)
    assert _plan(all_).count("lineitem.parquet") == 1
    assert all_.columns == log.columns
    added = all_.exceptAll(log)
    hit = log.where((F.col("topic") == fx.ORDERS_TOPIC) & (F.col("offset") == 1) & F.col("value").isNotNull()
                    & (F.col("key").cast("long") % 97 == 0))
    assert log.exceptAll(all_).isEmpty() and added.count() == hit.count() > 0
    assert added.drop("value").exceptAll(hit.drop("value")).isEmpty()
    assert unwrapped_orders(log).count() == unwrapped_orders(all_).count()
