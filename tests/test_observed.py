"""Checks that the silver write counts itself."""

from stratum import fixtures as fx
from stratum.operators import quality as Q
from stratum.plans import medallion as MD
from stratum.plans.materialize import materialize_table
from stratum.session import scratch_path

from stratum_test_data import SF_SMALL


def _write(spark, rows):
    specs = [Q.null_spec("a"), Q.accepted_spec("b", ["x"]), Q.range_spec("a", 0, 5)]
    seen = Q.ObservedChecks("t", *specs)
    df = spark.createDataFrame(rows, "a int, b string").repartition(3)
    out = materialize_table(seen.attach(df), scratch_path(spark, "observed"))
    return seen.report(spark), Q.table_checks(out, "t", *specs)


def _same(one, other):
    assert one.schema.simpleString() == other.schema.simpleString()
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))


def test_equal_to_a_pass_of_their_own(spark):
    _same(*_write(spark, [(None, "x"), (9, "y"), (1, None), (-1, "x"), (-1, "x")]))
    _same(*_write(spark, []))


def test_medallion_report_and_one_scan_less(spark):
    seen = Q.ObservedChecks("stg_orders", *MD.order_row_checks())
    path = scratch_path(spark, "silver")
    o, p, u = MD.silver_models(fx.bronze_orders(spark, SF_SMALL), fx.bronze_products(spark, SF_SMALL),
                               fx.bronze_users(spark, SF_SMALL), fx.ORDER_TIEBREAK, persist_orders_at=path,
                               order_checks=seen)
    own, observed = MD.silver_checks(o, p, u), MD.silver_checks(o, p, u, observed=seen)

    _same(observed, own)
    assert _scans(own, o) == _scans(observed, o) + 1


def _scans(df, table):
    """Leaves of the plan that read the table's files."""
    files = set(table.inputFiles())
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    n = 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.nodeName() == "LogicalRelation" or "Relation" in leaf.nodeName():
            n += any(f in files for f in leaf.relation().location().inputFiles())
    return n
