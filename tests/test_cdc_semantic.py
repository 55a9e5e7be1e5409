import datetime as dt
import json

from pyspark.sql import functions as F

from stratum.functions.envelope import decode_decimal, encode_decimal
from stratum.operators import quality as Q
from stratum.plans.rollup import Rollup, build_rollup
from stratum.plans.semantic import ORDERS, apply_rls, query
from stratum.sources import cdc
from stratum import fixtures as fx


def test_decimal_envelope_round_trip(spark):
    vals = ["0.00", "0.01", "-0.01", "1.28", "-1.28", "327.67", "-327.68", "12345678.90",
            "-99999999.99"]
    df = spark.createDataFrame([(v,) for v in vals], "v string").select(
        F.col("v").cast("decimal(10,2)").alias("d"))
    out = df.select("d", decode_decimal(encode_decimal("d", 2), 2, 10).alias("back")).collect()
    assert all(r.d == r.back for r in out)


def test_unwrap_tombstone_malformed_and_deletes(spark):
    row = fx.order_row_schema()

    def env(op, before=None, after=None):
        return json.dumps({"before": before, "after": after, "op": op, "ts_ms": 1})

    r1 = {"id": 1, "status": "x", "amount": "AQ==", "order_date": 1, "updated_at": 1}
    recs = [
        ("shop.public.orders", 0, 1, "1", env("c", after=r1), None),
        ("shop.public.orders", 0, 2, "1", env("d", before=r1), None),
        ("shop.public.orders", 0, 3, "1", None, None),                  # tombstone
        ("shop.public.orders", 0, 4, "9", "{broken", None),             # malformed
        ("shop.public.products", 0, 1, "5", env("r", after={"id": 5}), None),
    ]
    df = spark.createDataFrame(recs, cdc.RECORD_SCHEMA)
    routed = cdc.route(df, ["orders"])
    soft = cdc.unwrap(routed, row).collect()
    assert [(r.op, r._is_deleted, r.id) for r in soft] == [("c", 0, 1), ("d", 1, 1)]
    dropped = cdc.unwrap(routed, row, delete_mode="drop").collect()
    assert [r.op for r in dropped] == ["c"]
    bad = cdc.quarantine(routed, row).collect()
    assert [r.key for r in bad] == ["9"]


def _fct(spark):
    rows = [(i, "completed" if i % 2 else "pending", f"cat{i % 3}", f"C{i % 4}",
             dt.date(2021, 1 + i % 12, 1 + i % 28), float(10 + i), float(i % 5))
            for i in range(300)]
    return spark.createDataFrame(rows, "order_id long, order_status string, category string, "
                                       "country string, order_date date, amount double, "
                                       "margin double").select(
        "order_id", "order_status", "category", "country", "order_date",
        F.col("amount").cast("decimal(18,2)").alias("amount_usd"),
        F.col("margin").cast("decimal(18,2)").alias("gross_margin_usd"),
        F.lit(1).alias("product_id"))


def test_rollup_answer_equals_direct(spark):
    fct = _fct(spark)
    spec = Rollup("t", ("count", "totalAmount", "avgOrderValue", "marginRatio"),
                  ("category", "status"), "orderDate", "day")
    table = build_rollup(fct, ORDERS, spec)
    for gran in ("month", "quarter", "year"):
        ask = dict(measures=["count", "totalAmount", "avgOrderValue", "marginRatio"],
                   dimensions=["category"], time_dimension=("orderDate", gran),
                   filters=[("status", "equals", ["completed"])])
        a = sorted(query(fct, ORDERS, **ask).collect())
        b = sorted(query(fct, ORDERS, rollups=[table], **ask).collect())
        assert a == b
    # country is not in the rollup: must fall back to the fact (still correct)
    direct = query(fct, ORDERS, ["count"], ["country"])
    via = query(fct, ORDERS, ["count"], ["country"], rollups=[table])
    assert sorted(direct.collect()) == sorted(via.collect())
    # week does not nest in a month rollup
    m = Rollup("m", ("count",), ("category",), "orderDate", "month")
    assert not build_rollup(fct, ORDERS, m).can_answer(ORDERS, ["count"], [],
                                                         ("orderDate", "week"), [])


def test_having_and_rls(spark):
    fct = _fct(spark)
    out = query(fct, ORDERS, ["count"], ["category"], filters=[("count", "gt", [100])])
    assert out.count() == 0
    pol = spark.createDataFrame([("alice", "C1"), ("alice", "C2"), ("bob", "C3")],
                                "principal string, country string")
    got = apply_rls(fct, pol, "alice", "country").select("country").distinct().collect()
    assert sorted(r.country for r in got) == ["C1", "C2"]


def test_quality_checks_and_gate(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (None, "b"), (2, "zz")], "id long, s string")
    rep = Q.report(Q.not_null(df, ["id", "s"], "t"), Q.unique(df, ["id"], "t"),
                   Q.accepted_values(df, "s", ["a", "b"], "t"))
    got = {(r.check, r.column): r.failures for r in rep.collect()}
    assert got == {("not_null", "id"): 1, ("not_null", "s"): 1, ("unique", "id"): 1,
                   ("accepted_values", "s"): 1}
    try:
        Q.gate(rep)
        raise AssertionError("gate should fail")
    except Q.QualityGateError:
        pass
    # the same failures at warn level do not block
    warn = {("not_null", "id"): "warn", ("not_null", "s"): "warn", ("unique", "id"): "warn",
            ("accepted_values", "s"): "warn"}
    assert Q.gate(rep, severities=warn) is rep
