"""Edge cases of the gate, change feed, rollups, row-level security, series and pipelines."""

import base64
import datetime as dt
import json
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum import fixtures as fx
from stratum.functions.envelope import decode_decimal
from stratum.functions.scalar import args_json, fmt_date, round_half_even
from stratum.operators import forecast as FC
from stratum.operators import monitor as M
from stratum.operators import quality as Q
from stratum.operators.joins import bounded_broadcast
from stratum.operators.latest import latest_by_key
from stratum.operators.retrieval import nearest_examples
from stratum.plans import medallion as MD
from stratum.plans import semantic as SEM
from stratum.plans.materialize import materialize_table
from stratum.plans.rollup import Rollup, build_rollup, refresh_rollups
from stratum.plans.versioned import VersionedTable
from stratum.session import scratch_path
from stratum.sources import cdc


# ------------------------------------------------------------------ quality
def test_gate_finds_one_error_among_many_warnings(spark):
    rows = [("t", "in_range", f"c{i}", 1) for i in range(1500)] + [("t", "not_null", "id", 1)]
    report = spark.createDataFrame(rows, Q.REPORT_SCHEMA)
    warn = {("in_range", f"c{i}"): "warn" for i in range(20)}
    with pytest.raises(Q.QualityGateError, match="1481 checks"):
        Q.gate(report, severities=warn)
    only = report.withColumn("failures", F.when(F.col("check") == "not_null", 1).otherwise(1))
    with pytest.raises(Q.QualityGateError, match="1 checks: t.id not_null=1"):
        Q.gate(only, severity="warn", severities={("t", "not_null", "id"): "error"})
    Q.gate(only, severity="warn", severities={("other", "not_null", "id"): "error"})


def test_table_checks_scan_once(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b")], "id int, s string").repartition(2)
    checks = Q.table_checks(df, "t", Q.null_spec("id"), Q.accepted_spec("s", ["a"]), Q.range_spec("id", 2, None))
    assert {(r["check"], r["failures"]) for r in checks.collect()} == {("not_null", 1), ("accepted_values", 1), ("in_range", 1)}
    assert checks._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


# ---------------------------------------------------------------- retrieval
def test_nearest_examples_over_many_sparse_blocks(spark):
    rng = np.random.default_rng(1)
    q = [(int(i), rng.normal(size=4).tolist()) for i in rng.choice(2**50, 40, replace=False)]
    e = [(int(i), rng.normal(size=4).tolist()) for i in rng.choice(2**50, 90, replace=False)] + [(1, [0.0] * 4), (2, None)]
    schema = "vec_id long, embedding array<double>"
    got = nearest_examples(spark.createDataFrame(q, schema), spark.createDataFrame(e, schema), 3, block_rows=4, example_rows=8)
    want = set()
    for i, v in q:
        s = sorted((-np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w), j) for j, w in e if w and any(w))[:3]
        want |= {(i, j, r + 1) for r, (_, j) in enumerate(s)}
    assert {(r.query_id, r.example_id, r["rank"]) for r in got.collect()} == want


def test_nearest_examples_without_queries_or_examples(spark):
    schema = "vec_id long, embedding array<double>"
    none, some = spark.createDataFrame([], schema), spark.createDataFrame([(1, [1.0])], schema)
    assert nearest_examples(none, some).count() == 0 and nearest_examples(some, none).count() == 0


# ------------------------------------------------------------------- series
def test_rate_is_the_same_however_it_is_sliced(spark):
    rng = np.random.default_rng(2)
    t0 = dt.datetime(2024, 1, 1)
    v, rows = 0.0, []
    for i in range(60):
        v = 0.1 if i % 17 == 0 else v + float(rng.random())
        rows.append(("s", t0 + dt.timedelta(seconds=7 * i), float("inf") if i == 20 else v, i))
    df = spark.createDataFrame(rows, "series string, ts timestamp_ntz, value double, i int")
    out = []
    for target in (1 << 20, 2):
        r = M.counter_rate(df, ["series"], 10, tiebreak=["i"], target_rows=target)
        out.append([(x.i, x.increase, x.rate) for x in r.orderBy("i").collect()])
    assert out[0] == out[1]
    after = [x for x in out[0] if x[0] == 25][0]
    assert np.isfinite(after[1])  # an infinity outside the window has no effect


def test_resample_lookback_and_dense_steps(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(seconds=s), float(s), s) for s in (0, 1, 14, 15, 16, 400, 2000)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, value double, i int")
    got = {(r.eval_ts - t0).total_seconds(): r.value for r in M.resample(df, ["k"], 15, 60, tiebreak=["i"]).collect()}
    want = {}
    for g in range(0, 2100, 15):
        ok = [s for _, _, _, s in rows if g - 60 < s <= g]
        if ok:
            want[float(g)] = float(max(ok))
    assert got == want


def test_lag_series_shows_silence(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", t), ("a", t + dt.timedelta(minutes=10)), ("b", t + dt.timedelta(seconds=30))]
    df = spark.createDataFrame(rows, "table string, _synced_at timestamp_ntz")
    got = M.complete_lag_series(M.lag_series(df, ["table"]), ["table"], 60).orderBy("table", "window_start").collect()
    assert [r.lag_seconds for r in got if r.table == "a"] == [60 * i for i in range(1, 11)] + [60]
    assert [r["rows"] for r in got if r.table == "b"] == [1] + [0] * 10  # stalled while the other goes on


# ---------------------------------------------------------------------- cdc
ROW = "id long, name string, updated_at long"


def _records(spark, values):
    rows = [("db.public.t", 0, i, str(i), json.dumps(v) if v is not None else None, dt.datetime(2024, 1, 1)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, cdc.RECORD_SCHEMA)


def test_key_only_delete_wins_by_source_time(spark):
    log = _records(spark, [{"after": {"id": 1, "name": "x", "updated_at": 1000}, "op": "c", "ts_ms": 1},
                           {"before": {"id": 1}, "op": "d", "ts_ms": 5000}])
    rows = cdc.unwrap(log, fx.row_schema(ROW)).withColumn("updated_at", F.timestamp_micros("updated_at"))
    latest = latest_by_key(cdc.with_version(rows), ["id"], "updated_at", ["_offset"]).collect()
    assert [(r.id, r.op) for r in latest] == [(1, "d")]
    bare = cdc.with_version(rows.drop("updated_at")).orderBy("_offset").collect()
    assert bare[0].updated_at == dt.datetime(1970, 1, 1, 0, 0, 0, 1000)


def test_broken_records_are_quarantined(spark):
    log = _records(spark, [{"after": {"id": "abc"}, "op": "u"}, {"after": None, "op": "u"}, {"op": "d"}, {"after": {"id": 1}, "op": "x"},
                           {"after": {"id": 7, "name": "ok"}, "op": "r", "ts_ms": 1}, None, {"after": {"name": "no key"}, "op": "c"}])
    assert cdc.quarantine(log, fx.row_schema(ROW)).count() == 5
    assert [r.id for r in cdc.unwrap(log, fx.row_schema(ROW)).collect()] == [7]


@pytest.mark.parametrize("value", ["0.00", "1.28", "-1.28", "-0.01", "12345678901234567890123.45", "-12345678901234567890123.45",
                                   "92233720368547758.07", "92233720368547758.08", "-92233720368547758.09", "184467440737095516.16"])
def test_wide_decimals(spark, value):
    n = int(Decimal(value).scaleb(2))
    size = max(1, (n.bit_length() + 8) // 8)
    text = base64.b64encode(n.to_bytes(size, "big", signed=True)).decode()
    assert spark.range(1).select(decode_decimal(F.lit(text), 2, 38).alias("x")).first().x == Decimal(value)


def test_decimals_that_do_not_fit_are_null(spark):
    for n in (b"\x01" * 17, b""):
        text = base64.b64encode(n).decode()
        assert spark.range(1).select(decode_decimal(F.lit(text), 2, 38).alias("x")).first().x is None
    big = base64.b64encode((10**20).to_bytes(9, "big")).decode()
    assert spark.range(1).select(decode_decimal(F.lit(big), 2, 10).alias("x")).first().x is None


# ----------------------------------------------------- semantic, rls, rollups
def _facts(spark):
    return spark.createDataFrame(
        [(1, "MX", "a", dt.datetime(2024, 1, 31, 12), Decimal("5.00")), (2, "US", "a", dt.datetime(2024, 1, 31, 0), Decimal("7.00")),
         (3, "MX", "b", dt.datetime(2024, 2, 1), Decimal("9.00"))], "id int, country string, cat string, at timestamp, amount decimal(10,2)")


CUBE = SEM.Cube("Facts", "facts", {"count": SEM.Measure("count"), "total": SEM.Measure("sum", "amount"), "mean": SEM.Measure("avg", "amount")},
                {"id": SEM.Dimension("id", primary_key=True), "country": SEM.Dimension("country"), "cat__name": SEM.Dimension("cat"), "at": SEM.Dimension("at", "time")})


def test_date_range_counts_the_whole_last_day(spark):
    q = SEM.query(_facts(spark), CUBE, ["count"], filters=[("at", "inDateRange", ["2024-01-01", "2024-01-31"])])
    assert q.first()["count"] == 2
    assert SEM.query(_facts(spark), CUBE, ["count"], filters=[("at", "afterDate", "2024-01-31")]).first()["count"] == 1


def test_dimension_names_may_hold_two_underscores(spark):
    table = build_rollup(_facts(spark), CUBE, Rollup("r1", ("count", "mean"), ("cat__name",)))
    for rollups in ([], [table]):
        q = SEM.query(_facts(spark), CUBE, ["count", "mean"], ["cat__name"], rollups=rollups)
        assert {(r["cat__name"], r["count"], r["mean"]) for r in q.collect()} == {("a", 2, 6.0), ("b", 1, 9.0)}


def test_policy_column_is_explicit_everywhere(spark):
    policy = spark.createDataFrame([("MX", "ana")], "allowed string, principal string")
    with pytest.raises(KeyError):
        SEM.query(_facts(spark), CUBE, ["count"], ["country"], rls=(policy, "ana", "country"))
    rls = (policy, "ana", "country", "allowed")
    assert [tuple(r) for r in SEM.query(_facts(spark), CUBE, ["count"], ["country"], rls=rls).collect()] == [("MX", 2)]
    assert {r.id for r in SEM.drill(_facts(spark), CUBE, "count", rls=rls).collect()} == {1, 3}
    SEM.register_cube(_facts(spark), CUBE, rls=rls, name="facts_ana")
    assert spark.sql("SELECT count(*) AS n FROM facts_ana WHERE country = 'US'").first().n == 0
    nobody = (policy, "eve", "country", "allowed")
    assert SEM.query(_facts(spark), CUBE, ["count"], rls=nobody).first()["count"] == 0


def test_rollup_identity_versions_and_place(spark):
    facts, spec = _facts(spark), Rollup("r2", ("count", "total"), ("country",))
    table = build_rollup(facts, CUBE, spec, version_col="id")
    assert table.source_version == 3 and "__source_version" not in table.df.columns
    other = SEM.Cube("Other", "x", CUBE.measures, CUBE.dimensions)
    assert not table.can_answer(other, ["count"], ["country"], None, [])
    assert refresh_rollups(facts, CUBE, [table], version_col="id")[0] is table
    more = facts.unionByName(facts.withColumn("id", F.col("id") + 10))
    fresh = refresh_rollups(more, CUBE, [table], version_col="id")[0]
    assert fresh.source_version == 13 and fresh.path.rpartition("/")[0] == table.path.rpartition("/")[0] != fresh.path
    q = SEM.query(more, CUBE, ["count", "total"], filters=[("country", "equals", "none")], rollups=[fresh]).first()
    assert (q["count"], q["total"]) == (0, None)


def test_capped_tells_when_it_cuts(spark):
    page, cut = SEM.capped(spark.range(10).orderBy(F.desc("id")), 4)
    assert cut and sorted(r.id for r in page.collect()) == [6, 7, 8, 9]
    assert not SEM.capped(spark.range(4), 4)[1]


# ----------------------------------------------------------------- forecast
def test_double_trend_keeps_small_values(spark):
    df = spark.createDataFrame([(i, i * 1e-7) for i in range(1, 4)], "x int, y double")
    assert FC.fit_line(df, "x", "y").first().slope == pytest.approx(1e-7)
    wide = df.select("x", (F.col("x") * 10).cast("decimal(38,18)").alias("y"))
    assert FC.fit_line(wide, "x", "y").first().slope == pytest.approx(10)


def test_one_period_or_none_is_an_error(spark):
    one = spark.createDataFrame([(1, 5.0), (1, 6.0), (2, None)], "x int, y double")
    for df in (one, one.where("x > 5"), one.withColumn("y", F.col("y").cast("decimal(10,2)"))):
        with pytest.raises(FC.EmptyTrainingSet):
            FC.forecast_next(df, "x", "y")
    with pytest.raises(FC.EmptyTrainingSet):
        FC.forecast_next(one.where("x > 5").withColumn("g", F.lit(1)), "x", "y", ["g"])
    grouped = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 1.0)], "g string, x int, y double")
    fc = FC.forecast_next(grouped, "x", "y", ["g"])
    assert [r.prediccion_ventas for r in FC.prediction_table(fc, dt.date(2024, 1, 1)).collect()] == [3.0]


def test_run_forecast_refreshes_its_rollup(spark):
    hist = spark.createDataFrame([(i, 100.0 * i) for i in range(1, 6)], "historico_mes int, ventas_reales double")
    run = FC.run_forecast(spark, hist, "hist_r2", scratch_path(spark, "hist"), scratch_path(spark, "pred"), run_date=dt.date(2024, 1, 1))
    spark.sql("DROP TABLE hist_r2")
    assert run.predictions.first().prediccion_ventas == 600.0
    q = SEM.query(run.predictions, SEM.SALES_FORECAST, ["count"], ["modeloVersion"], rollups=[run.rollup])
    assert q.first()["count"] == 1


def test_scalars(spark):
    df = spark.createDataFrame([(0.575, "{}", {"a": 1}, dt.date(2024, 1, 2))], "x double, s string, m map<string,int>, d date")
    r = df.select(round_half_even("x").alias("x"), args_json(df, "s").alias("s"), args_json(df, "m").alias("m"), fmt_date("d").alias("d")).first()
    assert tuple(r) == (float(np.round(0.575, 2)), "{}", '{"a":1}', "2024-01-02")


def test_broadcast_bound_is_rows_and_bytes(spark):
    df = spark.range(100).withColumn("wide", F.repeat(F.lit("x"), 1000))
    hinted = "ResolvedHint"
    assert hinted in bounded_broadcast(df, 1000)._jdf.queryExecution().analyzed().toString()
    assert hinted not in bounded_broadcast(df, 99)._jdf.queryExecution().analyzed().toString()
    assert hinted not in bounded_broadcast(df, 1000, 50_000)._jdf.queryExecution().analyzed().toString()


# ---------------------------------------------------------------- pipelines
def test_replace_drops_partitions_also_when_the_session_says_dynamic(spark):
    path = scratch_path(spark, "replace")
    two = spark.createDataFrame([(1, 202401), (2, 202402)], "id int, ym int")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        materialize_table(two, path, partition_by=["ym"])
        assert materialize_table(two.where("ym = 202401"), path, partition_by=["ym"]).count() == 1
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")


def test_versioned_table(spark):
    t = VersionedTable(spark, scratch_path(spark, "versioned"), "ym")
    rows = spark.createDataFrame([(i, 202400 + i % 3) for i in range(9)], "id int, ym int")
    before = t.replace(rows)
    after = t.replace_partitions(rows.where("ym = 202401 and id < 4"), [202401, 202402])
    assert sorted(r.id for r in after.collect()) == [0, 1, 3, 6]
    assert before.count() == 9  # a reader of the old version is not disturbed
    assert t.replace(rows.where("ym = 1")).count() == 0


def _bronze(spark, rows):
    return spark.createDataFrame([(*r, dt.datetime(2024, 5, 1), 0) for r in rows],
                                 "id long, user_id long, product_id long, status string, amount double, order_date date, "
                                 "updated_at timestamp_ntz, _offset long, _synced_at timestamp_ntz, _is_deleted int")


def _dims(spark):
    t = dt.datetime(2024, 1, 1)
    p = spark.createDataFrame([(1, "p", "c", 1.0, t, t, 0)], "id long, name string, category string, price double, updated_at timestamp_ntz, _synced_at timestamp_ntz, _is_deleted int")
    u = spark.createDataFrame([(1, "u", "e@x", "MX", t, t, t, 0)], "id long, name string, email string, country string, created_at timestamp_ntz, updated_at timestamp_ntz, _synced_at timestamp_ntz, _is_deleted int")
    return p, u


def test_run_medallion_gates_before_it_publishes(spark):
    p, u = _dims(spark)
    good = (1, 1, 1, "completed", 5.0, dt.date(2024, 1, 2), dt.datetime(2024, 1, 2), 1)
    assert MD.run_medallion(spark, _bronze(spark, [good]), p, u).gold.count() == 1
    orphan = (2, 1, 99, "completed", 5.0, dt.date(2024, 1, 2), dt.datetime(2024, 1, 2), 1)
    path = scratch_path(spark, "gated")
    with pytest.raises(Q.QualityGateError, match="product_id relationships=1"):
        MD.run_medallion(spark, _bronze(spark, [good, orphan]), p, u, path)
    assert VersionedTable(spark, path, MD.MONTH).version() is None
    old = (3, 1, 1, "completed", 5.0, dt.date(1969, 1, 2), dt.datetime(2024, 1, 2), 1)
    with pytest.raises(Q.QualityGateError, match="in_range"):
        MD.run_medallion(spark, _bronze(spark, [old]), p, u)


def test_run_incremental_equals_a_full_run_and_writes_touched_months(spark):
    p, u = _dims(spark)
    d = dt.datetime
    first = [(i, 1, 1, "completed", 10.0 + i, dt.date(2024, 1 + i % 4, 5), d(2024, 5, 1), i) for i in range(8)]
    second = [(1, 1, 1, "completed", 99.0, dt.date(2024, 4, 5), d(2024, 5, 2), 20),          # moves from February to April
              (2, 1, 1, "weird", 1.0, dt.date(2024, 3, 5), d(2024, 5, 2), 21),
              (6, 1, 1, "unknown", 1.0, dt.date(2024, 3, 5), d(2024, 5, 2), 22)]              # March is emptied
    landing, bronze, ckpt, gold = (scratch_path(spark, n) for n in ("l", "b", "c", "g"))
    for rows in (first, second):
        part = _bronze(spark, rows)
        part.coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(part.schema).parquet(landing)
        res = MD.run_incremental(spark, stream, bronze, lambda s: s, p, u, ckpt, gold)
    full = MD.run_medallion(spark, _bronze(spark, first + second), p, u, order_tiebreak=["_offset"]).gold
    key = lambda df: sorted((r.order_id, r.amount_usd, r.order_ym) for r in df.collect())
    assert key(res.gold) == key(full) and res.months == [202402, 202403, 202404]
    assert 202403 not in {r.order_ym for r in res.gold.collect()}
    stream = spark.readStream.schema(_bronze(spark, first).schema).parquet(landing)
    again = MD.run_incremental(spark, stream, bronze, lambda s: s, p, u, ckpt, gold)
    assert again.months == [] and key(again.gold) == key(full)


def test_business_zone_reaches_gold(spark):
    p, u = _dims(spark)
    o = _bronze(spark, [(1, 1, 1, "completed", 5.0, dt.date(2024, 1, 1), dt.datetime(2024, 1, 2), 1)])
    o = o.withColumn("order_date", F.lit("2024-02-01 03:00:00").cast("timestamp"))
    row = MD.run_medallion(spark, o, p, u, tz="America/Mexico_City").gold.first()
    assert (row.order_date, row.order_ym) == (dt.date(2024, 1, 31), 202401)


# ------------------------------------------------------------------- alerts
def _alerts(spark, batches, **kw):
    """Alerts of ``batches`` of (series, second, value), each one micro-batch."""
    from stratum.streaming import latest_stream as LS
    from stratum.streaming.alerts import alert_stream
    t0, landing, out = dt.datetime(2024, 1, 1), scratch_path(spark, "alert-in"), scratch_path(spark, "alert-out")
    schema = "series string, ts timestamp, value double"
    for rows in batches:
        df = spark.createDataFrame([(s, t0 + dt.timedelta(seconds=t), v) for s, t, v in rows], schema)
        df.coalesce(1).write.mode("append").parquet(landing)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landing)
    LS.await_done(LS.write_versions(alert_stream(stream, "series", "ts", "value", 30, 60, watermark="0 seconds", **kw), out, output_mode="append"))
    return sorted((r.series, (r.start_ts - t0).total_seconds(), (r.fired_ts - t0).total_seconds()) for r in spark.read.parquet(out).collect())


def test_alert_fires_without_a_new_sample(spark):
    batches = [[("a", 0, 40.0), ("b", 0, 1.0)], [("b", 50, 1.0)], [("b", 200, 1.0)], [("b", 300, 1.0)], [("b", 400, 1.0)]]
    assert _alerts(spark, batches) == []
    assert _alerts(spark, batches, fire_when_silent=True) == [("a", 0.0, 60.0)]
    assert _alerts(spark, [*batches, [("a", 500, 40.0), ("b", 500, 1.0)]], fire_when_silent=True) == [("a", 0.0, 60.0)]


def test_alert_drops_samples_older_than_the_last(spark):
    batches = [[("a", 100, 40.0)], [("a", 20, 1.0), ("a", 170, 40.0)]]
    assert _alerts(spark, batches, idle_timeout_s=None) == [("a", 100.0, 170.0)]
