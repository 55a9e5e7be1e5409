import datetime as dt

from stratum.streaming import latest_stream as LS
from stratum.streaming.alerts import alert_stream

T0 = dt.datetime(2024, 1, 1)


def _run(spark, landing, out, ckpt, **kw):
    schema = "series string, ts timestamp_ntz, value double, eid long"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landing)
    alerts = alert_stream(stream, "series", "ts", "value", 30, 60, tiebreak="eid", **kw)
    LS.await_done(LS.write_versions(alerts, out, ckpt, output_mode="append"))
    return sorted((r.start_ts, r.fired_ts) for r in spark.read.parquet(out).collect())


def test_alert_stream_idle_gap(spark, tmp_path):
    schema = "series string, ts timestamp_ntz, value double, eid long"
    landing = str(tmp_path / "landing")
    first = [("a", T0 + dt.timedelta(seconds=s), 40.0, s) for s in (0, 30, 60, 90)]
    later = [("a", T0 + dt.timedelta(seconds=7200 + s), 40.0, 7200 + s) for s in (0, 30, 60, 90)]
    spark.createDataFrame(first, schema).coalesce(1).write.mode("append").parquet(landing)
    spark.createDataFrame(later, schema).coalesce(1).write.mode("append").parquet(landing)
    plain = _run(spark, landing, str(tmp_path / "o1"), str(tmp_path / "c1"))
    assert plain == [(T0, T0 + dt.timedelta(seconds=60))]           # one streak across the gap
    idle = _run(spark, landing, str(tmp_path / "o2"), str(tmp_path / "c2"), idle_timeout_s=600)
    assert idle == [(T0, T0 + dt.timedelta(seconds=60)),
                    (T0 + dt.timedelta(seconds=7200), T0 + dt.timedelta(seconds=7260))]


def test_batch_max_gap_matches_stream_idle(spark):
    from pyspark.sql import functions as F
    from stratum.operators.monitor import alert_intervals
    rows = [("a", T0 + dt.timedelta(seconds=s), 40.0, s)
            for s in (0, 30, 60, 90, 7200, 7230, 7260, 7290)]
    df = spark.createDataFrame(rows, "series string, ts timestamp_ntz, value double, eid long")
    plain = alert_intervals(df, ["series"], F.col("value") > 30, 60, tiebreak=["eid"])
    assert plain.count() == 1
    stale = alert_intervals(df, ["series"], F.col("value") > 30, 60, tiebreak=["eid"],
                            max_gap_s=600)
    assert sorted(r.start_ts for r in stale.collect()) == [T0, T0 + dt.timedelta(seconds=7200)]
