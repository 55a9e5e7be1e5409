"""Range sums of DOUBLE counters: blocks instead of a moving frame."""

import datetime as dt
import math
import random
import re
import time

from pyspark.sql import functions as F

from stratum.operators import monitor as M

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "series string, ts timestamp_ntz, value double, i int"


def brute(rows, window_s):
    """increase per i, from the definition."""
    out, by = {}, {}
    for s, ts, v, i in sorted(rows, key=lambda r: (r[0], r[1], r[3])):
        by.setdefault(s, []).append((ts, v, i))
    for samples in by.values():
        deltas = []
        for k, (ts, v, i) in enumerate(samples):
            prev = samples[k - 1][1] if k else None
            deltas.append(None if v is None and prev is not None else 0.0 if prev is None else v if v < prev else v - prev)
        for ts, _, i in samples:
            inside = [d for (t, *_), d in zip(samples, deltas)
                      if ts - dt.timedelta(seconds=window_s) <= t <= ts and d is not None]
            out[i] = math.fsum(inside) if inside else None
    return out


def increases(spark, rows, window_s, **kw):
    r = M.counter_rate(spark.createDataFrame(rows, SCHEMA), ["series"], window_s, tiebreak=["i"], **kw)
    return {x.i: x.increase for x in r.select("i", "increase").collect()}


def same(a, b):
    return a.keys() == b.keys() and all(
        x == y or (x is not None and b[i] is not None and math.isclose(x, b[i], rel_tol=1e-12, abs_tol=1e-9))
        for i, x in a.items() for y in [b[i]])


def test_brute_force_over_windows_and_slices(spark):
    rnd = random.Random(5)
    rows = [("ab"[rnd.random() < 0.2], T0 + dt.timedelta(seconds=rnd.choice([0, rnd.randrange(4000), 60 * rnd.randrange(60)])),
             None if rnd.random() < 0.05 else rnd.choice([rnd.random() * 1e6, float(rnd.randrange(9))]), i)
            for i in range(500)]
    for window in (1, 60, 61, 900, 100_000):
        want = brute(rows, window)
        got = increases(spark, rows, window)
        assert same(got, want)
        # slices of few rows give the very same bits: blocks lie on the time axis
        sliced = increases(spark, rows, window, target_rows=20, bucket_s=max(600, window))
        assert same(sliced, want)
    assert increases(spark, rows[:0], 60) == {}


def test_edges_of_the_range(spark):
    rows = [("s", T0 + dt.timedelta(seconds=60 * k), float(k * k), k) for k in range(8)]
    got = increases(spark, rows, 60)  # both ends belong to the range
    assert got == {0: 0.0, **{k: float(k * k - max(k - 2, 0) ** 2) for k in range(1, 8)}}
    before = [("s", dt.datetime(1969, 12, 31, 23, 59, 59) + dt.timedelta(seconds=k), float(k), k) for k in range(4)]
    assert increases(spark, before, 1) == {0: 0.0, 1: 1.0, 2: 2.0, 3: 2.0}


def test_infinity_stays_in_its_range(spark):
    rows = [("s", T0 + dt.timedelta(seconds=7 * k), math.inf if k == 20 else float(k), k) for k in range(60)]
    got = increases(spark, rows, 70)
    assert {k for k, v in got.items() if not math.isfinite(v)} == set(range(20, 31))


def test_every_frame_only_grows(spark):
    df = spark.createDataFrame([("s", T0, 1.0, 1)], SCHEMA)
    for extrapolate in (False, True):
        r = M.counter_rate(df, ["series"], 3600, tiebreak=["i"], extrapolate=extrapolate)
        plan = r._jdf.queryExecution().executedPlan().toString()
        frames = re.findall(r"specifiedwindowframe\(RangeFrame, ([^,]+),", plan)
        assert frames and set(frames) == {"unboundedpreceding$()"}


def test_time_does_not_grow_with_the_window(spark):
    n = 60_000
    df = spark.range(n).select(F.lit("s").alias("series"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"),
                               F.col("id").cast("double").alias("value"), F.col("id").cast("int").alias("i"))

    def took(window):
        at = time.monotonic()
        total = M.counter_rate(df, ["series"], window, tiebreak=["i"], bucket_s=10 * n).agg(F.sum("increase")).first()[0]
        assert total == sum(min(k, window + 1) for k in range(n))
        return time.monotonic() - at

    took(10)
    short, long = took(10), took(n // 2)  # a moving frame would add 1.4 billion numbers
    assert long < 4 * short + 2


def test_last_slice_is_as_wide_as_the_window(spark):
    # 250 s do not divide an hour: a rest of 100 s would lie between slices that need each other's samples
    rows = [("s", T0 + dt.timedelta(seconds=5 * k), float(k), k) for k in range(1500)]
    assert increases(spark, rows, 250, bucket_s=3600, target_rows=8) == {k: float(min(k, 51)) for k in range(1500)}
    whole = spark.createDataFrame([(s, t, int(v), i) for s, t, v, i in rows], SCHEMA.replace("double", "long"))
    r = M.counter_rate(whole, ["series"], 250, tiebreak=["i"], bucket_s=3600, target_rows=8)
    assert {x.i: x.increase for x in r.collect()} == {k: min(k, 51) for k in range(1500)}
