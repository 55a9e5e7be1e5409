"""Held-condition alerts on runs: equal to a plain walk over the samples, whatever the batches."""

import datetime as dt
import random

import numpy as np
import pytest

from stratum.session import scratch_path
from stratum.streaming import alerts as A
from stratum.streaming import latest_stream as LS

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "series string, ts timestamp, value double"


def walk(samples, hold, idle=None):
    """(start, fired) of the streaks of (t, on)."""
    out, since, last, fired = [], None, None, False
    for t, on in samples:
        if not on or (idle is not None and last is not None and t - last > idle):
            since, fired = None, False
        if on and since is None:
            since = t
        if on and not fired and t - since >= hold:
            out.append((since, t))
            fired = True
        last = t
    return out


@pytest.mark.parametrize("idle", [None, 9])
def test_runs_merge_to_the_same_streaks(idle):
    rng = random.Random(idle)
    for _ in range(400):
        times = sorted(rng.sample(range(200), rng.randint(1, 60)))
        on, samples = rng.random() < 0.5, []
        for t in times:
            on ^= rng.random() < 0.2
            samples.append((t, on))
        cuts = sorted(rng.sample(range(1, len(samples)), min(len(samples) - 1, rng.randint(0, 6))))
        state, fires, n = (False, -1, False, None), [], 0
        for a, b in zip([0, *cuts], [*cuts, len(samples)]):
            t, flags = (np.array(x) for x in zip(*samples[a:b]))
            for run in A.runs_of(t, flags, 12, idle):
                state, fire = A.advance(state, run, 12, idle)
                fires += [fire] if fire else []
                n += 1
        assert fires == walk(samples, 12, idle)


def landing(spark, batches, name):
    path = scratch_path(spark, name)
    for rows in batches:
        spark.createDataFrame([(s, T0 + dt.timedelta(seconds=t), v) for s, t, v in rows], SCHEMA) \
            .coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_one_series_holds_all_rows(spark):
    """Runs, not samples, reach the state function: 6,000 samples of one series become a few runs."""
    rows = [("a", t, 40.0 if t // 700 % 2 == 0 else 1.0) for t in range(6000)]
    batch = spark.createDataFrame([(s, t * 1_000_000, 0, v) for s, t, v in rows], "series string, t long, tb long, v double")
    runs = A.run_rows(batch.repartition(5), 30.0, 60_000_000, None).collect()
    assert sum(r.n for r in runs) == 6000 and len(runs) <= 9 + 2
    assert max(len(r.heads) for r in runs) <= 61
    stream = landing(spark, [rows[i:i + 1500] for i in range(0, 6000, 1500)], "one-series")
    out = scratch_path(spark, "one-series-out")
    LS.await_done(LS.write_versions(A.alert_stream(stream, "series", "ts", "value", 30, 60, idle_timeout_s=None), out,
                                    output_mode="append"))
    found = sorted(((r.start_ts - T0).total_seconds(), (r.fired_ts - T0).total_seconds())
                   for r in spark.read.parquet(out).collect())
    assert found == walk([(t, v > 30) for _, t, v in rows], 60)


def test_heartbeat_moves_time_when_all_are_silent(spark):
    batches = [[("a", 0, 40.0), ("b", 0, 40.0)], [("a", 30, 40.0), ("b", 30, 1.0)]]
    for beat in (False, True):
        samples = landing(spark, batches, "silent")
        beats = landing(spark, [[("", t, None)] for t in (10, 40, 200, 400, 600)], "beats") if beat else None
        out = scratch_path(spark, "silent-out")
        LS.await_done(LS.write_versions(A.alert_stream(
            samples, "series", "ts", "value", 30, 60, watermark="0 seconds", fire_when_silent=True, heartbeat=beats),
            out, output_mode="append"))
        found = [(r.series, (r.fired_ts - T0).total_seconds()) for r in spark.read.parquet(out).collect()]
        assert found == ([("a", 60.0)] if beat else [])


@pytest.mark.parametrize("idle", [None, 9])
def test_runs_of_many_series_at_once(spark, idle):
    """One pass over a partition gives each series' runs, and in few batches (one per series and slice before)."""
    rng, groups, t, on, expected = random.Random(5), [], [], [], []
    for _ in range(300):
        times = np.array(sorted(rng.sample(range(-100, 100), rng.randint(1, 40))))
        flags = np.array([rng.random() < 0.7 for _ in times])
        groups.append(sum(map(len, t)))
        t.append(times)
        on.append(flags)
        expected += A.runs_of(times, flags, 12, idle)
    t, on = np.concatenate(t), np.concatenate(on)
    c = A.run_columns(t, on, np.array(groups), 12, idle)
    found = [{"on": bool(o), "first_t": f, "last_t": e, "n": n, "fired_t": None if d == A.NOT_FIRED else d,
              "heads": t[a:a + h].tolist()}
             for a, o, f, e, n, d, h in zip(*(v.tolist() for v in c.values()))]
    assert found == expected and any(r["fired_t"] for r in found) and any(len(r["heads"]) > 1 for r in found)
