"""Property: latest_by_key equals a plain-Python reference on random logs,
whatever the input order and partitioning."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from stratum.operators.latest import latest_by_key, live

versions = st.lists(
    st.tuples(st.integers(0, 4),            # key
              st.integers(0, 5),            # version (ties likely)
              st.integers(0, 1),            # deleted
              st.integers(0, 10 ** 6)),     # arrival offset (unique below)
    min_size=1, max_size=40, unique_by=lambda r: r[3])


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=versions, parts=st.integers(1, 4))
def test_latest_matches_reference(spark, rows, parts):
    base = dt.datetime(2024, 1, 1)
    data = [(k, base + dt.timedelta(days=v), d, off) for k, v, d, off in rows]
    df = spark.createDataFrame(data, "k long, v timestamp_ntz, deleted int, off long") \
              .repartition(parts)
    got = {r.k: (r.v, r.deleted, r.off)
           for r in latest_by_key(df, ["k"], "v", ["off"]).collect()}
    ref = {}
    for k, v, d, off in data:
        if k not in ref or (v, off) > (ref[k][0], ref[k][2]):
            ref[k] = (v, d, off)
    assert got == ref
    alive = {r.k for r in live(latest_by_key(df, ["k"], "v", ["off"]), "deleted").collect()}
    assert alive == {k for k, (_, d, _) in ref.items() if d == 0}


samples = st.lists(st.tuples(st.sampled_from(["a", "b"]),      # series
                             st.integers(0, 400),               # second (ties likely)
                             st.integers(0, 30)),               # counter value (resets)
                   min_size=1, max_size=60)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=samples, target=st.sampled_from([1, 4, 1 << 20]))
def test_counter_rate_matches_reference(spark, rows, target):
    from stratum.operators import monitor as M
    base = dt.datetime(2024, 1, 1)
    data = [(sid, base + dt.timedelta(seconds=sec), i, v) for i, (sid, sec, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "sid string, ts timestamp_ntz, eid long, value long")
    got = {r.eid: (r.delta, r.increase) for r in
           M.counter_rate(df, ["sid"], 60, tiebreak=["eid"], bucket_s=3600,
                          target_rows=target).collect()}
    ref = {}
    for sid in ("a", "b"):
        ser = sorted((t, e, v) for s, t, e, v in data if s == sid)
        deltas, prev = [], None
        for t, e, v in ser:
            d = 0 if prev is None else (v if v < prev else v - prev)
            deltas.append((t, e, d))
            prev = v
        for t, e, d in deltas:
            lo = t - dt.timedelta(seconds=60)
            ref[e] = (d, sum(x for tt, _, x in deltas if lo <= tt <= t))
    assert got == ref
