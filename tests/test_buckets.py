"""Latest rows by key-hash bucket: a batch rewrites the buckets that it meets."""

import os

import pytest

from stratum.operators.latest import latest_by_key
from stratum.plans import buckets as B
from stratum.session import scratch_path

SCHEMA = "id long, version int, v string"


def _files(path):
    return {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("bucket=")}


def _table(spark, path=None):
    return B.BucketedLatest(spark, path or scratch_path(spark, "bucketed"), ["id"], "version", ["v"], buckets=16)


def _rows(df):
    return sorted(map(tuple, df.select("id", "version", "v").collect()), key=str)


def test_touched_buckets_only(spark):
    log = [(i, n, f"{i}-{n}") for i in range(200) for n in range(3)] + [(None, 1, "null key")]
    batch = [(3, 9, "new"), (3, 9, "newer"), (4, 1, "late"), (777, 1, "first"), (777, 1, "first"), (None, 2, "null again")]
    t = _table(spark)
    t.merge(spark.createDataFrame(log, SCHEMA))
    before = _files(t.path.removeprefix("file:"))
    touched = t.merge(spark.createDataFrame(batch, SCHEMA))
    after = _files(t.path.removeprefix("file:"))
    assert len(touched) <= 4
    assert {d for d in after if after[d] != before.get(d)} == {f"bucket={n}" for n in touched}
    whole = latest_by_key(spark.createDataFrame(log + batch, SCHEMA), ["id"], "version", ["v"])
    assert _rows(t.read()) == _rows(whole)
    # the same batch again and an empty one change no row
    t.merge(spark.createDataFrame(batch, SCHEMA))
    assert t.merge(spark.createDataFrame([], SCHEMA)) == []
    assert _rows(t.read()) == _rows(whole)


def test_merge_reads_touched_buckets(spark):
    t = _table(spark)
    t.merge(spark.createDataFrame([(i, 1, "a") for i in range(100)], SCHEMA))
    plan = t.read([2, 5])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "(2,5)" in plan.replace(" ", "")


def test_interrupted_swap_is_done_again(spark, monkeypatch):
    t = _table(spark)
    t.merge(spark.createDataFrame([(i, 1, "a") for i in range(50)], SCHEMA))
    real = t._by_bucket

    def dies(df, path, mode):
        if mode == "dynamic":
            raise RuntimeError("driver lost")
        real(df, path, mode)

    monkeypatch.setattr(t, "_by_bucket", dies)
    with pytest.raises(RuntimeError):
        t.merge(spark.createDataFrame([(7, 2, "b")], SCHEMA))
    again = _table(spark, t.path)
    assert (7, 2, "b") in _rows(again.read()) and again.read().count() == 50


def test_layout_is_kept_and_empty_refused(spark):
    t = _table(spark)
    with pytest.raises(ValueError, match="no rows"):
        t.read()
    with pytest.raises(ValueError, match="another number"):
        B.BucketedLatest(spark, t.path, ["id"], "version", buckets=8)
