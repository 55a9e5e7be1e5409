"""Merged buckets are written once, by the tasks that found their rows, and swapped in as folders."""
import os

import pytest
from pyspark.sql import functions as F

from stratum.plans import buckets as B
from stratum.session import scratch_path

SCHEMA = "id long, version int, v string"


def _table(spark, path=None):
    return B.BucketedLatest(spark, path or scratch_path(spark, "bucketed"), ["id"], "version", ["v"], buckets=16)


def _files(path):
    local = path.removeprefix("file:")
    return {(d, f) for d in os.listdir(local) if d.startswith("bucket=")
            for f in os.listdir(f"{local}/{d}") if f.startswith("part-")}


def test_written_once_and_one_file_per_bucket(spark, monkeypatch):
    t, written = _table(spark), set()
    real = t._by_bucket

    def seen(df, path, mode):
        real(df, path, mode)
        if mode == "static":
            written.update(_files(path))

    monkeypatch.setattr(t, "_by_bucket", seen)
    had = spark.conf.get(B.PARTITIONS)
    for n in (1, 2):
        t.merge(spark.range(5000).select("id", F.lit(n).alias("version"), F.lit("x").alias("v")).repartition(7))
    assert _files(t.path) <= written and len(_files(t.path)) == 16
    assert spark.conf.get(B.PARTITIONS) == had
    assert t.read().where("version = 2").count() == t.read().count() == 5000


def test_swap_goes_on_after_some_buckets(spark, monkeypatch):
    t = _table(spark)
    t.merge(spark.range(200).select("id", F.lit(1).alias("version"), F.lit("a").alias("v")))
    real, moved = B.move_path, []

    def dies(spark, path, to):
        if len(moved) == 3:
            raise RuntimeError("driver lost")      # the old folder is gone, the new one not there yet
        moved.append(to)
        real(spark, path, to)

    monkeypatch.setattr(B, "move_path", dies)
    with pytest.raises(RuntimeError):
        t.merge(spark.range(200).select("id", F.lit(2).alias("version"), F.lit("b").alias("v")))
    monkeypatch.setattr(B, "move_path", real)
    again = _table(spark, t.path)
    assert again.read().where("version = 2 and v = 'b'").count() == again.read().count() == 200


def test_other_placement_is_refused(spark):
    path = scratch_path(spark, "bucketed")
    spark.createDataFrame([(16, "id")], "buckets int, keys string").write.parquet(f"{path}/_layout")
    with pytest.raises(ValueError, match="another number"):
        _table(spark, path)
