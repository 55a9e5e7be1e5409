"""Two-run queries: the log is written once, as landing files, and shuffle files go with their query."""
import time

from pyspark.sql import functions as F

from stratum import fixtures as fx
from stratum import registry as R
from stratum.session import shuffles_removed
from stratum.sources.cdc import RECORD_SCHEMA
from stratum_test_data import SF_SMALL


def test_halves_hold_the_log_by_time(spark):
    early, late = (spark.read.schema(RECORD_SCHEMA).json(p) for p in R._spooled_halves(spark, SF_SMALL))
    log = fx.change_log(spark, SF_SMALL).select(early.columns)
    both = early.unionByName(late)
    assert log.exceptAll(both).isEmpty() and both.count() == log.count()
    assert early.where("timestamp is null").count() == 1 and late.where("timestamp is null").isEmpty()
    assert early.agg(F.max("timestamp")).first()[0] < late.agg(F.min("timestamp")).first()[0]


def test_incremental_runs_stage_no_log(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("the log is staged beside its landing files")

    monkeypatch.setattr(R, "staged", refuse)
    assert R.REGISTRY["run_incremental"](spark, SF_SMALL).count() > 0


def test_shuffle_files_go_with_their_query(spark, tmp_path):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {f for f in blocks.getAllFiles().mkString(",").split(",") if "shuffle_" in f}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    had, before = spark.conf.get(key), files()
    with shuffles_removed(spark):
        spark.range(10000).groupBy((F.col("id") % 7).alias("k")).count().write.parquet(f"{tmp_path}/out")
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(key) == had
