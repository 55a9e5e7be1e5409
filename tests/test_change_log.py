"""The order change log: arrival numbers by either way of counting, and its landing folder."""
import os

from pyspark.sql import functions as F

from stratum import fixtures as fx
from stratum.registry import _stream_change_files
from stratum.sources.cdc import RECORD_SCHEMA
from stratum.streaming import latest_stream as LS
from stratum_test_data import SF_SMALL


def test_hot_blocks_are_numbered_like_others(spark):
    plain = fx.numbered_orders(spark, SF_SMALL)
    blocks = [r[0] for r in plain.groupBy(F.floor(F.col("id") / 1000)).count().select("count").collect()]
    assert min(blocks) <= 400 < max(blocks)
    sliced = fx.numbered_orders(spark, SF_SMALL, hot_rows=400)   # some blocks are hot, some are not
    cols = ["id", "updated_at", *fx.ORDER_TIEBREAK, "seq"]
    assert plain.count() == sliced.count() == fx.bronze_orders(spark, SF_SMALL).count()
    assert plain.select(cols).exceptAll(sliced.select(cols)).isEmpty()
    assert plain.groupBy("id").agg(F.max("seq").alias("m"), F.count("*").alias("n"), F.countDistinct("seq").alias("d")) \
        .where("m <> n or d <> n").isEmpty()


def test_landed_changes_are_compressed_and_whole(spark):
    path = _stream_change_files(spark, SF_SMALL)
    local = path.removeprefix("file:")
    sizes = [os.path.getsize(f"{local}/{n}") for n in os.listdir(local) if n.startswith("part-")]
    landed = spark.read.schema(RECORD_SCHEMA).json(path)
    log = fx.change_log(spark, SF_SMALL).select(landed.columns)
    assert landed.count() == log.count() and log.exceptAll(landed).isEmpty()
    assert sum(sizes) * 4 < log.agg(F.sum(F.length("value"))).first()[0]


def test_streams_are_awaited_to_their_end():
    class Slow:
        isActive, waited = False, []

        def awaitTermination(self, timeout=None):
            self.waited.append(timeout)

        def exception(self):
            return None

    LS.await_done(Slow())
    assert Slow.waited == [None]
