"""Stream queries leave no landing files, checkpoint or shuffle files behind, and keep their dealing."""
import os
import time

import pytest
from pyspark.sql import functions as F

from stratum import registry as R
from stratum.session import child_names, shared_dir
from stratum.sources.cdc import RECORD_SCHEMA
from stratum_test_data import SF_SMALL


def _shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for f in blocks.getAllFiles().mkString(",").split(",") if "shuffle_" in f}


@pytest.mark.parametrize("name, kept", [("stream_latest", "stream-latest"), ("rate_grid_stream", "rate-grid")])
def test_only_the_output_stays(spark, name, kept):
    folder = f"{shared_dir(spark)}/stratum"
    before, shuffles = set(child_names(spark, folder)), _shuffle_files(spark)
    out = R.REGISTRY[name](spark, SF_SMALL)
    assert {c.rsplit("-", 1)[0] for c in set(child_names(spark, folder)) - before} == {kept}
    until = time.time() + 20
    while _shuffle_files(spark) - shuffles and time.time() < until:
        time.sleep(0.2)
    assert not _shuffle_files(spark) - shuffles
    assert out.count() > 0


def test_versions_of_a_key_land_in_different_batches_without_a_shuffle(spark):
    path = R._stream_change_files(spark, SF_SMALL)
    found = spark.read.schema(RECORD_SCHEMA).json(path).select("key", "offset", F.input_file_name().alias("f"))
    files = sorted((c for c in child_names(spark, path) if c.startswith("part-")),
                   key=lambda c: os.path.getmtime(f"{path.removeprefix('file:')}/{c}"))
    slots = [c.split("-")[1] for c in files]
    assert slots == sorted(slots)
    slot = F.regexp_extract("f", r"/part-(\d+)-", 1)
    assert found.select(slot).distinct().count() == R.CHANGE_FILES
    # neighbouring versions are never in one slot; records of a slot may be in many files
    near = found.groupBy("key", "offset").agg(F.first(slot).alias("slot"))
    same = near.alias("a").join(near.alias("b"), F.expr("a.key = b.key and a.offset + 1 = b.offset and a.slot = b.slot"))
    assert same.isEmpty()
