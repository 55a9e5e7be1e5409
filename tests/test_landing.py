"""Landing files of the stream queries: in time order, and of bounded rows also in a burst."""
import datetime as dt

from pyspark.sql import functions as F

from stratum.registry import _landing_in_time_order

T0 = dt.datetime(2024, 1, 1)


def files(spark, df, *args):
    landing = _landing_in_time_order(df, "ts", 4, *args)
    found = (spark.read.schema(df.schema).parquet(landing).select("*", "_metadata.file_modification_time", "_metadata.file_name")
             .groupBy("file_modification_time", "file_name")
             .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ts", "id")).alias("lo"), F.max(F.struct("ts", "id")).alias("hi"))
             .orderBy("file_modification_time").collect())
    return [(r.n, tuple(r.lo), tuple(r.hi)) for r in found]


def test_burst_is_several_files_in_time_order(spark):
    # half of the rows in one second of five days, a sixth at one time
    seconds = [i * 200 for i in range(2000)] + [400_000] * 1000
    rows = [(T0 + dt.timedelta(seconds=s), i) for i, s in enumerate(seconds)]
    rows += [(T0 + dt.timedelta(seconds=400_001, microseconds=i), 5000 + i) for i in range(3000)]
    df = spark.createDataFrame(rows + [(None, -1)], "ts timestamp_ntz, id long").repartition(3)
    found = files(spark, df, "id")
    assert sum(n for n, _, _ in found) == len(rows) + 1
    assert found[0][:2] == (1, (None, -1))
    assert max(n for n, _, _ in found) < len(rows) / 2.5
    assert all(a[2] < b[1] for a, b in zip(found[1:], found[2:]))


def test_without_times_and_empty(spark):
    df = spark.createDataFrame([(None, 1), (None, 2)], "ts timestamp_ntz, id long")
    assert [n for n, _, _ in files(spark, df)] == [2]
    assert files(spark, df.where("id > 5")) == []


def test_slices_come_from_one_write_and_few_batches(spark):
    from stratum.registry import LANDING_BATCHES, _landing_batches
    from stratum.session import child_names
    df = spark.createDataFrame([(T0 + dt.timedelta(seconds=i), i) for i in range(400)], "ts timestamp_ntz, id long")
    landing = _landing_in_time_order(df, "ts", 40, "id")
    names = [n for n in child_names(spark, landing) if n.startswith("part-")]
    writes = {n.split("-", 2)[2].split(".")[0].rsplit("-", 1)[0] for n in names}
    assert len(names) >= 40 and len(writes) <= 2     # the rows without a time, and all slices
    batches, per_batch = _landing_batches(spark, landing)
    assert batches <= LANDING_BATCHES and batches * int(per_batch) >= len(names)
