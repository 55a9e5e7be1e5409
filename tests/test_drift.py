"""VARIANT bronze: fields that come, go and change their type."""

import json

from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from stratum.sources.drift import conform, drift_report, variant_bronze

ROW = StructType([StructField("id", LongType()), StructField("qty", DoubleType()), StructField("tag", StringType())])


def _bronze(spark, tmp_path, values):
    rows = [("shop.public.t", 0, i, None, v if v is None or isinstance(v, str) else json.dumps(v))
            for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "topic string, partition int, offset long, key string, value string")
    variant_bronze(df).write.parquet(str(tmp_path / "bronze"))
    return spark.read.parquet(str(tmp_path / "bronze"))


def test_conform_and_report(spark, tmp_path):
    b = _bronze(spark, tmp_path, [
        {"op": "c", "after": {"id": 1, "qty": 2.5, "tag": "a"}},
        {"op": "u", "after": {"id": 1, "qty": "7", "tag": None, "new": {"x": 1}}},
        {"op": "u", "after": {"id": 2, "qty": "many", "new": 5, "more": [1]}},
        {"op": "d", "before": {"id": 2}},
        None, "{oops", {"op": "x", "after": {"id": 1}}, {"op": "u", "after": None},
        {"op": "u", "after": {"qty": 1}}, {"op": "u", "after": {"id": None}}, {"op": "u", "after": [1]}])
    assert [r["offset"] for r in b.where("bad").orderBy("offset").collect()] == [5, 6, 7, 8, 9, 10]
    got = [tuple(r) for r in conform(b, ROW).orderBy("_offset").collect()]
    assert got == [
        (1, 2.5, "a", "c", 0, None, ""),
        (1, 7.0, None, "u", 1, '{"new":{"x":1}}', "qty"),
        (2, None, None, "u", 2, '{"more":[1],"new":5}', "qty"),
        (2, None, None, "d", 3, None, "")]
    report = {(r["field"], r["status"]): (r["found"], r["records"]) for r in drift_report(b, ROW).collect()}
    assert report == {("qty", "retyped"): ("STRING", 2), ("qty", "missing"): ("VOID", 1), ("tag", "missing"): ("VOID", 3),
                      ("new", "added"): ("VARIANT", 2), ("more", "added"): ("ARRAY<BIGINT>", 1)}


def test_empty_and_steady(spark, tmp_path):
    b = _bronze(spark, tmp_path, [{"op": "c", "after": {"id": 1, "qty": 1, "tag": ""}}])
    assert drift_report(b, ROW).count() == 0
    assert conform(b.limit(0), ROW).columns == ["id", "qty", "tag", "op", "_offset", "rest", "retyped"]
    assert drift_report(b.limit(0), ROW).count() == 0


def test_report_names_every_deviation_of_a_record(spark, tmp_path):
    b = _bronze(spark, tmp_path, [
        {"op": "c", "after": {"id": "9", "qty": {"n": 1}, "tag": ["a"], "x": None, "y": True}},
        {"op": "c", "after": {"id": 1, "qty": False, "tag": 5, "y": 1.5}}, {"op": "c", "after": {"id": 2}}])
    report = {(r["field"], r["status"]): (r["found"], r["records"]) for r in drift_report(b, ROW).collect()}
    assert report == {("id", "retyped"): ("STRING", 1), ("qty", "retyped"): ("VARIANT", 2), ("qty", "missing"): ("VOID", 1),
                      ("tag", "retyped"): ("VARIANT", 2), ("tag", "missing"): ("VOID", 1),
                      ("x", "added"): ("VOID", 1), ("y", "added"): ("VARIANT", 2)}
    rest = [r["rest"] for r in conform(b, ROW).orderBy("_offset").collect()]
    assert rest == ['{"x":null,"y":true}', '{"y":1.5}', None]


def test_a_field_is_taken_out_of_its_image_once(spark, tmp_path):
    b = _bronze(spark, tmp_path, [{"op": "c", "after": {"id": 1, "qty": 1, "tag": ""}}])
    plan = drift_report(b, ROW)._jdf.queryExecution().optimizedPlan().toString()
    # a type per field, and that of a deviation
    assert plan.count("schemaOfVariant(") == len(ROW.fields) + 1


def test_bronze_is_written_whole(spark):
    import pyarrow.parquet as pq
    from stratum.registry import _drifting_bronze
    from stratum_test_data import SF_SMALL
    files = [f.removeprefix("file:") for f in _drifting_bronze(spark, SF_SMALL).inputFiles()]
    assert files and not any("typed_value" in str(pq.ParquetFile(f).schema) for f in files)
    assert spark.conf.get("spark.sql.variant.inferShreddingSchema") == "true"
