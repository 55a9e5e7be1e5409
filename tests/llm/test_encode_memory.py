"""The encoder works on small parts of a batch and returns the decoded text only where it is asked for."""
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from stratum.llm import sentencepiece_backend as S

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_parts_give_the_same_rows(spark, monkeypatch):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(
        F.lit("a  line\n"), F.repeat(F.concat(F.lit(" wörd"), F.col("id").cast("string"), F.lit(" 中")), 200)).alias("text")).coalesce(1)
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, " ")], "doc_id long, text string"))
    whole = S.encode_decode(docs, MODEL)
    bare = S.encode_decode(docs, MODEL, keep_decoded=False)
    assert bare.columns == [c for c in whole.columns if c != "decoded"]
    assert whole.drop("decoded").exceptAll(bare).isEmpty() and bare.count() == 303
    assert bare.where("round_trip").count() == 303


def test_parts_of_a_batch_are_bounded():
    assert S.PART_BYTES <= 1 << 19


def test_pipeline_does_not_ship_decoded_texts(spark):
    docs = spark.createDataFrame([(1, "some text", "en", "web", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    plan = corpus_pipeline.encode(spark, docs, "")._jdf.queryExecution().analyzed().toString()
    assert "decoded" not in plan
