from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as P
from stratum.llm.quality_knn import KEEP, fit
from test_bagminhash import brute_classes
from test_line_dedup import brute as brute_lines
from test_mixing import brute as brute_mix

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs.collect())
    for name, stage in P.STAGES:
        docs = P.staged(stage(spark, docs, SF), "test-stage")
        out.append(docs.collect())
    return out


def rows(found):
    return Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in found)


def test_quality_stage(spark, stages):
    import pyarrow as pa
    model = fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    keep = model.scores(pa.array([r["text"] for r in stages[0]])) >= KEEP
    assert rows(stages[1]) == rows([r for r, k in zip(stages[0], keep) if k])
    assert 0 < len(stages[1]) < len(stages[0])


def test_line_stage(stages):
    drops = brute_lines([(r["doc_id"], r["text"]) for r in stages[1]])
    want = Counter()
    for r in stages[1]:
        drop = drops[r["doc_id"], r["text"]]
        text = "\n".join(x for i, x in enumerate(r["text"].split("\n")) if i not in drop)
        if not drop:
            want[tuple(r)] += 1
        elif text.strip():
            want[r["doc_id"], text, r["lang"], r["source"], len(text)] += 1
    assert rows(stages[2]) == want and any(drops.values())


def test_near_dedup_stage(stages):
    classes = brute_classes([(r["doc_id"], r["text"]) for r in stages[2]])
    keep = {c for _, c, _ in classes}
    assert rows(stages[3]) == rows([r for r in stages[2] if r["doc_id"] in keep])


def test_mixing_stage(stages):
    want = Counter()
    for r, taken in zip(stages[3], brute_mix([(r["doc_id"], r["text"], r["source"]) for r in stages[3]])):
        if taken["copies"]:
            want[tuple(r)] += taken["copies"]
    assert rows(stages[4]) == want


def test_encoding_stage(stages):
    theirs = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert rows(stages[5]) == rows(stages[4])
    for r in stages[5]:
        assert r["input_ids"] == theirs.encode(r["text"]) and r["n_tokens"] == len(r["input_ids"]) and r["round_trip"]


def test_run_on_odd_rows(spark, docs_of, monkeypatch):
    docs = docs_of([(None, None), (1, ""), (2, "x " * 40000), (2, "x " * 40000), (3, "a line of more than thirty-two characters"),
                    (4, "a line of more than thirty-two characters!"), (5, None, None)])
    monkeypatch.setattr(P, "documents", lambda spark, d: docs.withColumn("score", F.lit(1)))
    assert {r["doc_id"] for r in P.run(spark, SF).collect()} <= {None, 1, 2, 3, 5}
    monkeypatch.setattr(P, "documents", lambda spark, d: docs.where("doc_id > 9"))
    assert P.run(spark, SF).count() == 0
