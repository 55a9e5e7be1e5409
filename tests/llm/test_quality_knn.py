import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratum.llm import quality_knn as Q
from stratum.llm.queries import op3_quality_knn

SF = "/root/testdata/sf0.01"


def auc(scores, marks):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    for s in np.unique(scores):
        ranks[scores == s] = ranks[scores == s].mean()
    good = marks == 1
    return (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_term_counts_are_words_and_shapes():
    a, b, c, e = Q.term_counts(pa.array(["The cat, the", "the the cat,", "", "THE the THE"]), 1 << 16)
    assert a.sum() == b.sum() == 9 and c.sum() == 0  # words, shapes, and the repeat class
    assert (a != b).any() and (e > 0).sum() == 4  # one word, two shapes, the repeat class


def test_repeated_share():
    codes, row = np.array([0, 1, 0, 1, 2, 2, 2, 5]), np.array([0, 0, 0, 0, 0, 1, 1, 1])
    assert Q.repeated_share(codes, row, 3).tolist() == [2 / 5, 1 / 3, 0]


def test_cosines_match_plain_numpy(spark, docs_of):
    rows = [(i, ("good plain words here and there " if i % 3 else "bad&&& junk$$$ more%%% ") + f"w{i % 7} v{i % 5}") for i in range(60)]
    docs = docs_of(rows)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    model = Q.fit(docs, labels, sample=40, terms=512, rank=8, k=5)
    learnt = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(model.labels) == min(40, len(learnt))
    texts = pa.array([t for _, t in rows] + ["", "zzz"])
    latent = Q.unit_rows(model.tfidf(Q.term_counts(texts, 512)) @ model.projection)
    for i, s in enumerate(model.scores(texts)):
        cos = (model.vectors.astype(np.float64) @ latent[i])
        top = np.sort(cos)[::-1][:5]
        if top[-1] - np.sort(cos)[::-1][5] > 1e-4:
            near = np.argsort(-cos)[:5]
            w = np.maximum(cos[near], 0)
            want = (w * model.labels[near]).sum() / w.sum() if w.sum() > 1e-9 else model.prior
            assert s == pytest.approx(want, abs=1e-4)
    got = {r["doc"]["doc_id"]: r["score"] for r in Q.score(docs, model).collect()}
    assert all((got[i] > 0.7) == (i % 3 > 0) for i in got)


def test_edges(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (None, "x"), (4, "long " * 50000), (4, "again")]).withColumn("score", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in Q.score(docs, Q.fit(docs, none)).collect()] == [1.0] * 5
    some = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, 1, 0), (4, 0, 1), (None, 1, 0), (5, None, 0), (99, 1, 0)],
                                 "doc_id long, quality int, toxic int")
    model = Q.fit(docs, some)
    rows = Q.score(docs, model).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    empties = {r["score"] for r in rows if not r["doc"]["text"]}
    assert empties == {model.prior}
    assert Q.score(docs.where("doc_id > 50"), model).count() == 0
    assert Q.fit(docs.where("doc_id > 50"), some).prior == 1.0


def test_held_out_accuracy(spark):
    rows = {r["doc_id"]: r for r in op3_quality_knn(spark, SF).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows.values())
    marks = [(rows[r["doc_id"]]["score"], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()
             if rows[r["doc_id"]]["held_out"]]
    scores, truth = (np.array(x) for x in zip(*marks))
    assert auc(scores, truth) > 0.95
    assert (scores[truth == 1] >= 0.7).mean() > 0.95
    assert (scores[truth == 0] < 0.7).mean() > 0.9
