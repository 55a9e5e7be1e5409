import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from stratum.llm import toxicity as T
from stratum.llm.queries import op11_toxicity

SF = "/root/testdata/sf0.1"


def test_folding():
    assert T.fold("1D10T!!") == T.fold("idiot") == T.fold("іdіоt") == T.fold("ｉｄｉｏｔ") == T.fold("i​diot")
    assert T.fold("l0ser") == T.fold("LOSER,") and T.fold("$cum") == T.fold("scum")
    assert T.fold("2048") == ["2048"] and T.fold("a-b") == ["a", "b"] and T.fold("...") == []
    assert T.fold("réeux") == ["réeux"] and T.fold("réeux") == ["réeux"]


def plain_hits(lexicon, text):
    """Row weights by comparing every word with every entry."""
    total, pieces = 0.0, text.split()
    for i, piece in enumerate(pieces):
        weight = sum(max((w for e, w in lexicon.weights.items() if f" {word} ".startswith(e)), default=0.0) for word in T.fold(piece))
        around = T.folded(" ".join(pieces[max(i - 1, 0):i + 2]))
        if weight and not any(p in around for p in lexicon.exceptions):
            total += weight
    return total


def test_matches_are_those_of_a_plain_search():
    rng = random.Random(2)
    words = ["idiot", "id10t", "idiom", "clown", "fish", "the", "loser/bracket", "los", "a", "Clown!", "scum,scum", "…"]
    lexicon = T.Lexicon({" idiot ": 3.0, " idi": 1.0, T.folded("clown"): 2.0, T.folded("scum"): 1.5, " ios": 0.5},
                        {T.folded("clown fish"): 1.0, T.folded("the idiot"): 1.0})
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(300)] + ["idiot " * 100_000, "x" * 200_000]
    x = lexicon.features(pa.array(texts))
    for text, row in zip(texts, x):
        total = plain_hits(lexicon, text) if len(text) < 1000 else {"i": 300_000.0, "x": 0.0}[text[0]]
        assert row.tolist() == pytest.approx([1, np.log1p(total), np.log1p(100 * total / max(len(text.split()), 1))])


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op11_toxicity(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    test = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p for p, t in test if t) >= 0.85 * sum(t for _, t in test)
    assert sum(p for p, t in test if not t) <= 0.02 * sum(1 - t for _, t in test)


def test_labels_of_held_out_rows_teach_nothing(spark, docs_of):
    rows = [(i, f"filler words here zorgon{'x' * (i % 2)} and more of {i}") for i in range(400)]
    docs = docs_of(rows)
    mark = lambda flip: spark.createDataFrame(
        [(i, int((i % 2) ^ (flip and zlib.crc32(str(i).encode()) % 3 == 1))) for i in range(400)], "doc_id long, toxic int")
    a, b = T.fit(docs, mark(False)), T.fit(docs, mark(True))
    assert a.weights == b.weights and a.curve.tolist() == b.curve.tolist()
    assert T.folded("zorgonx") in a.weights or any(e.startswith(" zorgon") for e in a.weights)
    scores = {r.doc_id: r.score for r in T.score(docs, a).select("doc.doc_id", "score").collect()}
    assert min(s for i, s in scores.items() if i % 2) > max(s for i, s in scores.items() if not i % 2)


def test_sample_is_bounded(spark, docs_of):
    docs = docs_of([(i, f"text {i}") for i in range(100)])
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    rows = T.labelled_sample(docs, labels, toxic=7, clean=11).collect()
    assert sorted(r.label for r in rows) == [False] * 11 + [True] * 7


def test_odd_rows(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (2, ""), (None, "you idiot"), (4, " \t\n"), (5, "idiot " * 60_000)])
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    more = docs.selectExpr("*", "7 AS score", "8 AS doc", "9 AS label")
    rows = T.score(more, T.fit(more, none)).select("doc.*", F.col("score").alias("s")).collect()
    assert len(rows) == 6 and all(r.score == 7 and r.doc == 8 for r in rows)
    empty = {r.s for r in rows if not (r.text or "").strip()}
    assert len(empty) == 1 and all(r.s > max(empty) for r in rows if "idiot" in (r.text or ""))
    assert T.score(docs.limit(0), T.fit(docs.limit(0), none)).collect() == []
