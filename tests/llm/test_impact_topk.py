import math
import random

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.llm.impact_topk import Block, top_k

VEC = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                    T.StructField("label", T.IntegerType())])


def brute(rows, k=5):
    use = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in rows
           if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for qi, q in use:
        if qi % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in use if i != qi)[:k]
            out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, VEC).repartition(3).withColumn("rank", F.lit("clash"))
    return sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 50 == 0, **kw).collect())


def test_matches_brute_force_over_many_blocks(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(16)], 0) for i in range(400)]
    assert run(spark, rows, block_rows=64, query_rows=3) == brute(rows)


def test_ties_repeats_and_bad_vectors(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.5]) for _ in range(4)], 0) for i in range(160)]
    rows += [(300, None, 0), (350, [1.0, None, 1.0, 1.0], 0), (400, [float("nan")] * 4, 0), (450, [float("inf")] * 4, 0),
             (None, [9.0] * 4, 0), (500, [], 0), (550, [0.5], 0), (551, [0.5] * 9, 0)]
    assert run(spark, rows, block_rows=16, query_rows=2) == brute(rows)


def test_fewer_candidates_than_k_and_empty(spark):
    rows = [(0, [1.0, 2.0], 0), (50, [0.5, -2.0], 0), (7, [0.0, 0.0], 0)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:1]) == []
    assert run(spark, [(1, [1.0], 0)]) == []
    assert run(spark, []) == []


def test_stops_before_the_last_posting_and_stays_exact():
    rng = np.random.default_rng(3)
    weights = np.floor(256 * rng.normal(0, 0.12, (3000, 64))).astype(np.int64)
    block = Block(np.arange(3000), weights)
    looked = []
    real = Block._possible

    def spy(acc, own, norms, remaining, k):
        looked.append(remaining.max())
        return real(acc, own, norms, remaining, k)
    block._possible = spy
    q, v, s = block.search(np.arange(0, 3000, 50), weights[::50], 5)
    assert looked[-1] > 0  # proven before the postings ran out
    scores = weights[::50] @ weights.T
    scores[np.arange(60), np.arange(0, 3000, 50)] = -2**62
    want = -np.sort(-scores, axis=1)[:, :5]
    assert (s.reshape(60, 5) == want).all()


def test_wide_weights_use_64_bits():
    rng = np.random.default_rng(4)
    weights = rng.integers(-2**24, 2**24, (50, 8))
    q, v, s = Block(np.arange(50), weights).search(np.array([99]), weights[:1], 3)
    assert s.tolist() == sorted((weights @ weights[0]).tolist(), reverse=True)[:3]
