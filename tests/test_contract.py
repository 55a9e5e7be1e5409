import math

import numpy as np

import __spark_entry__ as E
from stratum.operators import forecast as FC
from stratum.operators.retrieval import nearest_examples

from stratum_test_data import SF_SMALL


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"category", "orderDate_month", "count", "totalAmount",
                               "avgOrderValue", "grossMargin"}


def test_every_sql_key_is_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_forecast_reference_series(spark):
    # The warehouse's seed series: slope 27.2727.., intercept 74, next 374.0
    ys = [100, 150, 120, 200, 210, 250, 240, 300, 320, 350]
    df = spark.createDataFrame([(i + 1, float(y)) for i, y in enumerate(ys)], "x int, y double")
    r = FC.forecast_next(df, "x", "y").first()
    assert math.isclose(r.slope, 27.272727272727273) and math.isclose(r.intercept, 74.0)
    assert r.next_x == 11 and r.prediction == 374.0


def test_forecast_empty_raises(spark):
    df = spark.createDataFrame([], "x int, y double")
    try:
        FC.forecast_next(df, "x", "y")
        raise AssertionError("expected EmptyTrainingSet")
    except FC.EmptyTrainingSet:
        pass


def test_nearest_examples_brute_force(spark):
    rng = np.random.default_rng(1)
    q = rng.normal(size=(7, 8))
    e = rng.normal(size=(90, 8))
    qdf = spark.createDataFrame([(i, q[i].tolist()) for i in range(7)], "vec_id long, embedding array<double>")
    edf = spark.createDataFrame([(100 + j, e[j].tolist()) for j in range(90)],
                                "vec_id long, embedding array<double>").repartition(5)
    got = {(r.query_id, r.rank): r.example_id
           for r in nearest_examples(qdf, edf, k=3, block_rows=4).collect()}
    sims = (q / np.linalg.norm(q, axis=1)[:, None]) @ (e / np.linalg.norm(e, axis=1)[:, None]).T
    for i in range(7):
        best = np.argsort(-sims[i], kind="stable")[:3]
        assert [got[(i, k + 1)] for k in range(3)] == [100 + int(b) for b in best]


def test_small_sf_queries_run(spark):
    qs = E.queries()
    for name in ("latest_by_key", "fct_sales", "counter_rate", "authorize", "forecast_next"):
        assert qs[name](spark, SF_SMALL).count() >= 0
