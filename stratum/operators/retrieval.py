"""Nearest stored examples for a batch of query vectors (exact cosine top-k).

Queries and examples are dealt into blocks by a hash of their ids, and every
query block meets every example block in one task (a grid, so neither side
has to be small, and nothing passes through the driver).  A task scores its
pair of blocks with matrix products, a few queries at a time, and emits only
its local top-k per query; a final ``row_number`` over those candidates picks
the global top-k.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CANDIDATE_SCHEMA = "query_id long, example_id long, score double"
SCORES_AT_ONCE = 1 << 20


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.vstack(vectors.to_numpy()).astype(np.float64)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, np.nan, norm)


def _local_topk(k: int):
    def run(queries: pd.DataFrame, examples: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(examples):
            ids, stored = examples["id"].to_numpy(np.int64), _unit(examples["v"])
            at_once = max(1, SCORES_AT_ONCE // len(ids))
            for a in range(0, len(queries), at_once):
                part = queries.iloc[a:a + at_once]
                scores = _unit(part["v"]) @ stored.T
                sortable = np.where(np.isnan(scores), -np.inf, scores)
                kth = -np.partition(-sortable, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
                for qid, s, r, least in zip(part["id"], scores, sortable, kth):
                    found = np.flatnonzero(r >= least)
                    found = found[np.lexsort((ids[found], -r[found]))[:k]]
                    out.append(pd.DataFrame({"query_id": qid, "example_id": ids[found], "score": s[found]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "example_id": [], "score": []})
    return run


def nearest_examples(queries: DataFrame, examples: DataFrame, k: int = 5,
                     id_col: str = "vec_id", vec_col: str = "embedding",
                     block_rows: int = 2048, example_rows: int = 16384) -> DataFrame:
    """Top-``k`` examples by cosine similarity for every query.

    Returns ``query_id, example_id, rank, score`` (ties broken by example id;
    a vector of length zero scores NULL-like NaN, last).  Rows without an id or
    vector take no part.
    """
    def dealt(df: DataFrame, rows: int, name: str) -> tuple[DataFrame, int]:
        df = df.select(F.col(id_col).cast("long").alias("id"),
                       F.col(vec_col).cast("array<double>").alias("v")).dropna()
        n = max(1, -(-df.count() // rows))
        return df.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")), n

    q, n_q = dealt(queries, block_rows, "qb")
    e, n_e = dealt(examples, example_rows, "eb")
    q = q.withColumn("eb", F.explode(F.sequence(F.lit(0), F.lit(n_e - 1))))
    e = e.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    cand = (q.groupBy("qb", "eb").cogroup(e.groupBy("qb", "eb"))
            .applyInPandas(_local_topk(k), CANDIDATE_SCHEMA))
    w = Window.partitionBy("query_id").orderBy(F.isnan("score"), F.col("score").desc_nulls_last(),
                                               F.col("example_id").asc())
    return (cand.withColumn("rank", F.row_number().over(w).cast("long"))
                .where(F.col("rank") <= k))
