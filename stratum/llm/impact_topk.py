"""Exact top-k search by inner product over an impact-ordered index.

Vectors are integers (each component x becomes floor(256 x)).  The stored index
holds the ids and weights of the vectors in blocks, nothing else.  A task that
meets a block orders it anew: every component is a posting (vector, weight) of
its dimension, postings are cut into segments by quantised impact (the
magnitude of the weight) from the highest impact down, and each vector's
remaining norm is computed at the levels where stopping is considered.

A block of queries meets a block of the index in one task, score at a time:
segments are added to the accumulators level by level.  After a level, the
part of a score still to come is at most |query| * remaining norm of the vector
(Cauchy-Schwarz), so a vector is possible for a query only if its upper bound
reaches the k-th best lower bound.  Processing stops when exact rescoring of
the possible members costs less than the remaining postings; only then, and
every possible member is rescored exactly, so nothing depends on the bound
being sharp.  The best k of each block are merged per query.

Queries grow with the table, so neither side is broadcast: index blocks and
query blocks are dealt over a grid of block pairs.

Defined cases: vectors that are null or hold null or non-finite components,
and rows without an id, take no part; vectors of different lengths are
compared over the shorter one (as if padded by zeros); magnitudes beyond 64
bits saturate; ids repeated in the table are rows of their own, and none of
them is a candidate of a query with that id; ties go to the smaller id; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

BLOCK_ROWS = 8192
QUERY_ROWS = 512
LEVELS = 32
#: shares of postings left at which stopping is considered
LOOK_AT = (0.5, 0.35, 0.25, 0.15, 0.07)


def quantised(docs: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, weights (array<bigint>) of the rows that take part."""
    v = F.col("embedding")

    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return (docs.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~F.exists(v, bad))
            .select(F.col("vec_id").cast("long").alias("vec_id"),
                    F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("weights")))


def matrix(weights: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length, padded by zeros."""
    lists = weights.combine_chunks() if isinstance(weights, pa.ChunkedArray) else weights
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False)
    n = np.diff(offsets)
    out = np.zeros((len(n), int(n.max()) if len(n) else 0), np.int64)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], n)] = values[offsets[0]:offsets[-1]]
    return out


class Block:
    """Impact-ordered postings of one block of vectors."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, levels: int = LEVELS):
        self.ids, self.weights = ids, weights
        size = np.abs(weights)
        step = max(1, -(-int(size.max(initial=0)) // levels))
        level = size // step
        row, dim = np.nonzero(weights)
        order = np.lexsort((row, dim, -level[row, dim]))  # level down, then dimension
        self.row, self.dim = row[order].astype(np.int32), dim[order].astype(np.int32)
        impact = level[self.row, self.dim]
        cut = np.flatnonzero((np.diff(impact) != 0) | (np.diff(self.dim) != 0)) + 1
        self.bounds = np.concatenate([[0], cut, [len(order)]]) if len(order) else np.zeros(1, np.int64)
        self.impact = impact[self.bounds[:-1]] if len(order) else np.zeros(0, np.int64)
        self.level = level

    def remaining(self, impact: int) -> np.ndarray:
        """Norm of each vector's components below the level ``impact``."""
        rest = np.where(self.level < impact, self.weights, 0).astype(np.float64)
        return np.sqrt((rest * rest).sum(axis=1))

    def search(self, q_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the best ``k`` of this block for each query, ties to smaller ids."""
        dims = min(queries.shape[1], self.weights.shape[1])
        queries, weights = queries[:, :dims], self.weights[:, :dims]
        most = float(np.abs(queries).sum(axis=1).max(initial=0)) * float(np.abs(weights).max(initial=0))
        dtype = np.int32 if most < 2**31 else np.int64
        q = queries.T.astype(dtype)
        acc = np.zeros((len(weights), len(queries)), dtype)
        norms = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        own = self.ids[:, None] == q_ids[None, :] if np.isin(q_ids, self.ids).any() else None
        total = max(1, len(self.row))
        looks = [share * total for share in LOOK_AT]
        possible = None
        for s, (a, b) in enumerate(zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist())):
            d = self.dim[a]
            if d < dims:
                rows = self.row[a:b]
                acc[rows] += weights[rows, d].astype(dtype)[:, None] * q[d][None, :]
            left = total - b
            ends_level = s + 1 == len(self.impact) or self.impact[s + 1] != self.impact[s]
            if left and looks and ends_level and left <= looks[0]:
                looks = [x for x in looks if x < left]
                found = self._possible(acc, own, norms, self.remaining(int(self.impact[s])), k)
                if found.sum() * dims <= left * len(queries):
                    possible = found
                    break
        if possible is None:
            possible = self._possible(acc, own, norms, np.zeros(len(weights)), k)
        rows, cols = np.nonzero(possible)
        wide = np.einsum("ij,ij->i", weights[rows], queries[cols])
        order = np.lexsort((self.ids[rows], -wide, cols))
        rows, cols, wide = rows[order], cols[order], wide[order]
        rank = np.arange(len(cols)) - np.searchsorted(cols, cols)
        best = rank < k
        return q_ids[cols[best]], self.ids[rows[best]], wide[best]

    @staticmethod
    def _possible(acc, own, norms, remaining, k: int) -> np.ndarray:
        """Vectors whose upper bound reaches the k-th best lower bound, per query."""
        spread = np.ceil(remaining[:, None] * norms[None, :]).astype(np.int64) + (remaining.max(initial=0) > 0)
        low = acc - spread
        if own is not None:
            low[own] = np.iinfo(np.int64).min // 2
        if len(low) > k:
            kth = np.partition(low, len(low) - k, axis=0)[len(low) - k]
        else:
            kth = np.full(low.shape[1], np.iinfo(np.int64).min)
        found = acc + spread >= kth[None, :]
        return found if own is None else found & ~own


def _pack(ids: np.ndarray, weights: np.ndarray) -> dict:
    return {"ids": ids.astype("<i8").tobytes(), "weights": weights.astype("<i8").tobytes(), "dims": weights.shape[1]}


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], "<i8")
    return ids, np.frombuffer(row["weights"], "<i8").reshape(len(ids), row["dims"])


PACKED = "ids binary, weights binary, dims int"


def _packed(table: pa.Table) -> pa.Table:
    ids, weights = table.column("vec_id").to_numpy(), matrix(table.column("weights"))
    packed = _pack(ids, weights)
    return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()),
                     "ids": pa.array([packed["ids"]], pa.binary()), "weights": pa.array([packed["weights"]], pa.binary()),
                     "dims": pa.array([packed["dims"]], pa.int32())})


def blocks(vectors: DataFrame, rows: int, n: int) -> tuple[DataFrame, int]:
    """One row per block of about ``rows`` of the ``n`` vectors, and the number of blocks."""
    count = max(1, -(-n // rows))
    cell = F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")
    return (vectors.withColumn("block", cell).groupBy("block").applyInArrow(_packed, "block int, " + PACKED),
            count)


def top_k(docs: DataFrame, is_query: Column, k: int = 5, block_rows: int = BLOCK_ROWS,
          query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best rows of each query row, without its own."""
    vectors = staged(quantised(docs), "vectors")
    asked = vectors.where(is_query)
    index, n_index = blocks(vectors, block_rows, vectors.count())
    queries, n_queries = blocks(asked, query_rows, asked.count())
    index = staged(index, "impact-index")
    grid_index = index.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    grid_queries = (queries.withColumnRenamed("block", "cell")
                    .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_index - 1)))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], []]
        for row in left.to_pylist():
            block = Block(*_unpack(row))
            for other in right.to_pylist():
                for found, values in zip(out, block.search(*_unpack(other), k)):
                    found.append(values)
        arrays = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, arrays))))

    best = (grid_index.groupBy("block", "cell").cogroup(grid_queries.groupBy("block", "cell"))
            .applyInArrow(search, "query_id long, vec_id long, score long"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
