"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into segments, few at the coarsest level and more at each finer one, and described by
the mean and the deviation of each segment. Two segments of m components have a squared distance of at
least m * ((difference of means)^2 + (difference of deviations)^2). With the known norms this lower
bound of the distance is an upper bound of the inner product. In each pair of a block of queries and a
block of candidates the pairs are bounded coarse to fine, and only the survivors are computed exactly.

Components are floor(1024 x), so scores are whole numbers and computed without rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precis.llm.common import written

_QUERIES = 256  # rows in a block of queries
_CANDIDATES = 2048  # rows in a block of candidates
_SEGMENTS = (4, 8, 16, 32)
_EXACT = 2.0**52
_LEAST, _MOST = -(2**63), 2**63 - 1


def _usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``id, v``: the vectors without a null or non-finite component, as doubles."""
    v = F.col(vector)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = v.isNotNull() & ~F.exists(v, bad)
    rows = df.filter(usable & F.col(vec_id).isNotNull())
    return rows.select(F.col(vec_id).cast("long").alias("id"), v.cast("array<double>").alias("v"))


def _blocks(df: DataFrame, size: int, scale: int) -> DataFrame:
    """Rows of up to ``size`` vectors of one dimension: dim, n, ids and matrix as bytes.

    The matrix holds floor(scale * x) as doubles, which are whole numbers of any size.
    """
    def pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def row(dim: int) -> pa.RecordBatch:
            ids = np.array([i for i, _ in held[dim]], dtype=np.int64)
            matrix = np.array([v for _, v in held.pop(dim)], dtype=np.float64).reshape(len(ids), dim)
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()], pa.binary()),
                 pa.array([np.floor(np.clip(matrix * scale, -1.7e308, 1.7e308)).tobytes()], pa.binary())],
                names=["dim", "n", "ids", "matrix"])

        for batch in frames:
            ids = batch.column(0).to_numpy()
            lists = batch.column(1)
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for i, a, b in zip(ids.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                held.setdefault(b - a, []).append((i, values[a:b]))
                if len(held[b - a]) == size:
                    yield row(b - a)
        for dim in list(held):
            yield row(dim)

    return df.mapInArrow(pack, "dim int, n int, ids binary, matrix binary")


def _segments(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, means and deviations of ``count`` segments (fewer for short vectors)."""
    dim = matrix.shape[1]
    edges = np.unique(np.linspace(0, dim, min(count, dim) + 1).astype(int))
    lengths = np.diff(edges)
    means = np.add.reduceat(matrix, edges[:-1], axis=1) / lengths
    squares = np.add.reduceat(matrix**2, edges[:-1], axis=1) / lengths
    return lengths, means, np.sqrt(np.maximum(0, squares - means**2))


def _upper(one, two, rows: np.ndarray, cols: np.ndarray, norms) -> np.ndarray:
    """Upper bounds of inner products: half of |q|^2 + |c|^2 - (lower bound of the squared distance)."""
    lengths, mean_q, dev_q = one
    _, mean_c, dev_c = two
    distance = ((mean_q[rows] - mean_c[cols])**2 + (dev_q[rows] - dev_c[cols])**2) @ lengths
    total = norms[0][rows] + norms[1][cols]
    # The slack covers the rounding of the bound, so that no true hit is lost.
    return (total - distance) / 2 + 1e-9 * total + 1e-6


def best_in_blocks(q_ids, queries, c_ids, candidates, k: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Query, candidate and score of each query's best ``k`` in the block (ties to smaller ids)."""
    n_q, dim = queries.shape
    largest = (np.abs(queries).max(initial=0)) * (np.abs(candidates).max(initial=0)) * max(1, dim)
    if not largest < _EXACT:
        return _best_of_large(q_ids, queries, c_ids, candidates, k)
    if dim == 0:
        score_of = lambda rows, cols: np.zeros(len(rows))
    else:
        score_of = lambda rows, cols: np.einsum("ij,ij->i", queries[rows], candidates[cols])
    own = q_ids[:, None] == c_ids[None, :]
    rows, cols = np.nonzero(~own)
    if dim:
        norms = (queries**2).sum(1), (candidates**2).sum(1)
        levels = [(_segments(queries, s), _segments(candidates, s)) for s in _SEGMENTS if s <= dim] or [
            (_segments(queries, 1), _segments(candidates, 1))]
        bound = _by_parts(lambda a, b: _upper(*levels[0], a, b, norms), rows, cols)
        # A query's threshold: the k-th best true score among those with the highest coarse bounds.
        order = np.lexsort((-bound, rows))
        first = np.searchsorted(rows[order], np.arange(n_q))
        probe = np.arange(len(order)) - first[rows[order]] < 4 * k
        seen = order[probe]
        scores = score_of(rows[seen], cols[seen])
        threshold = np.full(n_q, -np.inf)
        ranked = np.lexsort((-scores, rows[seen]))
        start = np.searchsorted(rows[seen][ranked], np.arange(n_q + 1))
        for q in np.flatnonzero(np.diff(start) >= k):
            threshold[q] = scores[ranked[start[q] + k - 1]]
        alive = bound >= threshold[rows]
        rows, cols = rows[alive], cols[alive]
        for level in levels[1:]:
            bound = _by_parts(lambda a, b, level=level: _upper(*level, a, b, norms), rows, cols)
            alive = bound >= threshold[rows]
            rows, cols = rows[alive], cols[alive]
    scores = _by_parts(score_of, rows, cols)
    order = np.lexsort((c_ids[cols], -scores, rows))
    rows, cols, scores = rows[order], cols[order], scores[order]
    first = np.searchsorted(rows, np.arange(n_q))
    top = np.arange(len(rows)) - first[rows] < k
    return q_ids[rows[top]], c_ids[cols[top]], scores[top].astype(np.int64).tolist()


def _by_parts(function, rows: np.ndarray, cols: np.ndarray, size: int = 32_768) -> np.ndarray:
    parts = [function(rows[i:i + size], cols[i:i + size]) for i in range(0, len(rows), size)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _best_of_large(q_ids, queries, c_ids, candidates, k):
    """The same with whole numbers of any size; scores beyond a long stop at its ends."""
    found = [], [], []
    exact = [[int(x) for x in row] for row in candidates.tolist()]
    for q, row in zip(q_ids.tolist(), queries.tolist(), strict=True):
        own = [int(x) for x in row]
        scored = [(max(_LEAST, min(_MOST, sum(a * b for a, b in zip(own, c, strict=True)))), i)
                  for i, c in zip(c_ids.tolist(), exact, strict=True) if i != q]
        for score, i in sorted(scored, key=lambda s: (-s[0], s[1]))[:k]:
            for column, value in zip(found, (q, i, score), strict=True):
                column.append(value)
    return np.array(found[0], np.int64), np.array(found[1], np.int64), found[2]


def search(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, vec_id: str = "vec_id",
           vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest inner products of each query vector.

    All vectors but those with the query's own id are candidates; repeated rows are candidates as often
    as they occur. Queries with the same id count once (the smallest vector). Vectors that are null or
    hold a null or non-finite component take no part, nor do rows without an id. Only vectors of the
    query's dimension are candidates. Ties go to the smaller id; scores that a long cannot hold stop at
    its ends. Without queries the result is empty.
    """
    rows = _usable(vectors, vec_id, vector)
    asked = _usable(vectors.filter(is_query), vec_id, vector)
    asked = asked.groupBy("id").agg(F.min("v").alias("v"))
    n_blocks = max(1, -(-asked.count() // _QUERIES))
    dealt = asked.repartition(n_blocks, "id")
    queries = written(_blocks(dealt, _QUERIES, scale).withColumn("qb", F.monotonically_increasing_id()), "query-blocks")
    blocks = _blocks(rows, _CANDIDATES, scale).withColumn("cb", F.monotonically_increasing_id())
    candidates = written(blocks, "candidate-blocks")
    # Every block of queries meets every block of candidates of its dimension: an equi-join on the pair.
    pairs = queries.select("dim", "qb").join(candidates.select("dim", "cb"), "dim")
    left = queries.select("qb", F.col("ids").alias("q_ids"), F.col("matrix").alias("q"), "dim")
    right = candidates.select("cb", F.col("ids").alias("c_ids"), F.col("matrix").alias("c"))
    met = pairs.select("qb", "cb").join(left, "qb").join(right, "cb").select("dim", "q_ids", "q", "c_ids", "c")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, q_ids, q, c_ids, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                q_ids, c_ids = np.frombuffer(q_ids, np.int64), np.frombuffer(c_ids, np.int64)
                q = np.frombuffer(q).reshape(len(q_ids), dim)
                c = np.frombuffer(c).reshape(len(c_ids), dim)
                a, b, scores = best_in_blocks(q_ids, q, c_ids, c, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(scores, pa.int64())],
                    names=["query_id", "vec_id", "score"])

    found = met.mapInArrow(best, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
