"""Nearest neighbours by inner product: a block matrix join with int8 tiles and error bounds."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 4096
# Queries of a tile whose bounds are in memory at once.
STRIPE = 128
# Dimensions whose int8 products a float32 sum holds exactly: 127 * 127 * 1024 < 2 ** 24.
EXACT_DIMS = 1024


def usable(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, vector, dims) of the rows that take part: an id, and a vector that is neither null, empty
    nor zero and whose components are finite. Of rows with one id, the smallest vector counts."""
    x = F.col("vector")
    rows = vectors.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return (
        rows.where(F.col("id").isNotNull() & x.isNotNull())
        .where(~bad & F.exists(x, lambda v: v != 0.0))
        .groupBy("id").agg(F.min("vector").alias("vector"))
        .withColumn("dims", F.size("vector"))
    )


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k candidates of largest inner product.

    ``vectors`` is what ``usable`` returns; ``is_query`` is a condition on ``id``. Candidates are all
    rows but the query's own, of the query's number of dimensions; ranks count from 1, ties go to
    the smaller id, and a query with fewer candidates has fewer rows. The score is the inner
    product of the original vectors, added from the first component to the last in double precision.

    Queries and candidates are dealt into blocks by a hash of their id; each pair of blocks is a
    tile. In a tile the vectors are rounded to int8 with a scale each, their products are exact
    integers, and the rounding errors' norms bound how far the true product can be. Pairs whose
    upper bound is below the k-th lower bound of their query are out; the others are computed
    exactly. So the result is exact: the bounds only save work. Tiles' best are merged in heaps.
    An empty table, or one without queries, gives an empty table.
    """
    spread = lambda size: F.greatest(F.ceil(F.col("n") / size), F.lit(1)).cast("int")
    counted = vectors.groupBy("dims").agg(
        F.count("*").alias("n"), F.sum(F.when(is_query, 1).otherwise(0)).alias("n_queries")
    )
    counted = counted.where("n_queries > 0").select(
        F.col("dims"), spread(CANDIDATE_BLOCK).alias("columns"),
        F.greatest(F.ceil(F.col("n_queries") / QUERY_BLOCK), F.lit(1)).cast("int").alias("rows"),
    )
    v = vectors.join(counted, "dims")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    tile = F.concat_ws("/", "dims", "row", "column")
    queries = v.where(is_query).withColumns({"row": of("rows"), "column": every("columns")}).select(
        tile.alias("q_tile"), F.col("id").alias("q_id"), F.col("vector").alias("q_vector")
    )
    candidates = v.withColumns({"column": of("columns"), "row": every("rows")}).select(
        tile.alias("c_tile"), F.col("id").alias("c_id"), F.col("vector").alias("c_vector")
    )

    def multiply(q: pa.Table, c: pa.Table) -> pa.Table:
        return _best_of_tile(q, c, k)

    best = queries.groupBy("q_tile").cogroup(candidates.groupBy("c_tile")).applyInArrow(
        multiply, "query_id long, vec_id long, score double"
    )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list] = {}
        for batch in batches:
            for query, candidate, score in zip(*(column.to_pylist() for column in batch.columns)):
                heap = heaps.setdefault(query, [])
                if len(heap) < k:
                    heapq.heappush(heap, (score, -candidate))
                else:
                    heapq.heappushpop(heap, (score, -candidate))
        for query, heap in heaps.items():
            heap.sort(reverse=True)
            n = len(heap)
            yield pa.RecordBatch.from_arrays([
                pa.array([query] * n, pa.int64()), pa.array(range(1, n + 1), pa.int32()),
                pa.array([-c for _, c in heap], pa.int64()), pa.array([s for s, _ in heap], pa.float64()),
            ], names=["query_id", "rank", "vec_id", "score"])

    return best.repartition("query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column(1).to_numpy()
    flat = table.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return ids, flat.reshape(len(ids), -1)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, scales, norms of the rounding errors) of vectors."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = np.finfo(float).tiny  # components too small to divide
    whole = np.clip(np.rint(x / scale[:, None]), -127, 127)
    return whole.astype(np.int8), scale, np.sqrt(((x - whole * scale[:, None]) ** 2).sum(axis=1))


def int8_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of int8 rows, as exact whole numbers in double precision."""
    total = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], EXACT_DIMS):
        part = slice(at, at + EXACT_DIMS)
        total += a[:, part].astype(np.float32) @ b[:, part].astype(np.float32).T
    return total


def exact_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of corresponding rows, added in order of the components."""
    total = np.zeros(len(x))
    for at in range(x.shape[1]):
        total += x[:, at] * y[:, at]
    return total


def _best_of_tile(q: pa.Table, c: pa.Table, k: int) -> pa.Table:
    out: list[list] = [[], [], []]
    if q.num_rows and c.num_rows:
        ids, y = _matrix(c)
        queries, x = _matrix(q)
        with np.errstate(over="ignore", invalid="ignore"):
            y8, y_scale, y_error = quantise(y)
            x8, x_scale, x_error = quantise(x)
            y_norm = np.sqrt((y**2).sum(axis=1))
            x_norm = np.sqrt((x**2).sum(axis=1))
            for at in range(0, len(x), STRIPE):
                part = slice(at, at + STRIPE)
                about = int8_products(x8[part], y8) * x_scale[part, None] * y_scale
                # |x.y - x'.y'| <= |x'| |y - y'| + |x - x'| |y|, and the rounding of doubles.
                bound = (x_norm + x_error)[part, None] * y_error + x_error[part, None] * y_norm
                bound += 1e-12 * x_norm[part, None] * y_norm
                own = queries[part, None] == ids
                low = np.where(own, -np.inf, np.nan_to_num(about - bound, nan=-np.inf))
                high = np.where(own, -np.inf, np.nan_to_num(about + bound, nan=np.inf, posinf=np.inf))
                if len(ids) > k:
                    least = np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k, None]
                    alive = (high >= least) & ~own
                else:
                    alive = ~own
                i, j = np.nonzero(alive)
                score = exact_products(x[part][i], y[j])
                order = np.lexsort((ids[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                first = np.searchsorted(i, np.arange(len(own)))
                keep = np.arange(len(i)) - first[i] < k
                out[0].append(queries[part][i[keep]])
                out[1].append(ids[j[keep]])
                out[2].append(score[keep])
    columns = [np.concatenate(o) if o else np.empty(0, t) for o, t in zip(out, (np.int64, np.int64, float))]
    return pa.table(columns, names=["query_id", "vec_id", "score"])
