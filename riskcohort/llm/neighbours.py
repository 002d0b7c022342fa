"""Exact nearest neighbours by a block matrix join of quantised vectors.

Queries and candidates are packed into blocks; every pair of blocks meets in one task. There an int8 product
tile gives every distance with a bound on its quantisation error, pairs that the bounds cannot rule out are
computed again from the vectors, and the nearest of each query are merged.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window, functions as F

from riskcohort.llm.common import batch, shuffle_partitions

BLOCK = 2048
PAIRS = 1 << 16

_PACKED = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("quantised", pa.binary()), ("scale", pa.binary()),
                     ("error", pa.binary()), ("vectors", pa.binary())])
_PACKED_DDL = "dim int, ids binary, quantised binary, scale binary, error binary, vectors binary"


def _valid_rows(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors that take part, by dimension."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.array([-1 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()])
    values = column.flatten()
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)  # a null component becomes nan
    starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    out = {}
    for dim in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == dim)
        matrix = flat[starts[rows][:, None] + np.arange(dim)]
        good = np.isfinite(matrix).all(axis=1) & (matrix != 0).any(axis=1)
        if good.any():
            out[dim] = rows[good], matrix[good]
    return out


def quantise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale and norm of the error of each row."""
    scale = np.abs(matrix).max(axis=1) / 127
    codes = np.rint(matrix / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(matrix - scale[:, None] * codes, axis=1)
    return codes, scale, error


def _packed(ids: np.ndarray, matrix: np.ndarray) -> dict[str, list]:
    codes, scale, error = quantise(matrix)
    return {"dim": [matrix.shape[1]], "ids": [ids.tobytes()], "quantised": [codes.tobytes()], "scale": [scale.tobytes()],
            "error": [error.tobytes()], "vectors": [matrix.tobytes()]}


def _pack(vectors: DataFrame, size: int) -> DataFrame:
    """Blocks of at most ``size`` vectors that take part, as they lie."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in batches:
            ids = b.column("vec_id").to_numpy()
            for dim, (rows, matrix) in _valid_rows(b.column("vector")).items():
                held.setdefault(dim, []).append((ids[rows], matrix))
                while sum(len(x) for x, _ in held[dim]) >= size:
                    i, m = (np.concatenate(x) for x in zip(*held[dim]))
                    yield batch(_PACKED, **_packed(i[:size], m[:size]))
                    held[dim] = [(i[size:], m[size:])]
        for parts in held.values():
            i, m = (np.concatenate(x) for x in zip(*parts))
            if len(i):
                yield batch(_PACKED, **_packed(i, m))

    return vectors.mapInArrow(run, _PACKED_DDL)


class _Block:
    def __init__(self, dim: int, ids: bytes, quantised: bytes, scale: bytes, error: bytes, vectors: bytes) -> None:
        self.ids = np.frombuffer(ids, np.int64)
        self.codes = np.frombuffer(quantised, np.int8).reshape(-1, dim)
        self.scale, self.error = np.frombuffer(scale), np.frombuffer(error)
        self.vectors = np.frombuffer(vectors).reshape(-1, dim)
        self.norm = self.scale * np.sqrt((self.codes.astype(np.float64) ** 2).sum(axis=1))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """int8 products, exact: float32 holds sums of 1024 products of codes."""
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], 1024):
        out += a[:, k:k + 1024].astype(np.float32) @ b[:, k:k + 1024].astype(np.float32).T
    return out


class _Nearest:
    """The nearest candidates of a block of queries so far, in a heap for each query."""

    def __init__(self, block: _Block, k: int) -> None:
        self.block, self.k = block, k
        # Negated, so that the farthest (of equals, the largest id) is on top.
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in block.ids]
        self.worst = np.full(len(block.ids), np.inf)

    def add(self, c: _Block) -> None:
        q, k = self.block, self.k
        square = q.norm[:, None] ** 2 + c.norm[None, :] ** 2 - 2 * np.outer(q.scale, c.scale) * _products(q.codes, c.codes)
        about = np.sqrt(np.maximum(square, 0))
        slack = q.error[:, None] + c.error[None, :]
        # Rounding: of the estimate (it is a difference of squares) and of the exact score.
        slack += 1e-7 * (q.norm[:, None] + c.norm[None, :])
        own = q.ids[:, None] == c.ids[None, :]
        upper = np.where(own, np.inf, about + slack)
        limit = np.partition(upper, k - 1, axis=1)[:, k - 1] if upper.shape[1] > k else np.full(len(upper), np.inf)
        limit = np.minimum(limit, self.worst)
        i, j = np.nonzero(~own & (about - slack <= limit[:, None]))
        edges = np.searchsorted(i, np.arange(len(q.ids) + 1))
        score = np.empty(len(i))
        for start in range(0, len(i), PAIRS):
            part = slice(start, start + PAIRS)
            # Added up in order, as anybody else would.
            score[part] = np.sqrt(np.add.accumulate((q.vectors[i[part]] - c.vectors[j[part]]) ** 2, axis=1)[:, -1])
        for row in np.flatnonzero(np.diff(edges)).tolist():
            part, heap = slice(edges[row], edges[row + 1]), self.heaps[row]
            for found in zip((-score[part]).tolist(), (-c.ids[j[part]]).tolist()):
                if len(heap) < k:
                    heapq.heappush(heap, found)
                elif found > heap[0]:
                    heapq.heapreplace(heap, found)
            if len(heap) == k:
                self.worst[row] = -heap[0][0]

    def rows(self) -> dict[str, np.ndarray]:
        found = [(q, -i, -s) for q, heap in zip(self.block.ids.tolist(), self.heaps) for s, i in heap]
        query, ids, score = zip(*found) if found else ((), (), ())
        return {"query_id": np.array(query, np.int64), "vec_id": np.array(ids, np.int64), "score": np.array(score, np.float64)}


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
            block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest ``vectors`` of each of ``queries`` by Euclidean distance.

    Exact: the error bounds only leave out pairs that cannot be among the nearest. Candidates with the query's id
    are left out; ties go to the smaller id; fewer candidates give fewer rows. Rows without an id or vector, and
    vectors that are zero, of no or of another dimension than the query, or with null or non-finite components
    take no part. Rows of repeated ids are candidates each; of queries one row per id is taken (the smallest vector).
    Empty tables give an empty result.

    Runs a job that counts the queries. The blocks form a grid: queries are cut into as many parts as they need,
    candidates into as many as there are tasks to fill, and every cell of the grid reads one part of each.
    """
    spark = vectors.sparkSession

    def plain(df: DataFrame) -> DataFrame:
        return (df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"),
                          F.col(f"`{vector_col}`").cast("array<double>").alias("vector")).filter("vec_id is not null"))

    asked = plain(queries).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    parts = max(1, math.ceil(asked.count() / block))
    shards = max(1, math.ceil(2 * shuffle_partitions(spark) / parts))
    dealt = asked.repartition(parts, "vec_id")
    left = (_pack(dealt, block).withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int"))
            .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    right = (_pack(plain(vectors), block).withColumn("shard", F.pmod(F.xxhash64("ids"), F.lit(shards)).cast("int"))
             .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))))
    names = list(_PACKED.names)
    both = (left.select("part", "shard", F.lit(0).alias("side"), *names)
            .unionByName(right.select("part", "shard", F.lit(1).alias("side"), *names))
            .repartition("part", "shard").sortWithinPartitions("part", "shard", "side"))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked = None, []
        for b in batches:
            for row in b.to_pylist():
                if (row["part"], row["shard"]) != cell:
                    for found in asked:
                        yield batch(schema, **found.rows())
                    cell, asked = (row["part"], row["shard"]), []
                packed = _Block(*(row[n] for n in names))
                if row["side"] == 0:
                    asked.append(_Nearest(packed, k))
                else:
                    for found in asked:
                        if found.block.vectors.shape[1] == packed.vectors.shape[1]:
                            found.add(packed)
        for found in asked:
            yield batch(schema, **found.rows())

    tiles = both.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (tiles.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
