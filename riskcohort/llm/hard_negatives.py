"""Hard negatives by the threshold algorithm over sorted lists.

Vectors become integers and are packed into blocks, each with one list of its rows per dimension, sorted by that
component. An anchor reads every list from the end that its own component's sign makes the better one. A row seen in any
list is scored at once from its vector; what is still unseen cannot score more than the sum of the anchor's components
times the last values read. Reading stops once that sum is strictly below the worst score still wanted in each window, so
ties are complete. Blocks are read one after the other with what was found so far, and many of them are left at their
first values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskcohort.llm.common import batch, shuffle_partitions
from riskcohort.session import cut_lineage

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
# A negative's share of the positive's score, in hundredths.
SHARES = (30, 90)
BLOCK = 8192
ANCHORS = 16384
# Rows read from every list at first; doubled as long as reading goes on.
FIRST = 16
_LEAST, _MOST = -(2**63) + 1, 2**63 - 1
_INDEX = np.uint16  # holds row numbers of a block

_PACKED = pa.schema([("slot", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()),
                     ("codes", pa.binary()), ("lists", pa.binary()), ("windows", pa.binary())])
_PACKED_DDL = "slot int, dim int, ids binary, labels binary, codes binary, lists binary, windows binary"


def _codes(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Integer components of each row as doubles, and which rows take part."""
    out, good = [], []
    for value in column:
        x = np.array(value.as_py() if value.is_valid else [np.nan], np.float64)  # a null component becomes nan
        with np.errstate(over="ignore"):
            x = np.floor(SCALE * x)
        good.append(bool(np.isfinite(x).all()))
        out.append(x)
    return out, np.array(good, bool)


def _narrow(codes: np.ndarray) -> bytes:
    """Two bytes a component where they suffice."""
    small = not codes.size or np.abs(codes).max() < 1 << 15
    return codes.astype(np.int16 if small else np.float64).tobytes()


class _Block:
    def __init__(self, dim: int, ids: bytes, labels: bytes, codes: bytes, lists: bytes, windows: bytes) -> None:
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        n = len(self.ids)
        kind = np.int16 if len(codes) == 2 * n * dim else np.float64
        self.codes = np.frombuffer(codes, kind).reshape(n, dim).astype(np.float64)
        self.largest = float(np.abs(self.codes).max(initial=0))
        self.lists = np.frombuffer(lists, _INDEX).reshape(n, dim) if len(lists) == 2 * n * dim else None
        self.windows = np.frombuffer(windows, np.int64)


def _pack(rows: DataFrame, size: int, slots: int, sorted_lists: bool) -> DataFrame:
    """Blocks of at most ``size`` rows ``vec_id, label, vector[, windows]``, dealt to ``slots`` in turn.

    Rows that a task holds are ordered by label, so that most blocks hold few labels.
    """
    windows = "windows" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        held: dict[int, list[tuple[int, int, np.ndarray, list[int]]]] = {}

        def packed(dim: int, count: int) -> Iterator[pa.RecordBatch]:
            nonlocal turn
            taken = sorted(held[dim], key=lambda r: r[:2])
            held[dim] = taken[count:]
            for start in range(0, count, size):
                part = taken[start:min(start + size, count)]
                codes = np.stack([r[2] for r in part])
                lists = np.argsort(codes, axis=0, kind="stable").astype(_INDEX).tobytes() if sorted_lists else b""
                yield batch(_PACKED, slot=[turn % slots], dim=[dim], ids=[np.array([r[0] for r in part], np.int64).tobytes()],
                            labels=[np.array([r[1] for r in part], np.int64).tobytes()], codes=[_narrow(codes)],
                            lists=[lists], windows=[np.array([r[3] for r in part], np.int64).tobytes()])
                turn += 1

        for b in batches:
            codes, good = _codes(b.column("vector"))
            ids, labels = b.column("vec_id").to_pylist(), b.column("label").to_pylist()
            more = b.column("windows").to_pylist() if windows else [[]] * len(ids)
            for k in np.flatnonzero(good).tolist():
                held.setdefault(len(codes[k]), []).append((ids[k], labels[k], codes[k], more[k]))
            for dim in held:
                if len(held[dim]) >= 4 * size:
                    yield from packed(dim, len(held[dim]) // size * size)
        for dim in held:
            yield from packed(dim, len(held[dim]))

    return rows.mapInArrow(run, _PACKED_DDL)


class _Search:
    """The best ``k`` rows of each window of each anchor of a block, so far."""

    def __init__(self, anchors: _Block, k: int, low: np.ndarray, high: np.ndarray, same: bool) -> None:
        self.anchors, self.k, self.low, self.high, self.same = anchors, k, low, high, same
        shape = (*low.shape, k)
        self.score = np.full(shape, _LEAST, np.int64)
        self.ids = np.zeros(shape, np.int64)
        self.found = np.zeros(low.shape, np.int64)
        # A bound below this cannot matter any more. A window that admits nothing wants nothing.
        self.wanted = np.where(low <= high, low.astype(np.float64), np.inf)
        self.up, self.down = np.maximum(anchors.codes, 0), np.minimum(anchors.codes, 0)

    def _scores(self, a: np.ndarray, rows: np.ndarray, block: _Block) -> np.ndarray:
        if block.largest * self.anchors.largest * max(1, len(a)) < 2.0**53:
            return (rows @ a).astype(np.int64)
        whole = [int(x) for x in a]
        return np.array([min(max(sum(int(x) * y for x, y in zip(r, whole)), _LEAST), _MOST) for r in rows], np.int64)

    def _take(self, i: int, score: np.ndarray, ids: np.ndarray) -> None:
        for w in range(self.low.shape[1]):
            n = self.found[i, w]
            least = max(self.low[i, w], self.score[i, w, -1] if n == self.k else _LEAST)
            fits = (score >= least) & (score <= self.high[i, w])
            if not fits.any():
                continue
            s, v = np.r_[self.score[i, w, :n], score[fits]], np.r_[self.ids[i, w, :n], ids[fits]]
            best = np.lexsort((v, -s))[:self.k]
            self.found[i, w] = len(best)
            self.score[i, w, :len(best)], self.ids[i, w, :len(best)] = s[best], v[best]
            if len(best) == self.k:
                self.wanted[i, w] = s[best[-1]]

    def read(self, block: _Block) -> None:
        n = len(block.ids)
        values = np.take_along_axis(block.codes, block.lists.astype(np.int64), axis=0)
        first = self.up @ values[-1] + self.down @ values[0]
        slack = 1 + 1e-9 * np.abs(first) if block.largest * self.anchors.largest * max(1, values.shape[1]) >= 2.0**53 else 0.0
        for i in np.flatnonzero((first + slack >= self.wanted.min(axis=1))).tolist():
            allowed = (block.labels == self.anchors.labels[i]) == self.same
            allowed &= block.ids != self.anchors.ids[i]
            if allowed.any():
                self._read_for(i, block, values, ~allowed, n)

    def _read_for(self, i: int, block: _Block, values: np.ndarray, done: np.ndarray, n: int) -> None:
        a = self.anchors.codes[i]
        up, down = np.flatnonzero(a > 0), np.flatnonzero(a < 0)
        exact = block.largest * self.anchors.largest * max(1, len(a)) < 2.0**53
        depth, step = 0, FIRST
        while True:
            end = min(n, depth + step)
            if end == n:
                new = np.flatnonzero(~done)
            else:
                seen = np.zeros(n, bool)
                seen[block.lists[n - end:n - depth][:, up]] = True
                seen[block.lists[depth:end][:, down]] = True
                new = np.flatnonzero(seen & ~done)
            done[new] = True
            if len(new):
                self._take(i, self._scores(a, block.codes[new], block), block.ids[new])
            if end == n:
                return
            bound = a[up] @ values[n - end, up] + a[down] @ values[end - 1, down]
            if not exact:
                bound += 1 + 1e-9 * abs(bound)  # sums of doubles are rounded here
            if (bound < self.wanted[i]).all():
                return
            depth, step = end, 2 * step

    def rows(self) -> Iterator[tuple[int, int, int, int]]:
        """anchor, window, row, score."""
        for i, w in zip(*np.nonzero(self.found)):
            for r in range(self.found[i, w]):
                yield int(self.anchors.ids[i]), int(w), int(self.ids[i, w, r]), int(self.score[i, w, r])


_FOUND = pa.schema([("anchor_id", pa.int64()), ("place", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
_FOUND_DDL = "anchor_id long, place int, vec_id long, score long"


def _searched(anchors: DataFrame, rows: DataFrame, k: int, shares: tuple[int, int] | None, parts: int, block: int,
              most: int) -> DataFrame:
    """``anchor_id, place, vec_id, score``: what each cell of the grid of anchors and candidates finds.

    With ``shares`` rows of other labels, in a window for each of the anchor's positive scores; else of its own label.
    """
    shards = max(1, math.ceil(2 * shuffle_partitions(rows.sparkSession) / parts))
    names = [n for n in _PACKED.names if n != "slot"]
    left = (_pack(anchors, most, parts, False).withColumnRenamed("slot", "part")
            .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    right = (_pack(rows, block, shards, True).withColumnRenamed("slot", "shard")
             .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))))
    both = (left.select("part", "shard", F.lit(0).alias("side"), *names)
            .unionByName(right.select("part", "shard", F.lit(1).alias("side"), *names))
            .repartition("part", "shard").sortWithinPartitions("part", "shard", "side"))

    def searches(packed: _Block) -> _Search:
        n = len(packed.ids)
        if shares is None:
            return _Search(packed, k, np.full((n, 1), _LEAST), np.full((n, 1), _MOST), True)
        scores = packed.windows.reshape(n, -1)
        low, high = np.ones(scores.shape, np.int64), np.zeros(scores.shape, np.int64)
        for at in zip(*np.nonzero(scores != _LEAST)):
            s = int(scores[at])
            low[at], high[at] = max(-(-shares[0] * s // 100), _LEAST), min(shares[1] * s // 100, _MOST)
        return _Search(packed, k, low, high, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: tuple[int, int] | None = None
        asked: list[_Search] = []

        def told() -> Iterator[pa.RecordBatch]:
            for search in asked:
                found = list(search.rows())
                if found:
                    yield batch(_FOUND, **dict(zip(_FOUND.names, map(list, zip(*found)))))

        for b in batches:
            for r in range(b.num_rows):
                row = {n: b.column(n)[r].as_py() for n in ("part", "shard", "side", *names)}
                if (row["part"], row["shard"]) != cell:
                    yield from told()
                    cell, asked = (row["part"], row["shard"]), []
                packed = _Block(*(row[n] for n in names))
                if row["side"] == 0:
                    asked.append(searches(packed))
                else:
                    for search in asked:
                        if search.anchors.codes.shape[1] == packed.codes.shape[1]:
                            search.read(packed)
        yield from told()

    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id")
    return (both.mapInArrow(run, _FOUND_DDL).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))


def mine(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None,
         positives: int = POSITIVES, negatives: int = NEGATIVES, shares: tuple[int, int] = SHARES, block: int = BLOCK,
         most: int = ANCHORS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchor`` is a condition on ``vectors``; ``label`` defaults to the column of that name. Components are rounded down
    after scaling by 256; a score is the integer inner product with the anchor, higher first, ties to the smaller id. An
    anchor's positives are its best ``positives`` other rows of its label. Each of them has a window, ``shares`` hundredths
    of its score, and the best ``negatives`` rows of other labels whose scores lie in the window. Exact: the lists only
    leave out rows that cannot be among the best.

    Rows without an id, label or vector, and with a null or non-finite component (also after scaling) take no part. Rows
    meet only rows of their dimension. Of an id that several anchors share the smallest label and vector is the anchor;
    candidates of repeated ids count each, but never for the anchor of their id. Scores beyond 64 bits are held at the end
    of the range. Empty tables give an empty result.

    Runs jobs: the anchors are counted and the positives checkpointed. Blocks of anchors and of candidates form a grid whose cells are the tasks' work; the
    labels play no part in dealing rows out, so a label that holds most rows is as even as any.
    """
    if not 0 < block <= 1 << 16:
        raise ValueError("a block holds at most 65,536 rows")
    label = F.col("label") if label is None else label
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), label.cast("long").alias("label"),
                          F.col(f"`{vector_col}`").cast("array<double>").alias("vector"), anchor.alias("is_anchor"))
    rows = rows.filter("vec_id is not null and label is not null and vector is not null")
    usable = rows.filter(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    asked = (usable.filter("is_anchor").groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row"))
             .select("vec_id", "row.label", "row.vector"))
    rows = rows.drop("is_anchor")
    parts = max(1, math.ceil(asked.count() / most))
    asked = asked.repartition(parts, "vec_id")
    good = cut_lineage(_searched(asked, rows, positives, None, parts, block, most))
    # At most ``positives`` entries each.
    listed = good.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("good"))
    filled = [F.coalesce(F.get("good", F.lit(i))["score"], F.lit(_LEAST)) for i in range(positives)]
    windowed = (asked.join(listed, asked["vec_id"] == listed["anchor_id"])
                .select("vec_id", "label", "vector", F.array(*filled).alias("windows")))
    bad = _searched(windowed, rows, negatives, shares, parts, block, most).withColumnRenamed("rank", "bad_rank")
    named = good.select("anchor_id", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"),
                        F.col("score").alias("positive_score"))
    return (bad.join(named, ["anchor_id", "place"])
            .select("anchor_id", "positive_id", F.col("bad_rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))
