"""Quality grades of texts by ordinal cumulative-link regression.

Ratings are ordered grades 0, 1, ..., K - 1. One weight per hashed text feature is shared by all grades, and ordered
thresholds cut the score: P(grade <= k) = logistic(threshold_k - score). The model gives the expected grade and the
probability of the best one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from riskcohort.llm.common import texts_as_bytes

BITS = 18
FIT_ROWS = 16_384
PENALTY = 0.3
# Features of fewer rows of the sample get no weight: they would only learn these rows by heart.
MIN_ROWS = 5
PART = 1 << 19
CUT = 0.5
# The share of held-out texts of the best grade that may be lost to the limit on the lowest grade.
LOSS = 0.01
HELD_OUT = 5
_TOKEN = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\s\x80-\xff]+")


def features(text: bytes) -> np.ndarray:
    """Numbers of the hashed features of a text: every text, its different words and runs of marks, how much the words
    repeat and how many of the tokens are marks."""
    tokens = _TOKEN.findall(text.decode().lower().encode())
    words = [t for t in tokens if t[0] > 127 or t[:1].isalnum() or t[0] == 95]
    shown = {b"#text", b"#repeats%d" % (10 * len(set(words)) // len(words) if words else -1),
             b"#marks%d" % (20 * (len(tokens) - len(words)) // len(tokens) if tokens else -1), *tokens}
    return np.unique(np.fromiter((xxhash.xxh32_intdigest(t) >> (32 - BITS) for t in shown), np.int32, len(shown)))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    # The highest probability of the lowest grade that is kept.
    limit: float = 1.0

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for every k but the last, by row."""
        return 1 - _logistic(self.thresholds[None, :] - score[:, None])

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[r].sum(dtype=np.float64) for r in rows]).reshape(-1)

    def keep(self, tails: np.ndarray, cut: float = CUT) -> np.ndarray:
        return (tails[:, -1] >= cut) & (1 - tails[:, 0] <= self.limit)


def _minimum(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with a backtracking line search."""
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    value, slope = f(x)
    for _ in range(rounds):
        direction, scales = slope.copy(), []
        for s, y in reversed(steps):
            scales.append((s @ direction) / (y @ s))
            direction -= scales[-1] * y
        direction *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1, np.linalg.norm(slope))
        for (s, y), scale in zip(steps, reversed(scales)):
            direction += s * (scale - (y @ direction) / (y @ s))
        step = 1.0
        while True:
            new = x - step * direction
            new_value, new_slope = f(new)
            if new_value <= value - 1e-4 * step * (slope @ direction) or step < 1e-6:
                break
            step /= 2
        done = abs(value - new_value) <= 1e-5 * abs(value)
        s, y = new - x, new_slope - slope
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-memory:]
        x, value, slope = new, new_value, new_slope
        if done:
            break
    return x


def fit_rows(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, penalty: float = PENALTY, rounds: int = 80,
             min_rows: int = MIN_ROWS) -> Model:
    """The model with the highest penalised likelihood."""
    flat = np.concatenate(rows)
    used = np.flatnonzero(np.bincount(flat, minlength=1 << BITS) >= min_rows)
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used))
    at = place[flat]
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])[at >= 0]
    at, n, m, k = at[at >= 0], len(rows), len(used), n_grades - 1
    del flat, place
    # Passes over the entries go in parts, so that their copies stay small.
    parts = [slice(i, i + PART) for i in range(0, len(at), PART)]

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, free = p[:m], p[m:]
        gaps = np.exp(free[1:])
        edges = np.r_[-np.inf, free[0] + np.r_[0, np.cumsum(gaps)], np.inf]
        score = sum((np.bincount(owner[x], w[at[x]], n) for x in parts), np.zeros(n))
        high, low = _logistic(edges[grades + 1] - score), _logistic(edges[grades] - score)
        chance = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / chance, low * (1 - low) / chance
        by_edge = np.bincount(grades, d_low, n_grades + 1) - np.bincount(grades + 1, d_high, n_grades + 1)
        d_free = np.r_[by_edge[1:k + 1].sum(), [by_edge[j + 1:k + 1].sum() * gaps[j - 1] for j in range(1, k)]]
        # A weak pull keeps thresholds of grades without rows in place.
        value = -np.log(chance).sum() + penalty / 2 * (w @ w) + 0.01 / 2 * (free @ free)
        slope = d_high - d_low
        d_w = sum((np.bincount(at[x], slope[owner[x]], m) for x in parts), penalty * w)
        return value, np.r_[d_w, d_free + 0.01 * free]

    p = _minimum(loss, np.r_[np.zeros(m), -1.0, np.zeros(k - 1)], rounds)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = p[:m]
    return Model(weights, p[m] + np.r_[0, np.cumsum(np.exp(p[m + 1:]))])


def calibrated(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, penalty: float = PENALTY, loss: float = LOSS) -> Model:
    """The model of all rows, with a limit on the probability of the lowest grade from held-out rows.

    A model of four fifths is scored on the other fifth (by hash of the features, so that copies stay together). The
    limit is what all but a share of ``loss`` of its texts of the best grade stay below; with too few of them there is none.
    """
    held = np.array([xxhash.xxh64_intdigest(r.tobytes()) % HELD_OUT == 0 for r in rows])
    part = lambda x: [r for r, h in zip(rows, held) if h == x]
    limit = 1.0
    best = held & (grades == n_grades - 1)
    if best.sum() * loss >= 1 and len(np.unique(grades[~held])) > 1:
        tails = (tried := fit_rows(part(False), grades[~held], n_grades, penalty)).tails(tried.score(part(True)))
        limit = float(np.quantile((1 - tails[:, 0])[grades[held] == n_grades - 1], 1 - loss))
    model = fit_rows(rows, grades, n_grades, penalty)
    model.limit = limit
    return model


def fit(docs: DataFrame, ratings: DataFrame, n_grades: int, id_col: str = "doc_id", text_col: str = "text",
        fit_rows_: int = FIT_ROWS, penalty: float = PENALTY) -> Model | None:
    """Fits ``ratings(id_col, grade)`` on a bounded sample: of the rated texts, each id, text and grade once, the
    ``fit_rows_`` with the smallest hash of id and text.

    Rows without an id or a grade, or with a grade outside 0 to ``n_grades`` - 1, are no ratings. None if no rated
    document is found, or only one grade. The driver gets the feature numbers of the sample.
    """
    rated = (ratings.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade"))
             .filter(f"doc_id is not null and grade between 0 and {n_grades - 1}").distinct())
    texts = (docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                         F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
             .withColumn("text_key", F.xxhash64("text")))
    names = ["doc_id", "text_key", "grade"]
    picked = (texts.select("doc_id", "text_key").distinct().join(rated, "doc_id")
              .orderBy(F.xxhash64("doc_id", "text_key"), *names).limit(fit_rows_))
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("grade", pa.int32()), ("features", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()  # bounded by fit_rows_
        for b in batches:
            kept = []
            for at, key in enumerate(zip(*(b.column(c).to_pylist() for c in names))):
                if key not in seen:
                    seen.add(key)
                    kept.append(at)
            b = b.take(pa.array(kept, pa.int64()))
            found = [features(t).tobytes() for t in texts_as_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(found, pa.binary())], schema=schema)

    sample = (texts.join(F.broadcast(picked), ["doc_id", "text_key"]).select(*names, "text")  # bounded by fit_rows_
              .mapInArrow(run, "doc_id long, text_key long, grade int, features binary")
              .groupBy(*names).agg(F.first("features").alias("features")).select("grade", "features").toPandas())
    grades = sample["grade"].to_numpy(np.int64)
    if len(np.unique(grades)) < 2:
        return None
    # In an order of its own, so that reruns agree.
    order = np.lexsort((sample["features"].to_numpy(), grades))
    rows = [np.frombuffer(sample["features"].iat[i], np.int32) for i in order]
    del sample
    return calibrated(rows, grades[order], n_grades, penalty)


def rate(docs: DataFrame, model: Model | None, n_grades: int, id_col: str = "doc_id", text_col: str = "text",
         cut: float = CUT, carry: Column | None = None) -> DataFrame:
    """``doc_id, expected_grade, p_best, keep`` (and ``carried``), one row per input row.

    ``p_best`` is the probability of the best grade, ``keep`` whether it reaches ``cut`` and the lowest grade is not
    likelier than the model's limit. A null text is empty. Without a
    model every document is kept, with null numbers. Null ids and repeated rows are kept. An empty table gives an
    empty result.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
                       *([] if carry is None else [carry.alias("carried")]))
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # a weight for each of 2 ** BITS features
    names = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for b in batches:
            n = b.num_rows
            if model is None:
                numbers = [pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.array([True] * n)]
            else:
                tails = model.tails(model.score([features(t) for t in texts_as_bytes(b.column("text"))]))
                numbers = [pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(model.keep(tails, cut))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *numbers],
                                             [*names, "expected_grade", "p_best", "keep"])

    schema = rows.drop("text").schema.add("expected_grade", "double").add("p_best", "double").add("keep", "boolean")
    return rows.mapInArrow(run, schema)


def graded(labels: DataFrame) -> DataFrame:
    """``doc_id, grade`` of ``labels``: 0 toxic, 1 neither toxic nor good, 2 good; none if both are null."""
    grade = (F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2))
    return labels.select("doc_id", grade.alias("grade"))


GRADES = 3
