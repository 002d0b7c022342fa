"""Three-year risk model on follow-up data: monotone boosted trees, out-of-fold scores, calibration."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import DenseMatrix
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from riskcohort import constants as K
from riskcohort.operators import boosting as hist, split
from riskcohort.session import cut_lineage, spread_by

MONOTONE = ("age", "bmi", "fpg_mmol_l")
FREE = ("male",)
# Settings of the risk model.
RISK = hist.Boost(rounds=180, rate=0.05, leaves=12, min_leaf=50, l2=5.0, loss="logistic", monotone=MONOTONE)


def thresholds(df: DataFrame, steps: int = 20, accuracy: int = 10_000) -> dict[str, list[float]]:
    """Cut values per monotone feature at even quantiles; a few dozen numbers on the driver."""
    marks = [i / steps for i in range(1, steps)]
    row = df.agg(*[F.percentile_approx(c, marks, accuracy).alias(c) for c in MONOTONE]).first()
    return {c: sorted(set(float(v) for v in row[c])) for c in MONOTONE}


def step_features(df: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """0/1 columns ``value >= cut``: with non-negative weights any sum of them is monotone."""
    flags = [
        (F.col(c) >= F.lit(v)).cast("double").alias(f"{c}_ge_{i}")
        for c in MONOTONE for i, v in enumerate(cuts[c])
    ]
    return df.select("*", *flags)


class MonotoneRisk:
    """Weighted logistic model over threshold steps, non-decreasing in age, BMI and glucose."""

    def __init__(self, cuts: dict[str, list[float]], model):
        self.cuts, self.model = cuts, model

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """Add the risk: a sum of the weights of the steps that a row has reached, as one expression."""
        weights = iter(self.model.coefficients.toArray().tolist())
        margin = F.lit(float(self.model.intercept))
        for column, cuts in [(c, self.cuts[c]) for c in MONOTONE]:
            for cut in cuts:
                margin = margin + F.when(F.col(column) >= cut, next(weights)).otherwise(0.0)
        margin = margin + F.col("male").cast("double") * next(weights)
        return df.withColumn(name, 1.0 / (1.0 + F.exp(-margin)))


def _assembled(df: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    names = [f"{c}_ge_{i}" for c in MONOTONE for i in range(len(cuts[c]))]
    stepped = step_features(df.withColumn("_male", F.col("male").cast("double")), cuts)
    return VectorAssembler(inputCols=[*names, "_male"], outputCol="features").transform(stepped)


def fit_steps(train: DataFrame, y: str = "y", w: str = "ipcw_weight", steps: int = 20,
              reg: float = 1e-4, max_iter: int = 200) -> MonotoneRisk:
    """The additive model; fails if the optimiser has not settled."""
    cuts = thresholds(train, steps)
    n = sum(len(v) for v in cuts.values())
    lower = DenseMatrix(1, n + 1, [0.0] * n + [float("-inf")])
    rows = _assembled(train, cuts).select("features", F.col(y).cast("double").alias("label"), F.col(w).alias("_w"))
    rows = rows.persist()
    model = LogisticRegression(
        featuresCol="features", labelCol="label", weightCol="_w", regParam=reg, maxIter=max_iter,
        lowerBoundsOnCoefficients=lower, standardization=False,
    ).fit(rows)
    rows.unpersist()
    if model.summary.totalIterations >= max_iter:
        raise RuntimeError(f"the step model has not settled in {max_iter} iterations")
    return MonotoneRisk(cuts, model)


def _risk_features(train: DataFrame) -> list[hist.Feature]:
    return hist.learn_features(train, list(MONOTONE), list(FREE), "ordinal")


def fit_monotone(train: DataFrame, y: str = "y", w: str = "ipcw_weight", boost: hist.Boost = RISK) -> hist.Model:
    """Weighted boosted trees of the risk, non-decreasing in age, BMI and glucose."""
    key = F.col("participant_id") if "participant_id" in train.columns else None
    task = hist.Task("risk", boost, _risk_features(train), F.lit(True))
    return hist.fit(train, [task], F.col(y).cast("int"), [y], F.col(w), key, classes=2, whole=hist.WHOLE).models[0]


def risk(model: hist.Model, df: DataFrame, name: str = "score") -> DataFrame:
    """Add the risk."""
    return model.transform(df, "_risk").withColumn(name, F.col("_risk")[0]).drop("_risk")


def out_of_fold(weighted: DataFrame, folds: int = K.FOLDS, seed: int = K.SEED, per_fold=None, boost: hist.Boost = RISK,
                y: str = "y", w: str = "ipcw_weight") -> DataFrame:
    """Score every evaluable row by a model that did not see it."""
    return out_of_fold_fits(weighted, folds, seed, per_fold, boost, y, w)[0]


def out_of_fold_fits(weighted: DataFrame, folds: int = K.FOLDS, seed: int = K.SEED, per_fold=None, boost: hist.Boost = RISK,
                     y: str = "y", w: str = "ipcw_weight") -> tuple[DataFrame, list[hist.Model]]:
    """Scores out of fold (``oof_risk_3y``) and the models of the folds, which are fitted in step.

    ``per_fold`` optionally re-weights a training part from its own censoring curve, one fit after the other; by
    default the weights of the whole eligible cohort are kept.
    """
    stored = cut_lineage(spread_by(weighted, "participant_id"))
    folded = cut_lineage(split.fold_assignment(stored, label=y, row_id="participant_id", seed=seed, folds=folds))
    parts = [folded.filter(F.col("fold") != k) for k in range(folds)]
    if per_fold is None:
        tasks = [hist.Task(f"fold {k}", boost, _risk_features(parts[k]), F.col("fold") != k) for k in range(folds)]
        found = hist.fit(folded, tasks, F.col(y).cast("int"), folded.columns, F.col(w), F.col("participant_id"), classes=2,
                         whole=hist.WHOLE)
        return found.scored().withColumn("oof_risk_3y", F.col("probability")[0]).drop("probability", "model"), found.models

    def run(k: int) -> tuple[DataFrame, hist.Model]:
        model = fit_monotone(per_fold(parts[k]), y, w, boost)
        return risk(model, folded.filter(F.col("fold") == k), "oof_risk_3y"), model

    # The fits run side by side; rows stay on the executors.
    with ThreadPool(min(folds, 5)) as pool:
        made = pool.map(run, range(folds))
    out = made[0][0]
    for part, _ in made[1:]:
        out = out.unionByName(part)
    return out, [m for _, m in made]


def fit_report(spark: SparkSession, models: list[hist.Model]) -> DataFrame:
    """One row per model: rounds grown, whether it stopped by itself, the best and the last loss held out."""
    rows = [(m.name, len(m.trees), m.stopped, min(m.losses, default=None), m.losses[-1] if m.losses else None) for m in models]
    return spark.createDataFrame(rows, "model string, rounds int, stopped boolean, best_loss double, last_loss double")


def log_odds(p: Column, clip: float = 1e-8) -> Column:
    def held(x: Column) -> Column:
        return F.least(F.greatest(x, F.lit(clip)), F.lit(1 - clip))

    return F.ln(held(p) / F.greatest(1.0 - p, F.lit(clip)))


def calibration(df: DataFrame, y: str = "y", score: str = "oof_risk_3y", w: str = "ipcw_weight") -> DataFrame:
    """Weighted intercept and slope of the outcome on the log-odds of the score."""
    rows = df.select(log_odds(F.col(score)).alias("x"), F.col(y).cast("double").alias("label"), F.col(w).alias("_w"))
    vectors = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
    model = LogisticRegression(regParam=0.0, maxIter=100, tol=1e-10, weightCol="_w").fit(vectors)
    return df.sparkSession.createDataFrame(
        [(float(model.intercept), float(model.coefficients[0]))], "intercept double, slope double"
    )


def _poisson_draws(repeats: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Replicate multiplicities of rows (key, count), a block at once; a row's draws depend on its key alone.

    The inner functions carry all they need, so that executors do not need this package for them.
    """
    def uniform(keys: np.ndarray) -> np.ndarray:
        """One number in (0, 1) per row and replicate, a mix of the bits of the row's key and the replicate."""
        x = keys.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, repeats + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53 + 2.0**-54

    def poisson(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Poisson draws by inversion; means above 30 by their normal limit."""
        u, n = uniform(keys), counts.astype(np.float64)[:, None]
        out = np.zeros_like(u)
        term = np.exp(-n)
        reached = term.copy()
        small = n <= 30
        for k in range(1, 200):
            more = small & (u > reached)
            if not more.any():
                break
            out += more
            term = term * n / k
            reached = reached + term
        if not small.all():
            # Box-Muller over two independent streams.
            radius = np.sqrt(-2 * np.log(u))
            angle = 2 * np.pi * uniform(~keys.astype(np.int64))
            out = np.where(small, out, np.maximum(0, np.rint(n + np.sqrt(n) * radius * np.cos(angle))))
        return out

    return poisson


def _replicate_part(repeats: int, block: int = 2048):
    """Per sorted partition: replicate totals and the within-partition part of the AUC.

    Rows stream through in score order, so the state is a few vectors of ``repeats`` numbers.
    """
    poisson = _poisson_draws(repeats)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pos, neg, pairs, loss, weight = (np.zeros(repeats) for _ in range(5))
        last, first, tie_pos, tie_neg = None, None, np.zeros(repeats), np.zeros(repeats)
        for batch in batches:
            for start in range(0, len(batch), block):
                part = batch.iloc[start:start + block]
                drawn = poisson(part["key"].to_numpy(), part["n"].to_numpy())
                scores, y = part["score"].to_numpy(), part["y"].to_numpy()
                mass = drawn * part["w"].to_numpy()[:, None]
                loss += (mass * ((scores - y) ** 2)[:, None]).sum(axis=0)
                weight += mass.sum(axis=0)
                edges = np.flatnonzero(np.r_[True, scores[1:] != scores[:-1]])
                tp = np.add.reduceat(mass * y[:, None], edges, axis=0)
                tn = np.add.reduceat(mass * (1 - y)[:, None], edges, axis=0)
                if first is None:
                    first, last = scores[0], scores[0]
                if scores[0] == last:  # the open tie goes on
                    tp[0] += tie_pos
                    tn[0] += tie_neg
                else:
                    tp, tn = np.vstack([tie_pos, tp]), np.vstack([tie_neg, tn])
                # All but the last score are complete.
                below = neg + np.cumsum(tn[:-1], axis=0) - tn[:-1]
                pairs += (tp[:-1] * (below + tn[:-1] / 2.0)).sum(axis=0)
                pos, neg = pos + tp[:-1].sum(axis=0), neg + tn[:-1].sum(axis=0)
                last, tie_pos, tie_neg = scores[-1], tp[-1], tn[-1]
        if first is None:
            return
        pairs += tie_pos * (neg + tie_neg / 2.0)
        yield pd.DataFrame({
            "replicate": np.arange(repeats), "first": first, "pos": pos + tie_pos, "neg": neg + tie_neg,
            "pairs": pairs, "loss": loss, "weight": weight,
        })

    return run


def bootstrap_replicates(df: DataFrame, repeats: int = 1000, y: str = "y", score: str = "oof_risk_3y",
                         w: str = "ipcw_weight", seed: int = K.SEED) -> DataFrame:
    """AUC and Brier score of every Poisson bootstrap replicate; scores and weights stay fixed.

    Equal rows are reduced to counts, range-partitioned by score and read once in order. Each
    partition answers with one row per replicate; earlier partitions' negatives are added after.
    """
    reduced = df.groupBy(
        (F.col(score) + F.lit(0.0)).alias("score"), F.col(y).cast("double").alias("y"), F.col(w).alias("w")
    ).agg(F.count(F.lit(1)).alias("n"))
    keyed = reduced.withColumn("key", F.xxhash64(F.lit(seed), "score", "y", "w"))
    sorted_rows = keyed.repartitionByRange("score").sortWithinPartitions("score", "y", "w")
    parts = cut_lineage(sorted_rows.mapInPandas(
        _replicate_part(repeats),
        "replicate int, first double, pos double, neg double, pairs double, loss double, weight double",
    ))
    # One row per partition and replicate.
    earlier = W.partitionBy("replicate").orderBy("first").rowsBetween(W.unboundedPreceding, -1)
    joined = parts.withColumn("_below", F.coalesce(F.sum("neg").over(earlier), F.lit(0.0)))
    return joined.groupBy("replicate").agg(
        F.try_divide(F.sum(F.col("pairs") + F.col("pos") * F.col("_below")), F.sum("pos") * F.sum("neg")).alias("auc"),
        F.try_divide(F.sum("loss"), F.sum("weight")).alias("brier"),
    )


def bootstrap_intervals(df: DataFrame, repeats: int = 1000, **columns) -> DataFrame:
    """95% percentile intervals, one row per metric."""
    replicates = bootstrap_replicates(df, repeats, **columns)
    row = replicates.agg(*[F.percentile(c, [0.025, 0.975]).alias(c) for c in ("auc", "brier")])
    entries = F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c)[0].alias("low"), F.col(c)[1].alias("high"))
        for c in ("auc", "brier")
    ])
    return row.select(F.explode(entries).alias("e")).select("e.*")
