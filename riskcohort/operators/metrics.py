"""Classification and weighted ranking metrics as grouped aggregates.

Inputs are plain columns; every function takes ``keys`` and returns one metric row (or a fixed
few) per group, so folds, models, replicates and subgroups are all the same call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskcohort import constants as K
from riskcohort.operators import ordered
from riskcohort.operators.scoring import PROBABILITIES

Keys = tuple[str, ...]
PROBABILITY_OF = {"High": "p_high", "Low": "p_low", "Moderate": "p_moderate"}


def ratio(part: Column, whole: Column) -> Column:
    """Zero where the denominator is zero."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, keys: Keys = (), truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """All nine cells per group in display order, zeros included."""
    cells = [(t, p) for t in K.CLASS_LABELS for p in K.CLASS_LABELS]
    counted = df.groupBy(*keys).agg(*[
        F.count_if((F.col(truth) == t) & (F.col(pred) == p)).alias(f"{t}_{p}") for t, p in cells
    ])
    entries = F.array(*[
        F.struct(F.lit(t).alias("y_true"), F.lit(p).alias("y_pred"), F.col(f"{t}_{p}").alias("n"))
        for t, p in cells
    ])
    return counted.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.*")


def confusion_rates(cells: DataFrame, keys: Keys = ()) -> DataFrame:
    """Row-normalised cells."""
    totals = cells.groupBy(*keys, "y_true").agg(F.sum("n").alias("_n"))
    return cells.join(totals, [*keys, "y_true"]).select(
        *keys, "y_true", "y_pred", ratio(F.col("n"), F.col("_n")).alias("rate")
    )


def class_metrics(cells: DataFrame, keys: Keys = ()) -> DataFrame:
    """Precision, recall, F1 and support per class from confusion cells."""
    n = F.col("n")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, n).otherwise(0))

    counts = []
    for c in K.CLASS_LABELS:
        t, p = F.col("y_true") == c, F.col("y_pred") == c
        counts += [total(t & p).alias(f"{c}_tp"), total(~t & p).alias(f"{c}_fp"), total(t & ~p).alias(f"{c}_fn")]
    wide = cells.groupBy(*keys).agg(*counts)
    entries = F.array(*[
        F.struct(F.lit(c).alias("label"), *[F.col(f"{c}_{k}").alias(k) for k in ("tp", "fp", "fn")])
        for c in K.CLASS_LABELS
    ])
    rows = wide.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.*")
    rows = rows.withColumns({
        "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
        "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
        "support": F.col("tp") + F.col("fn"),
    })
    p, r = F.col("precision"), F.col("recall")
    return rows.select(
        *keys, "label", "precision", "recall", ratio(2.0 * p * r, p + r).alias("f1"), "support", "tp"
    )


def macro_metrics(cells: DataFrame, keys: Keys = ()) -> DataFrame:
    per_class = class_metrics(cells, keys)
    return per_class.groupBy(*keys).agg(
        ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
    )


def class_probability_means(df: DataFrame, keys: Keys = ()) -> DataFrame:
    """Mean probability of every class, and of the true class, per true class."""
    return df.groupBy(*keys, "y_true").agg(
        *[F.avg(p).alias(f"mean_{p}") for p in PROBABILITIES],
        F.avg(probability_of(F.col("y_true"))).alias("mean_p_true"),
    )


def probability_of(label: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, column in PROBABILITY_OF.items():
        out = F.when(label == name, F.col(column)).otherwise(out)
    return out


def error_pairs(df: DataFrame, keys: Keys = ()) -> DataFrame:
    return (
        df.filter(F.col("y_true") != F.col("y_pred")).groupBy(*keys, "y_true", "y_pred")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(probability_of(F.col("y_pred"))).alias("mean_p_pred"),
            F.avg(probability_of(F.col("y_true"))).alias("mean_p_true"),
            F.avg("age").alias("mean_age"),
            F.avg("bmi").alias("mean_bmi"),
        )
    )


def weighted_means(df: DataFrame, keys: Keys = (), y: str = "y", score: str = "score", w: str = "w") -> DataFrame:
    """Counts, weighted mean outcome, weighted mean score and weighted Brier score."""
    c = F.col
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_evaluable"),
        F.sum(c(y).cast("long")).alias("cases"),
        F.try_divide(F.sum(c(w) * c(y)), F.sum(w)).alias("observed_risk"),
        F.try_divide(F.sum(c(w) * c(score)), F.sum(w)).alias("mean_predicted_risk"),
        F.try_divide(F.sum(c(w) * (c(score) - c(y)) * (c(score) - c(y))), F.sum(w)).alias("brier"),
    )


def by_score(df: DataFrame, keys: Keys = (), y: str = "y", score: str = "score", w: str = "w") -> DataFrame:
    """Positive and negative weight per distinct score; the only full-size shuffle of a curve."""
    c = F.col
    return df.groupBy(*keys, score).agg(
        F.sum(c(w) * c(y)).alias("wp"), F.sum(c(w) * (1 - c(y))).alias("wn")
    )


def ranking_metrics(df: DataFrame, keys: Keys = (), y: str = "y", score: str = "score", w: str = "w",
                    rows_per_range: int = ordered.ROWS_PER_RANGE) -> DataFrame:
    """Weighted ROC AUC (ties count half) and step-form average precision, exact.

    Both are NULL for a group with a single outcome class.
    """
    c = F.col
    # Adding 0.0 turns a negative zero into zero: both are one score.
    clean = df.withColumn(score, c(score) + F.lit(0.0))
    curve = ordered.running(
        by_score(clean, keys, y, score, w), score, {"p": c("wp"), "n": c("wn")}, keys=keys,
        rows_per_range=rows_per_range,
    )
    tp, fp = c("p_from"), c("n_from")            # at or above this score
    terms = curve.select(
        *keys, "wp", "wn",
        (c("wp") * (c("n_before") + c("wn") / 2.0)).alias("u"),
        (c("wp") * F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))).alias("a"),
    )
    return terms.groupBy(*keys).agg(
        F.try_divide(F.sum("u"), F.sum("wp") * F.sum("wn")).alias("auc"),
        F.try_divide(F.sum("a"), F.sum("wp")).alias("average_precision"),
    )


def risk_metrics(df: DataFrame, keys: Keys = (), y: str = "y", score: str = "score", w: str = "w") -> DataFrame:
    """The full weighted metric row per group, from one reduction to distinct scores."""
    c = F.col
    rows = df.groupBy(*keys, (c(score) + F.lit(0.0)).alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("cases"),
        F.sum(c(w) * c(y)).alias("wp"), F.sum(c(w) * (1 - c(y))).alias("wn"),
    )
    return _curve_metrics(rows, keys, ordered.ROWS_PER_RANGE)


def _curve_metrics(rows: DataFrame, keys: Keys, rows_per_range: int) -> DataFrame:
    """Metric row per group from ``(keys, score, n, cases, wp, wn)``."""
    c = F.col
    curve = ordered.running(
        rows, "score", {"p": c("wp"), "m": c("wn")}, keys=keys, rows_per_range=rows_per_range
    )
    tp, fp = c("p_from"), c("m_from")
    w_all = F.sum(c("wp") + c("wn"))
    s = c("score")
    return curve.groupBy(*keys).agg(
        F.sum("n").alias("n_evaluable"),
        F.sum("cases").cast("long").alias("cases"),
        F.try_divide(F.sum("wp"), w_all).alias("observed_risk"),
        F.try_divide(F.sum((c("wp") + c("wn")) * s), w_all).alias("mean_predicted_risk"),
        F.try_divide(
            F.sum(c("wp") * (c("m_before") + c("wn") / 2.0)), F.sum("wp") * F.sum("wn")
        ).alias("auc"),
        F.try_divide(
            F.sum(c("wp") * F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))), F.sum("wp")
        ).alias("average_precision"),
        F.try_divide(
            F.sum(c("wp") * (s - 1.0) * (s - 1.0) + c("wn") * s * s), w_all
        ).alias("brier"),
    )


def risk_groups(age: Column, male: Column, bmi: Column, fpg: Column) -> Column:
    """Names of every overlapping subgroup a follow-up row belongs to."""
    f, a, b = K.FPG_BANDS, K.AGE_BANDS, K.BMI_BANDS
    # The subgroup names.
    named = [
        (F.lit(True), "all"),
        (fpg < f[0], "fpg_below_100"),
        ((fpg >= f[0]) & (fpg < f[1]), "fpg_100_109"),
        (fpg >= f[1], "fpg_110_125"),
        (male == 0, "women"),
        (male == 1, "men"),
        (age < a[0], "age_20_29"),
        ((age >= a[0]) & (age < a[1]), "age_30_49"),
        ((age >= a[1]) & (age < a[2]), "age_50_69"),
        (age >= a[2], "age_70_plus"),
        (bmi < b[0], "bmi_below_25"),
        ((bmi >= b[0]) & (bmi < b[1]), "bmi_25_29"),
        (bmi >= b[1], "bmi_30_plus"),
    ]
    return F.array_compact(F.array(*[F.when(cond, name) for cond, name in named]))


def subgroup_metrics(df: DataFrame, y: str = "y", score: str = "score", w: str = "w",
                     rows_per_range: int = ordered.ROWS_PER_RANGE) -> DataFrame:
    """A metric row for all thirteen subgroups.

    Rows are first reduced to (set of groups, score, outcome, weight) so that membership in up
    to five groups multiplies the reduced table, not the input.
    """
    c = F.col
    member = df.select(
        risk_groups(c("age"), c("male"), c("bmi"), c("fpg_mmol_l")).alias("groups"),
        c(y).alias("y"), c(score).alias("score"), c(w).alias("w"),
    )
    reduced = member.groupBy("groups", "score").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("cases"),
        F.sum(c("w") * c("y")).alias("wp"), F.sum(c("w") * (1 - c("y"))).alias("wn"),
    )
    rows = (
        reduced.select(F.explode("groups").alias("group"), "score", "n", "cases", "wp", "wn")
        .groupBy("group", "score")
        .agg(*[F.sum(x).alias(x) for x in ("n", "cases", "wp", "wn")])
    )
    return _curve_metrics(rows, ("group",), rows_per_range)


def one_vs_rest_auc(df: DataFrame, keys: Keys = ()) -> DataFrame:
    """AUC of each class against the rest, unweighted rows."""
    entries = F.array(*[
        F.struct(F.lit(label).alias("label"), F.col(p).alias("score"),
                 (F.col("y_true") == label).cast("int").alias("y"))
        for label, p in PROBABILITY_OF.items()
    ])
    rows = df.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.*", F.lit(1.0).alias("w"))
    return ranking_metrics(rows, (*keys, "label")).select(*keys, "label", "auc")


def macro_auc(df: DataFrame, keys: Keys = ()) -> DataFrame:
    """Mean of the one-vs-rest AUCs; NULL when a class is absent."""
    per_class = one_vs_rest_auc(df, keys)
    complete = F.count("auc") == len(K.CLASS_LABELS)
    return per_class.groupBy(*keys).agg(F.when(complete, F.avg("auc")).alias("macro_auc"))


def fold_mean_std(df: DataFrame, metrics: tuple[str, ...], keys: Keys = ("model",)) -> DataFrame:
    """Mean and population deviation over folds; NULL folds are skipped."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return df.groupBy(*keys).agg(*aggs)


def best_model(df: DataFrame, name: str = "model", first: str = "macro_f1", then: str = "macro_recall") -> DataFrame:
    """The model with the best score, ties by the second one."""
    return df.agg(
        F.max_by(name, F.struct(first, then)).alias(name),
        F.max(F.struct(first, then))[first].alias(first),
        F.max(F.struct(first, then))[then].alias(then),
    )


def acceptance(metrics: DataFrame, per_class: DataFrame, baseline: str, candidate: str, keys: str = "model") -> DataFrame:
    """Gate of a candidate over the baseline: enough gain, no class given up for it."""
    c = F.col

    def of(model: str, value: str, label: str | None = None) -> Column:
        hit = c(keys) == model
        if label is not None:
            hit = hit & (c("label") == label)
        return F.max(F.when(hit, c(value)))

    def diff(value: str, label: str) -> Column:
        return (of(baseline, value, label) - of(candidate, value, label))

    overall = metrics.select(keys, F.lit(None).cast("string").alias("label"), c("macro_f1").alias("f1"),
                             F.lit(None).cast("double").alias("recall"))
    rows = overall.unionByName(per_class.select(keys, "label", "f1", "recall"))
    total = F.col("label").isNull()
    gain = (F.max(F.when((c(keys) == candidate) & total, c("f1")))
            - F.max(F.when((c(keys) == baseline) & total, c("f1"))))
    out = rows.agg(
        gain.alias("macro_f1_gain"),
        diff("f1", "Moderate").alias("moderate_f1_drop"),
        diff("f1", "High").alias("high_f1_drop"),
        diff("recall", "High").alias("high_recall_drop"),
    )
    drops = [c(d) <= K.MAX_CLASS_DROP for d in ("moderate_f1_drop", "high_f1_drop", "high_recall_drop")]
    return out.withColumn(
        "accepted", (c("macro_f1_gain") >= K.MIN_F1_GAIN) & drops[0] & drops[1] & drops[2]
    )
