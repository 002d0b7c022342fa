import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskcohort.operators import metrics, ordered, split, survival


def brute_auc(y, s, w):
    num = den = 0.0
    for i, j in itertools.product(range(len(y)), repeat=2):
        if y[i] == 1 and y[j] == 0:
            den += w[i] * w[j]
            num += w[i] * w[j] * (1.0 if s[i] > s[j] else 0.5 if s[i] == s[j] else 0.0)
    return num / den


def brute_ap(y, s, w):
    out = prev = 0.0
    total = sum(wi for yi, wi in zip(y, w) if yi)
    for t in sorted(set(s), reverse=True):
        tp = sum(wi for yi, si, wi in zip(y, s, w) if yi and si >= t)
        fp = sum(wi for yi, si, wi in zip(y, s, w) if not yi and si >= t)
        out += (tp / total - prev) * tp / (tp + fp)
        prev = tp / total
    return out


@pytest.mark.parametrize("rows_per_range", [1_000_000, 7])
def test_auc_and_ap_match_brute_force(spark, rows_per_range):
    rng = np.random.default_rng(1)
    n = 120
    y = rng.integers(0, 2, n).tolist()
    s = np.round(rng.random(n), 2)
    s[: n // 3] = 0.5  # a third of all rows share one score
    w = rng.random(n) + 0.1
    df = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(y, s, w)], "y int, score double, w double")
    got = metrics.ranking_metrics(df, rows_per_range=rows_per_range).first()
    assert got.auc == pytest.approx(brute_auc(y, s, w), abs=1e-12)
    assert got.average_precision == pytest.approx(brute_ap(y, s, w), abs=1e-12)
    both = metrics.risk_metrics(df).first()
    assert both.auc == pytest.approx(got.auc) and both.n_evaluable == n
    assert both.brier == pytest.approx(np.average((s - np.array(y)) ** 2, weights=w))


def test_auc_single_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.2, 1.0), (1, 0.4, 1.0)], "y int, score double, w double")
    assert metrics.ranking_metrics(df).first().auc is None


@pytest.mark.parametrize("rows_per_range", [1_000_000, 2])
def test_censoring_curve_by_hand(spark, rows_per_range):
    rows = [(1.0, 0), (1.0, 1), (2.0, 0), (2.0, 0), (3.0, 1), (4.0, 0)]
    df = spark.createDataFrame(rows, "time_years double, event int")
    got = survival.censoring_curve(df, rows_per_range=rows_per_range).orderBy("t").collect()
    assert [(r.t, r.censored, r.at_risk) for r in got] == [(1.0, 1, 6), (2.0, 2, 4), (4.0, 1, 1)]
    assert [r.survival for r in got] == pytest.approx([5 / 6, 5 / 12, 0.0])
    asked = spark.createDataFrame([(0.5,), (1.0,), (1.5,), (2.0,), (2.5,), (4.0,), (9.0,), (9.0,)], "q double")
    curve = survival.censoring_curve(df)
    seen = {r.q: r.survival for r in ordered.as_of(asked, "q", curve, "t", "survival", 1.0, rows_per_range).collect()}
    assert seen == pytest.approx({0.5: 1.0, 1.0: 1.0, 1.5: 5 / 6, 2.0: 5 / 6, 2.5: 5 / 12, 4.0: 5 / 12, 9.0: 0.0})


def test_horizon_and_weights(spark):
    rows = [(1, 1.0, 1), (2, 3.0, 1), (3, 3.0, 0), (4, 3.5, 0), (5, 2.0, 0), (6, 4.0, 1)]
    df = spark.createDataFrame(rows, "participant_id long, time_years double, event int")
    lab = {r.participant_id: (r.known, r.y) for r in survival.horizon_labels(df).collect()}
    assert lab == {1: (True, 1), 2: (True, 1), 3: (False, None), 4: (True, 0), 5: (False, None), 6: (True, 0)}
    w = {r.participant_id: r.ipcw_weight for r in survival.ipcw_weights(df).collect()}
    # Five at risk at the censoring at 2.0; the one at 3.0 is not before 3.0.
    assert w == pytest.approx({1: 1.0, 2: 1.25, 4: 1.25, 6: 1.25})


def test_weight_floor(spark):
    rows = [(i, 1.0, 0) for i in range(40)] + [(99, 5.0, 0)]
    df = spark.createDataFrame(rows, "participant_id long, time_years double, event int")
    assert [r.ipcw_weight for r in survival.ipcw_weights(df).collect()] == [20.0]


def test_quotas_reproduce_published_sizes(spark):
    totals = spark.createDataFrame([("Low", 7759), ("Moderate", 5507), ("High", 3061)], "c string, n long")
    got = {r.c: r.quota for r in split.holdout_quotas(totals, "c").collect()}
    assert got == {"Low": 1552, "Moderate": 1102, "High": 612} and sum(got.values()) == 3266


def test_split_is_exact_and_independent_of_partitioning(spark):
    df = spark.range(1000).select(F.col("id").alias("SEQN"), F.when(F.col("id") % 3 == 0, "High").otherwise("Low").alias("diabetes_risk"))
    a = split.stratified_holdout(df, digits=1)
    b = split.stratified_holdout(df.repartition(7), digits=2)
    test_a = {r.SEQN for r in a.filter("is_test").collect()}
    assert test_a == {r.SEQN for r in b.filter("is_test").collect()} and len(test_a) == 200
    folds = split.fold_assignment(df)
    sizes = {(r.diabetes_risk, r.fold): r["count"] for r in folds.groupBy("diabetes_risk", "fold").count().collect()}
    assert sorted(sizes[("High", k)] for k in range(5)) == [66, 67, 67, 67, 67]
    assert folds.count() == 1000


def test_zero_filled_confusion_and_class_metrics(spark):
    df = spark.createDataFrame([("Low", "Low"), ("Low", "High"), ("High", "High")], "y_true string, y_pred string")
    cells = metrics.confusion(df)
    assert cells.count() == 9 and cells.agg(F.sum("n")).first()[0] == 3
    per = {r.label: r for r in metrics.class_metrics(cells).collect()}
    assert per["Moderate"].f1 == 0.0 and per["High"].precision == 0.5 and per["Low"].recall == 0.5
    overall = metrics.macro_metrics(cells).first()
    assert overall.accuracy == pytest.approx(2 / 3)


def test_accept_rule_edges(spark):
    m = spark.createDataFrame([("a", 0.50), ("b", 0.51)], "model string, macro_f1 double")
    rows = [("a", "Moderate", 0.40, 0.4), ("a", "High", 0.50, 0.45), ("b", "Moderate", 0.39, 0.4), ("b", "High", 0.49, 0.42)]
    per = spark.createDataFrame(rows, "model string, label string, f1 double, recall double")
    got = metrics.acceptance(m, per, "a", "b").first()
    assert got.accepted is False and got.high_recall_drop == pytest.approx(0.03)
