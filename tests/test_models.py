import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from riskcohort import constants as K
from riskcohort.operators import features, followup, importance, models, oversample
from riskcohort.operators.scoring import linear_scorer
from riskcohort.sources.tables import ContractError


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        age, bmi = int(rng.integers(20, 80)), float(np.round(rng.uniform(18, 45), 1))
        label = "High" if age + bmi > 95 else "Moderate" if age + bmi > 75 else "Low"
        rows.append((i, age, int(rng.integers(1, 3)), None if i % 50 == 0 else bmi, int(rng.choice(K.RACE_CODES)),
                     None if i % 40 == 0 else float(rng.integers(0, 2)), 0.0, 1.0, float(rng.integers(0, 3)), label))
    schema = ("SEQN long, age int, sex int, bmi double, race_ethnicity int, family_history double, hypertension double, "
              "physical_activity double, smoking_status double, diabetes_risk string")
    return spark.createDataFrame(rows, schema).repartition(2).persist()


def test_fit_score_save_load(spark, people, tmp_path):
    model = models.fit(models.Candidate("forest", models.forest(8, 5)), people)
    scored = models.score(model, people)
    sums = scored.select((F.col("p_high") + F.col("p_low") + F.col("p_moderate")).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert sums[0] == pytest.approx(1.0) and sums[1] == pytest.approx(1.0)
    right = scored.filter(F.col("y_pred") == F.col(K.TARGET)).count()
    assert right > 300
    summary = models.check_model(model)
    assert summary["features"] == list(K.PREDICTORS)
    models.save_model(spark, model, str(tmp_path / "m"))
    again = models.score(models.load_model(spark, str(tmp_path / "m")), people)
    assert again.select("SEQN", "p_high").exceptAll(scored.select("SEQN", "p_high")).count() == 0


def test_boosting_ordinal_with_indicators(spark, people, tmp_path):
    candidate = models.Candidate("b", models.boosting(20, leaves=8), "ordinal", True)
    model = models.fit(candidate, people)
    unseen = people.withColumn("race_ethnicity", F.lit(5))
    row = models.score(model, unseen).agg(F.min("p_high"), F.count("y_pred")).first()
    assert row[0] > 0 and row[1] == 400
    assert models.score(model, people).filter(F.col("y_pred") == F.col(K.TARGET)).count() > 330
    models.save_model(spark, model, str(tmp_path / "b"))
    again = models.load_model(spark, str(tmp_path / "b"))
    assert again.to_json() == model.to_json()
    assert models.check_model(again)["params"]["rounds_grown"] == len(model.trees)


def plain_boost(codes, bins, y, w, boost, rounds):
    """One model by plain loops over leaves, features and bins, level by level."""
    n, classes = len(y), 3
    shares = np.array([w[y == k].sum() for k in range(classes)])
    scores = np.tile(np.log(shares / shares.sum()), (n, 1))
    for _ in range(rounds):
        e = np.exp(scores - scores.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        steps = np.zeros_like(scores)
        for k in range(classes):
            g, h = (p[:, k] - (y == k)) * w, p[:, k] * (1 - p[:, k]) * w
            value = lambda r: -g[r].sum() / (h[r].sum() + boost.l2)
            worth = lambda r: g[r].sum() ** 2 / (h[r].sum() + boost.l2) / 2
            level, done = [np.arange(n)], []
            while level:
                found = []
                for r in level:
                    best = (-np.inf, None, None)
                    for f in range(codes.shape[1]):
                        for b in range(bins[f] - 1):
                            lo, hi = r[codes[r, f] <= b], r[codes[r, f] > b]
                            if min(len(lo), len(hi)) >= boost.min_leaf:
                                gain = worth(lo) + worth(hi) - worth(r)
                                if gain > best[0] + 1e-9:
                                    best = (gain, lo, hi)
                    found.append((best[0], r, best[1], best[2]))
                room = boost.leaves - len(done) - len(level)
                following = []
                for gain, r, lo, hi in sorted(found, key=lambda x: -x[0]):
                    if room > 0 and gain > 1e-12:
                        room -= 1
                        following += [lo, hi]
                    else:
                        done.append(r)
                level = following
                if room <= 0:
                    done, level = done + level, []
            for r in done:
                steps[r, k] = boost.rate * value(r)
        scores += steps
    return scores


def test_boosting_equals_plain_loops(spark):
    from riskcohort.operators import boosting as hist

    rng = np.random.default_rng(12)
    a, b, c = rng.normal(size=300), np.round(rng.normal(size=300), 1), rng.integers(0, 3, 300).astype(float)
    y = np.clip(np.floor(a + b / 2 + (c == 1) + rng.normal(size=300) / 2 + 1), 0, 2).astype(int)
    w = rng.uniform(0.5, 2, 300)
    rows = [(i, float(a[i]), None if i % 37 == 0 else float(b[i]), float(c[i]), int(y[i]), float(w[i])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y int, w double").repartition(5)
    feats = [hist.Feature("a", "numeric", (-1.0, -0.25, 0.25, 1.0)), hist.Feature("b", "numeric", (-0.5, 0.5), 0.7), hist.Feature("b", "missing"),
             hist.Feature("c", "onehot", (1.0,)), hist.Feature("c", "ordinal", (0.0, 1.0, 2.0))]
    boost = hist.Boost(rounds=4, rate=0.3, leaves=6, min_leaf=8, l2=0.5, patience=0)
    tasks = [hist.Task("all", boost, feats, F.lit(True)), hist.Task("some", boost, feats, F.col("id") % 3 != 0)]
    found = hist.fit(df, tasks, F.col("y"), ["id"], F.col("w"))
    raw = {"a": a, "b": np.where(np.arange(300) % 37 == 0, np.nan, b), "c": c}
    codes = hist.Layout(feats).codes(raw).astype(int)
    bins = [f.bins for f in feats]
    assert np.allclose(found.models[0].scores(raw, 300), plain_boost(codes, bins, y, w, boost, 4))
    part = np.arange(300) % 3 != 0
    want = plain_boost(codes[part], bins, y[part], w[part], boost, 4)
    assert np.allclose(found.models[1].scores({k: v[part] for k, v in raw.items()}, int(part.sum())), want)
    scored = {r.id: r for r in found.scored().collect()}
    assert set(scored) == {i for i in range(300) if i % 3 == 0} and {r.model for r in scored.values()} == {1}
    direct = hist.probabilities(found.models[1].scores(raw, 300), "softmax")
    assert all(np.allclose(r.probability, direct[i]) for i, r in scored.items())


def test_boosting_stops_on_noise(spark):
    from riskcohort.operators import boosting as hist

    rng = np.random.default_rng(13)
    df = spark.createDataFrame([(i, float(rng.normal()), int(rng.integers(0, 3))) for i in range(800)], "id long, a double, y int")
    task = hist.Task("noise", hist.Boost(rounds=300, patience=3), hist.learn_features(df, ["a"], []), F.lit(True))
    model = hist.fit(df, [task], F.col("y"), ["id"], key=F.col("id")).models[0]
    assert model.stopped and len(model.trees) < 60 and len(model.losses) == len(model.trees) + 1
    empty = hist.fit(df.filter("false"), [task], F.col("y"), ["id"]).models[0]
    assert empty.trees and empty.losses == []


def test_shared_columns_of_codes_give_sums_and_sides_by_feature():
    from riskcohort.operators import boosting as hist

    rng = np.random.default_rng(14)
    feats = [hist.Feature("a", "numeric", tuple(np.linspace(0, 1, 127))), hist.Feature("a", "missing"),
             *[hist.Feature("b", "onehot", (float(v),), 3.0) for v in range(300)], hist.Feature("c", "ordinal", (1.0, 2.0, 4.0), 2.0),
             *[hist.Feature("c", "onehot", (v,), 2.0) for v in (1.0, 2.0)]]
    raw = {"a": np.where(rng.uniform(size=2000) < 0.1, np.nan, rng.uniform(size=2000)), "b": rng.integers(0, 310, 2000).astype(float),
           "c": rng.choice([1.0, 2.0, 3.0, 4.0, np.nan], 2000)}
    layout, w = hist.Layout(feats), rng.uniform(size=2000)
    packs, codes = hist.Packs(layout), layout.codes(raw).astype(int)
    columns = packs.codes(raw)
    assert len(columns) < 6 and all(c.dtype == np.uint8 for c in columns)
    for i, f in enumerate(feats):
        for at in range(f.bins):
            assert np.array_equal(packs.below(i, at)[columns[packs.pack[i]]], codes[:, i] <= at)
    sums = packs.places([np.bincount(c, w, n) for c, n in zip(columns, packs.sizes)])
    assert np.allclose(sums, np.concatenate([np.bincount(codes[:, i], w, f.bins) for i, f in enumerate(feats)]))


def test_a_level_sums_one_child_of_two(spark, monkeypatch):
    from riskcohort.operators import boosting as hist

    rng = np.random.default_rng(15)
    df = spark.createDataFrame([(i, float(rng.normal()), int(rng.integers(0, 2))) for i in range(600)], "id long, a double, y int").repartition(40)
    sizes, summed = [], hist._summed

    def seen(blocks, counts, size, parts):
        sizes.append((size, parts))
        return summed(blocks, counts, size, parts)

    monkeypatch.setattr(hist, "_summed", seen)
    boost = hist.Boost(rounds=1, leaves=4, patience=0, loss="logistic")
    places = 6
    found = hist.fit(df, [hist.Task("m", boost, [hist.Feature("a", "numeric", (-1.0, -0.5, 0.0, 0.5, 1.0))], F.lit(True))], F.col("y"), ["id"], classes=2)
    assert sum(f < 0 for f in found.models[0].trees[0][0].feature) == 4
    # First scores; the root, one child of two, and the loss after the round.
    assert sizes == [(2, 1), (3 * places + 2, 1), (3 * places + 2, 1), (2, 1)]


def test_ended_models_leave_the_blocks(spark, monkeypatch):
    """A model of fewer rounds does not travel on, nor do its codes; its scores are there at the end. Sums meet by slices."""
    from riskcohort.operators import boosting as hist

    monkeypatch.setattr(hist, "TASK", 300)
    monkeypatch.setattr(hist, "AT_ONCE", 1)
    monkeypatch.setattr(hist, "SLICE", 7)
    monkeypatch.setattr(hist, "STORED_EVERY", 3)
    rng = np.random.default_rng(16)
    a = rng.normal(size=600)
    rows = [(i, float(a[i]), int(a[i] + rng.normal() > 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, a double, y int").repartition(5)
    states, updated = [], hist._updated

    def seen(*args):
        states.append(updated(*args))
        return states[-1]

    monkeypatch.setattr(hist, "_updated", seen)
    tasks = [hist.Task(str(n), hist.Boost(rounds=n, leaves=4, patience=0, loss="logistic"), [hist.Feature("a", "numeric", cuts)], F.col("id") % 3 != n % 3)
             for n, cuts in ((2, (-1.0, 0.0, 1.0)), (5, (-0.5, 0.5)))]
    found = hist.fit(df, tasks, F.col("y"), ["id"], classes=2)
    assert [len(m.trees) for m in found.models] == [2, 5]
    held = states[-1].collect()
    assert len(held) > 1
    assert all(b["scores"][0] is None and b["codes"][0] is None and b["scores"][1] is not None for b in held)
    scored = {(r.model, r.id): r.probability for r in found.scored().collect()}
    assert set(scored) == {(m, i) for m, n in ((0, 2), (1, 5)) for i in range(600) if i % 3 == n % 3}
    for m in (0, 1):
        direct = hist.probabilities(found.models[m].scores({"a": a}, 600), "logistic")
        assert all(np.allclose(p, direct[i]) for (k, i), p in scored.items() if k == m)


def test_a_model_of_few_cells_is_fitted_by_one_task(spark, monkeypatch):
    """Same losses and scores as level by level, without a job a level; a model of no rows and one of too many cells."""
    from riskcohort.operators import boosting as hist

    rng = np.random.default_rng(18)
    a, b, c = np.round(rng.normal(size=900), 1), rng.integers(0, 9, 900).astype(float), rng.integers(0, 3, 900).astype(float)
    y = np.clip(np.floor(a + (b > 4) / 2 + (c == 1) + rng.normal(size=900) / 2 + 1), 0, 2).astype(int)
    rows = [(i, float(a[i]), None if i % 31 == 0 else float(b[i]), float(c[i]), None if i % 53 == 0 else int(y[i]), 0.5 + i % 4) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y int, w double").repartition(5)
    feats = [hist.Feature("a", "numeric", tuple(np.arange(-2, 2, 0.25))), hist.Feature("b", "numeric", (1.5, 4.5, 6.5), 4.0),
             hist.Feature("b", "missing"), hist.Feature("c", "onehot", (1.0,))]
    few = [hist.Feature("a", "numeric", (0.0,)), hist.Feature("c", "ordinal", (0.0, 1.0, 2.0))]
    boost = hist.Boost(rounds=40, rate=0.5, leaves=7, min_leaf=8, l2=0.5, patience=2)
    tasks = [hist.Task(f"{n} {k}", x, f, F.col("id") % 3 != k) for n, x, f in (
        ("all", boost, feats), ("few", boost, few), ("on", hist.Boost(rounds=3, leaves=20, min_leaf=8, patience=0), feats)) for k in range(2)]
    tasks.append(hist.Task("empty", hist.Boost(rounds=2), feats, F.lit(False)))
    risk = [hist.Task(f"risk {k}", hist.Boost(rounds=20, leaves=6, min_leaf=9, l2=1.0, loss="logistic", monotone=("a",)), feats, F.col("id") % 3 != k)
            for k in range(3)]
    jobs, summed = [], hist._summed
    monkeypatch.setattr(hist, "_summed", lambda *x: jobs.append(1) or summed(*x))
    for some, label, n in ((tasks, F.col("y"), 3), (risk, (F.col("y") > 0).cast("int"), 2)):
        by_level = hist.fit(df, some, label, ["id"], F.col("w"), F.col("id"), n)
        before = len(jobs)
        alone = hist.fit(df, some, label, ["id"], F.col("w"), F.col("id"), n, whole=hist.WHOLE)
        assert before > 0 and len(jobs) == before
        monkeypatch.setattr(hist, "SCORED", 100)
        for x, z in zip(by_level.models, alone.models):
            assert x.stopped == z.stopped and len(x.trees) == len(z.trees) and np.allclose(x.first, z.first) and np.allclose(x.losses, z.losses)
        want = {(r.model, r.id): r.probability for r in by_level.scored().collect()}
        got = {(r.model, r.id): r.probability for r in alone.scored().collect()}
        assert set(got) == set(want) and all(np.allclose(got[x], want[x]) for x in want)
        assert n == 2 or any(m.stopped for m in alone.models)
        hist.fit(df, some, label, ["id"], F.col("w"), F.col("id"), n, whole=100)
        assert len(jobs) == 2 * before
        jobs.clear()


def test_unknown_category_codes(people):
    rows = features.numeric_predictors(people)
    unseen = rows.limit(1).withColumn("race_ethnicity", F.lit(5.0))
    ordinal = features.feature_pipeline(rows, "ordinal").fit(rows).transform(unseen).first()
    assert ordinal["race_ethnicity_ord"] == -1.0
    onehot = features.feature_pipeline(rows).fit(rows).transform(unseen).first()
    assert onehot["race_ethnicity_vec"].numNonzeros() == 0


def test_leaky_model_is_rejected(people):
    with pytest.raises(ContractError):
        from pyspark.ml import Pipeline, PipelineModel
        from pyspark.ml.feature import VectorAssembler

        leaky = Pipeline(stages=[VectorAssembler(inputCols=["age", "SEQN"], outputCol="features")]).fit(people)
        models.check_model(PipelineModel(stages=leaky.stages))


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(5)
    pts = np.c_[np.round(rng.normal(size=(60, 2)), 2), rng.integers(0, 2, (60, 2))]
    pts = np.r_[pts, np.repeat(pts[:1], 30, axis=0), np.repeat(pts[1:2], 2, axis=0), [[9.0, 9.0, 0, 1]]]
    df = spark.createDataFrame([(Vectors.dense(p), 0.0) for p in pts], ["features", "label"])
    distinct = oversample.distinct_vectors(df).persist()
    vec = {r.vid: np.array(r.vec) for r in distinct.collect()}
    copies = {r.vid: r.copies for r in distinct.collect()}
    got = {r.base: r.near for r in oversample.neighbours(distinct, 5).collect()}
    assert set(got) == set(vec)
    for vid, near in got.items():
        others = sorted(np.linalg.norm(vec[vid] - vec[o]) for o in vec if o != vid for _ in range(copies[o]))
        want = ([0.0] * (copies[vid] - 1) + others)[:5]
        have = ([0.0] * (copies[vid] - 1) + [d for e in near for d in [e.d2 ** 0.5] * e.copies])[:5]
        assert have == pytest.approx(want)


@pytest.mark.parametrize("cell", [4, 1 << 20])
def test_neighbours_over_many_cells(spark, monkeypatch, cell):
    """Two classes that share vectors, ties on a lattice, dense and sparse places, one vector with half a class."""
    monkeypatch.setattr(oversample, "CELL", cell)
    rng = np.random.default_rng(8)
    pts = [(0.0, p) for p in np.c_[np.round(rng.normal(size=(300, 2)) * 3), rng.integers(0, 2, (300, 2))]]
    pts += [(0.0, p) for p in np.c_[rng.normal(size=(200, 2)) / 50, np.zeros((200, 2))]]
    pts += [(1.0, p) for _, p in pts[:120]] + [(1.0, np.array([0.0, 0.0, 1.0, 1.0]))] * 120
    df = spark.createDataFrame([(Vectors.dense(p), label) for label, p in pts], ["features", "label"]).repartition(4)
    distinct = oversample.distinct_vectors(df).persist()
    rows = distinct.collect()
    assert len({r.vid for r in rows}) == len(rows) == len({(r.label, tuple(r.vec)) for r in rows})
    got = {r.base: r for r in oversample.neighbours(distinct, 5).collect()}
    assert set(got) == {r.vid for r in rows}
    for r in rows:
        if r.copies > 5:
            assert got[r.vid].near == []
            continue
        others = sorted((sum((a - b) ** 2 for a, b in zip(r.vec, o.vec)), o.vid, o.copies) for o in rows if o.label == r.label and o.vid != r.vid)
        # As many as it takes to hold five rows; what follows is not looked at.
        n = next(i for i in range(1, 6) if r.copies - 1 + sum(o[2] for o in others[:i]) >= 5)
        assert [(e.vid, e.copies) for e in got[r.vid].near[:n]] == [o[1:] for o in others[:n]]


def test_names_are_not_compared_pair_by_pair():
    from riskcohort.operators import oversample

    class Name(str):
        compared = 0
        __hash__ = str.__hash__

        def __eq__(self, other):
            Name.compared += 1
            return str.__eq__(self, other)

    rng = np.random.default_rng(17)
    vec = rng.integers(0, 9, (300, 3)).astype(float)
    names = np.array([Name(f"v{i:03}") for i in range(300)], object)
    found = dict(oversample._nearest(vec, names, np.full(300, np.inf), vec, names, np.ones(300, np.int64), 4))
    assert Name.compared <= 300
    for i, near in found.items():
        d2 = ((vec - vec[i]) ** 2).sum(axis=1)
        want = sorted((d2[j], names[j]) for j in range(300) if j != i)[:4]
        assert [(d, n) for d, n, _ in near] == want


def test_oversampling_of_vectors_that_classes_share(spark):
    """Every lacking row is made, also from a vector of two minority classes."""
    rng = np.random.default_rng(9)
    shared = [Vectors.dense(*p) for p in np.round(rng.normal(size=(12, 3)), 1)]
    rows = [(v, 1.0) for v in shared] + [(v, 2.0) for v in shared[:8]] + [(Vectors.dense(*p), 0.0) for p in rng.normal(size=(90, 3))]
    rows += [(Vectors.dense(9.0, 9.0, 9.0), 2.0)] * 9
    out = oversample.oversampled(spark.createDataFrame(rows, ["features", "label"]))
    assert {r.label: r["count"] for r in out.groupBy("label").count().collect()} == {0.0: 90, 1.0: 90, 2.0: 90}


def test_oversampling_balances_classes(spark):
    rng = np.random.default_rng(6)
    rows = [(Vectors.dense(*p, 1.0), 0.0) for p in rng.normal(size=(40, 2))]
    rows += [(Vectors.dense(*p, 0.0), 1.0) for p in rng.normal(size=(15, 2))]
    rows += [(Vectors.dense(0.5, 0.5, 0.0), 2.0)] * 9
    df = spark.createDataFrame(rows, ["features", "label"])
    out = oversample.oversampled(df)
    assert {r.label: r["count"] for r in out.groupBy("label").count().collect()} == {0.0: 40, 1.0: 40, 2.0: 40}
    same = [r.features for r in oversample.synthetic_rows(df).filter("label = 2").collect()]
    assert all(np.allclose(v.toArray(), [0.5, 0.5, 0.0]) for v in same)


def test_permuted_copies_only_swap_one_feature(people):
    test = people.withColumns({"id": F.col("SEQN"), "y_true": F.col(K.TARGET)})
    copies = importance.permuted_copies(test, repeats=2)
    assert copies.count() == 400 * 2 * 8
    joined = copies.filter("feature = 'age' and repeat = 1").alias("c").join(test.alias("t"), "id")
    assert joined.filter("not (c.bmi <=> t.bmi) or not (c.sex <=> t.sex)").count() == 0
    ages = joined.agg(F.sum("c.age"), F.sum("t.age")).first()
    assert ages[0] == ages[1] and joined.filter("c.age <> t.age").count() > 300
    scorer = linear_scorer({"": -6.0, "age": 0.1}, {"": 3.0, "age": -0.05})
    got = {r.feature: r.importance_mean for r in importance.permutation_importance(test, scorer, 2).collect()}
    assert got["age"] > 0.05 and got["sex"] == 0.0


@pytest.fixture(scope="module")
def weighted(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(600):
        age, bmi, fpg = float(rng.integers(20, 80)), float(rng.uniform(18, 40)), float(rng.uniform(4, 6.9))
        p = 1 / (1 + np.exp(-(-12 + 0.03 * age + 0.05 * bmi + 1.4 * fpg)))
        y = int(rng.random() < p)
        rows.append((i, age, i % 2, bmi, fpg, y, 1.0 + i % 3 / 10, float(np.round(p, 2)), 2.0, y))
    return spark.createDataFrame(rows, "participant_id long, age double, male int, bmi double, fpg_mmol_l double, y int, "
                                       "ipcw_weight double, oof_risk_3y double, time_years double, event int").persist()


def test_monotone_risk(spark, weighted):
    from dataclasses import replace

    from riskcohort.operators import metrics

    steps = followup.fit_steps(weighted, steps=8)
    assert (steps.model.coefficients.toArray()[:-1] >= 0).all()
    boost = replace(followup.RISK, rounds=15, min_leaf=15, rate=0.2)
    model = followup.fit_monotone(weighted, boost=boost)
    fixed = {"age": F.lit(50.0), "bmi": F.lit(26.0), "fpg_mmol_l": F.lit(5.5), "male": F.lit(1)}
    for name, low, step in (("age", 18, 1.0), ("bmi", 16, 0.5), ("fpg_mmol_l", 3.5, 0.06)):
        for other in ({}, {"age": F.lit(25.0), "bmi": F.lit(38.0), "male": F.lit(0)}):
            columns = fixed | other | {name: F.col("id") * step + low}
            line = spark.range(60).select("id", *[c.cast("double").alias(n) for n, c in columns.items()])
            risk = [r.score for r in followup.risk(model, line).orderBy("id").collect()]
            assert all(b >= a - 1e-12 for a, b in zip(risk, risk[1:])) and risk[-1] > risk[0]
    out, fitted = followup.out_of_fold_fits(weighted.drop("oof_risk_3y"), folds=3, boost=boost)
    assert out.count() == 600 and out.filter("oof_risk_3y is null or oof_risk_3y < 0 or oof_risk_3y > 1").count() == 0
    report = followup.fit_report(spark, fitted).collect()
    assert len(report) == 3 and all(r.rounds <= 15 and r.best_loss <= r.last_loss for r in report)
    auc = lambda df: metrics.ranking_metrics(df, (), "y", "s", "ipcw_weight").first()["auc"]
    parts = [steps_k.score(out.filter(f"fold = {k}").drop("score"), "s") for k in range(3)
             for steps_k in [followup.fit_steps(out.filter(f"fold != {k}"), steps=8)]]
    additive = auc(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    trees = auc(out.withColumn("s", F.col("oof_risk_3y")))
    assert trees > additive - 0.03
    own = followup.out_of_fold(weighted.drop("oof_risk_3y"), folds=2, boost=replace(boost, rounds=3), per_fold=lambda df: df)
    assert own.count() == 600 and own.filter("oof_risk_3y is null").count() == 0


def test_calibration_of_true_risk(weighted):
    row = followup.calibration(weighted).first()
    assert abs(row.slope - 1) < 0.4 and abs(row.intercept) < 0.8


def test_bootstrap_matches_direct_computation(spark, weighted):
    repeats = 6
    got = {r.replicate: r for r in followup.bootstrap_replicates(weighted, repeats).collect()}
    reduced = (
        weighted.groupBy((F.col("oof_risk_3y") + F.lit(0.0)).alias("score"), F.col("y").cast("double").alias("y"), F.col("ipcw_weight").alias("w"))
        .agg(F.count(F.lit(1)).alias("n")).withColumn("key", F.xxhash64(F.lit(K.SEED), "score", "y", "w")).toPandas()
    )
    drawn = followup._poisson_draws(repeats)(reduced["key"].to_numpy(), reduced["n"].to_numpy())
    s, y = reduced["score"].to_numpy(), reduced["y"].to_numpy()
    for r in range(repeats):
        w = drawn[:, r] * reduced["w"].to_numpy()
        pos, neg = w * y, w * (1 - y)
        u = (pos[:, None] * neg[None, :] * ((s[:, None] > s[None, :]) + 0.5 * (s[:, None] == s[None, :]))).sum()
        assert got[r].auc == pytest.approx(u / (pos.sum() * neg.sum()))
        assert got[r].brier == pytest.approx((w * (s - y) ** 2).sum() / w.sum())


def test_poisson_draws():
    keys = np.arange(4000) * 7919 - 5
    for mean in (1, 3, 25, 60, 4000):
        drawn = followup._poisson_draws(50)(keys, np.full(len(keys), mean))
        assert abs(drawn.mean() / mean - 1) < 0.02 and abs(drawn.var() / mean - 1) < 0.05
    again = followup._poisson_draws(50)(keys[:3], np.full(3, 2))
    assert (again == followup._poisson_draws(50)(keys, np.full(len(keys), 2))[:3]).all()
