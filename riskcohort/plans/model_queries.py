"""Fitted models over the driver tables. Forests are kept small here; their size is a parameter of the library
functions. Boosting runs up to its full number of rounds and stops by its held-out part."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskcohort import constants as K
from riskcohort.operators import experiments as ex, features, followup as fu, importance, metrics as m, models, oversample, split, survival
from riskcohort.operators.scoring import scorecard
from riskcohort.plans.cohort_queries import stored_dataset
from riskcohort.plans.metric_queries import folded_training, followup
from riskcohort.plans.registry import query, rounded
from riskcohort.session import cut_lineage, ensure_checkpoint_dir

TREES = 20


def _candidates():
    return models.training_candidates(TREES, resample=oversample.oversampled)


@query("candidate_cv")
def candidate_cv(spark, sf_dir):
    """Five-fold comparison of forest, boosting and forest with oversampling."""
    folded = folded_training(spark, sf_dir)
    return rounded(models.cv_comparison(cut_lineage(models.cross_validated_scores(_candidates(), folded))))


@query("candidate_holdout")
def candidate_holdout(spark, sf_dir):
    held = split.stratified_holdout(stored_dataset(spark, sf_dir))
    return rounded(models.holdout_evaluation(cut_lineage(models.holdout_scores(_candidates(), held))))


@query("diagnostic_holdout")
def diagnostic_holdout(spark, sf_dir):
    """The six boosting variants on the held-out part."""
    held = split.stratified_holdout(stored_dataset(spark, sf_dir))
    scored = cut_lineage(models.holdout_scores(models.diagnostic_candidates(), held))
    return rounded(models.holdout_evaluation(scored))


@query("forest_pooled_cv")
def forest_pooled_cv(spark, sf_dir):
    """Cells summed over folds first."""
    folded = folded_training(spark, sf_dir)
    scored = models.cross_validated_scores([models.Candidate("forest", models.forest(TREES))], folded)
    return rounded(models.pooled_comparison(cut_lineage(scored)))


@query("diagnostic_pooled_cv")
def diagnostic_pooled_cv(spark, sf_dir):
    """The six boosting variants over five folds, cells summed over folds first: thirty fits in step."""
    scored = models.cross_validated_scores(models.diagnostic_candidates(), folded_training(spark, sf_dir))
    return rounded(models.pooled_comparison(cut_lineage(scored)))


@query("fitted_model_validation")
def fitted_model_validation(spark, sf_dir):
    """A boosted model is fitted on the training part, stored, read back, checked, and judged on the stress grid."""
    people = stored_dataset(spark, sf_dir)
    train = split.stratified_holdout(people).filter("not is_test")
    candidate = next(c for c in models.diagnostic_candidates() if c.name == "regularised")
    path = f"{ensure_checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    models.save_model(spark, models.fit(candidate, cut_lineage(train)), path)
    model = models.load_model(spark, path)
    grid = models.score(model, ex.profile_grid(ex.observed_backgrounds(people)))
    verdict = ex.validation_verdict(grid, models.contract_holds(model)).withColumn("reasons", F.concat_ws(",", "reasons"))
    summary = models.check_model(model)
    return rounded(verdict.withColumns({"features": F.lit(",".join(summary["features"])), "rounds": F.lit(summary["params"]["rounds_grown"])}))


@query("permutation_importance")
def permutation_importance(spark, sf_dir):
    """Importance of each predictor to a forest, on held-out people."""
    held = cut_lineage(split.stratified_holdout(stored_dataset(spark, sf_dir)))
    model = models.fit(models.Candidate("forest", models.forest(TREES)), held.filter("not is_test"))
    test = held.filter("is_test").withColumns({"id": F.col("SEQN"), "y_true": F.col(K.TARGET)})
    return rounded(importance.permutation_importance(test, models.scorer_of(model)))


@query("scorecard_importance")
def scorecard_importance(spark, sf_dir):
    """The same for the published-coefficients scorecard, top predictors first."""
    test = stored_dataset(spark, sf_dir).withColumns({"id": F.col("SEQN"), "y_true": F.col(K.TARGET)})
    return rounded(importance.top_predictors(importance.permutation_importance(test, scorecard)))


def _training_vectors(spark, sf_dir):
    held = split.stratified_holdout(stored_dataset(spark, sf_dir))
    train = cut_lineage(features.numeric_predictors(held.filter("not is_test")))
    prepared = features.feature_pipeline(train).fit(train)
    return features.label_encoder().transform(prepared.transform(train)).select("features", features.LABEL)


_TRAIN_CLASSES = (
    "(select cast(case diabetes_risk when 'High' then 0 when 'Low' then 1 else 2 end as double) as label, count(*) as n, "
    "max(count(*)) over () as top from holdout where not is_test group by diabetes_risk)"
)


@query("oversampled_training", (
    f"select label, 'original' as part, n from {_TRAIN_CLASSES} c union all "
    f"select label, 'synthetic', top - n from {_TRAIN_CLASSES} c where n < top"
))
def oversampled_training(spark, sf_dir):
    """Class sizes before and after oversampling the training part."""
    vectors = cut_lineage(_training_vectors(spark, sf_dir))
    tagged = vectors.withColumn("part", F.lit("original")).unionByName(
        oversample.synthetic_rows(vectors).withColumn("part", F.lit("synthetic"))
    )
    return tagged.groupBy(features.LABEL, "part").agg(F.count(F.lit(1)).alias("n"))


@query("encoded_features")
def encoded_features(spark, sf_dir):
    """Every person's ordinal-encoded feature vector with missing indicators."""
    from pyspark.ml.functions import vector_to_array

    people = features.numeric_predictors(stored_dataset(spark, sf_dir))
    fitted = features.feature_pipeline(people, "ordinal", missing_indicator=True).fit(people)
    return fitted.transform(people).select("SEQN", vector_to_array("features").alias("features"))


@query("missing_indicators", " union all ".join(
    f"select '{c}' as \"column\", count(*) filter ({c} is null) as n_flagged from dataset having count(*) filter ({c} is null) > 0"
    for c in K.PREDICTORS
))
def missing_indicators(spark, sf_dir):
    """Indicator columns exist only for predictors with gaps."""
    people = stored_dataset(spark, sf_dir)
    gaps = features.columns_with_gaps(people)
    flagged = features.indicator_stage(gaps).transform(people)
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}_missing").alias("flag")) for c in gaps])
    rows = flagged.select(F.explode(entries).alias("e")).select("e.*")
    return rows.groupBy("column").agg(F.sum("flag").cast("long").alias("n_flagged"))


def _oof(spark, sf_dir):
    return cut_lineage(fu.out_of_fold(survival.ipcw_weights(followup(spark, sf_dir))))


@query("monotone_risk_oof")
def monotone_risk_oof(spark, sf_dir):
    """Out-of-fold three-year risk of every evaluable person."""
    return rounded(_oof(spark, sf_dir).select("participant_id", "time_years", "event", "ipcw_weight", "oof_risk_3y"), 8)


@query("monotone_risk_fits")
def monotone_risk_fits(spark, sf_dir):
    """How the five models of the out-of-fold risk ended."""
    _, fitted = fu.out_of_fold_fits(survival.ipcw_weights(followup(spark, sf_dir)))
    return rounded(fu.fit_report(spark, fitted))


@query("oof_metrics")
def oof_metrics(spark, sf_dir):
    """All subgroup metrics of the out-of-fold scores."""
    return rounded(m.subgroup_metrics(_oof(spark, sf_dir), "y", "oof_risk_3y", "ipcw_weight"))


@query("calibration")
def calibration(spark, sf_dir):
    return rounded(fu.calibration(_oof(spark, sf_dir)))


@query("bootstrap_intervals")
def bootstrap_intervals(spark, sf_dir):
    """1000 Poisson replicates over fixed scores and weights."""
    from riskcohort.plans.metric_queries import weighted

    return rounded(fu.bootstrap_intervals(weighted(spark, sf_dir), score="score", w="w"))
