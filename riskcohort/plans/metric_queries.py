"""Metrics, survival, splits and experiments over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskcohort import constants as K
from riskcohort.operators import experiments as ex, metrics as m, ordered, records, split, survival
from riskcohort.operators.scoring import future_risk_score, linear_scorer, reduced_scorecard, scorecard
from riskcohort.operators import scoring
from riskcohort.plans import fixtures
from riskcohort.plans.cohort_queries import dataset, stored_dataset
from riskcohort.session import cut_lineage
from riskcohort.plans.registry import EXTRA, query, rounded
from riskcohort.functions import text
from riskcohort.sources.sinks import metric_report
from riskcohort.sources.tables import eligible_followup


# --- shared frames -----------------------------------------------------------------------------
def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scorecard(dataset(spark, sf_dir))
    return out.withColumns({"id": F.col("SEQN"), "y_true": F.col(K.TARGET)})


def folded_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds of the training part: people of the test part are in none."""
    held = split.stratified_holdout(stored_dataset(spark, sf_dir))
    return split.fold_assignment(cut_lineage(held.filter("not is_test").drop("is_test")))


def model_rows(spark: SparkSession, sf_dir: str, folds: bool = False) -> DataFrame:
    """One row per person and model."""
    people = folded_training(spark, sf_dir) if folds else dataset(spark, sf_dir)
    both = reduced_scorecard()(scorecard(people))
    names = ("y_pred", "p_high", "p_low", "p_moderate")
    answers = F.array(
        F.struct(F.lit("scorecard").alias("model"), *[F.col(n) for n in names]),
        F.struct(F.lit("reduced").alias("model"), *[F.col(f"old_{n}").alias(n) for n in names]),
    )
    keep = ["fold"] if folds else []
    return both.select(
        F.col("SEQN").alias("id"), F.col(K.TARGET).alias("y_true"), "age", "bmi", *keep, F.explode(answers).alias("a")
    ).select("id", "y_true", "age", "bmi", *keep, "a.*")


def followup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligible_followup(fixtures.fixture(spark, sf_dir, "followup_all"))


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluable people with outcome, censoring weight and the stand-in score."""
    out = survival.ipcw_weights(followup(spark, sf_dir)).withColumnRenamed("ipcw_weight", "w")
    risk = future_risk_score(F.col("age"), F.col("bmi"), F.col("fpg_mmol_l"))
    return out.withColumn("score", F.round(risk, 9))


# --- classification ------------------------------------------------------------------------------
@query("confusion_matrix", (
    "select t.label as y_true, p.label as y_pred, count(s.id) as n from label_names t cross join label_names p "
    "left join scored s on s.y_true = t.label and s.y_pred = p.label group by t.label, p.label"
))
def confusion_matrix(spark, sf_dir):
    return m.confusion(scored(spark, sf_dir))


@query("confusion_rates", (
    "select y_true, y_pred, round(n / sum(n) over (partition by y_true), 6) as rate from ("
    "select t.label as y_true, p.label as y_pred, count(s.id) as n from label_names t cross join label_names p "
    "left join scored s on s.y_true = t.label and s.y_pred = p.label group by t.label, p.label) c"
))
def confusion_rates(spark, sf_dir):
    return rounded(m.confusion_rates(m.confusion(scored(spark, sf_dir))))


@query("class_metrics", (
    "select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, "
    "cast(tp + fn as bigint) as support from model_f1 where model = 'scorecard'"
))
def class_metrics(spark, sf_dir):
    return rounded(m.class_metrics(m.confusion(scored(spark, sf_dir))).drop("tp"))


_MACRO = (
    "select model, round(sum(tp) / sum(tp + fn), 6) as accuracy, round(avg(precision), 6) as macro_precision, "
    "round(avg(recall), 6) as macro_recall, round(avg(f1), 6) as macro_f1 from model_f1 group by model"
)


@query("macro_metrics", _MACRO)
def macro_metrics(spark, sf_dir):
    cells = m.confusion(model_rows(spark, sf_dir), ("model",))
    return rounded(m.macro_metrics(cells, ("model",)))


@query("class_probability_means", (
    "select y_true, round(avg(p_high), 6) as mean_p_high, round(avg(p_low), 6) as mean_p_low, round(avg(p_moderate), 6) as mean_p_moderate, "
    "round(avg(case y_true when 'High' then p_high when 'Low' then p_low else p_moderate end), 6) as mean_p_true from scored group by y_true"
))
def class_probability_means(spark, sf_dir):
    return rounded(m.class_probability_means(scored(spark, sf_dir)))


@query("error_pairs", (
    "select y_true, y_pred, count(*) as n, round(avg(case y_pred when 'High' then p_high when 'Low' then p_low else p_moderate end), 6) as mean_p_pred, "
    "round(avg(case y_true when 'High' then p_high when 'Low' then p_low else p_moderate end), 6) as mean_p_true, "
    "round(avg(age), 6) as mean_age, round(avg(bmi), 6) as mean_bmi from scored where y_true <> y_pred group by y_true, y_pred"
))
def error_pairs(spark, sf_dir):
    return rounded(m.error_pairs(scored(spark, sf_dir)))


EXTRA["class_scores"] = (
    "select model, label, s, count(*) filter (y_true = label) * 1e0 as wp, count(*) filter (y_true <> label) * 1e0 as wn from ("
    "select model, y_true, unnest(['High', 'Low', 'Moderate']) as label, unnest([p_high, p_low, p_moderate]) as s from models) u "
    "group by model, label, s"
)
EXTRA["class_auc"] = (
    "select model, label, sum(wp * (below + wn / 2)) / (sum(wp) * sum(wn)) as auc from ("
    "select *, coalesce(sum(wn) over (partition by model, label order by s rows between unbounded preceding and 1 preceding), 0) as below "
    "from class_scores) c group by model, label"
)


@query("one_vs_rest_auc", "select model, label, round(auc, 6) as auc from class_auc")
def one_vs_rest_auc(spark, sf_dir):
    return rounded(m.one_vs_rest_auc(model_rows(spark, sf_dir), ("model",)))


@query("macro_ovr_auc", "select model, round(avg(auc), 6) as macro_auc from class_auc group by model")
def macro_ovr_auc(spark, sf_dir):
    return rounded(m.macro_auc(model_rows(spark, sf_dir), ("model",)))


# --- follow-up ------------------------------------------------------------------------------------
@query("horizon_labels", "select participant_id, time_years, event, known, case when known then y end as y from horizon")
def horizon_labels(spark, sf_dir):
    out = survival.horizon_labels(followup(spark, sf_dir))
    return out.select("participant_id", "time_years", "event", "known", "y")


@query("censoring_curve", "select t, censored, at_risk, round(survival, 8) as survival from curve")
def censoring_curve(spark, sf_dir):
    return rounded(survival.censoring_curve(followup(spark, sf_dir)), 8)


@query("asof_survival", (
    "select f.participant_id, round(coalesce(c.survival, 1e0), 8) as survival from followup f asof left join curve c on f.time_years > c.t"
))
def asof_survival(spark, sf_dir):
    """Survival just before everybody's own follow-up time."""
    people = followup(spark, sf_dir)
    out = survival.survival_at(people, "time_years", survival.censoring_curve(people))
    return rounded(out.select("participant_id", "survival"), 8)


@query("ipcw_weights", "select participant_id, y, round(w, 8) as ipcw_weight from weighted")
def ipcw_weights(spark, sf_dir):
    out = survival.ipcw_weights(followup(spark, sf_dir))
    return rounded(out.select("participant_id", "y", "ipcw_weight"), 8)


@query("weighted_risk", (
    "select count(*) as n_evaluable, cast(sum(y) as bigint) as cases, round(sum(w * y) / sum(w), 8) as observed_risk, "
    "round(sum(w * score) / sum(w), 8) as mean_predicted_risk from weighted"
))
def weighted_risk(spark, sf_dir):
    return rounded(m.weighted_means(weighted(spark, sf_dir)).drop("brier"), 8)


@query("weighted_brier", "select round(sum(w * (score - y) * (score - y)) / sum(w), 8) as brier from weighted")
def weighted_brier(spark, sf_dir):
    return rounded(m.weighted_means(weighted(spark, sf_dir)).select("brier"), 8)


@query("weighted_auc", "select round(auc, 6) as auc from group_ranks where grp = 'all'")
def weighted_auc(spark, sf_dir):
    return rounded(m.ranking_metrics(weighted(spark, sf_dir)).select("auc"))


@query("average_precision", "select round(ap, 6) as average_precision from group_ranks where grp = 'all'")
def average_precision(spark, sf_dir):
    return rounded(m.ranking_metrics(weighted(spark, sf_dir)).select("average_precision"))


_SUBGROUPS = (
    "select g.grp as \"group\", count(*) as n_evaluable, cast(sum(y) as bigint) as cases, "
    "round(sum(w * y) / sum(w), 6) as observed_risk, round(sum(w * score) / sum(w), 6) as mean_predicted_risk, "
    "round(any_value(r.auc), 6) as auc, round(any_value(r.ap), 6) as average_precision, "
    "round(sum(w * (score - y) * (score - y)) / sum(w), 6) as brier from grouped g join group_ranks r on g.grp = r.grp group by g.grp"
)


@query("subgroup_metrics", _SUBGROUPS)
def subgroup_metrics(spark, sf_dir):
    return rounded(m.subgroup_metrics(weighted(spark, sf_dir)))


@query("metric_report", _SUBGROUPS)
def report(spark, sf_dir):
    """The JSON report, read back into one row per group."""
    found = rounded(m.subgroup_metrics(weighted(spark, sf_dir)))
    row = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in found.schema)
    read = F.from_json("report", f"validation struct<{row}>, subgroups array<struct<{row}>>")
    parsed = metric_report(found).select(read.alias("r"))
    return parsed.select(F.explode(F.concat(F.array("r.validation"), "r.subgroups")).alias("e")).select("e.*")


# --- splits -----------------------------------------------------------------------------------------
@query("stratified_holdout", "select SEQN, diabetes_risk, is_test from holdout")
def stratified_holdout(spark, sf_dir):
    return split.stratified_holdout(stored_dataset(spark, sf_dir)).select("SEQN", K.TARGET, "is_test")


@query("fold_assignment", "select SEQN, diabetes_risk, fold from folds")
def fold_assignment(spark, sf_dir):
    return folded_training(spark, sf_dir).select("SEQN", K.TARGET, "fold")


EXTRA["fold_f1"] = (
    "select model, fold, sum(tp) / sum(tp + fn) as accuracy, avg(recall) as macro_recall, "
    "avg(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0e0 end) as macro_f1 from ("
    "select *, case when tp + fp > 0 then tp / (tp + fp) else 0e0 end as precision, "
    "case when tp + fn > 0 then tp / (tp + fn) else 0e0 end as recall from ("
    "select m.model, m.fold, l.label, sum(case when y_true = label and y_pred = label then 1e0 else 0e0 end) as tp, "
    "sum(case when y_true <> label and y_pred = label then 1e0 else 0e0 end) as fp, "
    "sum(case when y_true = label and y_pred <> label then 1e0 else 0e0 end) as fn "
    "from fold_models m, label_names l group by m.model, m.fold, l.label) c) d group by model, fold"
)


@query("fold_mean_std", (
    "select model, round(avg(macro_f1), 6) as macro_f1_mean, round(stddev_pop(macro_f1), 6) as macro_f1_std, "
    "round(avg(macro_recall), 6) as macro_recall_mean, round(stddev_pop(macro_recall), 6) as macro_recall_std, "
    "round(avg(accuracy), 6) as accuracy_mean, round(stddev_pop(accuracy), 6) as accuracy_std from fold_f1 group by model"
))
def fold_mean_std(spark, sf_dir):
    keys = ("model", "fold")
    per_fold = m.macro_metrics(m.confusion(model_rows(spark, sf_dir, folds=True), keys), keys)
    return rounded(m.fold_mean_std(per_fold, ("macro_f1", "macro_recall", "accuracy")))


@query("fold_pooled_metrics", (
    "select model, round(sum(tp) / sum(tp + fn), 6) as accuracy, round(avg(precision), 6) as macro_precision, "
    "round(avg(recall), 6) as macro_recall, "
    "round(avg(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0e0 end), 6) as macro_f1 from ("
    "select *, case when tp + fp > 0 then tp / (tp + fp) else 0e0 end as precision, "
    "case when tp + fn > 0 then tp / (tp + fn) else 0e0 end as recall from ("
    "select m.model, l.label, sum(case when y_true = label and y_pred = label then 1e0 else 0e0 end) as tp, "
    "sum(case when y_true <> label and y_pred = label then 1e0 else 0e0 end) as fp, "
    "sum(case when y_true = label and y_pred <> label then 1e0 else 0e0 end) as fn "
    "from fold_models m, label_names l group by m.model, l.label) c) d group by model"
))
def fold_pooled_metrics(spark, sf_dir):
    """Confusion cells summed over folds first, metrics on the sum."""
    cells = m.confusion(model_rows(spark, sf_dir, folds=True), ("model", "fold"))
    pooled = cells.groupBy("model", "y_true", "y_pred").agg(F.sum("n").alias("n"))
    return rounded(m.macro_metrics(pooled, ("model",)))


@query("best_model", "select model, macro_f1, macro_recall from (" + _MACRO + ") q order by macro_f1 desc, macro_recall desc limit 1")
def best_model(spark, sf_dir):
    cells = m.confusion(model_rows(spark, sf_dir), ("model",))
    return rounded(m.best_model(m.macro_metrics(cells, ("model",))))


@query("accept_rule", (
    "select round(gain, 6) as macro_f1_gain, round(md, 6) as moderate_f1_drop, round(hd, 6) as high_f1_drop, round(hr, 6) as high_recall_drop, "
    "gain >= 0.01 and md <= 0.02 and hd <= 0.02 and hr <= 0.02 as accepted from ("
    "select avg(f1) filter (model = 'scorecard') - avg(f1) filter (model = 'reduced') as gain, "
    "max(f1) filter (model = 'reduced' and label = 'Moderate') - max(f1) filter (model = 'scorecard' and label = 'Moderate') as md, "
    "max(f1) filter (model = 'reduced' and label = 'High') - max(f1) filter (model = 'scorecard' and label = 'High') as hd, "
    "max(recall) filter (model = 'reduced' and label = 'High') - max(recall) filter (model = 'scorecard' and label = 'High') as hr from model_f1) g"
))
def accept_rule(spark, sf_dir):
    cells = m.confusion(model_rows(spark, sf_dir), ("model",))
    per_class = m.class_metrics(cells, ("model",))
    return rounded(m.acceptance(m.macro_metrics(cells, ("model",)), per_class, "reduced", "scorecard"))


# --- experiments --------------------------------------------------------------------------------------
def _grid(spark, sf_dir) -> DataFrame:
    return scorecard(ex.profile_grid(ex.observed_backgrounds(dataset(spark, sf_dir))))


EXTRA["grid_axes"] = (
    "select * from (select sex, race_ethnicity, physical_activity, smoking_status, count(*) as n_people from dataset group by all) b, "
    "(select unnest([20, 30, 40, 50, 60, 70, 80]) as age) a, (select unnest([18e0, 22e0, 25e0, 28e0, 30e0, 35e0, 40e0, 45e0]) as bmi) w, "
    "(select unnest([0, 1]) as family_history) f, (select unnest([0, 1]) as hypertension) h"
)
EXTRA["grid"] = (
    "select *, case when p_high >= p_low and p_high >= p_moderate then 'High' when p_low >= p_moderate then 'Low' else 'Moderate' end as y_pred, "
    "case when age >= 60 and bmi >= 35 and family_history = 1 and hypertension = 1 then 'high_risk' "
    "when age <= 30 and bmi <= 25 and family_history = 0 and hypertension = 0 then 'low_risk' end as corner from ("
    "select *, round(eh / (eh + el + 1), 6) as p_high, round(el / (eh + el + 1), 6) as p_low, round(1 / (eh + el + 1), 6) as p_moderate from ("
    "select *, exp(-7e0 + 0.075e0 * age + 0.06e0 * bmi + 0.8e0 * family_history + 0.6e0 * hypertension "
    "+ 0.15e0 * coalesce(smoking_status, 0) - 0.2e0 * coalesce(physical_activity, 0)) as eh, "
    "exp(3.2e0 - 0.05e0 * age - 0.03e0 * bmi - 0.4e0 * family_history - 0.3e0 * hypertension "
    "- 0.1e0 * coalesce(smoking_status, 0) + 0.15e0 * coalesce(physical_activity, 0)) as el from grid_axes) a) b"
)


@query("profile_grid", "select sex, race_ethnicity, physical_activity, smoking_status, n_people, age, bmi, family_history, hypertension, p_high, y_pred from grid")
def profile_grid(spark, sf_dir):
    """The stress grid over every background seen in the cohort."""
    return _grid(spark, sf_dir).select(
        *ex.BACKGROUND, "n_people", "age", "bmi", "family_history", "hypertension", "p_high", "y_pred"
    )


@query("grid_class_share", (
    "select l.label, count(g.y_pred) as n, round(count(g.y_pred) / (select count(*) from grid), 6) as share "
    "from label_names l left join grid g on g.y_pred = l.label group by l.label"
))
def grid_class_share(spark, sf_dir):
    return rounded(ex.grid_class_share(_grid(spark, sf_dir)))


@query("grid_corners", (
    "select corner, count(*) as n_profiles, count(*) filter (y_pred = 'Low') as n_low, count(*) filter (y_pred = 'Moderate') as n_moderate, "
    "count(*) filter (y_pred = 'High') as n_high, round(min(p_high), 6) as min_p_high, round(max(p_high), 6) as max_p_high, "
    "round(avg(p_high), 6) as mean_p_high from grid where corner is not null group by corner"
))
def grid_corners(spark, sf_dir):
    return rounded(ex.grid_corners(_grid(spark, sf_dir)))


@query("marginal_means", (
    "select 'family_history' as predictor, family_history as value, round(avg(p_high), 6) as mean_p_high from grid group by family_history union all "
    "select 'hypertension', hypertension, round(avg(p_high), 6) from grid group by hypertension"
))
def marginal_means(spark, sf_dir):
    return rounded(ex.marginal_means(_grid(spark, sf_dir)))


@query("trend_lines", (
    "select *, p_end > p_start as increasing from ("
    "select sex, race_ethnicity, physical_activity, smoking_status, 'age' as axis, max(p_high) filter (age = 20) as p_start, max(p_high) filter (age = 80) as p_end "
    "from grid where family_history = 1 and hypertension = 1 and bmi = 30 group by all union all "
    "select sex, race_ethnicity, physical_activity, smoking_status, 'bmi', max(p_high) filter (bmi = 18), max(p_high) filter (bmi = 45) "
    "from grid where family_history = 1 and hypertension = 1 and age = 60 group by all) t"
))
def trend_lines(spark, sf_dir):
    return ex.trend_lines(_grid(spark, sf_dir))


@query("validation_verdict", (
    "select all_classes, high_corner_ok, round(separation, 6) as separation, trends_ok, true as interface_ok, "
    "concat_ws(',', case when not all_classes then 'class_missing' end, case when not high_corner_ok then 'high_corner_never_high' end, "
    "case when separation <= 0.2 then 'weak_separation' end, case when not trends_ok then 'trend_direction' end) as reasons, "
    "all_classes and high_corner_ok and separation > 0.2 and trends_ok as passed from ("
    "select count(distinct y_pred) = 3 as all_classes, count(*) filter (corner = 'high_risk' and y_pred = 'High') > 0 as high_corner_ok, "
    "avg(p_high) filter (corner = 'high_risk') - avg(p_high) filter (corner = 'low_risk') as separation, "
    "avg(p_high) filter (family_history = 1 and hypertension = 1 and bmi = 30 and age = 80) > avg(p_high) filter (family_history = 1 and hypertension = 1 and bmi = 30 and age = 20) "
    "and avg(p_high) filter (family_history = 1 and hypertension = 1 and age = 60 and bmi = 45) > avg(p_high) filter (family_history = 1 and hypertension = 1 and age = 60 and bmi = 18) "
    "and avg(p_high) filter (family_history = 1) > avg(p_high) filter (family_history = 0) "
    "and avg(p_high) filter (hypertension = 1) > avg(p_high) filter (hypertension = 0) as trends_ok from grid) v"
))
def validation_verdict(spark, sf_dir):
    interface = scoring.reads_only_predictors(scoring.SCORECARD_HIGH, scoring.SCORECARD_LOW)
    verdict = ex.validation_verdict(_grid(spark, sf_dir), interface)
    return rounded(verdict.withColumn("reasons", F.concat_ws(",", "reasons")))


EXTRA["two_models"] = (
    "select id, y_pred as new_pred, p_high as new_p_high, "
    "case when q_high >= q_low and q_high >= q_moderate then 'High' when q_low >= q_moderate then 'Low' else 'Moderate' end as old_pred, "
    "q_high as old_p_high from (select *, round(fh / (fh + fl + 1), 6) as q_high, round(fl / (fh + fl + 1), 6) as q_low, "
    "round(1 / (fh + fl + 1), 6) as q_moderate from (select *, "
    "exp(-7e0 + 0.075e0 * age + 0.06e0 * coalesce(bmi, 0) + 0.8e0 * (case when family_history = 1 then 1 else 0 end)) as fh, "
    "exp(3.2e0 - 0.05e0 * age - 0.03e0 * coalesce(bmi, 0) - 0.4e0 * (case when family_history = 1 then 1 else 0 end)) as fl from scored) a) b"
)
_SIGNAL = (
    "case when new_p_high > old_p_high + 0.1e0 then 'much stronger' when new_p_high > old_p_high then 'stronger' else 'not stronger' end"
)


def _pair(spark, sf_dir) -> DataFrame:
    def five(weights):
        return {k: v for k, v in weights.items() if k in ("", "age", "bmi", "family_history")}

    old = linear_scorer(five(scoring.SCORECARD_HIGH), five(scoring.SCORECARD_LOW))
    people = dataset(spark, sf_dir).withColumn("id", F.col("SEQN"))
    return ex.side_by_side(people, scorecard, old, "id")


@query("model_side_by_side", f"select id, new_pred, new_p_high, old_pred, old_p_high, {_SIGNAL} as signal from two_models")
def model_side_by_side(spark, sf_dir):
    return _pair(spark, sf_dir).select("id", "new_pred", "new_p_high", "old_pred", "old_p_high", "signal")


@query("signal_strength", f"select {_SIGNAL} as signal, count(*) as n from two_models group by 1")
def signal_strength(spark, sf_dir):
    return _pair(spark, sf_dir).groupBy("signal").agg(F.count(F.lit(1)).alias("n"))


# --- records ------------------------------------------------------------------------------------------
EXTRA["current_snapshot"] = (
    "select assessment_id, snapshot, ts, event_id from (select *, row_number() over (partition by assessment_id order by ts desc, event_id desc) as rn "
    "from record_events where action in ('create', 'edit')) r where rn = 1"
)
EXTRA["last_clear"] = (
    "select owner_id, ts as clear_ts, event_id as clear_id from (select *, row_number() over (partition by owner_id order by ts desc, event_id desc) as rn "
    "from record_events where action = 'clear') c where rn = 1"
)
EXTRA["existing"] = (
    "select r.* exclude (rn) from (select *, row_number() over (partition by owner_id, assessment_id order by ts desc, event_id desc) as rn "
    "from record_events where action in ('create', 'edit', 'delete')) r left join last_clear using (owner_id) "
    "where rn = 1 and action <> 'delete' and (clear_ts is null or ts > clear_ts or ts = clear_ts and event_id > clear_id)"
)
EXTRA["stored"] = "select event_id, assessment_id, snapshot from record_events where action = 'result'"


def _events(spark, sf_dir) -> DataFrame:
    return fixtures.fixture(spark, sf_dir, "record_events")


@query("current_records", (
    "select assessment_id, snapshot, event_id from existing"
))
def current_records(spark, sf_dir):
    return records.current_records(_events(spark, sf_dir)).select("assessment_id", "snapshot", "event_id")


@query("valid_cached_results", (
    "select s.event_id, s.assessment_id, s.snapshot from stored s where exists ("
    "select 1 from existing c where c.assessment_id = s.assessment_id and c.snapshot = s.snapshot)"
))
def valid_cached_results(spark, sf_dir):
    events = _events(spark, sf_dir)
    out = records.valid_results(records.results(events), records.current_records(events))
    return out.select("event_id", "assessment_id", "snapshot")


@query("stale_results", (
    "select s.event_id, s.assessment_id, s.snapshot from stored s where not exists ("
    "select 1 from existing c where c.assessment_id = s.assessment_id and c.snapshot = s.snapshot)"
))
def stale_results(spark, sf_dir):
    events = _events(spark, sf_dir)
    out = records.stale_results(records.results(events), records.current_records(events))
    return out.select("event_id", "assessment_id", "snapshot")


@query("record_dates", "select assessment_id, event_id, strftime(ts, '%b %-d, %Y, %-I:%M %p') as shown from current_snapshot")
def record_dates(spark, sf_dir):
    current = records.current_assessments(_events(spark, sf_dir))
    return current.select("assessment_id", "event_id", text.record_date(F.col("ts")).alias("shown"))


@query("newest_records", (
    "select assessment_id, event_id, ts from existing order by ts desc, event_id desc"
))
def newest_records(spark, sf_dir):
    """The list: every record that exists, the newest on top."""
    current = records.current_records(_events(spark, sf_dir))
    return records.newest_first(current).select("assessment_id", "event_id", "ts")
