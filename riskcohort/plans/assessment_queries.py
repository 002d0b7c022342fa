"""Submission checks, rule cascade and gates over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskcohort import constants as K
from riskcohort.functions import recode, rules, text
from riskcohort.operators import assessment, replay, split, submissions
from riskcohort.operators.scoring import scorecard, scored_export, model_features
from riskcohort.operators.cohort import labelled_with_labs
from riskcohort.plans import fixtures
from riskcohort.plans.cohort_queries import dataset, stored_dataset
from riskcohort.plans.registry import EXTRA, query, rounded

# --- SQL pieces ------------------------------------------------------------------------------
_NUMBER = r"^[+-]?([0-9]+(_[0-9]+)*[.]?([0-9]+(_[0-9]+)*)?|[.][0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?$"


def _num(x: str) -> str:
    return f"case when regexp_matches(trim({x}), '{_NUMBER}') then cast(replace(trim({x}), '_', '') as double) end"


def _gone(x: str) -> str:
    return f"({x} is null or trim({x}) = '')"


def _bad_number(name: str, x: str, upper: str | None = None) -> str:
    over = f" or {_num(x)} > {upper}" if upper else ""
    return (
        f"case when regexp_matches(lower(trim({x})), '^[+-]?(nan|inf|infinity)$') then '{name}.range' "
        f"when {_num(x)} is null then '{name}.type' when {_num(x)} <= 0{over} then '{name}.range' end"
    )


def _missing(name: str, x: str, null_word: bool = False) -> str:
    extra = f" or lower(trim({x})) = 'null'" if null_word else ""
    return f"case when {_gone(x)}{extra} then '{name}.missing' end"


def _among(name: str, x: str, tokens) -> str:
    listed = ", ".join(f"'{t}'" for t in tokens)
    return f"case when lower(trim({x})) not in ({listed}) then '{name}.value' end"


_SEX = ("1", "1.0", "male", "m", "0", "0.0", "2", "2.0", "female", "f")
_YES_NO = ("1", "1.0", "yes", "true", "0", "0.0", "no", "false")
_NUMBERS_AND_SEX = [
    _missing("age", "raw_age"), _bad_number("age", "raw_age", "130"),
    _missing("bmi", "raw_bmi"), _bad_number("bmi", "raw_bmi", "150"),
    _missing("sex", "raw_sex"), _among("sex", "raw_sex", _SEX),
]
_RACE = [
    _missing("race_ethnicity", "raw_race"),
    f"case when coalesce({_num('raw_race')}, 0) not in (1, 2, 3, 4, 6, 7) then 'race_ethnicity.value' end",
]
_REST = [
    _missing("hypertension", "raw_hypertension"), _among("hypertension", "raw_hypertension", _YES_NO),
    _missing("physical_activity", "raw_activity"),
    _among("physical_activity", "raw_activity", (*_YES_NO, "active", "inactive")),
    _missing("smoking_status", "raw_smoking"),
    _among("smoking_status", "raw_smoking", ("0", "0.0", "never", "1", "1.0", "former", "2", "2.0", "current")),
]
_FAMILY_OPEN = [
    _missing("family_history", "raw_family"),
    _among("family_history", "raw_family", (*_YES_NO, "unknown", "-1", "null")),
]
_FAMILY_STRICT = [
    _missing("family_history", "raw_family", True),
    _among("family_history", "raw_family", (*_YES_NO, "unknown", "-1")),
]


def _lab_gone(x: str) -> str:
    return f"({_gone(x)} or lower(trim({x})) = 'null')"


def _lab_gone_exact(x: str) -> str:
    return f"({_gone(x)} or trim({x}) in ('null', 'none', 'None'))"


_SCREENING = f"coalesce({', '.join(_NUMBERS_AND_SEX + _RACE + _FAMILY_OPEN + _REST)})"
_ASSESSMENT = (
    f"coalesce({', '.join(_NUMBERS_AND_SEX + _RACE + _FAMILY_STRICT + _REST)}, "
    f"case when not {_lab_gone('raw_hba1c')} then {_bad_number('hba1c', 'raw_hba1c')} end, "
    f"case when not {_lab_gone('raw_glucose')} then {_bad_number('glucose', 'raw_glucose')} end, "
    f"case when {_lab_gone('raw_hba1c')} and {_lab_gone('raw_glucose')} then 'labs.missing' end)"
)
_FUTURE = (
    f"coalesce({_missing('age', 'raw_age', True)}, {_bad_number('age', 'raw_age')}, "
    f"{_missing('sex', 'raw_sex', True)}, {_among('sex', 'raw_sex', (*_SEX, 'man', 'woman'))}, "
    f"{_missing('bmi', 'raw_bmi', True)}, {_bad_number('bmi', 'raw_bmi')}, "
    f"case when {_lab_gone_exact('raw_glucose')} then 'glucose.missing' end, {_bad_number('glucose', 'raw_glucose')}, "
    f"case when not {_lab_gone_exact('raw_hba1c')} then {_bad_number('hba1c', 'raw_hba1c')} end, "
    f"case when {_num('raw_glucose')} >= 126 or (not {_lab_gone_exact('raw_hba1c')} and {_num('raw_hba1c')} >= 6.5e0) then 'diagnostic.block' end, "
    f"case when {_num('raw_age')} > 130 then 'age.range' end, case when {_num('raw_bmi')} > 150 then 'bmi.range' end, "
    f"{', '.join(_RACE + _FAMILY_STRICT + _REST)})"
)


def _typed(error: str) -> str:
    return (
        "select *, case when error_code is null then age_n end as age, case when error_code is null then bmi_n end as bmi, "
        "case when error_code is null then case when lower(trim(raw_sex)) in ('1', '1.0', 'male', 'm', 'man') then 1e0 else 2e0 end end as sex, "
        "case when error_code is null then race_n end as race_ethnicity, "
        "case when error_code is null then case when lower(trim(raw_family)) in ('1', '1.0', 'yes', 'true') then 1e0 "
        "when lower(trim(raw_family)) in ('0', '0.0', 'no', 'false') then 0e0 end end as family_history, "
        "case when error_code is null then case when lower(trim(raw_hypertension)) in ('1', '1.0', 'yes', 'true') then 1e0 else 0e0 end end as hypertension, "
        "case when error_code is null then case when lower(trim(raw_activity)) in ('1', '1.0', 'yes', 'true', 'active') then 1e0 else 0e0 end end as physical_activity, "
        "case when error_code is null then case when lower(trim(raw_smoking)) in ('0', '0.0', 'never') then 0e0 "
        "when lower(trim(raw_smoking)) in ('1', '1.0', 'former') then 1e0 else 2e0 end end as smoking_status, "
        "case when error_code is null then h_n end as hba1c, case when error_code is null then g_n end as fasting_glucose "
        f"from (select *, {_num('raw_age')} as age_n, {_num('raw_bmi')} as bmi_n, {_num('raw_race')} as race_n, "
        f"{_num('raw_hba1c')} as h_n, {_num('raw_glucose')} as g_n, {error} as error_code from raw_submissions) r"
    )


def _score(source: str) -> str:
    high = (
        "exp(-7e0 + 0.075e0 * coalesce(age, 0) + 0.06e0 * coalesce(bmi, 0) + 0.8e0 * coalesce(family_history, 0) "
        "+ 0.6e0 * coalesce(hypertension, 0) + 0.15e0 * coalesce(smoking_status, 0) - 0.2e0 * coalesce(physical_activity, 0))"
    )
    low = (
        "exp(3.2e0 - 0.05e0 * coalesce(age, 0) - 0.03e0 * coalesce(bmi, 0) - 0.4e0 * coalesce(family_history, 0) "
        "- 0.3e0 * coalesce(hypertension, 0) - 0.1e0 * coalesce(smoking_status, 0) + 0.15e0 * coalesce(physical_activity, 0))"
    )
    return (
        "select *, case when rule in ('diagnostic_lab', 'high_probability') then 'High' "
        "when rule = 'prediabetic_lab' then 'Moderate' when p_high >= p_low then 'High' else 'Low' end as tier from ("
        "select *, case when hba1c >= 6.5e0 or fasting_glucose >= 126 then 'diagnostic_lab' "
        "when p_high >= 0.7e0 then 'high_probability' "
        "when hba1c between 5.7e0 and 6.4e0 or fasting_glucose between 100 and 125 then 'prediabetic_lab' "
        "else 'low_high_fallback' end as rule from ("
        "select *, round(eh / (eh + el + 1), 6) as p_high, round(el / (eh + el + 1), 6) as p_low, "
        f"round(1 / (eh + el + 1), 6) as p_moderate from (select *, {high} as eh, {low} as el from {source}) a) b) c"
    )


EXTRA.update({
    "screened": _typed(_SCREENING),
    "assessed_input": _typed(_ASSESSMENT),
    "future_input": _typed(_FUTURE),
    "assessed": _score("(select * from assessed_input where error_code is null) v"),
    "future_scored": _score("future_input"),
    "future_gated": (
        "select *, coalesce(error_code, case when tier = 'High' or coalesce(hba1c >= 6.5e0, false) or "
        "fasting_glucose >= 126 or not coalesce(fasting_glucose > 0, false) then 'eligibility.high' end, "
        "case when fasting_glucose < 50.45e0 or fasting_glucose >= 126 then 'evidence.glucose' "
        "when age not between 20 and 99 then 'evidence.age' when bmi not between 15 and 52.7e0 then 'evidence.bmi' end) as final_code "
        "from future_scored"
    ),
    "future_risk": (
        "select *, round(1 / (1 + exp(-(-12e0 + 0.02e0 * age + 0.05e0 * bmi + 1.4e0 * (fasting_glucose / 18.0182e0)))), 9) as p3, "
        "age < 25 or age > 78 or bmi < 17 or bmi > 32.2e0 or fasting_glucose < 62 or fasting_glucose > 117.65e0 as sparse "
        "from future_gated where final_code is null"
    ),
    "rule_labs": "select id, p_high, p_low, LBXGH, LBXGLU, rule, tier, age, bmi from ruled",
})


# --- DataFrames the queries share --------------------------------------------------------------
def ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled people, scored, with both labs and the cascade's answer."""
    people = scorecard(labelled_with_labs(fixtures.modules(spark, sf_dir))).withColumn("id", F.col("SEQN"))
    return assessment.apply_rules(people, "LBXGH", "LBXGLU")


def assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = submissions.accepted(submissions.validate_assessment(fixtures.submissions(spark, sf_dir)))
    return assessment.assess(valid)


def future(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessment.future_risk(fixtures.submissions(spark, sf_dir))


_VALUES = ("age, sex, bmi, race_ethnicity, family_history, hypertension, physical_activity, smoking_status")
VALUES = _VALUES.split(", ")


# --- queries -----------------------------------------------------------------------------------
@query("validate_screening", f"select submission_id, error_code, {_VALUES} from screened")
def validate_screening(spark, sf_dir):
    out = submissions.validate_screening(fixtures.submissions(spark, sf_dir))
    return out.select("submission_id", "error_code", *VALUES)


@query("validate_assessment", f"select submission_id, error_code, {_VALUES}, hba1c, fasting_glucose from assessed_input")
def validate_assessment(spark, sf_dir):
    out = submissions.validate_assessment(fixtures.submissions(spark, sf_dir))
    return out.select("submission_id", "error_code", *VALUES, "hba1c", "fasting_glucose")


@query("validate_future_risk", f"select submission_id, error_code, {_VALUES}, hba1c, fasting_glucose from future_input")
def validate_future_risk(spark, sf_dir):
    out = submissions.validate_future_risk(fixtures.submissions(spark, sf_dir))
    return out.select("submission_id", "error_code", *VALUES, "hba1c", "fasting_glucose")


@query("error_code_counts", "select error_code, count(*) as n from assessed_input group by error_code")
def error_code_counts(spark, sf_dir):
    out = submissions.validate_assessment(fixtures.submissions(spark, sf_dir))
    return out.groupBy("error_code").agg(F.count(F.lit(1)).alias("n"))


@query("alias_resolution", (
    "select submission_id, case age_case when 0 then x when 1 then x when 2 then x when 4 then y end as age, "
    "age_case <> 5 as age_present, case bmi_case when 0 then y when 1 then y end as bmi, "
    "case glucose_case when 0 then z when 2 then z end as glucose, "
    "case sex_case when 0 then w when 1 then 'Male' when 2 then w end as sex, "
    "case hba1c_case when 0 then v when 1 then v when 3 then v when 4 then concat('[', v, ',', w, ']') when 5 then 'true' end as hba1c "
    "from alias_bodies"
))
def alias_resolution(spark, sf_dir):
    """Which key supplies each value: presence decides, even when the value is null."""
    parsed = fixtures.alias_bodies(spark, sf_dir).withColumn("_values", submissions.parse_body(F.col("body")))
    names, values = submissions.FUTURE_FIELDS, F.col("_values")
    return parsed.select(
        "submission_id",
        submissions.resolve(values, names["age"]).alias("age"),
        submissions.present(values, names["age"]).alias("age_present"),
        submissions.resolve(values, names["bmi"]).alias("bmi"),
        submissions.resolve(values, names["glucose"]).alias("glucose"),
        submissions.resolve(values, names["sex"]).alias("sex"),
        submissions.resolve(values, names["hba1c"]).alias("hba1c"),
    )


@query("sex_translation", (
    "select submission_id, sex, cast(2 - sex as int) as male, case when sex = 1 then 'Male' when sex = 2 then 'Female' end as label "
    "from screened where error_code is null"
))
def sex_translation(spark, sf_dir):
    valid = submissions.accepted(submissions.validate_screening(fixtures.submissions(spark, sf_dir)))
    sex = F.col("sex")
    return valid.select(
        "submission_id", "sex", recode.sex_code_to_male(sex).alias("male"),
        recode.label_of(sex, K.SEX_LABELS, F.lit(None).cast("string")).alias("label"),
    )


@query("screening_scores", (
    "select submission_id, p_high, p_low, p_moderate, case when p_high >= p_low and p_high >= p_moderate then 'High' "
    "when p_low >= p_moderate then 'Low' else 'Moderate' end as y_pred, round(p_high * 100, 1) as prob_high from ("
    + _score("(select * from screened where error_code is null) s") + ") q"
))
def screening_scores(spark, sf_dir):
    """Only the eight predictors reach the scorer."""
    valid = submissions.accepted(submissions.validate_screening(fixtures.submissions(spark, sf_dir)))
    scored = scorecard(model_features(valid, ("submission_id",)))
    return scored.select(
        "submission_id", "p_high", "p_low", "p_moderate", "y_pred",
        text.percent(F.col("p_high"), 1).alias("prob_high"),
    )


@query("rule_cascade", "select id, p_high, p_low, LBXGH, LBXGLU, rule, tier from rule_labs")
def rule_cascade(spark, sf_dir):
    return ruled(spark, sf_dir).select("id", "p_high", "p_low", "LBXGH", "LBXGLU", "rule", "tier")


@query("rule_counts", "select rule, tier, count(*) as n, round(avg(p_high), 6) as mean_p_high from rule_labs group by rule, tier")
def rule_counts(spark, sf_dir):
    out = ruled(spark, sf_dir).groupBy("rule", "tier").agg(
        F.count(F.lit(1)).alias("n"), F.avg("p_high").alias("mean_p_high")
    )
    return rounded(out)


def _finding(test: str, v: str, unit: str, low: str, high: str, diabetic: str) -> str:
    return (
        f"select id, '{test}' as test, {v} as value, '{unit}' as unit, case when {v} is null then 'absent' "
        f"when {v} <= 0 then 'invalid' when {v} >= {diabetic} then 'diabetes_range' "
        f"when {v} between {low} and {high} then 'prediabetes_range' when {v} < {low} then 'below_bands' "
        "else 'between_bands' end as finding from rule_labs"
    )


@query("lab_findings", _finding("hba1c", "LBXGH", "%", "5.7e0", "6.4e0", "6.5e0") + " union all "
       + _finding("fasting_glucose", "LBXGLU", "mg/dL", "100", "125", "126"))
def lab_findings(spark, sf_dir):
    found = rules.lab_findings(F.col("LBXGH"), F.col("LBXGLU"))
    return ruled(spark, sf_dir).select("id", F.explode(found).alias("f")).select("id", "f.*")


@query("reasons", (
    "select id, rule, 'hba1c.diabetic' as reason from rule_labs where rule = 'diagnostic_lab' and LBXGH >= 6.5e0 union all "
    "select id, rule, 'glucose.diabetic' from rule_labs where rule = 'diagnostic_lab' and LBXGLU >= 126 union all "
    "select id, rule, 'profile.high' from rule_labs where rule = 'high_probability' union all "
    "select id, rule, 'hba1c.prediabetic' from rule_labs where rule = 'prediabetic_lab' and LBXGH between 5.7e0 and 6.4e0 union all "
    "select id, rule, 'glucose.prediabetic' from rule_labs where rule = 'prediabetic_lab' and LBXGLU between 100 and 125 union all "
    "select id, rule, case when LBXGH is null and LBXGLU is null then 'fallback.no_labs' else 'fallback.with_labs' end "
    "from rule_labs where rule = 'low_high_fallback'"
))
def reasons(spark, sf_dir):
    fired = rules.reasons(F.col("rule"), F.col("LBXGH"), F.col("LBXGLU"))
    return ruled(spark, sf_dir).select("id", "rule", F.explode(fired).alias("reason"))


@query("final_recommendation", (
    "select id, tier, rule, case when tier = 'High' and rule = 'diagnostic_lab' then 'confirm_lab' "
    "when tier = 'High' then 'discuss_profile' when tier = 'Moderate' then 'prevention_plan' else 'keep_screening' end as next_step, "
    "p_high as high_probability, round(p_high * 100, 1) as high_percent from rule_labs"
))
def final_recommendation(spark, sf_dir):
    rec = rules.recommendation(F.col("tier"), F.col("rule"))
    section = rules.profile_section(F.col("p_high"))
    return ruled(spark, sf_dir).withColumns({"r": rec, "s": section}).select(
        "id", "r.tier", "r.rule", "r.next_step", "s.high_probability", "s.high_percent"
    )


@query("eligibility", (
    "select id, tier <> 'High' and not coalesce(LBXGH >= 6.5e0, false) and not coalesce(LBXGLU >= 126, false) "
    "and coalesce(LBXGLU > 0, false) as eligible from rule_labs"
))
def eligibility(spark, sf_dir):
    return ruled(spark, sf_dir).select(
        "id", rules.future_risk_eligible(F.col("tier"), F.col("LBXGH"), F.col("LBXGLU")).alias("eligible")
    )


@query("evidence_gate", (
    "select id, case when coalesce(LBXGH >= 6.5e0, false) or coalesce(LBXGLU >= 126, false) then 'diagnostic.block' "
    "when not coalesce(LBXGLU >= 50.45e0 and LBXGLU < 126, false) then 'evidence.glucose' "
    "when not coalesce(age between 20 and 99, false) then 'evidence.age' "
    "when not coalesce(bmi between 15 and 52.7e0, false) then 'evidence.bmi' end as error_code from rule_labs"
))
def evidence_gate(spark, sf_dir):
    c = F.col
    return ruled(spark, sf_dir).select(
        "id", rules.evidence_error(c("age"), c("bmi"), c("LBXGH"), c("LBXGLU")).alias("error_code")
    )


@query("caution_flags", (
    "select submission_id, case when sparse then 'caution' else 'supported' end as reliability, "
    "cast(sparse as int) as n_warnings from future_risk"
))
def caution_flags(spark, sf_dir):
    out = future(spark, sf_dir).filter("error_code is null")
    return out.select("submission_id", "reliability", F.size("warnings").alias("n_warnings"))


@query("risk_bands", (
    "select submission_id, p3 as risk_probability, case when p3 < 0.01e0 then 'lower' when p3 < 0.05e0 then 'increased' else 'elevated' end as risk_category, "
    "case when p3 < 0.01e0 then 'repeat_screening' when p3 < 0.05e0 then 'prevention_plan' else 'clinical_review' end as next_step from future_risk"
))
def risk_bands(spark, sf_dir):
    out = future(spark, sf_dir).filter("error_code is null")
    return out.select(
        "submission_id", F.round("risk_probability", 9).alias("risk_probability"), "risk_category", "next_step"
    )


@query("reassessment", "select submission_id, final_code as error_code, case when error_code is null then tier end as tier, case when error_code is null then rule end as rule from future_gated")
def reassessment(spark, sf_dir):
    """Tier and eligibility recomputed from full inputs; nothing the client claims is read."""
    raw = fixtures.submissions(spark, sf_dir)
    # Forged claims in the body must not matter.
    forged = F.concat(F.lit('{"tier":"Low","stage3_eligible":true,'), F.expr("substring(body, 2)"))
    out = assessment.future_risk(raw.withColumn("body", forged))
    passed = F.col("age").isNotNull()
    return out.select(
        "submission_id", "error_code",
        F.when(passed, F.col("tier")).alias("tier"), F.when(passed, F.col("rule")).alias("rule"),
    )


@query("assessment_results", (
    "select submission_id, tier, rule, p_high, hba1c is not null as hba1c_present, "
    "fasting_glucose is not null as glucose_present, tier <> 'High' and coalesce(hba1c < 6.5e0, true) "
    "and coalesce(fasting_glucose < 126, true) and coalesce(fasting_glucose > 0, false) as stage3_eligible, "
    "raw_name as patient_name from assessed"
))
def assessment_results(spark, sf_dir):
    return assessed(spark, sf_dir).select(
        "submission_id", "tier", "rule", "p_high",
        F.col("inputs_used.hba1c_present").alias("hba1c_present"),
        F.col("inputs_used.fasting_glucose_present").alias("glucose_present"),
        "stage3_eligible", F.col("person.patient_name").alias("patient_name"),
    )


@query("assessment_responses", (
    "select submission_id, tier as final_risk_level, tier, rule as rule_triggered, p_high as \"High\", p_low as \"Low\", "
    "tier <> 'High' and not coalesce(hba1c >= 6.5e0, false) and not coalesce(fasting_glucose >= 126, false) "
    "and coalesce(fasting_glucose > 0, false) as stage3_eligible, fasting_glucose is not null as has_fasting_glucose, "
    "raw_name as patient from assessed"
))
def assessment_responses(spark, sf_dir):
    """The JSON answers, read back into columns."""
    out = assessed(spark, sf_dir)
    answer = out.select("submission_id", assessment.assessment_response(out).alias("response"))
    read = F.from_json("response", (
        "final_risk_level string, tier string, rule_triggered string, profile_probability struct<High: double, Low: double>, "
        "stage3_eligible boolean, has_fasting_glucose boolean, person map<string, string>"))
    return answer.select("submission_id", read.alias("r")).select(
        "submission_id", "r.final_risk_level", "r.tier", "r.rule_triggered", "r.profile_probability.High",
        "r.profile_probability.Low", "r.stage3_eligible", "r.has_fasting_glucose", F.col("r.person")["Patient Name"].alias("patient"))


@query("future_risk_responses", (
    "select submission_id, case when p3 < 0.01e0 then 'lower' when p3 < 0.05e0 then 'increased' else 'elevated' end as risk_category, "
    "case when p3 < 0.01e0 then 'repeat_screening' when p3 < 0.05e0 then 'prevention_plan' else 'clinical_review' end as next_step, "
    "p3 as risk_probability, p3 as probability, case when sparse then 'caution' else 'supported' end as reliability, "
    "case sex when 1 then 'Male' else 'Female' end as \"Sex\" from future_risk"
))
def future_risk_responses(spark, sf_dir):
    """The JSON answers, read back into columns."""
    out = future(spark, sf_dir).filter("error_code is null")
    answer = out.select("submission_id", assessment.future_risk_response().alias("response"))
    read = F.from_json("response", (
        "risk_category string, next_step string, risk_probability double, reliability string, "
        "time_horizons map<string, struct<probability: double>>, features_evaluated struct<Sex: string>"))
    return answer.select("submission_id", read.alias("r")).select(
        "submission_id", "r.risk_category", "r.next_step", "r.risk_probability",
        F.col("r.time_horizons")["3_year"]["probability"].alias("probability"), "r.reliability", "r.features_evaluated.Sex")


_RACE_SHOWN = (
    "case race_ethnicity when 1 then 'Mexican American' when 2 then 'Other Hispanic' when 3 then 'Non-Hispanic White' "
    "when 4 then 'Non-Hispanic Black' when 6 then 'Non-Hispanic Asian' when 7 then 'Other / Multi-racial' "
    "else concat('Code ', coalesce(cast(cast(race_ethnicity as int) as varchar), '?')) end"
)
_YES_NO_SHOWN = "case {0} when 1 then 'Yes' when 0 then 'No' else 'Unknown' end"


@query("shown_details", (
    "select submission_id, 'Patient Name' as label, raw_name as value from assessed union all "
    "select submission_id, 'Patient Address', 'Not provided' from assessed union all "
    "select submission_id, 'Sex', case sex when 1 then 'Male' else 'Female' end from assessed union all "
    "select submission_id, 'Age', cast(age as varchar) from assessed union all "
    "select submission_id, 'BMI', cast(bmi as varchar) from assessed union all "
    "select submission_id, 'HbA1c', concat(cast(hba1c as varchar), '%') from assessed where hba1c is not null union all "
    "select submission_id, 'Fasting Glucose', concat(cast(fasting_glucose as varchar), ' mg/dL') from assessed where fasting_glucose is not null union all "
    "select submission_id, 'Race/Ethnicity', " + _RACE_SHOWN + " from assessed union all "
    "select submission_id, 'Family History', " + _YES_NO_SHOWN.format("family_history") + " from assessed union all "
    "select submission_id, 'Hypertension', " + _YES_NO_SHOWN.format("hypertension") + " from assessed union all "
    "select submission_id, 'Physical Activity', case when physical_activity = 1 then 'Active' else 'Inactive' end from assessed union all "
    "select submission_id, 'Smoking Status', case when smoking_status = 0 then 'Never' when smoking_status = 1 then 'Former' else 'Current' end from assessed"
))
def shown_details(spark, sf_dir):
    """Detail rows as displayed: absent labs are dropped, other absent values stay."""
    out = assessed(spark, sf_dir)
    details = text.shown_details(submissions.person_details(out))
    return out.select("submission_id", F.explode(details).alias("label", "value"))


@query("escaped_markup", (
    "select page_id, length(e) as n_chars, md5(e) as digest from (select page_id, "
    "replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;') as e from pages) p"
))
def escaped_markup(spark, sf_dir):
    escaped = text.escape_markup(F.col("html"))
    pages = fixtures.table(spark, sf_dir, "pages").select("page_id", escaped.alias("e"))
    return pages.select("page_id", F.length("e").cast("long").alias("n_chars"), F.md5("e").alias("digest"))


@query("meter_zones", "select case when p_high < 0.3e0 then 'low' when p_high < 0.7e0 then 'middle' else 'high' end as zone, count(*) as n from scored group by 1")
def meter_zones(spark, sf_dir):
    scored = scorecard(dataset(spark, sf_dir))
    return scored.groupBy(text.meter_zone(F.col("p_high")).alias("zone")).agg(F.count(F.lit(1)).alias("n"))


_MEASURES = {
    "all": {
        "held_out_rows": "true", "both_normal": "both_normal", "available_normal": "available_normal",
        "evidence_population": "present and evidence", "no_labs": "not present",
    },
    **{r: {
        "final_high": r, "both_normal_high": f"{r} and both_normal", "available_normal_high": f"{r} and available_normal",
        "evidence_eligible": f"{r} and evidence", "complete_and_evidence": f"{r} and evidence and complete",
        "known_diabetes_and_evidence": f"{r} and evidence and diq010 = 1",
        "both_normal_known_diabetes": f"{r} and both_normal and diq010 = 1",
    } for r in ("rule2", "rule4")},
}
EXTRA["masks"] = (
    "select *, not diagnostic and p_high >= 0.7e0 and present as rule2, "
    "not diagnostic and not (p_high >= 0.7e0 and present) and not prediabetes and p_high >= p_low and present as rule4, "
    "coalesce(LBXGH > 0 and LBXGH < 5.7e0, false) and coalesce(LBXGLU > 0 and LBXGLU < 100, false) as both_normal, "
    "present and (LBXGH is null or LBXGH > 0 and LBXGH < 5.7e0) and (LBXGLU is null or LBXGLU > 0 and LBXGLU < 100) as available_normal, "
    "not diagnostic and coalesce(age between 20 and 99 and bmi between 15 and 52.7e0 and LBXGLU >= 50.45e0 and LBXGLU < 126, false) as evidence, "
    "bmi is not null and family_history is not null and hypertension is not null and physical_activity is not null and smoking_status is not null as complete "
    "from (select l.*, coalesce(LBXGH >= 6.5e0, false) or coalesce(LBXGLU >= 126, false) as diagnostic, "
    "coalesce(LBXGH between 5.7e0 and 6.4e0, false) or coalesce(LBXGLU between 100 and 125, false) as prediabetes, "
    "LBXGH is not null or LBXGLU is not null as present from lab_scored l join holdout h on l.SEQN = h.SEQN where h.is_test) m"
)


@query("policy_replay", " union all ".join(
    f"select '{scope}' as scope, '{name}' as measure, count(*) filter ({mask}) as n from masks"
    for scope, measures in _MEASURES.items() for name, mask in measures.items()
))
def policy_replay(spark, sf_dir):
    f = fixtures.fixture
    held_out = split.stratified_holdout(stored_dataset(spark, sf_dir)).filter("is_test")
    labs = replay.labs_outer_join(f(spark, sf_dir, "ghb"), f(spark, sf_dir, "glu"))
    return replay.policy_replay(replay.replay_masks(replay.with_labs(scorecard(held_out), labs)))


@query("prediction_equality", (
    "select count(*) as n_matched, 0::bigint as n_unmatched, 0::bigint as n_label_differs, "
    "count(*) filter (greatest(abs(p_high - o_high), abs(p_low - o_low), abs(p_moderate - o_moderate)) > 1e-12) as n_probability_differs, "
    "round(max(greatest(abs(p_high - o_high), abs(p_low - o_low), abs(p_moderate - o_moderate))), 6) as max_difference from scored"
))
def prediction_equality(spark, sf_dir):
    """Do the full and the reduced scorecard agree? (They should not.)"""
    from riskcohort.operators.scoring import reduced_scorecard

    both = reduced_scorecard()(scorecard(dataset(spark, sf_dir))).withColumns(
        {"id": F.col("SEQN"), "y_true": F.col(K.TARGET)}
    )
    old = both.select("id", "y_true", *[F.col(f"old_{p}").alias(p) for p in ("p_high", "p_low", "p_moderate")])
    return rounded(replay.prediction_equality(both, old))


@query("scored_export", "select id, y_true, y_pred, p_high, p_low, p_moderate from scored")
def scored_rows(spark, sf_dir):
    scored = scorecard(dataset(spark, sf_dir)).withColumns({"id": F.col("SEQN"), "y_true": F.col(K.TARGET)})
    return scored_export(scored)
