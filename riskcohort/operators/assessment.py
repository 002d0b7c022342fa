"""From accepted submissions to assessment and future-risk results, one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskcohort.functions import rules, text
from riskcohort.functions.recode import mgdl_to_mmoll
from riskcohort.operators import submissions
from riskcohort.operators.scoring import Scorer, future_risk_score, scorecard


def _labs() -> tuple[Column, Column]:
    return F.col("hba1c"), F.col("fasting_glucose")


def apply_rules(scored: DataFrame, hba1c: str = "hba1c", glucose: str = "fasting_glucose") -> DataFrame:
    """Add ``rule`` and ``tier`` to rows that carry probabilities and two lab columns."""
    scored = scored.withColumn(
        "rule", rules.rule_fired(F.col("p_high"), F.col(hba1c), F.col(glucose))
    )
    return scored.withColumn(
        "tier", rules.tier_of(F.col("rule"), F.col("p_high"), F.col("p_low"))
    )


def assess(df: DataFrame, scorer: Scorer = scorecard) -> DataFrame:
    """Cascade plus everything shown with it. Any tier a client sent is not read."""
    out = apply_rules(scorer(df))
    tier, rule = F.col("tier"), F.col("rule")
    hba1c, glucose = _labs()
    return out.withColumns({
        "inputs_used": rules.inputs_used(hba1c, glucose),
        "reasons": rules.reasons(rule, hba1c, glucose),
        "lab_assessment": rules.lab_findings(hba1c, glucose),
        "profile_screening": rules.profile_section(F.col("p_high")),
        "final_recommendation": rules.recommendation(tier, rule),
        "stage3_eligible": rules.future_risk_eligible(tier, hba1c, glucose),
        "has_fasting_glucose": glucose.isNotNull(),
    })


def assessment_response(df: DataFrame) -> Column:
    """JSON answer of one assessment."""
    c = F.col
    # The keys of the answer.
    return F.to_json(F.struct(
        c("tier").alias("final_risk_level"), c("tier"), c("rule").alias("rule_triggered"),
        text.percent(c("p_high"), 1).alias("prob_high"),
        c("y_pred").alias("profile_prediction"),
        F.struct(c("p_high").alias("High"), c("p_low").alias("Low"),
                 c("p_moderate").alias("Moderate")).alias("profile_probability"),
        c("lab_assessment"), c("profile_screening"), c("final_recommendation"),
        c("stage3_eligible"), c("has_fasting_glucose"), c("reasons").alias("reason"),
        c("inputs_used"), submissions.person_details(df).alias("person"),
    ))


def assess_submissions(df: DataFrame, scorer: Scorer = scorecard) -> DataFrame:
    """Validate and assess. Rejected rows keep their code and carry no result."""
    return assess(submissions.validate_assessment(df), scorer)


def future_risk(df: DataFrame, scorer: Scorer = scorecard, risk=future_risk_score) -> DataFrame:
    """Validate, recompute the assessment from its inputs, gate, and score.

    The error code is extended in order: field checks, then eligibility, then evidence limits.
    """
    out = apply_rules(scorer(submissions.validate_future_risk(df)))
    hba1c, glucose = _labs()
    out = out.withColumn("stage3_eligible", rules.future_risk_eligible(F.col("tier"), hba1c, glucose))
    age, bmi = F.col("age"), F.col("bmi")
    out = out.withColumn("error_code", F.coalesce(
        F.col("error_code"),
        F.when(~F.col("stage3_eligible"), "eligibility.high"),
        rules.evidence_error(age, bmi, hba1c, glucose),
    ))
    out = submissions.evaluated_once(out)
    ok = F.col("error_code").isNull()
    out = out.withColumn("risk_probability", F.when(ok, risk(age, bmi, mgdl_to_mmoll(glucose))))
    sparse, band = rules.is_sparse(age, bmi, glucose), rules.risk_band(F.col("risk_probability"))
    return out.withColumns({
        "reliability": F.when(ok, rules.reliability(sparse)),
        "warnings": F.when(ok, rules.warnings(sparse)),
        "risk_category": F.when(ok, band),
        "next_step": F.when(ok, rules.band_step(band)),
    })


def future_risk_response() -> Column:
    """JSON answer of one future-risk request."""
    c, p = F.col, F.col("risk_probability")
    hba1c, glucose = _labs()
    # The keys of the answer and the scope text.
    horizon = F.struct(
        p.alias("probability"), (p * 100.0).alias("percentage"),
        F.lit("research_internal_validation_only").alias("evidence_scope"),
    )
    named = c("person.patient_name") != "Not provided"
    return F.to_json(F.struct(
        c("risk_category"), c("next_step"), p,
        (p * 100.0).alias("risk_percentage"),
        F.create_map(F.lit("3_year"), horizon).alias("time_horizons"),
        c("reliability"), c("warnings"),
        F.struct(
            c("age").alias("Age"),
            F.when(c("sex") == 1, "Male").otherwise("Female").alias("Sex"),
            c("bmi").alias("BMI"),
            text.with_unit(glucose, " mg/dL", 1).alias("Fasting_Glucose"),
            text.with_unit(hba1c, "%", 1).alias("HbA1c"),
        ).alias("features_evaluated"),
        F.when(named, c("person.patient_name")).alias("patient_name"),
    ))
