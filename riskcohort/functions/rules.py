"""Assessment rules as Column expressions: the cascade, its explanations and the gates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from riskcohort import constants as K
from riskcohort.functions.recode import is_true, lab
from riskcohort.functions.text import percent

RULES = ("diagnostic_lab", "high_probability", "prediabetic_lab", "low_high_fallback")

# Our own wording, one line per rule and per next step.
RULE_TEXT = {
    "diagnostic_lab": "A supplied laboratory value is in the diabetes range.",
    "high_probability": "The profile model gives its High class at least 70% probability.",
    "prediabetic_lab": "A supplied laboratory value is in the prediabetes range.",
    "low_high_fallback": "No earlier rule applied; High and Low probabilities were compared.",
}
NEXT_STEP = {
    "confirm_lab": "Have the laboratory finding confirmed; no future-risk estimate is made.",
    "discuss_profile": "Discuss the profile with a clinician; no future-risk estimate is made.",
    "prevention_plan": "Discuss the laboratory result and a prevention plan.",
    "keep_screening": "Continue prevention and repeat screening as advised.",
}


def diagnostic_lab(hba1c: Column, glucose: Column) -> Column:
    hba1c, glucose = lab(hba1c), lab(glucose)
    return is_true((hba1c >= K.HBA1C_DIABETIC) | (glucose >= K.GLUCOSE_DIABETIC))


def prediabetic_lab(hba1c: Column, glucose: Column) -> Column:
    hba1c, glucose = lab(hba1c), lab(glucose)
    return is_true(
        hba1c.between(*K.HBA1C_PREDIABETIC) | glucose.between(*K.GLUCOSE_PREDIABETIC)
    )


def rule_fired(p_high: Column, hba1c: Column, glucose: Column) -> Column:
    """Name of the first rule that matches."""
    return (
        F.when(diagnostic_lab(hba1c, glucose), RULES[0])
        .when(is_true(p_high >= K.HIGH_PROBABILITY), RULES[1])
        .when(prediabetic_lab(hba1c, glucose), RULES[2])
        .otherwise(RULES[3])
    )


def tier_of(rule: Column, p_high: Column, p_low: Column) -> Column:
    """Final tier. The fallback ignores P(Moderate); High wins a tie."""
    high = F.coalesce(p_high, F.lit(0.0)) >= F.coalesce(p_low, F.lit(0.0))
    return (
        F.when(rule.isin(RULES[0], RULES[1]), "High")
        .when(rule == RULES[2], "Moderate")
        .otherwise(F.when(high, "High").otherwise("Low"))
    )


def inputs_used(hba1c: Column, glucose: Column) -> Column:
    return F.struct(
        hba1c.alias("hba1c"),
        glucose.alias("fasting_glucose"),
        lab(hba1c).isNotNull().alias("hba1c_present"),
        lab(glucose).isNotNull().alias("fasting_glucose_present"),
    )


def reasons(rule: Column, hba1c: Column, glucose: Column) -> Column:
    """Codes of everything that made the rule fire; never empty."""
    def compact(*codes: Column) -> Column:
        return F.filter(F.array(*codes), lambda c: c.isNotNull())

    hba1c, glucose = lab(hba1c), lab(glucose)
    diabetic = compact(
        F.when(hba1c >= K.HBA1C_DIABETIC, "hba1c.diabetic"),
        F.when(glucose >= K.GLUCOSE_DIABETIC, "glucose.diabetic"),
    )
    prediabetic = compact(
        F.when(hba1c.between(*K.HBA1C_PREDIABETIC), "hba1c.prediabetic"),
        F.when(glucose.between(*K.GLUCOSE_PREDIABETIC), "glucose.prediabetic"),
    )
    no_labs = hba1c.isNull() & glucose.isNull()
    fallback = F.when(no_labs, "fallback.no_labs").otherwise("fallback.with_labs")
    return (
        F.when(rule == RULES[0], diabetic)
        .when(rule == RULES[1], F.array(F.lit("profile.high")))
        .when(rule == RULES[2], prediabetic)
        .otherwise(F.array(fallback))
    )


def _finding(value: Column, low: float, high: float, diabetic: float) -> Column:
    value = lab(value)
    return (
        F.when(value.isNull(), "absent")
        .when(value <= 0, "invalid")
        .when(value >= diabetic, "diabetes_range")
        .when(value.between(low, high), "prediabetes_range")
        .when(value < low, "below_bands")
        .otherwise("between_bands")
    )


def lab_findings(hba1c: Column, glucose: Column) -> Column:
    """One struct per laboratory test."""
    def entry(test: str, value: Column, unit: str, band: tuple, diabetic: float) -> Column:
        return F.struct(
            F.lit(test).alias("test"),
            value.alias("value"),
            F.lit(unit).alias("unit"),
            _finding(value, *band, diabetic).alias("finding"),
        )

    return F.array(
        entry("hba1c", hba1c, "%", K.HBA1C_PREDIABETIC, K.HBA1C_DIABETIC),
        entry("fasting_glucose", glucose, "mg/dL", K.GLUCOSE_PREDIABETIC, K.GLUCOSE_DIABETIC),
    )


def next_step(tier: Column, rule: Column) -> Column:
    return (
        F.when((tier == "High") & (rule == RULES[0]), "confirm_lab")
        .when(tier == "High", "discuss_profile")
        .when(tier == "Moderate", "prevention_plan")
        .otherwise("keep_screening")
    )


def _lookup(code: Column, texts: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, text in texts.items():
        out = F.when(code == key, text).otherwise(out)
    return out


def recommendation(tier: Column, rule: Column) -> Column:
    step = next_step(tier, rule)
    return F.struct(
        tier.alias("tier"),
        rule.alias("rule"),
        _lookup(rule, RULE_TEXT).alias("explanation"),
        step.alias("next_step"),
        _lookup(step, NEXT_STEP).alias("next_step_text"),
    )


def profile_section(p_high: Column) -> Column:
    p = F.coalesce(p_high, F.lit(0.0))
    return F.struct(p.alias("high_probability"), percent(p, 1).alias("high_percent"))


def future_risk_eligible(tier: Column, hba1c: Column, glucose: Column) -> Column:
    """Every High tier and every diabetes-range lab is out; glucose is required."""
    usable = is_true((glucose > 0) & ~F.isnan(glucose) & (glucose < float("inf")))
    return (tier != "High") & ~diagnostic_lab(hba1c, glucose) & usable


def evidence_error(age: Column, bmi: Column, hba1c: Column, glucose: Column) -> Column:
    """First limit of the future-risk evidence that is broken, or NULL."""
    low, high = K.GLUCOSE_EVIDENCE
    return (
        F.when(diagnostic_lab(hba1c, glucose), "diagnostic.block")
        .when(~is_true((glucose >= low) & (glucose < high)), "evidence.glucose")
        .when(~is_true(age.between(*K.AGE_EVIDENCE)), "evidence.age")
        .when(~is_true(bmi.between(*K.BMI_EVIDENCE)), "evidence.bmi")
    )


def is_sparse(age: Column, bmi: Column, glucose: Column) -> Column:
    """Any value in the thin outer range of the evidence."""
    return ~(
        age.between(*K.AGE_USUAL) & bmi.between(*K.BMI_USUAL) & glucose.between(*K.GLUCOSE_USUAL)
    )


def reliability(sparse: Column) -> Column:
    return F.when(sparse, "caution").otherwise("supported")


def warnings(sparse: Column) -> Column:
    return F.when(sparse, F.array(F.lit("sparse.outer_range"))).otherwise(
        F.array().cast("array<string>")
    )


def risk_band(p: Column) -> Column:
    """Band of the raw, unrounded probability."""
    low, high = K.RISK_BANDS
    return F.when(p < low, "lower").when(p < high, "increased").otherwise("elevated")


def band_step(band: Column) -> Column:
    return (
        F.when(band == "lower", "repeat_screening")
        .when(band == "increased", "prevention_plan")
        .otherwise("clinical_review")
    )


def all_of(*checks: Column) -> Column:
    out = F.lit(True)
    for check in checks:
        out = out & is_true(check)
    return out


def signal_strength(p_new: Column, p_old: Column) -> Column:
    return (
        F.when(p_new > p_old + K.MUCH_STRONGER, "much stronger")
        .when(p_new > p_old, "stronger")
        .otherwise("not stronger")
    )
