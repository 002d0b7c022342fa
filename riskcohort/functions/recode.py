"""Column recodes of survey answers. Every function takes and returns a Column."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from riskcohort import constants as K


def as_number(c: Column) -> Column:
    """Double, with unparsable text and NaN as NULL."""
    number = c.try_cast("double")
    return F.when(~F.isnan(number), number)


def is_true(condition: Column) -> Column:
    """NULL counts as false, so that the condition can be negated safely."""
    return F.coalesce(condition, F.lit(False))


def yes_no(c: Column) -> Column:
    return F.when(c == 1, 1.0).when(c == 2, 0.0)


def either_yes(a: Column, b: Column) -> Column:
    """One yes is enough; a no needs both answers."""
    return F.when((a == 1) | (b == 1), 1.0).when((a == 2) & (b == 2), 0.0)


def smoking_state(ever: Column, now: Column) -> Column:
    """0 never, 1 former, 2 current. A never-smoker skips the second question."""
    return (
        F.when(ever == 2, 0.0)
        .when((ever == 1) & (now == 3), 1.0)
        .when((ever == 1) & now.isin(1, 2), 2.0)
    )


def lab(c: Column) -> Column:
    """Optional laboratory value: NaN counts as absent."""
    return F.when(~F.isnan(c), c)


def glycemic_class(diagnosis: Column, hba1c: Column, glucose: Column) -> Column:
    """High / Moderate / Low, NULL when there is no evidence either way."""
    hba1c, glucose = lab(hba1c), lab(glucose)
    high = (diagnosis == 1) | (hba1c >= K.HBA1C_DIABETIC) | (glucose >= K.GLUCOSE_DIABETIC)
    moderate = (
        (diagnosis == 3)
        | hba1c.between(*K.HBA1C_PREDIABETIC)
        | glucose.between(*K.GLUCOSE_PREDIABETIC)
    )
    evidence = is_true(diagnosis == 2) | hba1c.isNotNull() | glucose.isNotNull()
    return (
        F.when(is_true(high), "High").when(is_true(moderate), "Moderate").when(evidence, "Low")
    )


def parent_history(c: Column) -> Column:
    """Binary-cohort coding: 10 is yes, 12 and 99 are no, the rest missing."""
    return F.when(c == 10, 1).when(c.isin(12, 99), 0)


def diagnosed(c: Column) -> Column:
    """Binary outcome; borderline, refused and unknown are missing."""
    return F.when(c == 1, 1).when(c == 2, 0)


def within(c: Column, low: float, high: float) -> Column:
    """The value, or NULL outside the closed range."""
    return F.when(c.between(low, high), c)


def mgdl_to_mmoll(c: Column) -> Column:
    return c / F.lit(K.MGDL_PER_MMOLL)


def label_of(code: Column, labels: Mapping[int, str], otherwise: Column) -> Column:
    """Display text of a small fixed code list."""
    out = None
    for key, text in labels.items():
        out = F.when(code == key, text) if out is None else out.when(code == key, text)
    return out.otherwise(otherwise)


def race_label(code: Column) -> Column:
    shown = F.coalesce(code.cast("int").cast("string"), F.lit("?"))
    return label_of(code, K.RACE_LABELS, F.concat(F.lit("Code "), shown))


def yes_no_label(code: Column) -> Column:
    return label_of(code, K.YES_NO_LABELS, F.lit("Unknown"))


def sex_code_to_male(sex: Column) -> Column:
    """1/2 survey coding to a 1/0 male flag."""
    return F.when(sex == 1, 1).when(sex == 2, 0)
