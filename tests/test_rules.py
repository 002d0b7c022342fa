import math

import pytest
from pyspark.sql import functions as F

from riskcohort.functions import recode, rules, text
from riskcohort.operators import assessment

SCHEMA = "i int, p_high double, p_low double, p_moderate double, hba1c double, fasting_glucose double"


def cascade(spark, rows):
    df = spark.createDataFrame([(i, *map(lambda v: None if v is None else float(v), r)) for i, r in enumerate(rows)], SCHEMA)
    return [(r.tier, r.rule) for r in assessment.apply_rules(df).orderBy("i").collect()]


def test_cascade_boundaries(spark):
    low = (0.1, 0.8, 0.1)
    cases = [
        ((*low, 6.5, None), ("High", "diagnostic_lab")),
        ((*low, 7.2, 90), ("High", "diagnostic_lab")),
        ((*low, None, 126), ("High", "diagnostic_lab")),
        ((*low, None, 180), ("High", "diagnostic_lab")),
        ((*low, 5.7, None), ("Moderate", "prediabetic_lab")),
        ((*low, 6.4, None), ("Moderate", "prediabetic_lab")),
        ((*low, 6.45, None), ("Low", "low_high_fallback")),
        ((*low, None, 100), ("Moderate", "prediabetic_lab")),
        ((*low, None, 125), ("Moderate", "prediabetic_lab")),
        ((*low, None, 125.5), ("Low", "low_high_fallback")),
        ((*low, 5.2, 90), ("Low", "low_high_fallback")),
        ((*low, None, None), ("Low", "low_high_fallback")),
        ((*low, math.nan, math.nan), ("Low", "low_high_fallback")),
        ((0.75, 0.15, 0.10, None, None), ("High", "high_probability")),
        ((0.70, 0.2, 0.1, 6.0, None), ("High", "high_probability")),
        ((0.60, 0.30, 0.10, None, None), ("High", "low_high_fallback")),
        ((0.20, 0.55, 0.25, None, None), ("Low", "low_high_fallback")),
        ((0.3, 0.2, 0.5, 5.2, 90), ("High", "low_high_fallback")),
        ((0.25, 0.25, 0.5, 5.2, 90), ("High", "low_high_fallback")),
        ((0.02, 0.95, 0.03, 8, None), ("High", "diagnostic_lab")),
        ((None, None, None, 5.2, None), ("High", "low_high_fallback")),
    ]
    got = cascade(spark, [c for c, _ in cases])
    assert got == [want for _, want in cases]


def test_findings_and_reasons(spark):
    rows = [(1, None, 0.0), (2, 6.5, 126.0), (3, 5.7, 125.0), (4, 6.45, 125.5), (5, 5.6, 99.0), (6, -1.0, 100.0)]
    df = spark.createDataFrame(rows, "i int, h double, g double")
    found = df.select("i", rules.lab_findings(F.col("h"), F.col("g")).alias("f")).orderBy("i").collect()
    assert [tuple(x.finding for x in r.f) for r in found] == [
        ("absent", "invalid"), ("diabetes_range", "diabetes_range"), ("prediabetes_range", "prediabetes_range"),
        ("between_bands", "between_bands"), ("below_bands", "below_bands"), ("invalid", "prediabetes_range"),
    ]
    why = df.select("i", rules.reasons(F.lit("diagnostic_lab"), F.col("h"), F.col("g")).alias("r")).filter("i = 2").first()
    assert why.r == ["hba1c.diabetic", "glucose.diabetic"]


@pytest.mark.parametrize("p,band", [
    (math.nextafter(0.01, 0), "lower"), (0.01, "increased"), (math.nextafter(0.05, 0), "increased"), (0.05, "elevated"),
])
def test_bands_use_raw_probability(spark, p, band):
    assert spark.range(1).select(rules.risk_band(F.lit(p)).alias("b")).first().b == band


def test_gate_order_and_caution(spark):
    rows = [
        (1, 40.0, 26.0, 6.5, 90.0, "diagnostic.block"), (2, 40.0, 26.0, None, 126.0, "diagnostic.block"),
        (3, 40.0, 26.0, None, 50.0, "evidence.glucose"), (4, 40.0, 26.0, None, 50.45, None),
        (5, 19.0, 26.0, None, 90.0, "evidence.age"), (6, 99.0, 14.9, None, 90.0, "evidence.bmi"),
        (7, 100.0, 14.9, None, 90.0, "evidence.age"), (8, 40.0, 52.7, None, 90.0, None),
        (9, 40.0, 26.0, None, None, "evidence.glucose"),
    ]
    df = spark.createDataFrame(rows, "i int, age double, bmi double, h double, g double, want string")
    c = F.col
    got = df.select("i", "want", rules.evidence_error(c("age"), c("bmi"), c("h"), c("g")).alias("e"),
                    rules.is_sparse(c("age"), c("bmi"), c("g")).alias("s")).orderBy("i").collect()
    assert [r.e for r in got] == [r.want for r in got]
    assert [r.s for r in got if r.i in (4, 8)] == [True, True]


def test_eligibility(spark):
    rows = [("High", 5.2, 90.0, False), ("Low", 5.2, 90.0, True), ("Low", 6.5, 90.0, False), ("Low", None, None, False),
            ("Moderate", None, 100.0, True), ("Low", None, float("nan"), False), ("Low", None, float("inf"), False)]
    df = spark.createDataFrame(rows, "t string, h double, g double, want boolean")
    got = df.select("want", rules.future_risk_eligible(F.col("t"), F.col("h"), F.col("g")).alias("e")).collect()
    assert [r.e for r in got] == [r.want for r in got]


def test_recodes(spark):
    rows = [(1, 1, 1, 2, 1, None, 1.0, 0.0), (2, 2, 2, 2, 2, None, None, None)]
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (9.0, 1.0), (None, 2.0), (2.0, 9.0)], "a double, b double")
    got = [tuple(r) for r in df.select(recode.yes_no(F.col("a")), recode.either_yes(F.col("a"), F.col("b"))).collect()]
    assert got == [(1.0, 1.0), (0.0, 0.0), (None, 1.0), (None, None), (0.0, None)]
    smoke = spark.createDataFrame([(2.0, None), (1.0, 3.0), (1.0, 1.0), (1.0, None), (9.0, 3.0), (None, 1.0)], "e double, n double")
    assert [r[0] for r in smoke.select(recode.smoking_state(F.col("e"), F.col("n"))).collect()] == [0.0, 1.0, 2.0, None, None, None]
    lab = spark.createDataFrame(
        [(2.0, 6.45, None), (7.0, None, None), (7.0, 5.0, None), (1.0, None, None), (3.0, 5.0, None), (2.0, None, 125.5), (None, None, 126.0)],
        "d double, h double, g double")
    assert [r[0] for r in lab.select(recode.glycemic_class(F.col("d"), F.col("h"), F.col("g"))).collect()] == [
        "Low", None, "Low", "High", "Moderate", "Low", "High"]
    nums = spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,)], "s string")
    assert [r[0] for r in nums.select(recode.as_number(F.col("s"))).collect()] == [1.5, None, None, None]
    hist = spark.createDataFrame([(10.0,), (12.0,), (99.0,), (77.0,), (None,)], "x double")
    assert [r[0] for r in hist.select(recode.parent_history(F.col("x"))).collect()] == [1, 0, 0, None, None]
    assert rows


def test_text(spark):
    df = spark.createDataFrame([("<b>\"a\" & 'c'</b>",)], "t string")
    assert df.select(text.escape_markup(F.col("t"))).first()[0] == "&lt;b&gt;&quot;a&quot; &amp; &#039;c&#039;&lt;/b&gt;"
    nums = spark.createDataFrame([(" 45 ",), ("1_000",), ("1.0d",), (".5",), ("5.",), ("1e3",), ("0x1",), ("",), ("1__0",)], "t string")
    assert [r[0] for r in nums.select(text.to_number(F.col("t"))).collect()] == [45.0, 1000.0, None, 0.5, 5.0, 1000.0, None, None, None]
    shown = spark.range(1).select(text.with_unit(F.lit(None).cast("double"), "%").alias("a"), text.with_unit(F.lit(5.25), "%", 1).alias("b")).first()
    assert shown.a == "Not provided" and shown.b.endswith("%")


def test_nan_labs_count_as_absent(spark):
    df = spark.createDataFrame([(math.nan, 90.0), (math.nan, math.nan), (5.2, math.nan)], "h double, g double")
    h, g = F.col("h"), F.col("g")
    rows = df.select(
        recode.glycemic_class(F.lit(None).cast("double"), h, g).alias("label"), rules.lab_findings(h, g).alias("found"),
        rules.evidence_error(F.lit(50.0), F.lit(25.0), h, g).alias("error"),
        rules.future_risk_eligible(F.lit("Low"), h, g).alias("eligible"),
        rules.reasons(rules.rule_fired(F.lit(0.1), h, g), h, g).alias("reasons"),
    ).collect()
    assert [r.label for r in rows] == ["Low", None, "Low"]
    assert [[f.finding for f in r.found] for r in rows] == [["absent", "below_bands"], ["absent", "absent"], ["below_bands", "absent"]]
    assert [r.error for r in rows] == [None, "evidence.glucose", "evidence.glucose"]
    assert [r.eligible for r in rows] == [True, False, False]
    assert [r.reasons for r in rows] == [["fallback.with_labs"], ["fallback.no_labs"], ["fallback.with_labs"]]
