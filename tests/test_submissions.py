import json

import pytest
from pyspark.sql import functions as F

from riskcohort.operators import assessment, submissions

GOOD = {
    "age": 45, "sex": 2, "bmi": 27, "race_ethnicity": 3, "family_history": 0, "hypertension": 0,
    "physical_activity": 1, "smoking_status": 0, "fasting_glucose": 90, "hba1c": 5.2,
}
ENDPOINTS = {
    "screening": submissions.validate_screening,
    "assessment": submissions.validate_assessment,
    "future": submissions.validate_future_risk,
}


def frame(spark, bodies):
    rows = [(i, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "submission_id long, body string")


def codes(spark, endpoint, bodies):
    out = ENDPOINTS[endpoint](frame(spark, bodies)).orderBy("submission_id")
    return [r.error_code for r in out.select("submission_id", "error_code").collect()]


def changed(**fields):
    return {**GOOD, **fields}


def without(name):
    return {k: v for k, v in GOOD.items() if k != name}


@pytest.mark.parametrize("endpoint", list(ENDPOINTS))
def test_bad_numbers(spark, endpoint):
    bad = [True, False, float("nan"), float("inf"), float("-inf"), [], {}, 0, -1]
    kinds = ["range", "range", "range", "range", "range", "type", "type", "range", "range"]
    for field in ("age", "bmi"):
        got = codes(spark, endpoint, [changed(**{field: v}) for v in bad])
        assert got == [f"{field}.{k}" for k in kinds]
    race = codes(spark, endpoint, [changed(race_ethnicity=v) for v in [*bad, 1.5, 5, 99]])
    assert race == ["race_ethnicity.value"] * len(race)


@pytest.mark.parametrize("endpoint", ["assessment", "future"])
def test_bad_labs(spark, endpoint):
    bad = [0, -1, True, False, float("nan"), float("inf"), [], {}]
    kinds = ["range", "range", "range", "range", "range", "range", "type", "type"]
    assert codes(spark, endpoint, [changed(fasting_glucose=v) for v in bad]) == [f"glucose.{k}" for k in kinds]
    assert codes(spark, endpoint, [changed(hba1c=v) for v in bad]) == [f"hba1c.{k}" for k in kinds]


@pytest.mark.parametrize("endpoint", list(ENDPOINTS))
def test_bodies_and_missing_fields(spark, endpoint):
    assert codes(spark, endpoint, ["[]", '"text"', "42", "not json", "null"]) == ["body.object"] * 5
    names = list(GOOD)[:8]
    assert codes(spark, endpoint, [without(n) for n in names]) == [f"{n}.missing" for n in names]
    assert codes(spark, endpoint, [changed(**{n: None}) for n in names]) == [f"{n}.missing" for n in names]
    assert codes(spark, endpoint, [changed(**{n: "  "}) for n in names]) == [f"{n}.missing" for n in names]
    assert codes(spark, endpoint, [GOOD]) == [None]


def test_sex_codes(spark):
    values = [0, 2, "female", " F ", 1, "male", "M", "1.0", 1.0]
    out = submissions.validate_assessment(frame(spark, [changed(sex=v) for v in values])).orderBy("submission_id")
    assert [r.sex for r in out.collect()] == [2.0, 2.0, 2.0, 2.0, 1.0, 1.0, 1.0, 1.0, 1.0]
    assert codes(spark, "screening", [changed(sex="man"), changed(sex=True)]) == ["sex.value", "sex.value"]
    assert codes(spark, "future", [changed(sex="man"), changed(sex="woman"), changed(sex="null")]) == [None, None, "sex.missing"]


def test_family_history_differs_by_endpoint(spark):
    tokens = ["unknown", "-1", "null", -1, -1.0, True, "maybe"]
    screening = codes(spark, "screening", [changed(family_history=v) for v in tokens])
    strict = codes(spark, "assessment", [changed(family_history=v) for v in tokens])
    bad = "family_history.value"
    assert screening == [None, None, None, None, bad, None, bad]
    assert strict == [None, None, "family_history.missing", None, bad, None, bad]
    out = submissions.validate_screening(frame(spark, [changed(family_history=v) for v in ("unknown", True, "no")]))
    assert [r.family_history for r in out.orderBy("submission_id").collect()] == [None, 1.0, 0.0]


def test_labs_required_and_null_words(spark):
    none = changed(fasting_glucose=None, hba1c=None)
    assert codes(spark, "assessment", [none, changed(hba1c="NULL"), changed(hba1c="none")]) == ["labs.missing", None, "hba1c.type"]
    got = codes(spark, "future", [changed(fasting_glucose=v) for v in (None, "", " ", "none", "NONE", "bad", 140)])
    assert got == ["glucose.missing"] * 4 + ["glucose.type", "glucose.type", "diagnostic.block"]
    assert codes(spark, "future", [changed(hba1c=6.5), changed(hba1c=7), changed(age=131), changed(bmi=151)]) == [
        "diagnostic.block", "diagnostic.block", "age.range", "bmi.range"]


def test_aliases_by_presence(spark):
    base = {k: v for k, v in GOOD.items() if k not in ("age", "bmi", "fasting_glucose")}
    bodies = [
        {**base, "Age": 50, "BMI": 30, "fasting_glucose_mgdl": 95},
        {**base, "age": None, "Age": 50, "bmi": 30, "fasting_glucose": 95},
        {**base, "sn256": 51, "bmi": 30, "fasting_glucose_mgdl": None, "fasting_glucose": 95},
    ]
    assert codes(spark, "future", bodies) == [None, "age.missing", "glucose.missing"]


def test_future_risk_end_to_end(spark):
    bodies = [
        GOOD, changed(fasting_glucose=50), changed(age=19), changed(bmi=14),
        changed(age=80, bmi=60, family_history=1, hypertension=1), changed(tier="Low", stage3_eligible=True, hba1c=7),
        changed(age=20, fasting_glucose=118), changed(patient_name="Ann <x>"),
    ]
    out = assessment.future_risk(frame(spark, bodies))
    rows = out.withColumn("r", assessment.future_risk_response()).orderBy("submission_id").collect()
    assert [r.error_code for r in rows] == [
        None, "evidence.glucose", "evidence.age", "evidence.bmi", "eligibility.high", "diagnostic.block", None, None]
    assert rows[0].reliability == "supported" and rows[6].reliability == "caution" and len(rows[6].warnings) == 1
    body = json.loads(rows[0].r)
    assert body["time_horizons"]["3_year"]["probability"] == rows[0].risk_probability
    assert "patient_name" not in body and json.loads(rows[7].r)["patient_name"] == "Ann <x>"


def test_identity_is_not_a_feature(spark):
    from riskcohort.operators.scoring import model_features

    valid = submissions.accepted(submissions.validate_assessment(frame(spark, [changed(patient_name="Ann")])))
    features = model_features(valid).columns
    assert "person" not in features and "hba1c" not in features and len(features) == 8
    with pytest.raises(ValueError):
        model_features(valid.drop("bmi"))


def test_same_submission_same_answer(spark):
    out = assessment.assess_submissions(frame(spark, [GOOD, GOOD]))
    answers = {r[0] for r in out.select(assessment.assessment_response(out)).collect()}
    assert len(answers) == 1


def test_the_last_of_repeated_keys_counts(spark):
    text = json.dumps(GOOD)
    bodies = [text[:-1] + tail for tail in (', "age": 300}', ', "age": true}', ', "age": "true"}', ', "age": null}', ', "age": 50}')]
    assert codes(spark, "assessment", bodies) == ["age.range", "age.range", "age.type", "age.missing", None]
    first = json.dumps(changed(age=300))[:-1] + ', "age": 45}'
    assert codes(spark, "screening", [first]) == [None]


def test_display_names_are_read_by_one_endpoint_only(spark):
    body = {**without("age"), "age": 45, "Patient Name": "N"}
    shown = {e: ENDPOINTS[e](frame(spark, [body])).first().person.patient_name for e in ENDPOINTS}
    assert shown == {"screening": "Not provided", "assessment": "Not provided", "future": "N"}
