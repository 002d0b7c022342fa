"""Whole-table checks of submitted assessments.

A submission is a row with a JSON ``body``. It is read once as a map of raw value texts, so an
absent key and a JSON null stay distinct; the kind of a value is looked up in a VARIANT only for
the texts ``true`` and ``false``, where a boolean and a string differ. Of a repeated key the last
value counts. Each endpoint is an ordered
list of nullable error codes; the first one that is not NULL is the row's error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from riskcohort import constants as K
from riskcohort.functions import rules, text
from riskcohort.functions.recode import is_true, race_label, yes_no_label

# Accepted names per field, in order of precedence. Presence of the key decides, not its value.
SCREENING_FIELDS = {name: (name,) for name in K.PREDICTORS}
ASSESSMENT_FIELDS = {
    **SCREENING_FIELDS,
    "hba1c": ("hba1c",),
    "glucose": ("fasting_glucose_mgdl", "fasting_glucose"),
}
FUTURE_FIELDS = {
    **SCREENING_FIELDS,
    "age": ("age", "Age", "sn256"),
    "sex": ("sex", "Sex", "sx060_r"),
    "bmi": ("bmi", "BMI"),
    "hba1c": ("hba1c_pct", "hba1c"),
    "glucose": ("fasting_glucose_mgdl", "fasting_glucose"),
}
NUMERIC_FIELDS = ("age", "bmi", "race_ethnicity", "hba1c", "glucose")
IDENTITY_FIELDS = {"patient_name": ("patient_name",), "patient_address": ("patient_address",)}
FUTURE_IDENTITY_FIELDS = {**IDENTITY_FIELDS, "patient_name": ("patient_name", "Patient Name")}


def parse_body(body: Column) -> Column:
    """Key -> raw value text of a JSON object; NULL for anything else."""
    return F.from_json(body, "map<string,string>", {"allowNonNumericNumbers": "true"})


def present(values: Column, names: tuple[str, ...]) -> Column:
    out = F.map_contains_key(values, names[0])
    for name in names[1:]:
        out = out | F.map_contains_key(values, name)
    return is_true(out)


def _last(values: Column, name: str) -> Column:
    """Value of a key; of a key that is repeated, the last one."""
    own = F.filter(F.map_entries(values), lambda e: e["key"] == name)
    return F.try_element_at(own, F.lit(-1))["value"]


def resolve(values: Column, names: tuple[str, ...]) -> Column:
    """Value of the first key that is present, even when that value is JSON null."""
    out = _last(values, names[-1])
    for name in reversed(names[:-1]):
        out = F.when(F.map_contains_key(values, name), _last(values, name)).otherwise(out)
    return out


def _is_boolean(body: Column, names: tuple[str, ...]) -> Column:
    value = resolve(F.from_json(body, "map<string,variant>"), names)
    return is_true(F.schema_of_variant(value) == "BOOLEAN")


def evaluated_once(df: DataFrame) -> DataFrame:
    """The same rows, with every column computed at this point.

    A filter on a derived column is otherwise pushed below each projection with its whole
    expression copied in. A one-element ``inline`` keeps later filters above the parsing.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.select(F.inline(F.array(row)))


def read_fields(df: DataFrame, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    """Replace ``body`` by ``<field>_text`` (trimmed, NULL when there is nothing) and, for numeric
    fields, ``<field>_bool`` and ``<field>_num``."""
    keep = [c for c in df.columns if c != "body"]
    out = df.withColumn("_values", parse_body(F.col("body")))
    out = out.select(
        *keep, "body", F.col("_values").isNotNull().alias("_object"),
        *[
            F.nullif(text.trimmed(resolve(F.col("_values"), names)), F.lit("")).alias(f"{f}_text")
            for f, names in fields.items()
        ],
    )
    numeric = [f for f in fields if f in NUMERIC_FIELDS]
    flags = {
        f"{f}_bool": F.when(F.col(f"{f}_text").isin("true", "false"), _is_boolean(F.col("body"), fields[f]))
        .otherwise(F.lit(False))
        for f in numeric
    }
    numbers = {f"{f}_num": text.to_number(F.col(f"{f}_text")) for f in numeric}
    return evaluated_once(out.withColumns({**flags, **numbers}).drop("body"))


@dataclass(frozen=True)
class Field:
    """Checks of one named field, over the columns that ``read_fields`` added."""

    name: str

    @property
    def text(self) -> Column:
        return F.col(f"{self.name}_text")

    @property
    def number(self) -> Column:
        return F.col(f"{self.name}_num")

    @property
    def empty(self) -> Column:
        """Absent key, JSON null or blank text."""
        return self.text.isNull()

    def among(self, tokens: tuple[str, ...]) -> Column:
        return is_true(F.lower(self.text).isin(*tokens))

    def missing(self, nulls: tuple[str, ...] = ()) -> Column:
        gone = self.empty | self.among(nulls) if nulls else self.empty
        return F.when(gone, f"{self.name}.missing")

    def not_positive(self, upper: float | None = None) -> Column:
        """Range and type codes for a value that is known to be there."""
        n = self.number
        bad = (n <= 0) | (n == float("inf"))
        if upper is not None:
            bad = bad | (n > upper)
        no_number = F.when(
            F.col(f"{self.name}_bool") | is_true(text.is_non_finite_text(self.text)), f"{self.name}.range"
        ).otherwise(f"{self.name}.type")
        return F.when(n.isNull(), no_number).when(bad, f"{self.name}.range")

    def not_among(self, *groups: tuple[str, ...]) -> Column:
        tokens = tuple(t for g in groups for t in g)
        return F.when(~self.among(tokens), f"{self.name}.value")

    def optional_positive(self, absent: Column) -> Column:
        return F.when(~absent, self.not_positive())


AGE, SEX, BMI = Field("age"), Field("sex"), Field("bmi")
RACE, FAMILY = Field("race_ethnicity"), Field("family_history")
PRESSURE, ACTIVITY, SMOKING = Field("hypertension"), Field("physical_activity"), Field("smoking_status")
HBA1C, GLUCOSE = Field("hba1c"), Field("glucose")


def required_number(field: Field, upper: float | None, nulls: tuple[str, ...] = ()) -> list[Column]:
    return [field.missing(nulls), field.not_positive(upper)]


def race_check() -> list[Column]:
    known = is_true(RACE.number.isin(*[float(c) for c in K.RACE_CODES]))
    return [RACE.missing(), F.when(~known, "race_ethnicity.value")]


def profile_checks(family_null_missing: bool, numbers_and_sex: bool = True) -> list[Column]:
    """The eight predictors in their fixed order."""
    checks: list[Column] = []
    if numbers_and_sex:
        checks += required_number(AGE, K.AGE_LIMIT) + required_number(BMI, K.BMI_LIMIT)
        checks += [SEX.missing(), SEX.not_among(K.MALE_TOKENS, K.FEMALE_TOKENS)]
    checks += race_check()
    if family_null_missing:
        checks += [FAMILY.missing(K.NULL_TOKENS)]
        checks += [FAMILY.not_among(K.YES_TOKENS, K.NO_TOKENS, K.UNKNOWN_TOKENS)]
    else:
        checks += [FAMILY.missing()]
        checks += [FAMILY.not_among(K.YES_TOKENS, K.NO_TOKENS, K.UNKNOWN_TOKENS, K.NULL_TOKENS)]
    checks += [PRESSURE.missing(), PRESSURE.not_among(K.YES_TOKENS, K.NO_TOKENS)]
    checks += [ACTIVITY.missing(), ACTIVITY.not_among(K.ACTIVE_TOKENS, K.INACTIVE_TOKENS)]
    checks += [SMOKING.missing(), SMOKING.not_among(*K.SMOKING_TOKENS.values())]
    return checks


def _lab_absent(field: Field) -> Column:
    return field.empty | field.among(K.NULL_TOKENS)


def _lab_absent_exact(field: Field) -> Column:
    """Null words compared with case, after trimming."""
    return field.empty | is_true(field.text.isin(*K.LAB_NULL_TOKENS))


def screening_error() -> Column:
    return F.coalesce(*profile_checks(family_null_missing=False))


def assessment_error() -> Column:
    h_gone, g_gone = _lab_absent(HBA1C), _lab_absent(GLUCOSE)
    return F.coalesce(
        *profile_checks(family_null_missing=True),
        HBA1C.optional_positive(h_gone),
        GLUCOSE.optional_positive(g_gone),
        F.when(h_gone & g_gone, "labs.missing"),
    )


def future_risk_error() -> Column:
    """Checks up to the rule cascade; eligibility and evidence follow after scoring."""
    h_gone = _lab_absent_exact(HBA1C)
    h, g = F.when(~h_gone, HBA1C.number), GLUCOSE.number
    return F.coalesce(
        *required_number(AGE, None, K.NULL_TOKENS),
        SEX.missing(K.NULL_TOKENS),
        SEX.not_among(K.MALE_TOKENS, K.MALE_EXTRA, K.FEMALE_TOKENS, K.FEMALE_EXTRA),
        *required_number(BMI, None, K.NULL_TOKENS),
        F.when(_lab_absent_exact(GLUCOSE), "glucose.missing"),
        GLUCOSE.not_positive(),
        HBA1C.optional_positive(h_gone),
        F.when(rules.diagnostic_lab(h, g), "diagnostic.block"),
        F.when(AGE.number > K.AGE_LIMIT, "age.range"),
        F.when(BMI.number > K.BMI_LIMIT, "bmi.range"),
        *profile_checks(family_null_missing=True, numbers_and_sex=False),
    )


def _family(field: Field) -> Column:
    return F.when(field.among(K.YES_TOKENS), 1.0).when(field.among(K.NO_TOKENS), 0.0)


def typed_columns(labs: bool) -> dict[str, Column]:
    """Model-ready values of a submission that passed its checks."""
    male = (*K.MALE_TOKENS, *K.MALE_EXTRA)
    female = (*K.FEMALE_TOKENS, *K.FEMALE_EXTRA)
    smoking = F.lit(None).cast("double")
    for code, tokens in K.SMOKING_TOKENS.items():
        smoking = F.when(SMOKING.among(tokens), code).otherwise(smoking)
    out = {
        "age": AGE.number,
        "sex": F.when(SEX.among(male), 1.0).when(SEX.among(female), 2.0),
        "bmi": BMI.number,
        "race_ethnicity": RACE.number,
        "family_history": _family(FAMILY),
        "hypertension": _family(PRESSURE),
        "physical_activity": F.when(ACTIVITY.among(K.ACTIVE_TOKENS), 1.0)
        .when(ACTIVITY.among(K.INACTIVE_TOKENS), 0.0),
        "smoking_status": smoking,
    }
    if labs:
        out["hba1c"] = F.when(~_lab_absent_exact(HBA1C), HBA1C.number)
        out["fasting_glucose"] = F.when(~_lab_absent_exact(GLUCOSE), GLUCOSE.number)
    return out


def _validated(df: DataFrame, fields: dict, error: Column, labs: bool, who: dict = IDENTITY_FIELDS) -> DataFrame:
    """``df`` without its body, plus ``error_code`` and typed values (NULL when rejected)."""
    identity = [c for c in df.columns if c != "body"]
    parsed = read_fields(df, {**fields, **who})
    parsed = parsed.withColumn("error_code", F.when(~F.col("_object"), "body.object").otherwise(error))
    passed = F.col("error_code").isNull()
    typed = [F.when(passed, c).alias(n) for n, c in typed_columns(labs).items()]
    person = F.struct(*[
        F.coalesce(F.col(f"{n}_text"), F.lit(K.NOT_PROVIDED)).alias(n) for n in who
    ]).alias("person")
    return evaluated_once(parsed.select(*identity, "error_code", *typed, person))


def validate_screening(df: DataFrame) -> DataFrame:
    return _validated(df, SCREENING_FIELDS, screening_error(), labs=False)


def validate_assessment(df: DataFrame) -> DataFrame:
    return _validated(df, ASSESSMENT_FIELDS, assessment_error(), labs=True)


def validate_future_risk(df: DataFrame) -> DataFrame:
    return _validated(df, FUTURE_FIELDS, future_risk_error(), labs=True, who=FUTURE_IDENTITY_FIELDS)


def accepted(df: DataFrame) -> DataFrame:
    return df.filter("error_code is null").drop("error_code")


def rejected(df: DataFrame) -> DataFrame:
    keep = [c for c in df.columns if c in ("submission_id", "user_id", "ts", "error_code")]
    return df.filter("error_code is not null").select(*keep)


def person_details(df: DataFrame) -> Column:
    """Label -> text map for display; never a model input."""
    c = F.col
    return F.create_map(
        F.lit("Patient Name"), c("person.patient_name"),
        F.lit("Patient Address"), c("person.patient_address"),
        F.lit("Age"), c("age").cast("string"),
        F.lit("Sex"), F.when(c("sex") == 1, "Male").otherwise("Female"),
        F.lit("BMI"), c("bmi").cast("string"),
        F.lit("HbA1c"), text.with_unit(c("hba1c"), "%"),
        F.lit("Fasting Glucose"), text.with_unit(c("fasting_glucose"), " mg/dL"),
        F.lit("Race/Ethnicity"), race_label(c("race_ethnicity")),
        F.lit("Family History"), yes_no_label(c("family_history")),
        F.lit("Hypertension"), yes_no_label(c("hypertension")),
        F.lit("Physical Activity"),
        F.when(c("physical_activity") == 1, "Active").otherwise("Inactive"),
        F.lit("Smoking Status"),
        F.when(c("smoking_status") == 0, "Never").when(c("smoking_status") == 1, "Former")
        .otherwise("Current"),
    )
