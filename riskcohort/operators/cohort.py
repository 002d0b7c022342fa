"""Cohort construction: join the modules, keep adults with valid codes, derive, label."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from riskcohort import constants as K
from riskcohort.functions import recode
from riskcohort.functions.checks import must
from riskcohort.sources.tables import reject_forbidden

KEY = ["cycle", "SEQN"]
Modules = Mapping[str, DataFrame]


def valid_people(demo: DataFrame, min_age: float) -> DataFrame:
    """Adults with known sex and race codes; applied to the scan of the first module."""
    return demo.filter(
        (F.col("RIDAGEYR") >= min_age)
        & F.col("RIAGENDR").isin(*map(float, K.SEX_CODES))
        & F.col("RIDRETH3").isin(*map(float, K.RACE_CODES))
    )


def join_modules(modules: Modules, min_age: float = K.ADULT_MIN_AGE,
                 observations: dict[str, Observation] | None = None) -> DataFrame:
    """Inner chain over the questionnaires, left joins for the two partial labs.

    All joins use the same key, so each module is shuffled at most once and the partitioning
    of the chain is kept. With ``observations`` every step counts its rows in the same job.
    """
    def counted(df: DataFrame, step: str) -> DataFrame:
        if observations is None:
            return df
        observations[step] = Observation(step)
        return df.observe(observations[step], F.count(F.lit(1)).alias("n"))

    out = counted(valid_people(modules["demo"], min_age), "demo")
    for name in K.INNER_MODULES:
        out = counted(out.join(modules[name], KEY, "inner"), name)
    for name in K.LEFT_MODULES:
        out = counted(out.join(modules[name], KEY, "left"), name)
    return out


def derive(joined: DataFrame, with_labs: bool = False) -> DataFrame:
    """Eight predictors, diagnosis, label, and lab availability for the reports.

    ``with_labs`` keeps the laboratory values beside them, for replays of rules; never in a dataset.
    """
    c = F.col
    return joined.select(
        c("SEQN"), c("cycle"),
        c("RIDAGEYR").cast("int").alias("age"),
        c("RIAGENDR").cast("int").alias("sex"),
        c("BMXBMI").alias("bmi"),
        c("RIDRETH3").cast("int").alias("race_ethnicity"),
        recode.yes_no(c("MCQ300C")).alias("family_history"),
        recode.yes_no(c("BPQ020")).alias("hypertension"),
        recode.either_yes(c("PAQ650"), c("PAQ665")).alias("physical_activity"),
        recode.smoking_state(c("SMQ020"), c("SMQ040")).alias("smoking_status"),
        c("DIQ010").alias("diq010"),
        recode.glycemic_class(c("DIQ010"), c("LBXGH"), c("LBXGLU")).alias(K.TARGET),
        recode.lab(c("LBXGH")).isNotNull().alias("has_hba1c"),
        recode.lab(c("LBXGLU")).isNotNull().alias("has_glucose"),
        *([recode.lab(c(n)).alias(n) for n in ("LBXGH", "LBXGLU")] if with_labs else []),
    )


def candidate_cohort(modules: Modules, **options) -> DataFrame:
    """Everybody with valid codes, labelled or not."""
    return derive(join_modules(modules, **options))


def labelled_with_labs(modules: Modules, **options) -> DataFrame:
    """Dataset columns and both laboratory values of everybody with a determined label, from one join chain."""
    rows = derive(join_modules(modules, **options), with_labs=True)
    return rows.filter(F.col(K.TARGET).isNotNull()).select(*K.DATASET_COLUMNS, "LBXGH", "LBXGLU")


def supervised_dataset(cohort: DataFrame, observation: Observation | None = None) -> DataFrame:
    """The twelve dataset columns of everybody with a determined label. A row that breaks a rule of the dataset stops the
    job that reads it (``row_rules``)."""
    if observation is not None:
        cohort = cohort.observe(
            observation,
            F.count(F.lit(1)).alias("cohort"),
            F.count_if(F.col(K.TARGET).isNull()).alias("undetermined"),
        )
    out = cohort.filter(F.col(K.TARGET).isNotNull()).select(*K.DATASET_COLUMNS)
    reject_forbidden(out.columns, K.LAB_COLUMNS)
    return must(out, row_rules(), "dataset")


def binary_dataset(demo: DataFrame, bmx: DataFrame, diq: DataFrame,
                   min_age: float = K.ADULT_MIN_AGE_BINARY) -> DataFrame:
    """The older eight-column dataset: binary outcome, complete cases, one row per person.

    ``diq`` carries DIQ010 and DIQ175A.
    """
    c = F.col
    joined = valid_people(demo, min_age).join(bmx, KEY).join(diq, KEY)
    shaped = joined.select(
        c("SEQN"),
        c("RIDAGEYR").cast("int").alias("age"),
        c("RIAGENDR").cast("int").alias("sex"),
        c("RIDRETH3").cast("int").alias("race_ethnicity"),
        recode.within(c("BMXBMI"), *K.BMI_PLAUSIBLE).alias("bmi"),
        recode.parent_history(c("DIQ175A")).alias("family_history"),
        recode.diagnosed(c("DIQ010")).alias("diabetes"),
        c("cycle"),
    )
    complete = complete_cases(shaped, [n for n in shaped.columns if n not in KEY])
    return first_per_key(complete, ["SEQN"], ["cycle"])


def complete_cases(df: DataFrame, columns: list[str], observation: Observation | None = None) -> DataFrame:
    """Rows with a value in every named column; optionally counts what was removed."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    if observation is not None:
        df = df.observe(
            observation,
            F.count(F.lit(1)).alias("before"),
            F.count_if(~whole).alias("removed"),
        )
    return df.dropna(subset=columns)


def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in an explicit order.

    An aggregate rather than a window: copies of a hot key are reduced before the shuffle.
    Remaining columns break ties so that the survivor never depends on the partitioning.
    """
    rest = [c for c in df.columns if c not in key]
    rank = [*order, *[c for c in rest if c not in order]]
    kept = df.groupBy(*key).agg(
        F.min_by(F.struct(*rest), F.struct(*rank)).alias("_row")
    )
    return kept.select(*[F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in df.columns])


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def cohort_sorted(df: DataFrame) -> DataFrame:
    return df.orderBy("cycle", "SEQN")


def stacked(df: DataFrame, names: list[Column | str], values: Mapping[str, Column], key: str, value: str) -> DataFrame:
    """Turn one aggregate row per group into one row per named measure."""
    entries = F.array(*[
        F.struct(F.lit(n).alias(key), v.alias(value)) for n, v in values.items()
    ])
    return df.select(*names, F.explode(entries).alias("_e")).select(*names, f"_e.{key}", f"_e.{value}")


def row_rules() -> dict[str, Column]:
    """What is true of a row that has no place in the final dataset."""
    c = F.col
    return {
        "age_below_minimum": c("age") < K.ADULT_MIN_AGE,
        "sex_code": ~c("sex").isin(*K.SEX_CODES),
        "race_code": ~c("race_ethnicity").isin(*K.RACE_CODES),
        "label": ~c(K.TARGET).isin(*K.CLASS_LABELS),
        "missing_key": c("SEQN").isNull() | c("cycle").isNull(),
    }


def domain_violations(df: DataFrame) -> DataFrame:
    """Counts of rows that break each rule of the final dataset, in one pass."""
    c = F.col
    checks = row_rules()
    checks |= {"bmi_implausible": ~c("bmi").between(*K.BMI_PLAUSIBLE), "missing_label": c(K.TARGET).isNull()}
    counted = df.agg(*[F.count_if(check).alias(name) for name, check in checks.items()])
    return stacked(counted, [], {n: c(n) for n in checks}, "check", "n_violations")


def core_nulls(df: DataFrame, columns) -> DataFrame:
    """Null counts of columns that must be complete."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return stacked(counted, [], {c: F.col(c) for c in columns}, "column", "n_null")


def assert_no_violations(violations: DataFrame, count: str) -> None:
    """Raise when a one-pass check reports anything; the table has one row per check."""
    broken = violations.filter(F.col(count) > 0).collect()
    if broken:
        raise ValueError(f"checks failed: {[r.asDict() for r in broken]}")


def unknown_labels(df: DataFrame, label: str = K.TARGET) -> DataFrame:
    """Labels outside the known classes, NULL included, with counts."""
    known = recode.is_true(F.col(label).isin(*K.CLASS_LABELS))
    return df.filter(~known).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def join_audit(modules: Modules) -> DataFrame:
    """Row count after every join, from one shuffle.

    Each module is reduced to key counts; the size after a join is the sum over keys of the
    product of counts so far. Right also when keys repeat.
    """
    order = ["demo", *K.INNER_MODULES, *K.LEFT_MODULES]
    tagged = None
    for i, name in enumerate(order):
        part = modules[name].select(*KEY, F.lit(i).alias("_m"))
        tagged = part if tagged is None else tagged.unionByName(part)
    counts = tagged.groupBy(*KEY).agg(
        *[F.count_if(F.col("_m") == i).alias(name) for i, name in enumerate(order)]
    )
    product, sizes = None, {}
    for name in order:
        factor = F.greatest(F.col(name), F.lit(1)) if name in K.LEFT_MODULES else F.col(name)
        product = factor if product is None else product * factor
        sizes[name] = product
    total = counts.agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(n) for n, v in sizes.items()])
    return stacked(
        total, [], {f"{i}_{n}": F.col(n) for i, n in enumerate(order)}, "step", "n_rows"
    )
