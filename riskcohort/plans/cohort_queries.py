"""Cohort construction and profiling over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskcohort import constants as K
from riskcohort.functions import recode
from riskcohort.operators import cohort as co, profile, split
from riskcohort.plans import fixtures
from riskcohort.plans.registry import query, rounded
from riskcohort.operators.replay import labs_outer_join, one_to_one_violations
from riskcohort.session import cut_lineage, spread_by
from riskcohort.sources.tables import eligible_followup, landing_audit


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.candidate_cohort(fixtures.modules(spark, sf_dir))


def dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.supervised_dataset(cohort(spark, sf_dir))


def stored_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dataset as a written table: splits and models read it several times."""
    return cut_lineage(spread_by(dataset(spark, sf_dir), "SEQN"))


def binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixtures.fixture
    return co.binary_dataset(f(spark, sf_dir, "demo"), f(spark, sf_dir, "bmx"), f(spark, sf_dir, "diq_history"))


DATASET_SQL = (
    "select SEQN, cycle, age, sex, bmi, race_ethnicity, family_history, hypertension, physical_activity, "
    "smoking_status, diq010, diabetes_risk from dataset"
)
BINARY_SQL = (
    "select SEQN, age, sex, race_ethnicity, bmi, family_history, diabetes, cycle from ("
    "select demo.SEQN, demo.cycle, cast(RIDAGEYR as int) as age, cast(RIAGENDR as int) as sex, "
    "cast(RIDRETH3 as int) as race_ethnicity, case when BMXBMI between 10 and 80 then BMXBMI end as bmi, "
    "case when DIQ175A = 10 then 1 when DIQ175A in (12, 99) then 0 end as family_history, "
    "case DIQ010 when 1 then 1 when 2 then 0 end as diabetes "
    "from demo join bmx using (cycle, SEQN) join diq_history using (cycle, SEQN) "
    "where RIDAGEYR >= 18 and RIAGENDR in (1, 2) and RIDRETH3 in (1, 2, 3, 4, 6, 7)) b "
    "where bmi is not null and family_history is not null and diabetes is not null"
)


@query("cohort_class_distribution", (
    "select l.position, l.label, count(d.SEQN) as n, round(count(d.SEQN) / (select count(*) from dataset), 6) as share "
    "from label_names l left join dataset d on d.diabetes_risk = l.label group by l.position, l.label"
))
def cohort_class_distribution(spark, sf_dir):
    return rounded(profile.class_distribution(dataset(spark, sf_dir)))


@query("cohort_rows", DATASET_SQL)
def cohort_rows(spark, sf_dir):
    return dataset(spark, sf_dir)


@query("cohort_sorted", DATASET_SQL)
def cohort_sorted(spark, sf_dir):
    return co.cohort_sorted(dataset(spark, sf_dir))


@query("cohort_by_cycle_union", (
    "select cycle, count(*) as n, cast(sum(SEQN) as bigint) as seqn_sum from demo group by cycle"
))
def cohort_by_cycle_union(spark, sf_dir):
    """The cycles as separate tables, united by name."""
    demo = fixtures.fixture(spark, sf_dir, "demo")
    parts = [demo.filter(F.col("cycle") == c) for c in K.CYCLES]
    united = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return united.groupBy("cycle").agg(F.count(F.lit(1)).alias("n"), F.sum("SEQN").alias("seqn_sum"))


@query("recode_predictors", (
    "select SEQN, cycle, family_history, hypertension, physical_activity, smoking_status from cohort"
))
def recode_predictors(spark, sf_dir):
    return cohort(spark, sf_dir).select(
        "SEQN", "cycle", "family_history", "hypertension", "physical_activity", "smoking_status"
    )


@query("target_three_class", "select SEQN, cycle, diq010, has_hba1c, has_glucose, diabetes_risk, diabetes_risk is null as undetermined from cohort")
def target_three_class(spark, sf_dir):
    return cohort(spark, sf_dir).select(
        "SEQN", "cycle", "diq010", "has_hba1c", "has_glucose", K.TARGET,
        F.col(K.TARGET).isNull().alias("undetermined"),
    )


@query("cohort_v1", BINARY_SQL)
def cohort_v1(spark, sf_dir):
    return binary(spark, sf_dir)


@query("outcome_prevalence", f"select count(*) as n, round(avg(diabetes), 6) as prevalence from ({BINARY_SQL}) v")
def outcome_prevalence(spark, sf_dir):
    return rounded(profile.prevalence(binary(spark, sf_dir), "diabetes"))


@query("first_reading_per_person", (
    "select SEQN, l_linenumber, l_quantity from (select l_orderkey as SEQN, l_linenumber, l_quantity, row_number() over ("
    "partition by l_orderkey order by l_linenumber, l_quantity) as rn from lineitem) r where rn = 1"
))
def first_reading_per_person(spark, sf_dir):
    """Repeated readings of a person reduced to the first one."""
    readings = fixtures.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("SEQN"), "l_linenumber", "l_quantity"
    )
    return co.first_per_key(readings, ["SEQN"], ["l_linenumber"])


@query("duplicate_keys", (
    "select SEQN, n, side from ("
    "select SEQN, count(*) as n, 'left' as side from demo group by SEQN union all "
    "select l_orderkey, count(*), 'right' from lineitem group by l_orderkey) d where n > 1"
))
def duplicate_keys(spark, sf_dir):
    """Which people would break a one-to-one join of demographics and raw readings."""
    demo = fixtures.fixture(spark, sf_dir, "demo")
    readings = fixtures.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("SEQN"))
    return one_to_one_violations(demo, readings, ["SEQN"])


@query("domain_violations", (
    "select unnest(['age_below_minimum', 'sex_code', 'race_code', 'label', 'bmi_implausible', 'missing_key', 'missing_label']) as \"check\", "
    "unnest([count(*) filter (age < 20), count(*) filter (sex not in (1, 2)), "
    "count(*) filter (race_ethnicity not in (1, 2, 3, 4, 6, 7)), "
    "count(*) filter (diabetes_risk not in ('Low', 'Moderate', 'High')), "
    "count(*) filter (bmi not between 10 and 80), count(*) filter (SEQN is null or cycle is null), "
    "count(*) filter (diabetes_risk is null)]) as n_violations from cohort"
))
def domain_violations(spark, sf_dir):
    """Checked on the cohort before exclusion, so that missing labels show up."""
    return co.domain_violations(cohort(spark, sf_dir))


@query("unknown_labels", "select diabetes_risk, count(*) as n from cohort where diabetes_risk is null group by diabetes_risk")
def unknown_labels(spark, sf_dir):
    return co.unknown_labels(cohort(spark, sf_dir))


@query("core_nulls", (
    "select unnest(['time_years', 'event', 'age', 'male', 'bmi', 'fpg_mmol_l']) as \"column\", "
    "unnest([count(*) filter (time_years is null), count(*) filter (event is null), count(*) filter (age is null), "
    "count(*) filter (male is null), count(*) filter (bmi is null), count(*) filter (fpg_mmol_l is null)]) as n_null from followup"
))
def core_nulls(spark, sf_dir):
    followup = eligible_followup(fixtures.fixture(spark, sf_dir, "followup_all"))
    return co.core_nulls(followup, ["time_years", "event", "age", "male", "bmi", "fpg_mmol_l"])


_GAPS = "\nunion all ".join(
    f"select '{c}' as \"column\", count(*) filter ({c} is null) as missing_before, "
    f"round(count(*) filter ({c} is null) / count(*), 6) as share_before, "
    f"count(*) filter ({c} is null and diabetes_risk is not null) as missing_after, "
    f"round(count(*) filter ({c} is null and diabetes_risk is not null) / count(diabetes_risk), 6) as share_after from cohort"
    for c in K.PREDICTORS
)


@query("missingness_before_after", _GAPS)
def missingness_before_after(spark, sf_dir):
    return rounded(profile.missingness_before_after(cohort(spark, sf_dir)))


_LABS = (
    "select unnest(['hba1c', 'glucose', 'both', 'neither']) as labs, "
    "unnest([count(*) filter (has_hba1c), count(*) filter (has_glucose), count(*) filter (has_hba1c and has_glucose), "
    "count(*) filter (not has_hba1c and not has_glucose)]) as n, count(*) as total from cohort"
)


@query("lab_availability", f"select labs, n, round(n / total, 6) as share from ({_LABS}) l")
def lab_availability(spark, sf_dir):
    return rounded(profile.lab_availability(cohort(spark, sf_dir)))


@query("cycle_counts", "select cycle, count(*) as n from dataset group by cycle")
def cycle_counts(spark, sf_dir):
    return profile.cycle_counts(dataset(spark, sf_dir))


@query("numeric_summary", (
    "select 'age' as \"column\", count(age) as n, cast(min(age) as double) as min, cast(max(age) as double) as max, "
    "round(avg(age), 6) as mean from dataset union all "
    "select 'bmi', count(bmi), min(bmi), max(bmi), round(avg(bmi), 6) from dataset"
))
def numeric_summary(spark, sf_dir):
    return rounded(profile.numeric_summary(dataset(spark, sf_dir), ["age", "bmi"]))


_RACES = " ".join(f"when {c} then '{t}'" for c, t in K.RACE_LABELS.items())


@query("category_shares", (
    "select variable, code, label, n, round(n / sum(n) over (partition by variable), 6) as share from ("
    f"select 'race_ethnicity' as variable, race_ethnicity as code, case race_ethnicity {_RACES} end as label, count(*) as n from dataset group by all union all "
    "select 'family_history', cast(family_history as int), case family_history when 1 then 'Yes' when 0 then 'No' else 'Unknown' end, count(*) from dataset group by all union all "
    "select 'hypertension', cast(hypertension as int), case hypertension when 1 then 'Yes' when 0 then 'No' else 'Unknown' end, count(*) from dataset group by all union all "
    "select 'sex', sex, case sex when 1 then 'Male' when 2 then 'Female' end, count(*) from dataset group by all union all "
    "select 'physical_activity', cast(physical_activity as int), case physical_activity when 1 then 'Active' when 0 then 'Inactive' else 'Unknown' end, count(*) from dataset group by all union all "
    "select 'smoking_status', cast(smoking_status as int), case smoking_status when 0 then 'Never' when 1 then 'Former' when 2 then 'Current' else 'Unknown' end, count(*) from dataset group by all) c"
))
def category_shares(spark, sf_dir):
    return rounded(profile.category_shares(dataset(spark, sf_dir)))


@query("evidence_ranges", " union all ".join(
    f"select '{c}' as \"column\", min({c}) as min, max({c}) as max, round(quantile_cont({c}, 0.01), 6) as q01, "
    f"round(quantile_cont({c}, 0.99), 6) as q99 from followup" for c in ("age", "bmi", "fpg_mmol_l")
))
def evidence_ranges(spark, sf_dir):
    followup = eligible_followup(fixtures.fixture(spark, sf_dir, "followup_all"))
    return rounded(profile.evidence_ranges(followup, ["age", "bmi", "fpg_mmol_l"]))


def _fill(c: str) -> str:
    if c in K.NUMERIC_PREDICTORS:
        value, method = f"quantile_cont({c}, 0.5)", "median"
    else:
        value = f"(select {c} from holdout where not is_test and {c} is not null group by {c} order by count(*) desc, {c} limit 1)"
        method = "mode"
    return (f"select '{c}' as \"column\", '{method}' as method, cast({value} as double) as fill, "
            f"count(*) filter ({c} is null) as n_missing, round(count(*) filter ({c} is null) / count(*), 6) as share "
            "from holdout where not is_test")


@query("fill_values", " union all ".join(_fill(c) for c in K.PREDICTORS))
def fill_values(spark, sf_dir):
    """Learned on the training part only."""
    train = split.stratified_holdout(stored_dataset(spark, sf_dir)).filter("not is_test")
    return rounded(profile.fill_values(train))


_CHAIN = ["bmx", "diq", "mcq", "bpq", "paq", "smq"]


def _audit_sql() -> str:
    parts, source = ["select '0_demo' as step, count(*) as n_rows from demo"], "demo"
    for i, m in enumerate(_CHAIN, 1):
        source += f" join {m} using (cycle, SEQN)"
        parts.append(f"select '{i}_{m}', count(*) from {source}")
    for i, m in enumerate(("ghb", "glu"), len(_CHAIN) + 1):
        source += f" left join {m} using (cycle, SEQN)"
        parts.append(f"select '{i}_{m}', count(*) from {source}")
    return " union all ".join(parts)


@query("join_audit", _audit_sql())
def join_audit(spark, sf_dir):
    return co.join_audit(fixtures.modules(spark, sf_dir))


@query("labs_outer_join", "select cycle, SEQN, LBXGH, LBXGLU from labs")
def labs_outer(spark, sf_dir):
    f = fixtures.fixture
    return labs_outer_join(f(spark, sf_dir, "ghb"), f(spark, sf_dir, "glu"))


@query("construction_report", (
    "select 'classes' as section, l.label as item, count(d.SEQN) as n, round(count(d.SEQN) / (select count(*) from dataset), 6) as share "
    "from label_names l left join dataset d on d.diabetes_risk = l.label group by l.label union all "
    f"select 'labs', labs, n, round(n / total, 6) from ({_LABS}) l union all "
    "select 'cycles', cycle, count(*), null from dataset group by cycle union all "
    f"select 'missing_before', \"column\", missing_before, share_before from ({_GAPS}) g union all "
    f"select 'missing_after', \"column\", missing_after, share_after from ({_GAPS}) g"
))
def construction_report(spark, sf_dir):
    return rounded(profile.construction_report(cohort(spark, sf_dir)))


@query("display_labels", (
    f"select SEQN, case race_ethnicity {_RACES} end as race, case sex when 1 then 'Male' else 'Female' end as sex_text, "
    "case family_history when 1 then 'Yes' when 0 then 'No' else 'Unknown' end as family, 2 - sex as male from dataset"
))
def display_labels(spark, sf_dir):
    c = F.col
    return dataset(spark, sf_dir).select(
        "SEQN", recode.race_label(c("race_ethnicity")).alias("race"),
        recode.label_of(c("sex"), K.SEX_LABELS, F.lit("Unknown")).alias("sex_text"),
        recode.yes_no_label(c("family_history")).alias("family"),
        recode.sex_code_to_male(c("sex")).alias("male"),
    )


@query("unit_conversion", "select SEQN, cycle, LBXGLU as mg_dl, round(LBXGLU / 18.0182e0, 6) as mmol_l from glu")
def unit_conversion(spark, sf_dir):
    glu = fixtures.fixture(spark, sf_dir, "glu")
    return rounded(glu.select(
        "SEQN", "cycle", recode.lab(F.col("LBXGLU")).alias("mg_dl"), recode.mgdl_to_mmoll(recode.lab(F.col("LBXGLU"))).alias("mmol_l")
    ))


@query("landing_file_audit")
def landing_file_audit(spark, sf_dir):
    """Size, leading bytes and digest of every landed table file."""
    return landing_audit(spark, sf_dir, "PAR1", "*.parquet")
