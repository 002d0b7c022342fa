"""Named queries, each next to the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from riskcohort.plans.fixtures import as_ctes, duckdb_fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may use every fixture and derived table as a CTE."""
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round the double columns of a result, where engines may sum in a different order."""
    return df.select(*[
        F.round(f"`{f.name}`", digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
        for f in df.schema
    ])


# Derived tables of the oracles, in definition order.
DERIVED = {
    "people": (
        "select * from demo where RIDAGEYR >= 20 and RIAGENDR in (1, 2) and RIDRETH3 in (1, 2, 3, 4, 6, 7)"
    ),
    "answers": (
        "select p.cycle, p.SEQN, p.RIDAGEYR, p.RIAGENDR, p.RIDRETH3, bmx.BMXBMI, diq.DIQ010, mcq.MCQ300C, "
        "bpq.BPQ020, paq.PAQ650, paq.PAQ665, smq.SMQ020, smq.SMQ040, ghb.LBXGH, glu.LBXGLU "
        "from people p join bmx using (cycle, SEQN) join diq using (cycle, SEQN) join mcq using (cycle, SEQN) "
        "join bpq using (cycle, SEQN) join paq using (cycle, SEQN) join smq using (cycle, SEQN) "
        "left join ghb using (cycle, SEQN) left join glu using (cycle, SEQN)"
    ),
    "cohort": (
        "select SEQN, cycle, cast(RIDAGEYR as int) as age, cast(RIAGENDR as int) as sex, BMXBMI as bmi, "
        "cast(RIDRETH3 as int) as race_ethnicity, "
        "case MCQ300C when 1 then 1e0 when 2 then 0e0 end as family_history, "
        "case BPQ020 when 1 then 1e0 when 2 then 0e0 end as hypertension, "
        "case when PAQ650 = 1 or PAQ665 = 1 then 1e0 when PAQ650 = 2 and PAQ665 = 2 then 0e0 end as physical_activity, "
        "case when SMQ020 = 2 then 0e0 when SMQ020 = 1 and SMQ040 = 3 then 1e0 "
        "when SMQ020 = 1 and SMQ040 in (1, 2) then 2e0 end as smoking_status, "
        "DIQ010 as diq010, "
        "case when DIQ010 = 1 or LBXGH >= 6.5e0 or LBXGLU >= 126 then 'High' "
        "when DIQ010 = 3 or LBXGH between 5.7e0 and 6.4e0 or LBXGLU between 100 and 125 then 'Moderate' "
        "when DIQ010 = 2 or LBXGH is not null or LBXGLU is not null then 'Low' end as diabetes_risk, "
        "LBXGH is not null as has_hba1c, LBXGLU is not null as has_glucose from answers"
    ),
    "dataset": (
        "select SEQN, cycle, age, sex, bmi, race_ethnicity, family_history, hypertension, physical_activity, "
        "smoking_status, diq010, diabetes_risk from cohort where diabetes_risk is not null"
    ),
    "linear": (
        "select *, "
        "exp(-7e0 + 0.075e0 * age + 0.06e0 * coalesce(bmi, 0) + 0.8e0 * coalesce(family_history, 0) "
        "+ 0.6e0 * coalesce(hypertension, 0) + 0.15e0 * coalesce(smoking_status, 0) "
        "- 0.2e0 * coalesce(physical_activity, 0)) as eh, "
        "exp(3.2e0 - 0.05e0 * age - 0.03e0 * coalesce(bmi, 0) - 0.4e0 * coalesce(family_history, 0) "
        "- 0.3e0 * coalesce(hypertension, 0) - 0.1e0 * coalesce(smoking_status, 0) "
        "+ 0.15e0 * coalesce(physical_activity, 0)) as el, "
        "exp(-7e0 + 0.075e0 * age + 0.06e0 * coalesce(bmi, 0)) as oeh, "
        "exp(3.2e0 - 0.05e0 * age - 0.03e0 * coalesce(bmi, 0)) as oel from dataset"
    ),
    "probabilities": (
        "select *, SEQN as id, diabetes_risk as y_true, round(eh / (eh + el + 1), 6) as p_high, "
        "round(el / (eh + el + 1), 6) as p_low, round(1 / (eh + el + 1), 6) as p_moderate, "
        "round(oeh / (oeh + oel + 1), 6) as o_high, round(oel / (oeh + oel + 1), 6) as o_low, "
        "round(1 / (oeh + oel + 1), 6) as o_moderate from linear"
    ),
    "scored": (
        "select *, case when p_high >= p_low and p_high >= p_moderate then 'High' "
        "when p_low >= p_moderate then 'Low' else 'Moderate' end as y_pred, "
        "case when o_high >= o_low and o_high >= o_moderate then 'High' "
        "when o_low >= o_moderate then 'Low' else 'Moderate' end as o_pred from probabilities"
    ),
    "labs": (
        "select coalesce(a.cycle, b.cycle) as cycle, coalesce(a.SEQN, b.SEQN) as SEQN, a.LBXGH, b.LBXGLU "
        "from ghb a full outer join glu b on a.cycle = b.cycle and a.SEQN = b.SEQN"
    ),
    "lab_scored": "select s.*, l.LBXGH, l.LBXGLU from scored s left join labs l using (SEQN, cycle)",
    "ruled": (
        "select *, case when rule in ('diagnostic_lab', 'high_probability') then 'High' "
        "when rule = 'prediabetic_lab' then 'Moderate' when p_high >= p_low then 'High' else 'Low' end as tier from ("
        "select *, case when LBXGH >= 6.5e0 or LBXGLU >= 126 then 'diagnostic_lab' "
        "when p_high >= 0.7e0 then 'high_probability' "
        "when LBXGH between 5.7e0 and 6.4e0 or LBXGLU between 100 and 125 then 'prediabetic_lab' "
        "else 'low_high_fallback' end as rule from lab_scored) r"
    ),
    "models": (
        "select id, y_true, 'scorecard' as model, y_pred, p_high, p_low, p_moderate, age, bmi from scored union all "
        "select id, y_true, 'reduced', o_pred, o_high, o_low, o_moderate, age, bmi from scored"
    ),
    "label_names": "select * from (values (0, 'Low'), (1, 'Moderate'), (2, 'High')) v(position, label)",
    "hash_order": (
        "select *, row_number() over (partition by diabetes_risk order by md5(concat('42|', cast(SEQN as string))), SEQN) "
        "as hash_rank, count(*) over (partition by diabetes_risk) as label_n, count(*) over () as all_n from dataset"
    ),
    "quotas": (
        "select diabetes_risk, base + case when row_number() over (order by rest desc, diabetes_risk) "
        "<= target - sum(base) over () then 1 else 0 end as quota from ("
        "select diabetes_risk, target, floor(target * n / total) as base, target * n / total - floor(target * n / total) as rest "
        "from (select diabetes_risk, count(*) * 1e0 as n, sum(count(*)) over () * 1e0 as total, "
        "cast(ceil(sum(count(*)) over () * 0.2) as double) as target from dataset group by diabetes_risk) q) r"
    ),
    "holdout": "select h.*, h.hash_rank <= q.quota as is_test from hash_order h join quotas q using (diabetes_risk)",
    "train_order": (
        "select SEQN, diabetes_risk, row_number() over (partition by diabetes_risk order by hash_rank) as hash_rank, "
        "count(*) over (partition by diabetes_risk) as label_n from holdout where not is_test"
    ),
    "folds": (
        "select *, cast(case when hash_rank <= (label_n // 5 + 1) * (label_n % 5) "
        "then (hash_rank - 1) // (label_n // 5 + 1) "
        "else label_n % 5 + (hash_rank - 1 - (label_n // 5 + 1) * (label_n % 5)) // (label_n // 5) end as int) as fold "
        "from train_order"
    ),
    "fold_models": "select m.*, f.fold from models m join folds f on m.id = f.SEQN",
    "model_cells": (
        "select model, y_true, y_pred, count(*) as n from models group by all"
    ),
    "model_classes": (
        "select model, label, tp, fp, fn, case when tp + fp > 0 then tp / (tp + fp) else 0e0 end as precision, "
        "case when tp + fn > 0 then tp / (tp + fn) else 0e0 end as recall from ("
        "select m.model, l.label, sum(case when y_true = label and y_pred = label then 1e0 else 0e0 end) as tp, "
        "sum(case when y_true <> label and y_pred = label then 1e0 else 0e0 end) as fp, "
        "sum(case when y_true = label and y_pred <> label then 1e0 else 0e0 end) as fn "
        "from models m, label_names l group by m.model, l.label) c"
    ),
    "model_f1": (
        "select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0e0 end as f1 "
        "from model_classes"
    ),
    "followup": "select * from followup_all where fpg_mmol_l between 2.8e0 and 6.999999e0",
    "time_counts": (
        "select time_years as t, count(*) as n, count(*) filter (event = 0) as censored from followup group by time_years"
    ),
    "curve": (
        "select t, censored, at_risk, product(1 - censored / at_risk) over (order by t rows unbounded preceding) as survival "
        "from (select t, censored, cast(sum(n) over (order by t desc rows unbounded preceding) as bigint) as at_risk "
        "from time_counts) r where censored > 0"
    ),
    "horizon": (
        "select *, event = 1 and time_years <= 3 or time_years > 3 as known, "
        "case when event = 1 and time_years <= 3 then 1 when time_years > 3 then 0 end as y from followup"
    ),
    "weighted": (
        "select h.*, 1 / greatest(coalesce(c.survival, 1e0), 0.05e0) as w, "
        "round(1 / (1 + exp(-(-12e0 + 0.02e0 * age + 0.05e0 * bmi + 1.4e0 * fpg_mmol_l))), 9) as score from ("
        "select *, case when y = 1 then time_years else 3e0 end as at from horizon where known) h "
        "asof left join curve c on h.at > c.t"
    ),
    "grouped": (
        "select w.*, g.name as grp from weighted w, lateral (select unnest(["
        "'all', case when fpg_mmol_l < 5.6e0 then 'fpg_below_100' when fpg_mmol_l < 6.1e0 then 'fpg_100_109' "
        "else 'fpg_110_125' end, case when male = 0 then 'women' else 'men' end, "
        "case when age < 30 then 'age_20_29' when age < 50 then 'age_30_49' when age < 70 then 'age_50_69' "
        "else 'age_70_plus' end, case when bmi < 25 then 'bmi_below_25' when bmi < 30 then 'bmi_25_29' "
        "else 'bmi_30_plus' end]) as name) g"
    ),
    "group_scores": (
        "select grp, score, sum(w * y) as wp, sum(w * (1 - y)) as wn from grouped group by grp, score"
    ),
    "group_curve": (
        "select *, coalesce(sum(wn) over (partition by grp order by score rows between unbounded preceding and 1 preceding), 0) as neg_below, "
        "sum(wp) over (partition by grp order by score desc rows unbounded preceding) as tp, "
        "sum(wn) over (partition by grp order by score desc rows unbounded preceding) as fp from group_scores"
    ),
    "group_ranks": (
        "select grp, sum(wp * (neg_below + wn / 2)) / (sum(wp) * sum(wn)) as auc, sum(wp * tp / (tp + fp)) / sum(wp) as ap "
        "from group_curve group by grp"
    ),
}


def oracle_sql() -> dict[str, str]:
    bodies = {**duckdb_fixtures(), **DERIVED, **EXTRA}
    return {name: as_ctes(bodies, sql) for name, sql in SQL.items()}


# Derived tables that other query modules add.
EXTRA: dict[str, str] = {}
