"""Projections that give the driver tables the shapes the operators expect.

Each projection is plain SQL in the dialect Spark and DuckDB share; ``{name}`` stands for a
driver table. Spark runs them over DataFrames, the oracles inline them as CTEs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskcohort.sources.tables import conform_module

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

CYCLE = (
    "case when year(o_orderdate) <= 1996 then '2013-2014' "
    "when year(o_orderdate) <= 1998 then '2015-2016' else '2017-2018' end"
)


def _module(columns: str, source: str = "{orders}", where: str = "") -> str:
    return f"select {CYCLE} as cycle, o_orderkey as SEQN, {columns} from {source} {where}".strip()


FIXTURES = {
    "demo": _module(
        "cast(12 + (o_custkey * 7 + o_orderkey) % 69 as double) as RIDAGEYR, "
        "cast(1 + o_orderkey % 2 as double) as RIAGENDR, "
        "cast(1 + c_nationkey % 7 as double) as RIDRETH3",
        "{orders} join {customer} on o_custkey = c_custkey",
    ),
    # Low-priority orders play the people who were not examined.
    "bmx": _module(
        "case when o_orderkey % 53 = 0 then null "
        "else 15e0 + (cast(floor(o_totalprice) as bigint) % 300) / 10e0 end as BMXBMI",
        where="where o_orderpriority <> '5-LOW'",
    ),
    "diq": _module(
        "case when o_orderkey % 11 = 0 then 1e0 when o_orderkey % 37 = 1 then 3e0 "
        "when o_orderkey % 41 = 2 then 7e0 when o_orderkey % 43 = 3 then 9e0 else 2e0 end as DIQ010"
    ),
    "diq_history": _module(
        "case when o_orderkey % 11 = 0 then 1e0 when o_orderkey % 37 = 1 then 3e0 "
        "when o_orderkey % 41 = 2 then 7e0 when o_orderkey % 43 = 3 then 9e0 else 2e0 end as DIQ010, "
        "case when o_custkey % 3 = 0 then 10e0 when o_orderkey % 17 = 0 then 99e0 "
        "when o_orderkey % 23 = 0 then 77e0 else 12e0 end as DIQ175A"
    ),
    "mcq": _module(
        "case when o_orderkey % 29 = 0 then 9e0 when o_custkey % 3 = 0 then 1e0 else 2e0 end as MCQ300C"
    ),
    "bpq": _module(
        "case when o_orderkey % 97 = 0 then 7e0 when o_custkey % 5 < 2 then 1e0 else 2e0 end as BPQ020"
    ),
    "paq": _module(
        "case when o_orderkey % 4 = 0 then 1e0 when o_orderkey % 101 = 0 then 9e0 else 2e0 end as PAQ650, "
        "case when o_orderkey % 3 = 0 then 1e0 else 2e0 end as PAQ665"
    ),
    "smq": _module(
        "case when o_custkey % 7 < 3 then 1e0 when o_custkey % 61 = 0 then 9e0 else 2e0 end as SMQ020, "
        "case when o_custkey % 7 < 3 then 1e0 + o_custkey % 7 end as SMQ040"
    ),
    "ghb": (
        f"select {CYCLE} as cycle, l_orderkey as SEQN, "
        "case when l_orderkey % 47 = 0 then null when l_orderkey % 53 = 0 then cast('NaN' as double) "
        "when l_orderkey % 71 = 0 then 6.45e0 else 4.5e0 + (cast(qty as bigint) % 30) / 10e0 end as LBXGH "
        "from (select l_orderkey, sum(l_quantity) as qty from {lineitem} group by l_orderkey) q "
        "join {orders} on l_orderkey = o_orderkey"
    ),
    "glu": (
        f"select {CYCLE} as cycle, l_orderkey as SEQN, "
        "case when l_orderkey % 59 = 0 then cast('NaN' as double) "
        "else cast(70 + cast(floor(price) as bigint) % 70 as double) end as LBXGLU "
        "from (select l_orderkey, max(l_extendedprice) as price from {lineitem} group by l_orderkey) q "
        "join {orders} on l_orderkey = o_orderkey "
        "where o_orderpriority in ('1-URGENT', '2-HIGH')"
    ),
    "followup_all": (
        "select o_orderkey as participant_id, (1 + (o_orderkey * 37) % 70) / 10e0 as time_years, "
        "cast(case when (o_orderkey * 31 + o_custkey * 17) % 1000 < ((o_orderkey * 13) % 500) / 2e0 "
        "then 1 else 0 end as int) as event, "
        "cast(20 + (o_custkey * 7 + o_orderkey) % 70 as double) as age, "
        "cast(o_orderkey % 2 as int) as male, "
        "15e0 + (cast(floor(o_totalprice) as bigint) % 300) / 10e0 as bmi, "
        "2.5e0 + ((o_orderkey * 13) % 500) / 100e0 as fpg_mmol_l from {orders}"
    ),
    "raw_submissions": (
        "select event_id as submission_id, user_id, ts, "
        "case event_id % 31 when 0 then null when 1 then '' when 2 then 'abc' when 3 then 'NaN' "
        "when 4 then '-5' when 5 then '131' when 6 then ' 45 ' "
        "else cast(20 + event_id % 60 as string) end as raw_age, "
        "case event_id % 37 when 0 then null when 1 then '0' when 2 then 'Infinity' when 3 then '151' "
        "when 4 then '1.0d' else cast(18 + event_id % 25 as string) end as raw_bmi, "
        "case event_id % 9 when 0 then '1' when 1 then '0' when 2 then '2' when 3 then 'male' "
        "when 4 then 'Female' when 5 then ' F ' when 6 then 'm' when 7 then '1.0' "
        "else case when event_id % 5 = 0 then 'x' when event_id % 7 = 0 then null else '2.0' end end as raw_sex, "
        "case event_id % 23 when 0 then '1.5' when 1 then '5' when 2 then '99' when 3 then null "
        "else cast(1 + event_id % 4 as string) end as raw_race, "
        "case event_id % 19 when 0 then 'unknown' when 1 then 'null' when 2 then '-1' when 3 then 'maybe' "
        "when 4 then 'yes' else cast(event_id % 2 as string) end as raw_family, "
        "case event_id % 41 when 0 then 'bad' when 1 then null "
        "else cast(event_id % 2 as string) end as raw_hypertension, "
        "case event_id % 43 when 0 then 'active' when 1 then 'Inactive' when 2 then '7' "
        "else cast(event_id % 2 as string) end as raw_activity, "
        "case event_id % 47 when 0 then 'never' when 1 then 'former' when 2 then 'current' when 3 then '3' "
        "else cast(event_id % 3 as string) end as raw_smoking, "
        "case event_id % 13 when 0 then null when 1 then 'null' when 2 then '0' when 3 then 'bad' "
        "when 4 then '6.45' else cast(4.5e0 + (event_id % 30) / 10e0 as string) end as raw_hba1c, "
        "case event_id % 11 when 0 then null when 1 then '' when 2 then 'none' when 3 then '-1' "
        "when 4 then '125.5' else cast(70 + event_id % 70 as string) end as raw_glucose, "
        "event_type as raw_name from {events}"
    ),
    "record_events": (
        "select event_id, ts, user_id as assessment_id, user_id % 20 as owner_id, "
        "case when event_id % 499 = 7 then 'clear' else case event_type when 'signup' then 'create' when 'click' then 'edit' "
        "when 'view' then 'read' when 'purchase' then 'result' else 'delete' end end as action, "
        "md5(concat(cast(user_id as string), '|', cast(cast(floor(value) as bigint) as string))) as snapshot "
        "from {events}"
    ),
    # The same field under different names, present, null or absent.
    "alias_bodies": (
        "select event_id as submission_id, event_id % 6 as age_case, event_id % 3 as bmi_case, "
        "event_id % 4 as glucose_case, event_id % 5 as sex_case, event_id % 7 as hba1c_case, "
        "cast(20 + event_id % 60 as string) as x, cast(18 + event_id % 25 as string) as y, "
        "cast(70 + event_id % 70 as string) as z, cast(4 + event_id % 9 as string) as v, "
        "cast(1 + event_id % 2 as string) as w from {events}"
    ),
    # Requests of any JSON kind, by number.
    "untyped_kinds": (
        "select event_id as submission_id, event_id % 16 as kind, cast(20 + event_id % 60 as string) as x from {events}"
    ),
}

RAW_TO_FIELD = {
    "raw_age": "age", "raw_bmi": "bmi", "raw_sex": "sex", "raw_race": "race_ethnicity",
    "raw_family": "family_history", "raw_hypertension": "hypertension",
    "raw_activity": "physical_activity", "raw_smoking": "smoking_status",
    "raw_hba1c": "hba1c", "raw_glucose": "fasting_glucose", "raw_name": "patient_name",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than cores, spread over all of them; larger scans are left alone.

    Only worth it ahead of costly row work such as parsing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fixture(spark: SparkSession, sf_dir: str, name: str, spread_scan: bool = False) -> DataFrame:
    sql = FIXTURES[name]
    used = [t for t in TABLES if "{" + t + "}" in sql]
    read = {t: table(spark, sf_dir, t) for t in used}
    if spread_scan:
        read = {t: spread(df) for t, df in read.items()}
    return spark.sql(sql, **read)


def modules(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    names = ("demo", "bmx", "diq", "mcq", "bpq", "paq", "smq", "ghb", "glu")
    return {n: conform_module(fixture(spark, sf_dir, n), n) for n in names}


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as they arrive: ids and a JSON body; NULL fields are absent keys."""
    raw = fixture(spark, sf_dir, "raw_submissions", spread_scan=True)
    body = F.to_json(F.struct(*[F.col(r).alias(f) for r, f in RAW_TO_FIELD.items()]))
    return raw.select("submission_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), body.alias("body"))


def alias_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col

    def pair(name: str, value) -> object:
        return F.concat(F.lit(f'"{name}":'), value)

    null = F.lit("null")
    raw = fixture(spark, sf_dir, "alias_bodies")
    age = (
        F.when(c("age_case") == 0, pair("age", c("x")))
        .when(c("age_case") == 1, pair("Age", c("x")))
        .when(c("age_case") == 2, pair("sn256", c("x")))
        .when(c("age_case") == 3, F.concat_ws(",", pair("age", null), pair("Age", c("x"))))
        .when(c("age_case") == 4, F.concat_ws(",", pair("Age", c("y")), pair("sn256", c("x"))))
    )
    bmi = F.when(c("bmi_case") == 0, pair("BMI", c("y"))).when(
        c("bmi_case") == 1, F.concat_ws(",", pair("BMI", c("x")), pair("bmi", c("y"))))
    glucose = (
        F.when(c("glucose_case") == 0, pair("fasting_glucose", c("z")))
        .when(c("glucose_case") == 1, F.concat_ws(",", pair("fasting_glucose_mgdl", null), pair("fasting_glucose", c("z"))))
        .when(c("glucose_case") == 2, pair("fasting_glucose_mgdl", c("z")))
    )
    sex = (
        F.when(c("sex_case") == 0, pair("sex", c("w")))
        .when(c("sex_case") == 1, pair("Sex", F.lit('"Male"')))
        .when(c("sex_case") == 2, pair("sx060_r", c("w")))
        .when(c("sex_case") == 3, F.concat_ws(",", pair("sx060_r", c("w")), pair("sex", null)))
    )
    # Lists and booleans are shown as they stand.
    hba1c = (
        F.when(c("hba1c_case") == 0, pair("hba1c_pct", c("v")))
        .when(c("hba1c_case") == 1, pair("hba1c", c("v")))
        .when(c("hba1c_case") == 2, F.concat_ws(",", pair("hba1c", c("v")), pair("hba1c_pct", null)))
        .when(c("hba1c_case") == 3, F.concat_ws(",", pair("hba1c", c("w")), pair("hba1c_pct", c("v"))))
        .when(c("hba1c_case") == 4, pair("hba1c", F.concat(F.lit("["), c("v"), F.lit(","), c("w"), F.lit("]"))))
        .when(c("hba1c_case") == 5, pair("hba1c_pct", F.lit("true")))
    )
    body = F.concat(F.lit("{"), F.concat_ws(",", age, bmi, sex, glucose, hba1c), F.lit("}"))
    return raw.select("submission_id", body.alias("body"))


def as_ctes(bodies: dict[str, str], query: str) -> str:
    """``with`` clause of every named body the query needs, in definition order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, body in bodies.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(body)

    visit(query)
    parts = [f"{n} as ({b})" for n, b in bodies.items() if n in needed]
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + query


# Laboratory columns, in which NaN means absent; DuckDB would order it above all numbers.
LAB_COLUMNS = {"ghb": "LBXGH", "glu": "LBXGLU"}


def duckdb_fixtures() -> dict[str, str]:
    """Fixture bodies for the oracles, with absent laboratory values as NULL."""
    out = {n: s.format(**{t: t for t in TABLES}) for n, s in FIXTURES.items()}
    for name, column in LAB_COLUMNS.items():
        out[name] = (f"select cycle, SEQN, case when isnan({column}) then null else {column} end as {column} "
                     f"from ({out[name]}) raw_{name}_rows")
    return out
