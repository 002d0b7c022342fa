"""Files of text read through the readers and their contracts, and bodies of any JSON kind.

The files are derived from the driver tables: written as headed CSV to the shared folder, then read back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskcohort import constants as K
from riskcohort.operators import submissions
from riskcohort.plans import cohort_queries, fixtures
from riskcohort.plans.registry import query
from riskcohort.session import ensure_checkpoint_dir
from riskcohort.sources import tables


def landed(spark: SparkSession, df: DataFrame, *parts: str) -> str:
    """Folder of ``df`` as CSV with a header, one sub-folder per value of ``parts``."""
    folder = f"{ensure_checkpoint_dir(spark)}/landed-{uuid.uuid4().hex}"
    df.write.option("header", True).partitionBy(*parts).csv(folder)
    return folder


@query("module_files", "select cycle, SEQN, case when SEQN % 13 = 0 then null else BMXBMI end as BMXBMI from bmx")
def module_files(spark, sf_dir):
    """One folder per cycle; names in any case with blanks, numbers as text, some of them words, a column too many."""
    c = F.col
    texts = fixtures.fixture(spark, sf_dir, "bmx").select(
        c("cycle").alias("part"), c("SEQN").cast("string").alias(" seqn"),
        F.when(c("SEQN") % 13 == 0, "refused").otherwise(c("BMXBMI").cast("string")).alias("bmxBMI "),
        F.lit("x").alias("comment"),
    )
    folder = landed(spark, texts, "part")
    return tables.scan_cycles(spark, "bmx", {x: f"{folder}/part={x}" for x in K.CYCLES}, "csv")


@query("dataset_files", cohort_queries.DATASET_SQL)
def dataset_files(spark, sf_dir):
    """The supervised dataset after a way through text, under its exact-column contract."""
    return tables.read_dataset(spark, landed(spark, cohort_queries.dataset(spark, sf_dir)), "csv")


@query("followup_files", "select participant_id, time_years, event, age, male, bmi, fpg_mmol_l from followup")
def followup_files(spark, sf_dir):
    """The follow-up table under its long headers, sex coded 1 and 2, read and cut to the eligible rows."""
    rows = fixtures.fixture(spark, sf_dir, "followup_all").withColumn("male", 2 - F.col("male"))
    folder = landed(spark, rows.select(*[F.col(new).alias(old) for old, new in K.FOLLOWUP_HEADERS.items()]))
    return tables.eligible_followup(tables.read_followup(spark.read.option("header", True).csv(folder)))


def untyped_body(kind: Column, age: Column) -> Column:
    """A request by kind: first what is no object, then objects whose values are numbers, booleans, lists and objects."""
    def whole(age: Column | str, sex: str = "1", race: str = "3") -> Column:
        shown = age if isinstance(age, Column) else F.lit(age)
        return F.concat(F.lit('{"age":'), shown, F.lit(
            f',"bmi":25.5,"sex":{sex},"race_ethnicity":{race},"family_history":0,"hypertension":1,'
            '"physical_activity":true,"smoking_status":2,"fasting_glucose":101}'))

    bodies = [
        F.lit("[1,2]"), F.lit('"45"'), F.lit("45"), F.lit("true"), F.lit("null"), F.lit(""), F.lit('{"age":4'),
        F.lit("{}"), whole('{"years":40}'), whole("[40]"), whole("true"), whole("null"), whole("40", sex='{"code":1}'),
        whole("40", race="[3]"), whole(age),
    ]
    out = F.lit(None).cast("string")
    for k, body in enumerate(bodies):
        out = F.when(kind == k, body).otherwise(out)
    return out


@query("untyped_bodies", (
    "select submission_id, case when kind <= 6 or kind = 15 then 'body.object' when kind in (7, 11) then 'age.missing' "
    "when kind in (8, 9) then 'age.type' when kind = 10 then 'age.range' when kind = 12 then 'sex.value' "
    "when kind = 13 then 'race_ethnicity.value' end as error_code, case when kind = 14 then cast(x as double) end as age, "
    "case when kind = 14 then 1e0 end as physical_activity, case when kind = 14 then 101e0 end as fasting_glucose "
    "from untyped_kinds"
))
def untyped_bodies(spark, sf_dir):
    kinds = fixtures.fixture(spark, sf_dir, "untyped_kinds")
    bodies = kinds.select("submission_id", untyped_body(F.col("kind"), F.col("x")).alias("body"))
    checked = submissions.validate_assessment(bodies)
    return checked.select("submission_id", "error_code", "age", "physical_activity", "fasting_glucose")
