"""Behavioural checks of a scorer: stress grid, corners, trends, side-by-side, verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskcohort import constants as K
from riskcohort.functions.rules import all_of, signal_strength
from riskcohort.operators.scoring import Scorer

BACKGROUND = ("sex", "race_ethnicity", "physical_activity", "smoking_status")
# The profile every fixed set starts from.
BASE_PROFILE = {"sex": 1, "race_ethnicity": 1, "physical_activity": 1, "smoking_status": 0}

# Named profiles as (set, id, age, bmi, family history, hypertension, changes).
NAMED_PROFILES = (
    ("low", "A1", 20, 20, 0, 0, {}),
    ("low", "A2", 25, 22, 0, 0, {"sex": 2, "race_ethnicity": 2}),
    ("low", "A3", 30, 24, 0, 0, {"race_ethnicity": 3}),
    ("moderate", "B1", 40, 28, 1, 0, {}),
    ("moderate", "B2", 50, 30, 1, 1, {}),
    ("moderate", "B3", 55, 32, 0, 1, {}),
    ("moderate", "B4", 45, 31, 1, 1, {}),
    ("high", "C1", 60, 35, 1, 1, {}),
    ("high", "C2", 65, 40, 1, 1, {}),
    ("high", "C3", 70, 42, 1, 1, {}),
    ("high", "C4", 75, 45, 1, 1, {}),
    ("combination", "D1", 58, 33, 1, 1, {"sex": 2, "race_ethnicity": 4, "smoking_status": 2}),
    ("combination", "D2", 48, 29, 1, 0, {"sex": 2, "race_ethnicity": 6}),
    ("combination", "D3", 52, 31, 0, 1, {"race_ethnicity": 7, "physical_activity": 0}),
    ("combination", "D4", 44, 27, 1, 0,
     {"race_ethnicity": 2, "physical_activity": 0, "smoking_status": 1}),
    ("combination", "D5", 62, 36, 1, 1, {"sex": 2, "race_ethnicity": 3, "smoking_status": 1}),
    ("combination", "D6", 38, 26, 0, 0, {"physical_activity": 0, "smoking_status": 2}),
)


def named_profiles(spark: SparkSession) -> DataFrame:
    rows = [
        (group, name, age, float(bmi), fh, htn, *[{**BASE_PROFILE, **changes}[k] for k in BACKGROUND])
        for group, name, age, bmi, fh, htn, changes in NAMED_PROFILES
    ]
    schema = ("profile_set string, profile_id string, age int, bmi double, family_history int, "
              "hypertension int, sex int, race_ethnicity int, physical_activity int, smoking_status int")
    return spark.createDataFrame(rows, schema)


def base_background(spark: SparkSession) -> DataFrame:
    """The single background of the reference-size grid."""
    return spark.range(1).select(
        *[F.lit(BASE_PROFILE[k]).alias(k) for k in BACKGROUND], F.lit(1).cast("long").alias("n_people")
    )


def observed_backgrounds(cohort: DataFrame) -> DataFrame:
    """Every background that occurs, with how many people have it."""
    return cohort.groupBy(*BACKGROUND).agg(F.count(F.lit(1)).alias("n_people"))


def profile_grid(backgrounds: DataFrame) -> DataFrame:
    """Age x BMI x family history x hypertension for each background, by ``explode``."""
    def axis(values, kind: str) -> Column:
        return F.explode(F.array(*[F.lit(v).cast(kind) for v in values]))

    out = backgrounds.withColumn("age", axis(K.GRID_AGES, "int"))
    out = out.withColumn("bmi", axis(K.GRID_BMIS, "double"))
    out = out.withColumn("family_history", axis((0, 1), "int"))
    return out.withColumn("hypertension", axis((0, 1), "int"))


def grid_class_share(scored: DataFrame) -> DataFrame:
    total = F.count(F.lit(1))
    counted = scored.agg(
        total.alias("_n"), *[F.count_if(F.col("y_pred") == c).alias(c) for c in K.CLASS_LABELS]
    )
    entries = F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("n")) for c in K.CLASS_LABELS])
    rows = counted.select("_n", F.explode(entries).alias("e"))
    return rows.select("e.label", "e.n", (F.col("e.n") / F.col("_n")).alias("share"))


def corner(df: DataFrame) -> Column:
    """``high_risk`` / ``low_risk`` corner of the grid, NULL elsewhere."""
    c = F.col
    high = (c("age") >= 60) & (c("bmi") >= 35) & (c("family_history") == 1) & (c("hypertension") == 1)
    low = (c("age") <= 30) & (c("bmi") <= 25) & (c("family_history") == 0) & (c("hypertension") == 0)
    return F.when(high, "high_risk").when(low, "low_risk")


def grid_corners(scored: DataFrame) -> DataFrame:
    p = F.col("p_high")
    return (
        scored.withColumn("corner", corner(scored)).filter("corner is not null").groupBy("corner")
        .agg(
            F.count(F.lit(1)).alias("n_profiles"),
            *[F.count_if(F.col("y_pred") == c).alias(f"n_{c.lower()}") for c in K.CLASS_LABELS],
            F.min(p).alias("min_p_high"), F.max(p).alias("max_p_high"), F.avg(p).alias("mean_p_high"),
        )
    )


def marginal_means(scored: DataFrame, predictors=("family_history", "hypertension")) -> DataFrame:
    """Mean P(High) for both values of each binary predictor, one shuffle for all."""
    entries = F.array(*[
        F.struct(F.lit(p).alias("predictor"), F.col(p).cast("int").alias("value")) for p in predictors
    ])
    return (
        scored.select("p_high", F.explode(entries).alias("e")).groupBy("e.predictor", "e.value")
        .agg(F.avg("p_high").alias("mean_p_high"))
    )


def trend_lines(scored: DataFrame, keys: tuple[str, ...] = BACKGROUND) -> DataFrame:
    """P(High) at both ends of the age line (BMI 30) and the BMI line (age 60), and its direction."""
    c = F.col
    risky = (c("family_history") == 1) & (c("hypertension") == 1)
    lines = F.array_compact(F.array(
        F.when(risky & (c("bmi") == 30), F.struct(F.lit("age").alias("axis"), c("age").cast("double").alias("x"))),
        F.when(risky & (c("age") == 60), F.struct(F.lit("bmi").alias("axis"), c("bmi").alias("x"))),
    ))
    points = scored.select(*keys, "p_high", F.explode(lines).alias("e")).select(*keys, "p_high", "e.axis", "e.x")
    ends = points.groupBy(*keys, "axis").agg(
        F.min_by("p_high", "x").alias("p_start"), F.max_by("p_high", "x").alias("p_end")
    )
    return ends.withColumn("increasing", c("p_end") > c("p_start"))


def side_by_side(profiles: DataFrame, new: Scorer, old: Scorer, row_id: str) -> DataFrame:
    """Both models' answers per profile.

    The second model sees only its five features, with "no family history" coded as missing;
    each model is applied once to the whole table and the answers are joined on the id.
    """
    c = F.col
    old_input = profiles.select(
        row_id, "age", "bmi", "sex", "race_ethnicity",
        F.when(c("family_history") == 1, 1.0).alias("family_history"),
    )
    a = new(profiles).select(row_id, c("y_pred").alias("new_pred"), c("p_high").alias("new_p_high"))
    b = old(old_input).select(row_id, c("y_pred").alias("old_pred"), c("p_high").alias("old_p_high"))
    both = a.join(b, row_id)
    return both.withColumn("signal", signal_strength(c("new_p_high"), c("old_p_high")))


def validation_verdict(scored: DataFrame, interface_ok: bool = True) -> DataFrame:
    """The five behavioural checks, the verdict and the reasons against it, in one aggregate."""
    c = F.col
    p = c("p_high")
    where = scored.withColumn("_corner", corner(scored))
    risky = (c("family_history") == 1) & (c("hypertension") == 1)
    on_age, on_bmi = risky & (c("bmi") == 30), risky & (c("age") == 60)

    def mean_if(cond: Column) -> Column:
        return F.avg(F.when(cond, p))

    row = where.agg(
        *[F.count_if(c("y_pred") == x).alias(f"n_{x}") for x in K.CLASS_LABELS],
        F.count_if((c("_corner") == "high_risk") & (c("y_pred") == "High")).alias("high_corner_high"),
        mean_if(c("_corner") == "high_risk").alias("high_mean"),
        mean_if(c("_corner") == "low_risk").alias("low_mean"),
        mean_if(on_age & (c("age") == K.GRID_AGES[0])).alias("age_start"),
        mean_if(on_age & (c("age") == K.GRID_AGES[-1])).alias("age_end"),
        mean_if(on_bmi & (c("bmi") == K.GRID_BMIS[0])).alias("bmi_start"),
        mean_if(on_bmi & (c("bmi") == K.GRID_BMIS[-1])).alias("bmi_end"),
        *[mean_if(c(x) == v).alias(f"{x}_{v}") for x in ("family_history", "hypertension") for v in (0, 1)],
    )
    row = row.select(
        all_of(*[c(f"n_{x}") > 0 for x in K.CLASS_LABELS]).alias("all_classes"),
        (c("high_corner_high") > 0).alias("high_corner_ok"),
        (c("high_mean") - c("low_mean")).alias("separation"),
        all_of(
            c("age_end") > c("age_start"), c("bmi_end") > c("bmi_start"),
            c("family_history_1") > c("family_history_0"), c("hypertension_1") > c("hypertension_0"),
        ).alias("trends_ok"),
        F.lit(interface_ok).alias("interface_ok"),
    )
    apart = all_of(c("separation") > K.MIN_SEPARATION)
    reasons = F.array_compact(F.array(
        F.when(~c("all_classes"), "class_missing"),
        F.when(~c("high_corner_ok"), "high_corner_never_high"),
        F.when(~apart, "weak_separation"),
        F.when(~c("trends_ok"), "trend_direction"),
        F.when(~c("interface_ok"), "interface"),
    ))
    return row.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)
