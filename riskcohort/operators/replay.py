"""Replaying the rule cascade over held-out people with laboratory values."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskcohort import constants as K
from riskcohort.functions.checks import one_per_key
from riskcohort.functions.recode import is_true, lab
from riskcohort.functions.rules import diagnostic_lab, prediabetic_lab
from riskcohort.operators.cohort import KEY, stacked


def labs_outer_join(ghb: DataFrame, glu: DataFrame) -> DataFrame:
    """Everybody with a row in either laboratory table; NaN values count as absent. A person with two rows in one table
    stops the job."""
    left, right = (one_per_key(df.select(*KEY, lab(F.col(c)).alias(c)), KEY, c) for df, c in ((ghb, "LBXGH"), (glu, "LBXGLU")))
    return left.join(right, KEY, "full_outer")


def one_to_one_violations(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Keys repeated on either side of a join that should be one-to-one."""
    from riskcohort.operators.cohort import duplicate_keys

    return (
        duplicate_keys(left, key).withColumn("side", F.lit("left"))
        .unionByName(duplicate_keys(right, key).withColumn("side", F.lit("right")))
    )


def with_labs(held_out: DataFrame, labs: DataFrame) -> DataFrame:
    """People with their laboratory values, if any; a key that repeats in ``labs`` stops the job."""
    return held_out.join(one_per_key(labs, KEY, "labs"), KEY, "left")


def replay_masks(df: DataFrame) -> DataFrame:
    """Boolean columns describing what the cascade would do and why."""
    h, g = lab(F.col("LBXGH")), lab(F.col("LBXGLU"))
    low_h, low_g = K.HBA1C_PREDIABETIC[0], K.GLUCOSE_PREDIABETIC[0]
    p_high, p_low = F.col("p_high"), F.col("p_low")
    present = h.isNotNull() | g.isNotNull()
    diagnostic = diagnostic_lab(h, g)
    rule2 = ~diagnostic & is_true(p_high >= K.HIGH_PROBABILITY) & present
    rule4 = (
        ~diagnostic & ~rule2 & ~prediabetic_lab(h, g) & is_true(p_high >= p_low) & present
    )
    normal_h = is_true((h > 0) & (h < low_h))
    normal_g = is_true((g > 0) & (g < low_g))
    evidence = is_true(
        F.col("age").between(*K.AGE_EVIDENCE) & F.col("bmi").between(*K.BMI_EVIDENCE)
        & (g >= K.GLUCOSE_EVIDENCE[0]) & (g < K.GLUCOSE_EVIDENCE[1])
    ) & ~diagnostic
    complete = F.lit(True)
    for name in K.PREDICTORS:
        complete = complete & F.col(name).isNotNull()
    return df.withColumns({
        "present": present,
        "rule2": rule2,
        "rule4": rule4,
        "both_normal": normal_h & normal_g,
        "available_normal": present & (h.isNull() | normal_h) & (g.isNull() | normal_g),
        "evidence": evidence,
        "complete": complete,
        "known_diabetes": is_true(F.col("diq010") == 1),
    })


def policy_replay(masked: DataFrame) -> DataFrame:
    """All counts of the replay in one aggregate, as ``(scope, measure, n)``."""
    c = F.col
    # The names of the measures.
    counts = {
        ("all", "held_out_rows"): F.lit(True),
        ("all", "both_normal"): c("both_normal"),
        ("all", "available_normal"): c("available_normal"),
        ("all", "evidence_population"): c("present") & c("evidence"),
        ("all", "no_labs"): ~c("present"),
    }
    for rule in ("rule2", "rule4"):
        m = c(rule)
        counts.update({
            (rule, "final_high"): m,
            (rule, "both_normal_high"): m & c("both_normal"),
            (rule, "available_normal_high"): m & c("available_normal"),
            (rule, "evidence_eligible"): m & c("evidence"),
            (rule, "complete_and_evidence"): m & c("evidence") & c("complete"),
            (rule, "known_diabetes_and_evidence"): m & c("evidence") & c("known_diabetes"),
            (rule, "both_normal_known_diabetes"): m & c("both_normal") & c("known_diabetes"),
        })
    row = masked.agg(*[F.count_if(m).alias(f"{s}.{n}") for (s, n), m in counts.items()])
    long = stacked(row, [], {f"{s}.{n}": F.col(f"`{s}.{n}`") for s, n in counts}, "key", "n")
    return long.select(
        F.split_part("key", F.lit("."), F.lit(1)).alias("scope"),
        F.split_part("key", F.lit("."), F.lit(2)).alias("measure"),
        "n",
    )


def prediction_equality(a: DataFrame, b: DataFrame, row_id: str = "id", tolerance: float = 1e-12) -> DataFrame:
    """Do two prediction sets hold the same people, labels and probabilities?

    Matched by id, never by row order.
    """
    c = F.col
    names = ("p_high", "p_low", "p_moderate")
    left = a.select(row_id, c("y_true").alias("ta"), *[c(p).alias(f"a_{p}") for p in names])
    right = b.select(row_id, c("y_true").alias("tb"), *[c(p).alias(f"b_{p}") for p in names])
    joined = left.join(right, row_id, "full_outer")
    gap = F.greatest(*[F.abs(c(f"a_{p}") - c(f"b_{p}")) for p in names])
    both = c("ta").isNotNull() & c("tb").isNotNull()
    return joined.agg(
        F.count_if(both).alias("n_matched"),
        F.count_if(~both).alias("n_unmatched"),
        F.count_if(both & (c("ta") != c("tb"))).alias("n_label_differs"),
        F.count_if(both & (gap > tolerance)).alias("n_probability_differs"),
        F.max(gap).alias("max_difference"),
    )
