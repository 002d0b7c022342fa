"""Profiles of a cohort: class balance, missing values, ranges, fill values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskcohort import constants as K
from riskcohort.functions import recode
from riskcohort.operators.cohort import stacked
from riskcohort.operators.quantiles import exact_quantiles


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def class_distribution(df: DataFrame, label: str = K.TARGET, keys: tuple[str, ...] = ()) -> DataFrame:
    """Count and share of every class in display order; absent classes are zero."""
    counted = df.groupBy(*keys).agg(
        F.count(F.col(label)).alias("_all"),
        *[F.count_if(F.col(label) == c).alias(f"_{c}") for c in K.CLASS_LABELS],
    )
    entries = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("label"), F.col(f"_{c}").alias("n"))
        for i, c in enumerate(K.CLASS_LABELS)
    ])
    rows = counted.select(*keys, "_all", F.explode(entries).alias("e"))
    return rows.select(
        *keys, "e.position", "e.label", "e.n", share(F.col("e.n"), F.col("_all")).alias("share")
    )


def missingness(df: DataFrame, columns=K.PREDICTORS, keys: tuple[str, ...] = ()) -> DataFrame:
    counted = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    rows = stacked(counted, [*keys, "_n"], {c: F.col(c) for c in columns}, "column", "n_missing")
    return rows.select(
        *keys, "column", "n_missing", share(F.col("n_missing"), F.col("_n")).alias("share")
    )


def missingness_before_after(cohort: DataFrame, columns=K.PREDICTORS) -> DataFrame:
    """Missing values of the whole cohort and of its labelled part, from one pass."""
    labelled = F.col(K.TARGET).isNotNull()
    aggs = [F.count(F.lit(1)).alias("n_before"), F.count_if(labelled).alias("n_after")]
    for c in columns:
        gone = F.col(c).isNull()
        aggs += [F.count_if(gone).alias(f"{c}_b"), F.count_if(gone & labelled).alias(f"{c}_a")]
    counted = cohort.agg(*aggs)
    entries = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"{c}_b").alias("b"), F.col(f"{c}_a").alias("a"))
        for c in columns
    ])
    rows = counted.select("n_before", "n_after", F.explode(entries).alias("e"))
    return rows.select(
        "e.column",
        F.col("e.b").alias("missing_before"), share(F.col("e.b"), F.col("n_before")).alias("share_before"),
        F.col("e.a").alias("missing_after"), share(F.col("e.a"), F.col("n_after")).alias("share_after"),
    )


def lab_availability(cohort: DataFrame) -> DataFrame:
    h, g = F.col("has_hba1c"), F.col("has_glucose")
    masks = {"hba1c": h, "glucose": g, "both": h & g, "neither": ~h & ~g}
    counted = cohort.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(m).alias(n) for n, m in masks.items()]
    )
    rows = stacked(counted, ["_n"], {n: F.col(n) for n in masks}, "labs", "n")
    return rows.select("labs", "n", share(F.col("n"), F.col("_n")).alias("share"))


def cycle_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("cycle").agg(F.count(F.lit(1)).alias("n"))


def numeric_summary(df: DataFrame, columns) -> DataFrame:
    aggs = []
    for c in columns:
        aggs += [F.min(c).cast("double").alias(f"{c}_lo"), F.max(c).cast("double").alias(f"{c}_hi"),
                 F.avg(c).alias(f"{c}_mean"), F.count(c).alias(f"{c}_n")]
    entries = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"{c}_n").alias("n"), F.col(f"{c}_lo").alias("min"),
                 F.col(f"{c}_hi").alias("max"), F.col(f"{c}_mean").alias("mean"))
        for c in columns
    ])
    return df.agg(*aggs).select(F.explode(entries).alias("e")).select("e.*")


def category_shares(df: DataFrame) -> DataFrame:
    """Counts of the labelled categories, several variables in one shuffle."""
    def entry(name: str, code: Column, label: Column) -> Column:
        return F.struct(F.lit(name).alias("variable"), code.cast("int").alias("code"), label.alias("label"))

    c = F.col
    entries = F.array(
        entry("race_ethnicity", c("race_ethnicity"), recode.race_label(c("race_ethnicity"))),
        entry("family_history", c("family_history"), recode.yes_no_label(c("family_history"))),
        entry("hypertension", c("hypertension"), recode.yes_no_label(c("hypertension"))),
        entry("sex", c("sex"), recode.label_of(c("sex"), K.SEX_LABELS, F.lit("Unknown"))),
        entry("physical_activity", c("physical_activity"),
              recode.label_of(c("physical_activity"), K.ACTIVITY_LABELS, F.lit("Unknown"))),
        entry("smoking_status", c("smoking_status"),
              recode.label_of(c("smoking_status"), K.SMOKING_LABELS, F.lit("Unknown"))),
    )
    # Each row lists every variable once, so the rows of one variable are the rows of the table.
    counts = (
        df.select(F.explode(entries).alias("e")).groupBy("e.variable", "e.code", "e.label")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.groupBy("variable").agg(F.sum("n").alias("_n"))
    return counts.join(totals, "variable").select(
        "variable", "code", "label", "n", share(F.col("n"), F.col("_n")).alias("share")
    )


def prevalence(df: DataFrame, outcome: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(outcome).alias("prevalence"))


def evidence_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """Observed range and central 1-99%, exact; one row per column."""
    found = exact_quantiles(df, columns, [0.0, 0.01, 0.99, 1.0])
    rows = [(c, q[0.0], q[1.0], q[0.01], q[0.99]) for c, q in found.items()]
    return df.sparkSession.createDataFrame(rows, "column string, min double, max double, q01 double, q99 double")


def fill_values(train: DataFrame) -> DataFrame:
    """Median or most frequent value per predictor, with the share that will be filled."""
    medians = exact_quantiles(train, list(K.NUMERIC_PREDICTORS), [0.5])
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in K.PREDICTORS:
        # The mode keeps a count per code of the column.
        value = F.lit(medians[c][0.5]) if c in K.NUMERIC_PREDICTORS else F.mode(c, True)
        aggs += [value.cast("double").alias(f"{c}_fill"), F.count_if(F.col(c).isNull()).alias(f"{c}_gone")]
    entries = F.array(*[
        F.struct(F.lit(c).alias("column"),
                 F.lit("median" if c in K.NUMERIC_PREDICTORS else "mode").alias("method"),
                 F.col(f"{c}_fill").alias("fill"), F.col(f"{c}_gone").alias("n_missing"))
        for c in K.PREDICTORS
    ])
    rows = train.agg(*aggs).select("_n", F.explode(entries).alias("e"))
    return rows.select("e.*", share(F.col("e.n_missing"), F.col("_n")).alias("share"))


def construction_report(cohort: DataFrame) -> DataFrame:
    """Section / item / n / share: the whole construction report as one table.

    One pass: everything is counted by cycle, and every section is read off that table of a few rows.
    """
    labelled, h, g = F.col(K.TARGET).isNotNull(), F.col("has_hba1c"), F.col("has_glucose")
    masks = {
        **{f"classes.{c}": F.col(K.TARGET) == c for c in K.CLASS_LABELS},
        "labs.hba1c": h, "labs.glucose": g, "labs.both": h & g, "labs.neither": ~h & ~g,
        **{f"missing_before.{c}": F.col(c).isNull() for c in K.PREDICTORS},
        **{f"missing_after.{c}": F.col(c).isNull() & labelled for c in K.PREDICTORS},
    }
    by_cycle = cohort.groupBy("cycle").agg(
        F.count(F.lit(1)).alias("all"), F.count_if(labelled).alias("labelled"),
        *[F.count_if(mask).alias(name) for name, mask in masks.items()],
    )
    total = by_cycle.agg(
        F.collect_list(F.struct("cycle", "labelled")).alias("cycles"),  # one per cycle
        *[F.coalesce(F.sum(f"`{n}`"), F.lit(0)).alias(n) for n in ("all", "labelled", *masks)],
    )
    whole = {"classes": "labelled", "labs": "all", "missing_before": "all", "missing_after": "labelled"}

    def entry(section: str, item: Column, n: Column, part: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), item.alias("item"), n.alias("n"), part.alias("share"))

    counted = []
    for name in masks:
        section, item = name.split(".")
        n = F.col(f"`{name}`")
        counted.append(entry(section, F.lit(item), n, share(n, F.col(whole[section]))))
    cycles = F.transform(
        F.filter("cycles", lambda c: c["labelled"] > 0),
        lambda c: entry("cycles", c["cycle"], c["labelled"], F.lit(None).cast("double")),
    )
    return total.select(F.explode(F.concat(F.array(*counted), cycles)).alias("e")).select("e.*")
