"""Censoring curve, horizon labels and inverse-probability-of-censoring weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskcohort import constants as K
from riskcohort.functions.checks import must
from riskcohort.operators import ordered


def horizon_labels(df: DataFrame, time: str = "time_years", event: str = "event",
                   horizon: float = K.HORIZON_YEARS) -> DataFrame:
    """Whether the status at the horizon is known, and the outcome where it is.

    Event-free exactly at the horizon is not known.
    """
    t, e = F.col(time), F.col(event)
    case = (e == 1) & (t <= horizon)
    known = case | (t > horizon)
    return df.withColumns({"known": known, "y": F.when(known, case.cast("int"))})


def censoring_curve(df: DataFrame, time: str = "time_years", event: str = "event",
                    rows_per_range: int = ordered.ROWS_PER_RANGE) -> DataFrame:
    """Product-limit survival of the censoring time: one row per distinct censor time.

    Rows collapse to distinct times before anything is ordered.
    """
    c = F.col
    per_time = df.groupBy(c(time).cast("double").alias("t")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(c(event) == 0).alias("censored")
    )
    risk = ordered.running(per_time, "t", {"n": c("n")}, rows_per_range=rows_per_range)
    steps = risk.filter("censored > 0").select(
        "t", "censored", (c("n_total") - c("n_before")).cast("long").alias("at_risk")
    )
    steps = steps.withColumn("_f", 1.0 - c("censored") / c("at_risk"))
    out = ordered.running(steps, "t", products={"s": c("_f")}, rows_per_range=rows_per_range)
    return out.select("t", "censored", "at_risk", (c("s_before") * c("_f")).alias("survival"))


def survival_at(df: DataFrame, at: str, curve: DataFrame) -> DataFrame:
    """Add ``survival`` just before each ``at``; NULL ``at`` gives NULL.

    The lookup has one row per distinct point, so a point shared by many rows costs one lookup;
    Spark broadcasts it when its measured size allows, and splits the hot side otherwise.
    """
    found = ordered.as_of(df.filter(F.col(at).isNotNull()), at, curve, "t", "survival", 1.0)
    return df.join(found, at, "left")


def ipcw_weights(cohort: DataFrame, horizon: float = K.HORIZON_YEARS, floor: float = K.SURVIVAL_FLOOR,
                 curve: DataFrame | None = None) -> DataFrame:
    """Evaluable rows with ``y`` and ``ipcw_weight``; the curve uses the whole eligible cohort.

    Pass ``curve`` to weight a part (a fold, say) by a curve estimated elsewhere. A row without a time from 0 on, or with
    another event than 0 or 1, stops the job that reads it.
    """
    time, event = F.col("time_years"), F.col("event")
    cohort = must(cohort, {"time": time.isNull() | F.isnan(time.cast("double")) | (time < 0), "event": event.isNull() | ~event.isin(0, 1)},
                  "follow-up cohort")
    labelled = horizon_labels(cohort, horizon=horizon)
    curve = censoring_curve(cohort) if curve is None else curve
    known = labelled.filter("known").drop("known")
    # Everybody without an event looks up the same point: once, instead of as one hot join key.
    cases = survival_at(known.filter("y = 1"), "time_years", curve)
    end = curve.filter(F.col("t") < horizon).agg(
        F.coalesce(F.max_by("survival", "t"), F.lit(1.0)).alias("survival"))
    rest = known.filter("y = 0").join(F.broadcast(end.withColumn("y", F.lit(0))), "y")  # one row
    return cases.unionByName(rest).withColumn(
        "ipcw_weight", 1.0 / F.greatest(F.col("survival"), F.lit(floor))
    ).drop("survival")
