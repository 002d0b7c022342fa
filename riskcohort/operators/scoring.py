"""Scorers. A scorer is any function DataFrame -> DataFrame that adds
``p_high, p_low, p_moderate, y_pred``; rules and metrics only rely on those names."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from riskcohort import constants as K

Scorer = Callable[[DataFrame], DataFrame]
PROBABILITIES = ("p_high", "p_low", "p_moderate")


def top_class(p_high: Column, p_low: Column, p_moderate: Column) -> Column:
    """Class with the largest probability; ties go to the first encoded class."""
    return (
        F.when((p_high >= p_low) & (p_high >= p_moderate), "High")
        .when(p_low >= p_moderate, "Low")
        .otherwise("Moderate")
    )


def require_features(df: DataFrame, features=K.PREDICTORS) -> None:
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"missing features: {missing}")


def model_features(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Exactly the eight predictors (plus named row ids). Labs and identity never pass."""
    require_features(df)
    return df.select(*keep, *K.PREDICTORS)


def linear_scorer(high: Mapping[str, float], low: Mapping[str, float],
                  prefix: str = "", digits: int = 6) -> Scorer:
    """Softmax of two linear scores against a zero third one; ``""`` keys the constant.

    A plain, published-coefficients model: missing predictors count as zero.
    """
    def line(weights: Mapping[str, float]) -> Column:
        total = F.lit(weights[""])
        for name, weight in weights.items():
            if name:
                total = total + F.lit(weight) * F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        return total

    def score(df: DataFrame) -> DataFrame:
        eh, el = f"_{prefix}eh", f"_{prefix}el"
        ph, pl, pm = (f"{prefix}{p}" for p in PROBABILITIES)
        total = F.col(eh) + F.col(el) + 1.0
        return (
            df.withColumns({eh: F.exp(line(high)), el: F.exp(line(low))})
            .withColumns({
                ph: F.round(F.col(eh) / total, digits),
                pl: F.round(F.col(el) / total, digits),
                pm: F.round(1.0 / total, digits),
            })
            .drop(eh, el)
            .withColumn(f"{prefix}y_pred", top_class(F.col(ph), F.col(pl), F.col(pm)))
        )

    return score


# A stand-in scorecard for queries and tests. It is not fitted to anything.
SCORECARD_HIGH = {
    "": -7.0, "age": 0.075, "bmi": 0.06, "family_history": 0.8, "hypertension": 0.6,
    "smoking_status": 0.15, "physical_activity": -0.2,
}
SCORECARD_LOW = {
    "": 3.2, "age": -0.05, "bmi": -0.03, "family_history": -0.4, "hypertension": -0.3,
    "smoking_status": -0.1, "physical_activity": 0.15,
}
REDUCED_HIGH = {k: v for k, v in SCORECARD_HIGH.items() if k in ("", "age", "bmi")}
REDUCED_LOW = {k: v for k, v in SCORECARD_LOW.items() if k in ("", "age", "bmi")}

scorecard: Scorer = linear_scorer(SCORECARD_HIGH, SCORECARD_LOW)


def reads_only_predictors(*weights: dict[str, float]) -> bool:
    """Whether linear weights name nothing but predictors (the empty name is the intercept)."""
    return {name for w in weights for name in w if name} <= set(K.PREDICTORS)


def reduced_scorecard(prefix: str = "old_") -> Scorer:
    return linear_scorer(REDUCED_HIGH, REDUCED_LOW, prefix)


def future_risk_score(age: Column, bmi: Column, fpg_mmoll: Column) -> Column:
    """Stand-in three-year risk, increasing in all three inputs."""
    return 1.0 / (1.0 + F.exp(-(-12.0 + 0.02 * age + 0.05 * bmi + 1.4 * fpg_mmoll)))


def scored_export(df: DataFrame, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """Held-out rows as written to disk: truth, prediction, one column per class."""
    return df.select(*keep, "y_true", "y_pred", *PROBABILITIES)
