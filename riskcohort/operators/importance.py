"""Permutation importance as one scoring pass over permuted copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskcohort import constants as K
from riskcohort.operators import metrics
from riskcohort.operators.scoring import Scorer
from riskcohort.operators.split import order_hash
from riskcohort.session import cut_lineage

PREFIX_DIGITS = 3


def _hash_rank(df: DataFrame, hashed: Column, name: str) -> DataFrame:
    """Dense 1..n rank in hash order, through per-prefix counts instead of one global sort."""
    out = df.withColumn("_h", hashed).withColumn("_prefix", F.substring("_h", 1, PREFIX_DIGITS))
    counts = cut_lineage(out.groupBy("_prefix").agg(F.count(F.lit(1)).alias("_n")))
    # At most 16^digits rows.
    before = W.orderBy("_prefix").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("_prefix", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy("_prefix").orderBy("_h", "id")
    ranked = out.withColumn("_r", F.row_number().over(inside)).join(F.broadcast(starts), "_prefix")
    return ranked.withColumn(name, F.col("_start") + F.col("_r")).drop("_h", "_prefix", "_start", "_r")


def permuted_copies(test: DataFrame, repeats: int = 5, seed: int = K.SEED) -> DataFrame:
    """Rows tagged ``(feature, repeat)`` where that feature's value comes from another row.

    Per repeat the rows get a second hash order; a row takes its values from the row with the
    same rank in that order. All eight features share the repeat's permutation, so the copies
    need one join per repeat and no join per feature.
    """
    stored = cut_lineage(test.select("id", "y_true", *K.PREDICTORS))
    base = cut_lineage(_hash_rank(stored, order_hash(F.col("id"), seed), "rank"))
    parts = None
    for repeat in range(repeats):
        shuffled = _hash_rank(stored, F.md5(F.concat(F.lit(f"{seed}|{repeat}|"), F.col("id").cast("string"))), "rank")
        donors = shuffled.select("rank", *[F.col(p).alias(f"_d_{p}") for p in K.PREDICTORS])
        part = base.join(donors, "rank").withColumn("repeat", F.lit(repeat))
        parts = part if parts is None else parts.unionByName(part)
    named = F.explode(F.array(*[F.lit(p) for p in K.PREDICTORS])).alias("feature")
    copies = parts.select("*", named)
    swapped = [
        F.when(F.col("feature") == p, F.col(f"_d_{p}")).otherwise(F.col(p)).alias(p) for p in K.PREDICTORS
    ]
    return copies.select("id", "y_true", "feature", "repeat", *swapped)


def permutation_importance(test: DataFrame, scorer: Scorer, repeats: int = 5, seed: int = K.SEED) -> DataFrame:
    """Mean and deviation of the macro-F1 drop per feature. ``test`` has ``id`` and ``y_true``."""
    keys = ("feature", "repeat")
    scored = scorer(permuted_copies(test, repeats, seed))
    permuted = metrics.macro_metrics(metrics.confusion(scored, keys), keys)
    whole = metrics.macro_metrics(metrics.confusion(scorer(test.select("id", "y_true", *K.PREDICTORS))))
    one = F.lit(1).alias("_one")
    drops = permuted.select("feature", F.col("macro_f1").alias("after"), one).join(
        F.broadcast(whole.select(F.col("macro_f1").alias("before"), one)), "_one"
    )
    drop = F.col("before") - F.col("after")
    return drops.groupBy("feature").agg(
        F.avg(drop).alias("importance_mean"), F.stddev_pop(drop).alias("importance_std")
    )


def top_predictors(importance: DataFrame, k: int = 4) -> DataFrame:
    return importance.orderBy(F.desc("importance_mean"), "feature").limit(k)
