"""Seeded stratified splits of exact size, cut from a hash order.

Rows are ordered inside each label by ``md5(seed|id)``. A cut after rank ``k`` needs only the
k-th smallest hash: a histogram over hash prefixes finds the prefix it lies in, and just the
rows of that prefix are ranked. The split itself is then a comparison per row, so no label,
however large, is sorted or moved.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskcohort import constants as K
from riskcohort.session import cut_lineage

PREFIX_DIGITS = 4


def order_hash(row_id: Column, seed: int = K.SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), row_id.cast("string")))


def _cut_points(hashed: DataFrame, cuts: Callable[[DataFrame], DataFrame], label: str, digits: int) -> DataFrame:
    """``(label, cut, hash, id)`` of the last row at or before each requested rank.

    ``cuts`` maps ``(label, n)`` totals to ``(label, cut, rank)``; rank 0 has no last row.
    """
    prefix = F.substring("_hash", 1, digits)
    # Small and read three times: stored, so that the rows are scanned for it once.
    histogram = cut_lineage(
        hashed.groupBy(label, prefix.alias("_prefix")).agg(F.count(F.lit(1)).alias("_n"))
    )
    wanted = cuts(histogram.groupBy(label).agg(F.sum("_n").alias("n"))).filter("rank > 0")
    # At most 16^digits rows per label: fixed, whatever the table size.
    up_to = W.partitionBy(label).orderBy("_prefix").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = histogram.withColumn("_end", F.sum("_n").over(up_to))
    located = (
        ranked.join(F.broadcast(wanted), label)
        .filter((F.col("rank") <= F.col("_end")) & (F.col("rank") > F.col("_end") - F.col("_n")))
        .select(label, "cut", "_prefix", (F.col("rank") - F.col("_end") + F.col("_n")).alias("_k"))
    )
    # One prefix per label and cut: a handful of rows, safe to broadcast.
    inside = W.partitionBy(label, "cut").orderBy("_hash", "_id")
    return (
        hashed.withColumn("_prefix", prefix)
        .join(F.broadcast(located), [label, "_prefix"])
        .withColumn("_rank", F.row_number().over(inside))
        .filter("_rank = _k")
        .select(label, "cut", F.col("_hash").alias("_cut_hash"), F.col("_id").alias("_cut_id"))
    )


def _assign(df: DataFrame, label: str, row_id: str, seed: int, cuts, digits: int) -> DataFrame:
    """Add ``_passed``: how many cut points lie strictly before the row."""
    columns = df.columns
    hashed = df.withColumns({"_hash": order_hash(F.col(row_id), seed), "_id": F.col(row_id)})
    points = _cut_points(hashed.select(label, "_hash", "_id"), cuts, label, digits)
    # labels x cuts entries, gathered per label.
    listed = points.groupBy(label).agg(
        F.collect_list(F.struct("_cut_hash", "_cut_id")).alias("_points")
    )
    after = F.filter(
        "_points",
        lambda p: (p["_cut_hash"] < F.col("_hash"))
        | ((p["_cut_hash"] == F.col("_hash")) & (p["_cut_id"] < F.col("_id"))),
    )
    joined = hashed.join(F.broadcast(listed), label, "left")
    return joined.select(*columns, F.when(F.col("_points").isNull(), 0).otherwise(F.size(after)).alias("_passed"),
                         F.col("_points").isNull().alias("_no_cut"))


def holdout_quotas(totals: DataFrame, label: str, share: float = K.TEST_SHARE) -> DataFrame:
    """Test rows per label: the exact total, dealt out by largest remainder.

    ``totals`` has one row per class.
    """
    everything, by_label = W.partitionBy(F.lit(1)), W.partitionBy(F.lit(1))
    n_all = F.sum("n").over(everything)
    # A decimal product keeps ceil exact where a double could land just above a whole number.
    target = F.ceil(n_all.cast("decimal(20,0)") * F.lit(share).cast("decimal(6,4)"))
    exact = F.col("_target") * F.col("n") / F.col("_all")
    sized = totals.withColumns({"_all": n_all, "_target": target.cast("double")})
    sized = sized.withColumn("_base", F.floor(exact)).withColumn("_rest", exact - F.col("_base"))
    missing = (F.col("_target") - F.sum("_base").over(everything)).cast("int")
    place = F.row_number().over(by_label.orderBy(F.desc("_rest"), label))
    return sized.select(
        label, "n", (F.col("_base") + F.when(place <= missing, 1).otherwise(0)).cast("long").alias("quota")
    )


def stratified_holdout(df: DataFrame, label: str = K.TARGET, row_id: str = "SEQN", seed: int = K.SEED,
                       share: float = K.TEST_SHARE, digits: int = PREFIX_DIGITS) -> DataFrame:
    """Add ``is_test``: the first quota rows of each label in hash order."""
    def cuts(totals: DataFrame) -> DataFrame:
        return holdout_quotas(totals, label, share).select(label, F.lit(0).alias("cut"), F.col("quota").alias("rank"))

    out = _assign(df, label, row_id, seed, cuts, digits)
    return out.withColumn("is_test", (F.col("_passed") == 0) & ~F.col("_no_cut")).drop("_passed", "_no_cut")


def fold_assignment(df: DataFrame, label: str = K.TARGET, row_id: str = "SEQN", seed: int = K.SEED,
                    folds: int = K.FOLDS, digits: int = PREFIX_DIGITS) -> DataFrame:
    """Add ``fold``: ``folds`` consecutive stretches of each label's hash order.

    Stretch sizes of a label differ by at most one, larger ones first.
    """
    def cuts(totals: DataFrame) -> DataFrame:
        whole, rest = F.floor(F.col("n") / folds), F.col("n") % folds
        entries = F.array(*[
            F.struct(F.lit(i).alias("cut"), (whole * i + F.least(rest, F.lit(i))).cast("long").alias("rank"))
            for i in range(1, folds)
        ])
        return totals.select(label, F.explode(entries).alias("e")).select(label, "e.cut", "e.rank")

    out = _assign(df, label, row_id, seed, cuts, digits)
    return out.withColumn("fold", F.col("_passed").cast("int")).drop("_passed", "_no_cut")
