"""Running totals and as-of lookups over a global order, without a one-task window.

Rows are dealt out by ranges of the order, each range is totalled, the few range totals are accumulated, and a window
inside each range adds the rest. Results are exact: the ranges only decide where the cuts fall. Callers aggregate to
distinct order values first, so one value held by a third of all rows is a single row here and ranges stay even.

Inputs are read several times (size, totals, window), so their lineage is cut first: the work above is done once and
survives lost executors. A table of up to ``ROWS_PER_RANGE`` rows is one range.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskcohort.session import cut_lineage

ROWS_PER_RANGE = 1 << 17


def with_range(df: DataFrame, order: str, rows_per_range: int = ROWS_PER_RANGE) -> tuple[DataFrame, int]:
    """``df`` (stored) with the number of the range of ``order``, and how many ranges there are at most.

    Several ranges are stored again with their numbers: where the cuts fall may differ from one run to the next.
    """
    ranges = max(1, -(-df.count() // rows_per_range))
    if ranges == 1:
        return df.withColumn("_range", F.lit(0)), 1
    return cut_lineage(df.repartitionByRange(ranges, order).withColumn("_range", F.spark_partition_id())), ranges


def _before(keys: list, order: str) -> W:
    return W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)


def _onwards(keys: list, order: str, start: int) -> W:
    return W.partitionBy(*keys).orderBy(order).rowsBetween(start, W.unboundedFollowing)


def running(df: DataFrame, order: str, sums: Mapping[str, Column] | None = None,
            products: Mapping[str, Column] | None = None, keys: tuple[str, ...] = (),
            rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Add, per name, ``<name>_before`` (strictly earlier rows) and ``<name>_total`` (all rows), and for sums ``<name>_from``
    (the row and all later ones, added up from the end: no difference of large numbers).

    ``order`` must be unique within ``keys``. ``keys`` name a bounded set of groups: the range
    totals (groups x ranges rows) are the only thing accumulated in one place.
    """
    sums, products = dict(sums or {}), dict(products or {})
    values = {**sums, **products}
    start = {n: F.lit(0.0) if n in sums else F.lit(1.0) for n in values}
    total = {n: F.sum if n in sums else F.product for n in values}

    def combine(n: str, a: Column, b: Column) -> Column:
        return a + b if n in sums else a * b

    stored = cut_lineage(df.withColumns({f"_v_{n}": v.cast("double") for n, v in values.items()}))
    ranged, ranges = with_range(stored, order, rows_per_range)
    group = [*keys, "_range"]
    if ranges == 1:
        whole = W.partitionBy(*keys)
        out = ranged
        for n in values:
            before = F.coalesce(total[n](f"_v_{n}").over(_before(list(keys), order)), start[n])
            out = out.withColumns({f"{n}_before": before, f"{n}_total": total[n](f"_v_{n}").over(whole)})
        out = out.withColumns({f"{n}_from": F.sum(f"_v_{n}").over(_onwards(list(keys), order, 0)) for n in sums})
        return out.drop("_range", *[f"_v_{n}" for n in values])
    per_range = ranged.groupBy(*group).agg(*[total[n](f"_v_{n}").alias(f"_t_{n}") for n in values])
    earlier, every = _before(list(keys), "_range"), W.partitionBy(*keys)
    offsets = per_range.select(
        *group,
        *[F.coalesce(total[n](f"_t_{n}").over(earlier), start[n]).alias(f"_o_{n}") for n in values],
        *[total[n](f"_t_{n}").over(every).alias(f"{n}_total") for n in values],
        *[F.coalesce(F.sum(f"_t_{n}").over(_onwards(list(keys), "_range", 1)), F.lit(0.0)).alias(f"_l_{n}") for n in sums],
    )
    inside = _before(group, order)
    out = ranged.join(offsets, group)
    out = out.withColumns({
        f"{n}_before": combine(
            n, F.col(f"_o_{n}"), F.coalesce(total[n](f"_v_{n}").over(inside), start[n])
        )
        for n in values
    } | {f"{n}_from": F.col(f"_l_{n}") + F.sum(f"_v_{n}").over(_onwards(group, order, 0)) for n in sums})
    return out.drop("_range", *[f"_{p}_{n}" for n in values for p in ("v", "o", "l")])


def as_of(queries: DataFrame, at: str, steps: DataFrame, step_at: str, value: str,
          default: float, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Value of the last step strictly before each distinct query point, else ``default``.

    Returns ``(at, value)`` with one row per distinct query point.
    """
    points = queries.select(F.col(at).cast("double").alias("_p")).distinct()
    merged = (
        steps.select(F.col(step_at).cast("double").alias("_p"), F.lit(1).alias("_step"),
                     F.col(value).cast("double").alias("_s"))
        .unionByName(points.select("_p", F.lit(0).alias("_step"), F.lit(None).cast("double").alias("_s")))
    )
    ranged, ranges = with_range(cut_lineage(merged), "_p", rows_per_range)
    # At equal points the query sorts first, so that only earlier steps are seen.
    inside = W.partitionBy("_range").orderBy("_p", "_step").rowsBetween(W.unboundedPreceding, W.currentRow)
    if ranges == 1:
        found = ranged.withColumn("_s", F.last("_s", ignorenulls=True).over(inside)).filter("_step = 0")
        return found.select(F.col("_p").alias(at), F.coalesce("_s", F.lit(default)).alias(value))
    carried = ranged.groupBy("_range").agg(F.max_by("_s", F.when(F.col("_step") == 1, F.col("_p"))).alias("_last"))
    offsets = carried.select(
        "_range", F.last("_last", ignorenulls=True).over(_before([], "_range")).alias("_carry")
    )
    found = (
        ranged.withColumn("_s", F.last("_s", ignorenulls=True).over(inside))
        .join(offsets, "_range").filter("_step = 0")
    )
    return found.select(
        F.col("_p").alias(at), F.coalesce("_s", "_carry", F.lit(default)).alias(value)
    )
