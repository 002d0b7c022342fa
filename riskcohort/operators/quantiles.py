"""Exact quantiles by distributed selection: no task ever holds a column, or its distinct values.

The values that stand at the wanted ranks are enclosed in intervals. A pass counts the values of every interval in bins and
keeps the bin that holds the rank, with the smallest and the largest value that occur in it; it ends where they are one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

BINS = 1024


@dataclass
class _Place:
    """Where the value of a rank lies: between ``low`` and ``high``, with ``below`` values before the interval."""

    low: float
    high: float
    below: int = 0


def exact_quantiles(df: DataFrame, columns: list[str], marks: list[float]) -> dict[str, dict[float, float | None]]:
    """Per column and mark (0 to 1) the quantile, interpolated between the two values it falls between.

    Nulls and NaN do not count; a column without values gives None. Runs one pass for counts and limits and a few more,
    each an aggregate with BINS rows per interval; all columns and marks share the passes.
    """
    value = {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in columns}
    row = df.agg(*[f(value[c]).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    places: dict[tuple[str, int], _Place] = {}
    sizes = {c: row[f"n_{i}"] for i, c in enumerate(columns)}
    for i, c in enumerate(columns):
        for mark in marks:
            for rank in {math.floor(mark * (sizes[c] - 1)), math.ceil(mark * (sizes[c] - 1))} if sizes[c] else ():
                places[c, rank] = _Place(row[f"lo_{i}"], row[f"hi_{i}"])
    while going := {k: p for k, p in places.items() if p.low < p.high}:
        intervals = sorted({(c, p.low, p.high) for (c, _), p in going.items()})
        entries = []
        for i, (c, low, high) in enumerate(intervals):
            # Halves, so that the width of an interval cannot overflow.
            at = F.floor((value[c] / 2 - low / 2) / (high / 2 - low / 2) * BINS)
            entries.append(F.when(value[c].between(low, high), F.struct(
                F.lit(i).alias("i"), F.least(at, F.lit(BINS - 1)).cast("int").alias("bin"), value[c].alias("x"))))
        inside = df.select(F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e")).select("e.*")
        bins = inside.groupBy("i", "bin").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        counted: dict[int, list] = {}
        for r in sorted(bins.collect(), key=lambda r: (r.i, r.bin)):  # BINS rows an interval
            counted.setdefault(r.i, []).append(r)
        for (c, rank), p in going.items():
            below = p.below
            for r in counted[intervals.index((c, p.low, p.high))]:
                if rank < below + r.n:
                    places[c, rank] = _Place(r.low, r.high, below)
                    break
                below += r.n

    def between(c: str, mark: float) -> float | None:
        if not sizes[c]:
            return None
        at = mark * (sizes[c] - 1)
        low, high = places[c, math.floor(at)].low, places[c, math.ceil(at)].low
        return low + (high - low) * (at - math.floor(at))

    return {c: {m: between(c, m) for m in marks} for c in columns}
