"""Mixing sources to target weights by entropy balancing.

Every document is taken 0, 1 or 2 times. Base odds of 1:2:1 are tilted exponentially by the size of the
document, with one multiplier per source, such that the expected words of a source meet its target; the
multipliers solve the convex dual by Newton iterations over the table of sizes. Expected copies are then
rounded, passing the remainder on within blocks of a source.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskcohort.llm.common import batch, texts_as_bytes
from riskcohort.session import cut_lineage

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
BLOCK = 4096
# Sums are taken in integers of this resolution, so that they do not depend on the order of rows.
UNIT = 1 << 20


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float = MOST) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its source; the excess is shared anew."""
    out = [0.0] * len(sizes)
    open_ = [i for i in range(len(sizes)) if sizes[i] > 0]
    left = total
    while open_:
        weight = math.fsum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / weight >= most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def _word_counts(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``doc_id, text_key, source, size``; a null text has size 0."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("source", pa.string()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(schema, doc_id=b.column("doc_id"), text_key=b.column("text_key"), source=b.column("source"),
                        size=[len(t.split()) for t in texts_as_bytes(b.column("text"))])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, source string, size long")


def _copies(tilt, size: object) -> object:
    """Expected copies under odds 1 : 2 exp(z) : exp(2z), z = tilt * size: twice the logistic of z."""
    return 2 / (1 + F.exp(-F.least(F.lit(700.0), F.greatest(F.lit(-700.0), tilt * size))))


def balance(histogram: DataFrame, sources: list[dict], rounds: int = 60, tolerance: float = 1e-7) -> dict[int, float]:
    """Multiplier of each source (by ``source_id``) whose tilted sizes sum to ``target``, by Newton's method
    kept inside a bracket. ``histogram`` has ``source_id, size, n``.

    Sums over the histogram are distributed, and one row per source reaches the driver.
    """
    spark = histogram.sparkSession
    open_ = {s["source_id"]: s for s in sources if 0 < s["target"] < MOST * s["source_size"]}
    tilt = {k: 0.0 for k in open_}
    bracket: dict[int, list[float | None]] = {k: [None, None] for k in open_}
    waiting = set(open_)
    for _ in range(rounds):
        if not waiting:
            return tilt
        now = spark.createDataFrame([(k, tilt[k]) for k in sorted(waiting)], "source_id int, tilt double")
        copies = _copies(F.col("tilt"), F.col("size"))
        unit = lambda c: F.sum(F.round(c * UNIT).cast("decimal(38,0)"))
        sums = (histogram.join(F.broadcast(now), "source_id").withColumn("r", copies)  # one row per source
                .groupBy("source_id").agg(unit(F.col("n") * F.col("size") * F.col("r")).alias("taken"),
                                          unit(F.col("n") * F.col("size") * F.col("size") * F.col("r") * (2 - F.col("r")) / 2)
                                          .alias("slope")).collect())
        for row in sums:
            k = row["source_id"]
            gap = open_[k]["target"] - int(row["taken"]) / UNIT
            slope = int(row["slope"]) / UNIT
            low, high = bracket[k]
            bracket[k] = low, high = [tilt[k], high] if gap > 0 else [low, tilt[k]]
            if abs(gap) <= tolerance * open_[k]["target"]:
                waiting.discard(k)
                continue
            step = gap / slope if slope > 0 else math.copysign(math.inf, gap)
            new = tilt[k] + step
            if low is not None and high is not None and not low < new < high:
                new = (low + high) / 2
            elif not math.isfinite(new) or abs(step) > 4 * abs(tilt[k]) + 1 / max(1, open_[k]["source_size"]) ** 0.5:
                new = tilt[k] + math.copysign(max(abs(tilt[k]), 1e-6), gap)
            if new == tilt[k] or low is not None and high is not None and high - low <= 1e-15 * max(abs(low), abs(high)):
                waiting.discard(k)
            tilt[k] = new
    if waiting:
        raise RuntimeError(f"{len(waiting)} sources did not reach their targets in {rounds} rounds")
    return tilt


def _round_block(size: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Copies near the rates, largest document first; what rounding leaves over goes to the next document."""
    out = np.zeros(len(size), np.int64)
    over = 0.0
    for i, (s, r) in enumerate(zip(size.tolist(), rate.tolist())):
        if s:
            wanted = r * s + over
            out[i] = copies = min(MOST, max(0, round(wanted / s)))
            over = wanted - copies * s
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[float] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """``doc_id, text_key, source, size, source_size, target, rate, copies, taken``, one row per input row.

    Sizes are counts of words (a null text: 0). Sources in code point order, null last, get ``weights`` in
    turn and share ``share`` times all words; none gets more than twice its words. ``copies`` is 0, 1 or 2
    and ``taken`` is ``copies * size``; a document without words has rate and copies 1 (its source's share of
    words does not depend on it). Null ids and repeated rows are kept; equal rows of one block may get different
    copies. ``text_key`` is the xxhash64 of the text (null as empty). An empty table gives an empty result. The same table
    gives the same result.

    Runs jobs: sizes are checkpointed. The driver gets one row per source; sources name the parts of a
    mixture, so their number is taken to be small.
    """
    spark = docs.sparkSession
    sized = cut_lineage(_word_counts(docs, id_col, text_col, source_col))
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).collect()
    ordered = sorted(per_source, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    wanted = targets([r["source_size"] for r in ordered], [weights[i % len(weights)] for i in range(len(ordered))],
                     share * sum(r["source_size"] for r in ordered))
    sources = [{"source_id": i, "source": r["source"], "source_size": r["source_size"], "target": wanted[i],
                "blocks": max(1, r["n"] // BLOCK)} for i, r in enumerate(ordered)]
    schema = "source_id int, source string, source_size long, target double, blocks long"
    known = F.broadcast(spark.createDataFrame(sources, schema))  # one row per source
    rows = sized.join(known, sized["source"].eqNullSafe(known["source"])).drop(known["source"])
    histogram = cut_lineage(rows.filter("size > 0").groupBy("source_id", "size").agg(F.count("*").alias("n")))
    tilt = balance(histogram, sources)
    tilts = spark.createDataFrame([(s["source_id"], tilt.get(s["source_id"], math.inf if s["target"] > 0 else -math.inf))
                                   for s in sources], "source_id int, tilt double")
    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(_copies(F.col("tilt"), F.col("size")))
    rated = (rows.join(F.broadcast(tilts), "source_id").withColumn("rate", rate)
             .withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "doc_id", "size"), "blocks"))
             .select("doc_id", "text_key", "source", "size", "source_size", "target", "rate", "source_id", "block"))

    def settle(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["size", "doc_id", "text_key"], ascending=[False, True, True], kind="stable", na_position="last")
        copies = _round_block(block["size"].to_numpy(), block["rate"].to_numpy())
        copies[block["size"].to_numpy() == 0] = 1
        return block.drop(columns=["source_id", "block"]).assign(copies=copies, taken=copies * block["size"].to_numpy())

    return rated.groupBy("source_id", "block").applyInPandas(
        settle, "doc_id long, text_key long, source string, size long, source_size long, target double, rate double, copies long, taken long")
