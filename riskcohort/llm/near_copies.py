"""Groups of texts whose word shingles are alike: exact, by prefix filtering.

The shingles of every text are put in one order, rare ones first. Two sets of sizes n and m with similarity s or more share
at least ``s / (1 + s) * (n + m)`` shingles, so they share one among the first ``n - ceil(s * n) + 1`` of either. Texts meet
in buckets of these prefixes, and pairs are verified on the shingles of their texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from riskcohort.llm.common import batch, id_and_text, texts_as_bytes
from riskcohort.llm.components import connected
from riskcohort.session import cut_lineage

WORDS = 5
LIKENESS = 0.8
# Shingles that a sixteenth of the texts shows more than once go to the end of the order. The pick only moves work.
FREQUENT = 1 << 18
SAMPLED = 16
PAIRS = 1 << 18
# Sets of a range of sizes, the first by a hash so that buckets choose alike, that the others of a bucket are first compared
# with: what they link needs no pairs of its own.
CENTRES = 12
# Bits of the filter of wanted rows: sixteen a row up to 16 MB, beyond which it lets more rows through that are not wanted.
FILTER_BITS = 1 << 27
# A text's shingles counted by their leading seven bits. The counts of two texts differ by at most as many as the sets do.
BINS = 128
_SEED = 42
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_BUCKET = pa.schema([("bucket", pa.int64()), ("point", pa.int64()), ("size", pa.int32()), ("place", pa.int32())])
_BUCKET_DDL = "bucket long, point long, size int, place int"


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted different 64-bit hashes of the word shingles of a text.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. A text of fewer words than a
    shingle is one shingle; a text without words has none.
    """
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    hashed = np.fromiter((xxhash.xxh64_intdigest(w, _SEED) for w in found), np.uint64, len(found))
    k = min(words, len(found))
    out = np.full(len(found) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ (out >> np.uint64(31))) * _FACTOR + hashed[i:len(hashed) - k + 1 + i]
    return np.unique((out ^ (out >> np.uint64(29))) * _FACTOR)


def _point(found: np.ndarray) -> int:
    """A signed 64-bit hash of a set of shingles."""
    return xxhash.xxh64_intdigest(found.tobytes(), _SEED) - (1 << 63)


def _outline(found: np.ndarray) -> bytes:
    return np.minimum(np.bincount((found >> np.uint64(57)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes()


def _common(n: np.ndarray | int, m: np.ndarray | int, likeness: float) -> np.ndarray | int:
    """The fewest shingles that two sets of these sizes share if they are alike."""
    return np.ceil(likeness / (1 + likeness) * (n + m) - 1e-9)


def _frequent(texts: DataFrame, words: int) -> np.ndarray:
    """The most frequent shingles of a sample of texts, the rarest of them first; bounded by ``FREQUENT``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal sets of one task count once
        for b in batches:
            for t in texts_as_bytes(b.column("text")):
                found = shingles(t, words)
                if (p := _point(found)) not in seen:
                    seen.add(p)
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["shingle"])

    sample = texts.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0)
    counts = sample.mapInArrow(run, "shingle long").groupBy("shingle").count().filter("count > 1")
    top = counts.orderBy(F.desc("count"), "shingle").limit(FREQUENT).toPandas()
    return top["shingle"].to_numpy(np.int64).view(np.uint64)[::-1].copy()


def _prefixes(texts: DataFrame, words: int, likeness: float) -> DataFrame:
    """Rows ``bucket, point, size, place`` of the prefixes, only those of buckets with several points."""
    last = _frequent(texts, words)
    order = np.argsort(last)
    shipped = texts.sparkSession.sparkContext.broadcast((last[order], order + 1))  # at most FREQUENT shingles

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ranks = shipped.value
        seen: set[int] = set()  # a set that a task holds more than once is sent once
        for b in batches:
            held: list[tuple[np.ndarray, int, int]] = []
            for t in texts_as_bytes(b.column("text")):
                found = shingles(t, words)
                p, n = _point(found), len(found)
                if not n or p in seen:
                    continue
                seen.add(p)
                rank = np.zeros(n, np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    rank = np.where(known[at] == found, ranks[at], 0)
                first = np.argsort(rank, kind="stable")[:n - math.ceil(likeness * n - 1e-9) + 1]
                held.append((found[first], p, n))
            if held:
                sizes = [len(x) for x, _, _ in held]
                yield batch(_BUCKET, bucket=np.concatenate([x for x, _, _ in held]).view(np.int64),
                            point=np.repeat(np.array([p for _, p, _ in held], np.int64), sizes),
                            size=np.repeat(np.array([n for _, _, n in held], np.int32), sizes),
                            place=np.concatenate([np.arange(k, dtype=np.int32) for k in sizes]))

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, ["bucket", "point", "size", "place"]):
            new = np.r_[True, (run["bucket"][1:] != run["bucket"][:-1]) | (run["point"][1:] != run["point"][:-1])]
            run = {k: x[new] for k, x in run.items()}
            _, at, n = np.unique(run["bucket"], return_inverse=True, return_counts=True)
            yield batch(_BUCKET, **{k: x[n[at] > 1] for k, x in run.items()})

    spread = texts.mapInArrow(prefix, _BUCKET_DDL).repartition("bucket").sortWithinPartitions("bucket", "point")
    return spread.mapInArrow(several, _BUCKET_DDL)


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of rows sorted by bucket, cut where no bucket is parted."""
    held: list[dict[str, np.ndarray]] = []
    for b in batches:
        new = {k: b.column(k).to_numpy(zero_copy_only=False) for k in names}
        if not b.num_rows:
            continue
        held.append(new)
        if new["bucket"][0] == new["bucket"][-1]:
            continue
        cut = int(np.searchsorted(new["bucket"], new["bucket"][-1]))
        held[-1] = {k: x[:cut] for k, x in new.items()}
        yield {k: np.concatenate([x[k] for x in held]) for k in names}
        held = [{k: x[cut:] for k, x in new.items()}]
    if held:
        yield {k: np.concatenate([x[k] for x in held]) for k in names}


def _pairs(buckets: DataFrame, likeness: float) -> DataFrame:
    """``a, b``: pairs of points of different roots that meet in a bucket and can be alike.

    With ``root`` and ``outline`` all such pairs whose outlines allow it; without them only stars about CENTRES sets of each
    range of sizes, which leave few roots apart. A pair that is alike is made in the bucket of the first shingle it shares.
    """
    every = "root" in buckets.columns
    names = ["bucket", "point", "size", "place", *(["root", "outline"] if every else [])]

    def fits(r: dict[str, np.ndarray], i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
        n, m = r["size"][i].astype(np.int64), r["size"][j].astype(np.int64)
        share = np.minimum(n - r["place"][i], m - r["place"][j])
        return (np.minimum(n, m) >= likeness * np.maximum(n, m) - 1e-9) & (share >= _common(n, m, likeness))

    def made(r: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        edges = np.flatnonzero(np.diff(r["bucket"])) + 1
        for start, stop in zip([0, *edges.tolist()], [*edges.tolist(), len(r["bucket"])]):
            if not every:
                i = start
                while i < stop - 1:
                    end = start + int(np.searchsorted(r["size"][start:stop], r["size"][i] / likeness + 1e-9, "right"))
                    order = np.argsort(r["point"][i:end] * _FACTOR.view(np.int64), kind="stable")
                    for centre in (i + order[:CENTRES]).tolist():
                        j = np.arange(i, end)
                        j = j[fits(r, centre, j) & (j != centre)]
                        yield np.full(len(j), centre), j
                    i = max(end, i + 1)
            elif (r["root"][start:stop] != r["root"][start]).any():
                shown = np.frombuffer(b"".join(r["outline"][start:stop]), np.uint8).reshape(-1, BINS).astype(np.int16)
                for i in range(start, stop - 1):
                    end = start + int(np.searchsorted(r["size"][start:stop], r["size"][i] / likeness + 1e-9, "right"))
                    j = np.arange(i + 1, max(end, i + 1))
                    j = j[r["root"][j] != r["root"][i]]
                    j = j[fits(r, i, j)]
                    apart = np.abs(shown[j - start] - shown[i - start]).sum(axis=1)
                    both = r["size"][i] + r["size"][j].astype(np.int64)
                    j = j[apart <= both - 2 * _common(both, 0, likeness)]
                    yield np.full(len(j), i), j

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(x: list, y: list) -> pa.RecordBatch:
            both = np.unique(np.stack([np.concatenate(x), np.concatenate(y)], axis=1), axis=0)
            return batch(schema, a=both[:, 0].copy(), b=both[:, 1].copy())

        for r in _runs(batches, names):
            x, y, held = [], [], 0
            for i, j in made(r):
                if len(i):
                    x.append(np.minimum(r["point"][i], r["point"][j]))
                    y.append(np.maximum(r["point"][i], r["point"][j]))
                    held += len(i)
                if held >= PAIRS:
                    yield packed(x, y)
                    x, y, held = [], [], 0
            if x:
                yield packed(x, y)

    spread = buckets.select(*names).repartition("bucket").sortWithinPartitions("bucket", "size", "point")
    return spread.mapInArrow(run, "a long, b long").distinct()


def _alike(pairs: DataFrame, texts: DataFrame, words: int, likeness: float) -> DataFrame:
    """The pairs ``a, b`` whose texts (``point, text``) have the similarity."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, np.empty(0, np.uint64)
        for rows in batches:
            keep = []
            for a, s, t in zip(rows.column("a").to_pylist(), texts_as_bytes(rows.column("s")), texts_as_bytes(rows.column("t"))):
                if a != last:
                    last, x = a, shingles(s, words)
                y = shingles(t, words)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= likeness * (len(x) + len(y) - both) - 1e-9)
            at = np.flatnonzero(keep)
            yield batch(schema, a=rows.column("a").take(pa.array(at)), b=rows.column("b").take(pa.array(at)))

    # The side that many pairs may share comes last, where the adaptive planner can split it by bytes.
    with_t = pairs.join(texts.select(F.col("point").alias("b"), F.col("text").alias("t")), "b")
    both = with_t.join(texts.select(F.col("point").alias("a"), F.col("text").alias("s")), "a")
    return both.select("a", "b", "s", "t").mapInArrow(run, "a long, b long")


def _wanted(rows: DataFrame, keys: DataFrame, most: int = FILTER_BITS) -> DataFrame:
    """The rows whose ``doc_id, text_key`` is one of ``keys``, and a few others: thinned where they lie, by a bitmap."""
    bits = min(most, 1 << (4 + max(11, keys.count().bit_length())))
    spot = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(bits)) + 1  # bitmaps count from 1
    # At most ``most`` bits, in pieces of 4 KB.
    parts = keys.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits")).collect()
    held = np.zeros(max(bits // 8, 4096), np.uint8)
    for r in parts:
        held[4096 * (r["part"] - 1):4096 * r["part"]] = np.frombuffer(r["bits"], np.uint8)
    shipped = rows.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shipped.value
        for b in batches:
            at = b.column("spot").to_numpy() - 1
            keep = held[at >> 3] >> (at & 7) & 1
            yield b.filter(pa.array(keep.astype(bool))).select(["doc_id", "text_key", "text"])

    return rows.withColumn("spot", spot).mapInArrow(run, "doc_id long, text_key long, text string")


def _marks_of(words: int) -> Column:
    """``point`` and ``outline`` of a text."""
    @F.pandas_udf("point long, outline binary")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [(_point(x), _outline(x)) for x in (shingles(t.encode(), words) for t in texts)]
        return pd.DataFrame({"point": pd.Series([p for p, _ in found], dtype="int64"), "outline": [o for _, o in found]})

    return run("text")


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                    likeness: float = LIKENESS) -> DataFrame:
    """``doc_id, text_key, n``: one text of each group, and how many rows have this id and text.

    Two texts are linked if the Jaccard similarity of their sets of shingles is at least ``likeness``; groups are linked
    directly or over others. Texts without words are one group. The group's row has the smallest id (null comes last),
    then the smallest ``text_key``, the xxhash64 of the text (null as empty). An empty table gives an empty result.
    Sets, shingles and texts are compared by 64-bit hashes. All pairs that are alike are found.

    Runs jobs: keys, buckets, pairs and the rounds of the components are checkpointed.
    """
    rows = id_and_text(docs, id_col, text_col)
    marked = rows.select("doc_id", F.xxhash64("text").alias("text_key"), _marks_of(words).alias("marks"))
    keys = cut_lineage(marked.groupBy("doc_id", "text_key", "marks").agg(F.count("*").alias("n"))
                       .select("doc_id", "text_key", "marks.*", "n"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "n")
    points = keys.groupBy("point").agg(F.min(key).alias("first"))
    outlines = keys.select("point", "outline").distinct()
    buckets = cut_lineage(_prefixes(rows, words, likeness))

    def verified(pairs: DataFrame) -> DataFrame:
        met = pairs.select(F.explode(F.array("a", "b")).alias("point")).distinct()
        named = met.join(points, "point").select("point", F.col("first.doc_id").alias("d"), F.col("first.text_key").alias("k"))
        named = cut_lineage(named)
        some = _wanted(rows.withColumn("text_key", F.xxhash64("text")), named.select(F.col("d").alias("doc_id"), F.col("k").alias("text_key")))
        texts = (some.alias("r").join(named.alias("m"), F.col("r.doc_id").eqNullSafe(F.col("m.d")) & (F.col("r.text_key") == F.col("m.k")))
                 .select("point", "text"))
        once = texts.groupBy("point").agg(F.first("text").alias("text"))  # rows may repeat; equal by their key
        return cut_lineage(_alike(pairs, once, words, likeness))

    pairs = cut_lineage(_pairs(buckets, likeness))
    links = verified(pairs)
    parts = cut_lineage(connected(links.toDF("u", "v")))
    open_ = buckets.join(parts.withColumnsRenamed({"node": "point"}), "point", "left").withColumn(
        "root", F.coalesce("root", "point"))
    several = open_.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    open_ = open_.join(several.select("bucket"), "bucket", "left_semi").join(outlines, "point")
    rest = cut_lineage(_pairs(open_, likeness).join(pairs, ["a", "b"], "left_anti"))
    more = verified(rest)
    parts = connected(links.unionByName(more).toDF("u", "v"))
    grouped = (points.join(parts.withColumnsRenamed({"node": "point"}), "point", "left")
               .groupBy(F.coalesce("root", "point").alias("root")).agg(F.min("first").alias("first")))
    return grouped.select("first.doc_id", "first.text_key", "first.n")
