"""Packing of token sequences into windows.

The histogram of document lengths is packed, not the documents: combinations of a few lengths that fill a
window are enumerated, non-negative least squares gives their repeat counts, the counts are rounded and
what remains is packed greedily, longest first, cutting where a window is full. Documents then find their
places from their rank within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from riskcohort.llm.common import batch, id_and_text, shuffle_partitions
from riskcohort.llm.token_counts import WordEncoder
from riskcohort.session import cut_lineage

WINDOW = 4096
NO_ID = -(1 << 63)
# Pieces of cut documents up to which they are broadcast, 72 bytes each.
CUT_ROWS = 1 << 16


class WordIds:
    """Token ids (little-endian unsigned 32 bits) of texts. Of more than ``bound`` words and of their pre-tokens, those not
    used again are forgotten first."""

    def __init__(self, path: str, bound: int = 500_000) -> None:
        self.encoder, self.bound, self.known, self.older = WordEncoder(path), bound, {}, {}

    def of(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text: white space is dropped by the tokenizer, so words can be looked up one by one. Arrow cuts the
        texts, finds the different words of a group of texts and lays their ids side by side."""
        for group in _groups(texts):
            words = pc.ascii_split_whitespace(group)
            coded = words.flatten().dictionary_encode()
            ids = pa.array(self._ids(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
            ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, ids.offset * 8)
            data = memoryview(ids.buffers()[2] or b"")
            at = ends[words.offsets.to_numpy() - words.offsets[0].as_py()].tolist()
            for start, stop in zip(at, at[1:]):
                yield bytes(data[start:stop])

    def _ids(self, words: list[str]) -> list[bytes]:
        if len(self.known) > self.bound:
            self.older, self.known = self.known, {}
        new = [w for w in words if w not in self.known]
        if self.older:
            again = [w for w in new if w in self.older]
            self.known.update(zip(again, map(self.older.__getitem__, again)))
            new = [w for w in new if w not in self.known]
        for start in range(0, len(new), 20_000):
            some = new[start:start + 20_000]
            self.known.update(zip(some, self.encoder.packed(some)))
        return [self.known[w] for w in words]


def _groups(texts: pa.Array, size: int = 1 << 22) -> Iterator[pa.Array]:
    """Slices of about ``size`` bytes of texts, to bound what a look-up holds at once."""
    texts = pc.fill_null(texts, "")
    number = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // size
    edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(texts)]
    for start, stop in zip(edges, edges[1:]):
        if stop > start:
            yield texts.slice(start, stop - start)


# ---- the plan, over a histogram of at most ``window`` - 1 lengths ----


Combination = dict[int, int]  # times of each length


def combinations_of(counts: np.ndarray, window: int, repeats: int = 8, fullest: int = 3) -> list[Combination]:
    """Combinations of at most three present lengths that fill a window.

    A length comes alone (a power of two needs no padding either), or up to ``repeats`` times with what is
    then missing: one present length, or the ``fullest`` pairs of present lengths that add up to it.
    """
    present = np.flatnonzero(counts)
    have = counts > 0
    found: dict[tuple, Combination] = {}

    def add(*lengths: tuple[int, int]) -> None:
        combo: Combination = {}
        for a, m in lengths:
            combo[int(a)] = combo.get(int(a), 0) + int(m)
        found[tuple(sorted(combo.items()))] = combo

    for a in present.tolist():
        if a & (a - 1) == 0:
            add((a, 1))
        most = window // a
        for m in sorted({*range(1, min(most, repeats) + 1), most}):
            missing = window - m * a
            if missing == 0:
                add((a, m))
                continue
            if have[missing]:
                add((a, m), (missing, 1))
            b = present[(present >= (missing + 1) // 2) & (present < missing)]
            b = b[have[missing - b]]
            for c in b[np.argsort(-np.minimum(counts[b], counts[missing - b]), kind="stable")[:fullest]].tolist():
                add((a, m), (c, 1), (missing - c, 1))
    return [found[k] for k in sorted(found)]


def repeat_counts(combos: list[Combination], counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares of combination repeats against the histogram, by accelerated projected
    gradient on the sparse matrix of (combination, length) multiplicities."""
    if not combos:
        return np.zeros(0)
    rows = np.array([a for c in combos for a in c])
    times = np.array([m for c in combos for m in c.values()], float)
    columns = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    # Lengths are weighted by the size of their bins, so that rare ones count too; columns have unit norm.
    weight = 1 / np.sqrt(np.maximum(counts, 1))
    value = weight[rows] * times
    norm = np.sqrt(np.bincount(columns, value * value, len(combos)))
    value /= norm[columns]
    b = counts * weight
    apply = lambda x: np.bincount(rows, value * x[columns], len(counts))
    back = lambda r: np.bincount(columns, value * r[rows], len(combos))
    v = np.ones(len(combos))
    for _ in range(30):
        v = back(apply(v))
        v /= np.linalg.norm(v) or 1
    step = 1 / (1.1 * np.linalg.norm(back(apply(v))) + 1e-12)
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        z = np.maximum(0, y - step * back(apply(y) - b))
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        x, y = z, z + (last - 1) / t * (z - x)
    return x / norm


def plan(counts: np.ndarray, window: int = WINDOW) -> tuple[dict[str, np.ndarray], np.ndarray, int]:
    """Slots and residuals for a histogram of lengths.

    Returns arrays of slots ordered by (length, rank): from rank ``start`` on, ``repeats`` times ``per``
    documents of ``length`` go to sequences ``base``, ``base`` + 1, ... at offset ``offset``, + length, ...; the rank
    from which a length is residual; and the number of sequences used.
    """
    combos = combinations_of(counts, window)
    x = repeat_counts(combos, counts)
    down = np.floor(x + 1e-6).astype(np.int64)
    left = counts.astype(np.int64).copy()
    slots, base = [], 0
    # Rounded down first; then one more of each, by the part cut off; then as many as the lengths left allow.
    by_count, by_rest = np.argsort(-down, kind="stable"), np.argsort(down - x, kind="stable")
    for order, limit in ((by_count, down), (by_rest, np.ones_like(down)), (by_rest, np.full_like(down, counts.sum()))):
        for k, most in zip(order.tolist(), limit[order].tolist()):
            parts = combos[k]
            n = min([most, *(int(left[a]) // m for a, m in parts.items())])
            if n <= 0:
                continue
            at = 0
            for a, m in parts.items():
                slots.append((a, int(counts[a] - left[a]), n, m, base, at))
                left[a] -= n * m
                at += a * m
            base += n
    slots.sort()
    names = ("length", "start", "repeats", "per", "base", "offset")
    arrays = {n: np.array([s[i] for s in slots], np.int64) for i, n in enumerate(names)}
    return arrays, counts - left, base


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = WINDOW, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``: every piece of every document.

    A document is its tokens and ``end_id``; a null or empty text is ``end_id`` alone. Whole windows are cut
    off first, the remainders are packed by the plan above, and only residual documents are cut again. Every
    sequence but the last one is full or has a power of two of tokens. Rows that repeat with id and text, and
    null ids, are packed like others. An empty table gives an empty result.

    Runs jobs: lengths are checkpointed; the driver gets the histogram of at most ``window`` lengths.
    Residual documents that are cut are tokenized a second time, where they are.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col).select(
        "doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("id_key"), F.xxhash64("text").alias("text_key"), "text")
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("id_key", pa.int64()), ("text_key", pa.int64()), ("tokens", pa.int64()),
                        ("crcs", pa.list_(pa.int64()))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds(tokenizer_path)
        for b in batches:
            tokens, crcs = [], []
            for found in ids.of(b.column("text")):
                found += end
                tokens.append(len(found) // 4)
                crcs.append([zlib.crc32(found[i:i + 4 * window]) for i in range(0, len(found), 4 * window)])
            yield batch(schema, doc_id=b.column("doc_id"), id_key=b.column("id_key"), text_key=b.column("text_key"),
                        tokens=tokens, crcs=crcs)

    # The bucket splits a length that very many documents share.
    buckets = max(64, shuffle_partitions(spark))
    sized = cut_lineage(rows.mapInArrow(measure, "doc_id long, id_key long, text_key long, tokens long, crcs array<bigint>")
                        .withColumn("rest", (F.col("tokens") % window).cast("int"))
                        .withColumn("whole", F.floor(F.col("tokens") / window).cast("long"))
                        .withColumn("bucket", F.pmod(F.xxhash64("id_key", "text_key"), F.lit(buckets)).cast("int")))

    by_bucket = sized.groupBy("rest", "bucket").agg(F.count("*").alias("n"), F.sum("whole").alias("whole"))
    totals = by_bucket.groupBy("rest").agg(F.sum("n").alias("n")).collect()  # at most ``window`` rows
    counts = np.zeros(window, np.int64)
    for r in totals:
        counts[r["rest"]] = r["n"]
    counts[0] = 0
    slots, taken, sequences = plan(counts, window)
    # Residual documents follow each other, longest first, and are cut where a window is full.
    left = counts - taken
    lengths = np.arange(window)
    stream = np.zeros(window, np.int64)
    stream[::-1] = np.cumsum((left * lengths)[::-1]) - (left * lengths)[::-1]
    residual = int((left * lengths).sum())
    first_whole = sequences + -(-residual // window)

    before = F.sum("n").over(Window.partitionBy("rest").orderBy("bucket")) - F.col("n")
    starts = by_bucket.select("rest", "bucket", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("rest", "bucket").orderBy("id_key", "text_key"))
    ranked = (sized.withColumn("inside", inside).join(starts, ["rest", "bucket"])
              .select("doc_id", "id_key", "text_key", "tokens", "crcs", "rest", "bucket", "whole",
                      (F.col("before") + F.col("inside") - 1).alias("rank")))

    piece = pa.schema([("doc_id", pa.int64()), ("id_key", pa.int64()), ("text_key", pa.int64()), ("start", pa.int64()),
                       ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
                       ("sequence_id", pa.int64()), ("offset", pa.int64())])
    piece_ddl = ", ".join(f"{n} long" for n in piece.names)
    keys = slots["length"] * (1 << 40) + slots["start"] if len(slots["length"]) else np.zeros(0, np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {n: b.column(n).to_numpy(zero_copy_only=False) for n in ("tokens", "rest", "rank")}
            rest, rank = c["rest"].astype(np.int64), c["rank"].astype(np.int64)
            crc = np.array([x[-1] for x in b.column("crcs").to_pylist()], np.int64)
            start = c["tokens"] - rest
            planned = (rest > 0) & (rank < taken[rest])
            i = np.flatnonzero(planned)
            s = np.searchsorted(keys, rest[i] * (1 << 40) + rank[i], side="right") - 1
            k = rank[i] - slots["start"][s]
            rows = [(i, start[i], rest[i], crc[i], slots["base"][s] + k // slots["per"][s],
                     slots["offset"][s] + k % slots["per"][s] * rest[i])]
            i = np.flatnonzero((rest > 0) & ~planned)
            at = stream[rest[i]] + (rank[i] - taken[rest[i]]) * rest[i]
            room = np.minimum(rest[i], window - at % window)
            cut = room < rest[i]
            # -1: the checksum is still to be found
            rows.append((i, start[i], room, np.where(cut, -1, crc[i]), sequences + at // window, at % window))
            j = i[cut]
            rows.append((j, start[j] + room[cut], rest[j] - room[cut], np.full(len(j), -1), sequences + at[cut] // window + 1,
                         np.zeros(len(j), np.int64)))
            i, start, length, crc, sequence, offset = (np.concatenate(x) for x in zip(*rows))
            take = pa.array(i)
            yield batch(piece, **{n: b.column(n).take(take) for n in ("doc_id", "id_key", "text_key")}, start=start,
                        length=length, ids_crc32=crc, doc_tokens=c["tokens"][i], sequence_id=sequence, offset=offset)

    placed = cut_lineage(ranked.drop("bucket", "whole").mapInArrow(place, piece_ddl))

    # Whole windows are sequences of their own, numbered by bucket and then by document.
    per_bucket = (sized.filter("whole > 0").groupBy("bucket").agg(F.sum("whole").alias("n"))
                  .withColumn("before", F.sum("n").over(Window.orderBy("bucket")) - F.col("n")))
    running = F.sum("whole").over(Window.partitionBy("bucket").orderBy("id_key", "text_key").rowsBetween(
        Window.unboundedPreceding, Window.currentRow))
    whole = (sized.filter("whole > 0").withColumn("first", running - F.col("whole"))
             .join(F.broadcast(per_bucket.select("bucket", "before")), "bucket")  # one row per bucket
             .select("doc_id", "tokens", (F.col("first") + F.col("before") + first_whole).alias("first"),
                     F.posexplode(F.slice("crcs", F.lit(1), F.col("whole").cast("int"))).alias("k", "ids_crc32"))
             .select("doc_id", (F.col("k").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"),
                     "ids_crc32", F.col("tokens").alias("doc_tokens"), (F.col("first") + F.col("k")).alias("sequence_id"),
                     F.lit(0).cast("long").alias("offset")))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds(tokenizer_path)
        for b in batches:
            found, at = [], zip(b.column("start").to_pylist(), b.column("length").to_pylist())
            for t, (start, length) in zip(ids.of(b.column("text")), at):
                found.append(zlib.crc32((t + end)[4 * start:4 * (start + length)]))
            yield batch(piece, **{n: b.column(n) for n in piece.names if n != "ids_crc32"}, ids_crc32=found)

    # Texts that repeat with their id meet each piece more than once. Few pieces go to the texts, so that these are not shuffled.
    unknown = placed.filter("ids_crc32 < 0")
    if unknown.count() <= CUT_ROWS:
        unknown = F.broadcast(unknown)
    again = (unknown.join(rows.select("id_key", "text_key", "text"), ["id_key", "text_key"])
             .select(*piece.names, "text").mapInArrow(check, piece_ddl).dropDuplicates(["sequence_id", "offset"]))
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return placed.filter("ids_crc32 >= 0").select(out).unionByName(again.select(out)).unionByName(whole.select(out))
