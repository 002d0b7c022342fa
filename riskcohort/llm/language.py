"""Language identification by interpolated Kneser-Ney models of characters.

One model of order four per language, learned from labelled texts: Spark counts all their grams, the numbers of different
continuations, totals and discounts, and makes one table of log probabilities and weights of shorter endings. Tasks keep
it in arrays sorted by a hash of the gram: all of it while it is small, else the part that a bucket of texts asks for.
A text goes to the language with the lowest cross-entropy per character. Confidence and rejection are calibrated
on a part of the labelled texts, by a model that has not learned from it.
"""

from __future__ import annotations

import math
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskcohort.llm.common import batch
from riskcohort.session import cut_lineage

ORDER = 4
# Rows of the table up to which every task gets it whole, about 16 bytes each; beyond, buckets of texts fetch their part.
WHOLE_ROWS = 1 << 22
BUCKET_CHARS = 1 << 24
GROUP_CHARS, GROUP_TEXTS = 1 << 18, 1 << 12
# Grams that a task counts before it passes them on, and numbers (grams times languages) that it scores at once.
TASK_GRAMS = 1 << 19
CELLS = 1 << 21
# Rows of grams in a partition while a model is learned.
PART_ROWS = 1 << 16
# One in so many labelled texts is for calibration.
FOLDS = 5
BINS = 40
UNKNOWN = "und"
SPACE = 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the 16-bit symbol (lower case; a space for what is neither letter nor mark), and whether it is a
    letter. Characters beyond 16 bits share the 8448 places of surrogates and private use, in turn."""
    symbol = np.full(sys.maxunicode + 1, SPACE, np.uint16)
    letter = np.zeros(sys.maxunicode + 1, bool)
    for i in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(i))[0]
        if kind in "LM":
            low = chr(i).lower()
            code = ord(low[0])
            symbol[i] = code if code < 0x10000 else 0xD800 + code % 0x2100
            letter[i] = kind == "L"
    return symbol, letter


def _symbols(text: str) -> np.ndarray:
    """Symbols of a text, words parted by one space, with one at either end; empty without letters."""
    symbol, letter = _tables()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not letter[codes].any():
        return np.empty(0, np.uint16)
    s = np.concatenate([[np.uint16(SPACE)], symbol[codes], [np.uint16(SPACE)]])
    blank = s == SPACE
    return s[~(blank & np.r_[False, blank[:-1]])]


def _grams(s: np.ndarray) -> np.ndarray:
    """Packed grams of order four that end at each symbol after the first; the text begins with spaces."""
    x = np.concatenate([np.full(ORDER - 2, SPACE, np.uint64), s.astype(np.uint64)])
    out = x[:-3] << np.uint64(48)
    for k in (1, 2, 3):
        out |= x[k:len(x) - 3 + k] << np.uint64(16 * (3 - k))
    return out


def _read(texts: pa.Array) -> Iterator[str | None]:
    """The texts of a column one by one, so that a task does not hold all of a batch twice."""
    return (t.as_py() for t in texts)


def _groups(texts: Iterator[tuple[object, str | None]]) -> Iterator[list[tuple[object, np.ndarray]]]:
    held, size = [], 0
    for key, text in texts:
        s = _symbols(text or "")
        held.append((key, s))
        size += len(s)
        if size >= GROUP_CHARS or len(held) >= GROUP_TEXTS:
            yield held
            held, size = [], 0
    if held:
        yield held


def gram_counts(labelled: DataFrame) -> DataFrame:
    """``lang, part, gram, n`` over all texts of ``lang, part, text``. Grams are packed, 16 bits a character."""
    schema = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])
    Key = tuple[str, int]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[Key, tuple[np.ndarray, np.ndarray]] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for (lang, part), (grams, n) in held.items():
                yield batch(schema, lang=[lang] * len(grams), part=[part] * len(grams), gram=grams.view(np.int64), n=n)
            held.clear()

        for b in batches:
            keys = zip(b.column("lang").to_pylist(), b.column("part").to_pylist())
            for group in _groups(zip(keys, _read(b.column("text")))):
                by: dict[Key, list[np.ndarray]] = {}
                for key, s in group:
                    if len(s):
                        by.setdefault(key, []).append(_grams(s))
                for key, found in by.items():
                    grams, n = np.unique(np.concatenate(found), return_counts=True)
                    if key in held:
                        both = np.concatenate([held[key][0], grams])
                        grams, at = np.unique(both, return_inverse=True)
                        n = np.bincount(at, np.concatenate([held[key][1], n])).astype(np.int64)
                    held[key] = grams, n
                if sum(len(g) for g, _ in held.values()) > TASK_GRAMS:  # so that a task holds a bounded number
                    yield from counted()
        yield from counted()

    return (labelled.select("lang", "part", "text").mapInArrow(run, "lang string, part int, gram long, n long")
            .groupBy("lang", "part", "gram").agg(F.sum("n").alias("n")))


def _mask(k: int) -> int:
    return (1 << 16 * k) - 1


@dataclass(frozen=True)
class Learned:
    """``table`` has ``code, gram, at, log``: code k is the log probability of a gram of order k in language ``at``, code
    8 + k the log of the weight that its context (the gram without its last symbol) leaves to shorter endings."""

    languages: list[str]
    table: DataFrame
    rows: int
    uniform: float


def learn(counts: DataFrame) -> Learned | None:
    """Interpolated Kneser-Ney models from the frequencies ``lang, gram, n`` of grams of order four; None without any.

    All grams count: frequencies for order four, numbers of different symbols before for the shorter ones. The discount of
    a language and order is ``n1 / (n1 + 2 n2)``, or a half where no gram occurs once or none twice. Symbols that no
    language has share one place. The driver gets the list of languages. Tables are kept in partitions by their number of
    rows, however many the texts or shuffles have: each partition is small files in every shuffle and checkpoint.
    """
    spark = counts.sparkSession
    sizes = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    languages = sorted(sizes)
    if not languages:
        return None
    dealt = sum(sizes.values()) // PART_ROWS + 1
    orders = {ORDER: cut_lineage(counts.select("lang", "gram", "n").coalesce(dealt))}
    for k in range(ORDER - 1, 0, -1):
        ending = F.col("gram").bitwiseAND(F.lit(_mask(k))).alias("gram")
        orders[k] = cut_lineage(orders[k + 1].groupBy("lang", ending).agg(F.count("*").alias("n")).coalesce(dealt))
    places = orders[1].agg(F.count_distinct("gram")).first()[0] + 1
    below, parts = None, []
    for k in range(1, ORDER + 1):
        found = orders[k].withColumn("context", F.shiftrightunsigned("gram", 16))
        ones, twos = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        discounts = found.groupBy("lang").agg(
            F.when((ones > 0) & (twos > 0), ones / (ones + 2 * twos)).otherwise(0.5).alias("discount"))
        contexts = (found.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
                    .join(discounts, "lang").withColumn("rest", F.expr("discount * kinds / total")))
        joined = found.join(contexts, ["lang", "context"]).coalesce(dealt)
        if k == 1:
            joined = joined.withColumn("lower", F.lit(1 / places))
        else:
            joined = joined.withColumn("ending", F.col("gram").bitwiseAND(F.lit(_mask(k - 1)))).join(
                below.select("lang", F.col("gram").alias("ending"), F.col("p").alias("lower")), ["lang", "ending"])
        below = cut_lineage(joined.select("lang", "gram", F.expr("(n - discount) / total + rest * lower").alias("p")).coalesce(dealt))
        parts.append(below.select(F.lit(k).alias("code"), "lang", "gram", F.log("p").alias("log")))
        parts.append(contexts.select(F.lit(8 + k).alias("code"), "lang", F.col("context").alias("gram"), F.log("rest").alias("log")))
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    numbers = spark.createDataFrame([(x, i) for i, x in enumerate(languages)], "lang string, at int")
    table = cut_lineage(table.join(numbers, "lang").select("code", "gram", "at", F.col("log").cast("float").alias("log"))
                        .coalesce(2 * dealt))
    return Learned(languages, table, table.count(), -math.log(places))


class Model:
    """Rows of the table of :class:`Learned` in arrays sorted by a hash of the gram."""

    def __init__(self, languages: int, uniform: float, code: np.ndarray, gram: np.ndarray, at: np.ndarray, log: np.ndarray) -> None:
        self.languages, self.uniform = languages, uniform
        self.parts: dict[int, tuple[np.ndarray, ...]] = {}
        for c in [*range(1, ORDER + 1), *range(9, ORDER + 9)]:
            rows = np.flatnonzero(code == c)
            hashes = gram[rows].view(np.uint64) * _ODD
            order = np.argsort(hashes, kind="stable")
            unique, starts = np.unique(hashes[order], return_index=True)
            self.parts[c] = (unique, np.append(starts, len(rows)), at[rows][order].astype(np.int32), log[rows][order].astype(np.float32))

    def _entries(self, code: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of ``wanted``, language and number of all stored entries of the wanted grams."""
        hashes, starts, at, log = self.parts[code]
        if not len(hashes):
            return np.empty(0, np.int64), at, log
        h = wanted * _ODD
        spot = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        n = np.where(hashes[spot] == h, starts[spot + 1] - starts[spot], 0)
        rows = np.repeat(np.arange(len(wanted)), n)
        place = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[spot], n)
        return rows, at[place], log[place]

    def score(self, grams: np.ndarray) -> np.ndarray:
        """A row of log probabilities in every language for each packed gram, from the shortest ending up."""
        out = np.full((len(grams), self.languages), self.uniform, np.float32)
        for k in range(1, ORDER + 1):
            g = grams & np.uint64(_mask(k))
            rows, at, log = self._entries(8 + k, g >> np.uint64(16))
            out[rows, at] += log
            rows, at, log = self._entries(k, g)
            out[rows, at] = log
        return out

    def rate(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the best language, its cross-entropy and the margin to the second best; NaN without letters."""
        best, entropy, margin = np.zeros(len(texts), np.int64), np.full(len(texts), np.nan), np.full(len(texts), np.nan)
        most = max(1024, CELLS // self.languages)
        for group in _groups(enumerate(_read(texts))):
            group = [(i, _grams(s)) for i, s in group if len(s)]
            if not group:
                continue
            sums = np.zeros((len(group), self.languages))
            pieces = [(j, g[k:k + most]) for j, (_, g) in enumerate(group) for k in range(0, len(g), most)]
            while pieces:
                n = max(1, int(np.searchsorted(np.cumsum([len(g) for _, g in pieces]), most, "right")))
                some, pieces = pieces[:n], pieces[n:]
                sizes = np.array([len(g) for _, g in some])
                unique, where = np.unique(np.concatenate([g for _, g in some]), return_inverse=True)
                found = np.add.reduceat(self.score(unique)[where], np.cumsum(sizes) - sizes, axis=0, dtype=np.float64)
                np.add.at(sums, [j for j, _ in some], found)
            at = np.array([i for i, _ in group])
            mean = -sums / np.array([len(g) for _, g in group])[:, None]
            order = np.argsort(mean, axis=1, kind="stable")
            best[at] = order[:, 0]
            entropy[at] = mean[np.arange(len(at)), order[:, 0]]
            margin[at] = mean[np.arange(len(at)), order[:, 1]] - entropy[at] if self.languages > 1 else 0
        return best, entropy, margin


def _by_whole(rows: DataFrame, learned: Learned) -> DataFrame:
    """``rows`` with ``best, entropy, margin``; every task has the whole table, at most WHOLE_ROWS rows."""
    t = learned.table.toArrow()
    shipped = rows.sparkSession.sparkContext.broadcast(
        Model(len(learned.languages), learned.uniform, *[t.column(c).to_numpy() for c in ("code", "gram", "at", "log")]))
    kept = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, entropy, margin = shipped.value.rate(b.column("text"))
            none = np.isnan(entropy)
            found = [pa.array(best, pa.int32(), mask=none), pa.array(entropy, mask=none), pa.array(margin, mask=none)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *found], [*kept, "best", "entropy", "margin"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, ddl + ", best int, entropy double, margin double")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of batches, each within one bucket."""
    for b in batches:
        buckets = b.column("bucket").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
        for start, stop in zip(edges, edges[1:]):
            if stop > start:
                yield int(buckets[start]), b.slice(start, stop - start)


def _by_buckets(rows: DataFrame, learned: Learned, chars: int = BUCKET_CHARS) -> DataFrame:
    """As :func:`_by_whole`: different texts are dealt into buckets of about ``chars`` characters, a bucket asks for the
    rows of its different grams, contexts and endings, and meets them before its texts."""
    keyed = rows.withColumn("text_key", F.md5("text"))
    size = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    bucket = F.pmod(F.xxhash64("text_key"), F.lit(size // chars + 1)).alias("bucket")
    texts = cut_lineage(keyed.filter("text is not null").groupBy("text_key").agg(F.first("text").alias("text")).select(bucket, "text_key", "text"))
    asked = pa.schema([("bucket", pa.int64()), ("code", pa.int32()), ("gram", pa.int64())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def wanted(bucket: int, grams: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(1, ORDER + 1):
                g = np.unique(grams & np.uint64(_mask(k)))
                for code, x in ((k, g), (8 + k, np.unique(g >> np.uint64(16)))):
                    yield batch(asked, bucket=np.full(len(x), bucket), code=np.full(len(x), code, np.int32), gram=x.view(np.int64))

        last, held = None, np.empty(0, np.uint64)
        for bucket, b in _runs(batches):
            if bucket != last and last is not None:
                yield from wanted(last, held)
                held = held[:0]
            last = bucket
            for group in _groups(enumerate(_read(b.column("text")))):
                held = np.unique(np.concatenate([held, *[_grams(s) for _, s in group if len(s)]]))
        if last is not None:
            yield from wanted(last, held)

    dealt = texts.select("bucket", "text").repartition("bucket").sortWithinPartitions("bucket")
    answers = dealt.mapInArrow(ask, "bucket long, code int, gram long").join(learned.table, ["code", "gram"])
    languages, uniform = len(learned.languages), learned.uniform
    rated = pa.schema([("text_key", pa.string()), ("best", pa.int32()), ("entropy", pa.float64()), ("margin", pa.float64())])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, last = ("code", "gram", "at", "log"), None
        held: list[list[np.ndarray]] = []
        model: Model | None = None
        for bucket, b in _runs(batches):
            if bucket != last:
                last, held, model = bucket, [], None
            known = b.filter(b.column("text_key").is_null())
            if known.num_rows:
                held.append([known.column(c).to_numpy() for c in names])
            b = b.filter(b.column("text_key").is_valid())
            if not b.num_rows:
                continue
            if model is None:
                empty = [np.empty(0, d) for d in (np.int32, np.int64, np.int32, np.float32)]
                model = Model(languages, uniform, *[np.concatenate(x) for x in zip(empty, *held)])
                held = []
            best, entropy, margin = model.rate(b.column("text"))
            none = np.isnan(entropy)
            yield batch(rated, text_key=b.column("text_key"), best=pa.array(best, pa.int32(), mask=none),
                        entropy=pa.array(entropy, mask=none), margin=pa.array(margin, mask=none))

    both = answers.unionByName(texts, allowMissingColumns=True).repartition("bucket").sortWithinPartitions(
        "bucket", F.col("text_key").isNotNull())
    found = both.mapInArrow(rate, "text_key string, best int, entropy double, margin double")
    return keyed.drop("text").join(found, "text_key", "left").drop("text_key")


def scores(docs: DataFrame, learned: Learned | None, id_col: str = "doc_id", text_col: str = "text",
           keep: dict[str, Column] | None = None, whole_rows: int = WHOLE_ROWS) -> DataFrame:
    """``doc_id, lang_pred, entropy, margin`` and the columns of ``keep``, one row per input row.

    ``entropy`` is the cross-entropy in nats per character of the best language (ties: the first in order), ``margin`` how
    much the second best is worse (with one language: 0). A null text, or one without letters, is ``und`` with null numbers,
    and so is every text without a model. Only the text is looked at. A table of more than ``whole_rows`` rows
    is not handed to every task; results are the same.
    """
    keep = keep or {}
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"),
                       *[c.alias(n) for n, c in keep.items()])
    if learned is None:
        number = F.lit(None).cast("double")
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), number.alias("entropy"), number.alias("margin"), *keep)
    found = (_by_whole if learned.rows <= whole_rows else _by_buckets)(rows, learned)
    names = F.array(*[F.lit(x) for x in learned.languages])
    return found.select("doc_id", F.coalesce(F.get(names, F.col("best")), F.lit(UNKNOWN)).alias("lang_pred"), "entropy", "margin", *keep)


def _bin() -> Column:
    """Equal steps of the log of the margin, from 0.001 to 10 nats."""
    place = F.floor((F.log(F.greatest("margin", F.lit(1e-3))) - math.log(1e-3)) / math.log(1e4) * BINS)
    return F.least(F.greatest(place, F.lit(0)), F.lit(BINS - 1)).cast("int")


def identify(docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             tail: float = 0.001, keep: dict[str, Column] | None = None, whole_rows: int = WHOLE_ROWS) -> DataFrame:
    """``doc_id, lang_pred, score, entropy, margin, rejected`` and the columns of ``keep``, one row per input row.

    The model learns from the rows where ``learn_from`` is true and ``lang_col`` is not null. A fifth of these rows, by a
    hash of the text, is rated by a second model that learned from the others: ``score`` (0 to 1) is the share of them that was
    right at such a margin or a smaller one, a half where none tells; ``rejected`` tells that the text is less like the
    predicted language than all but a share of ``tail`` of those that were rightly given to it, if there are any. ``und`` has
    score 0 and is rejected. Null ids and repeated rows are kept; equal texts under different languages count for each. An empty
    table gives an empty result; without learned rows all is ``und``.

    Runs jobs: counts of grams and the tables of both models are checkpointed. The driver gets tables of up to ``whole_rows``
    rows, and the calibration.
    """
    spark = docs.sparkSession
    labelled = docs.filter(F.coalesce(learn_from, F.lit(False))).select(
        F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"),
        ).filter("lang is not null").withColumn("part", (F.pmod(F.xxhash64("text"), F.lit(FOLDS)) == 0).cast("int"))
    counts = cut_lineage(gram_counts(labelled))
    learned = learn(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    trial = learn(counts.filter("part = 0"))
    fold = labelled.filter("part = 1").withColumn("doc_id", F.lit(None).cast("long"))
    tried = cut_lineage(scores(fold, trial, keep={"truth": F.col("lang")}, whole_rows=whole_rows).filter("margin is not null"))
    bins = tried.groupBy(_bin().alias("bin")).agg(F.count("*").alias("n"), F.sum(F.expr("int(truth = lang_pred)")).alias("right"))
    n, right = np.zeros(BINS), np.zeros(BINS)
    for r in bins.collect():  # at most BINS rows
        n[r["bin"]], right[r["bin"]] = r["n"], r["right"]
    share = np.maximum.accumulate((right + 1) / (n + 2)) if n.sum() else np.full(BINS, 0.5)
    limits = tried.filter("truth = lang_pred").groupBy("lang_pred").agg(
        F.percentile_approx("entropy", 1 - tail, 10_000).alias("limit"))
    by_bin = spark.createDataFrame([(i, float(x)) for i, x in enumerate(share)], "bin int, sure double")
    found = scores(docs, learned, id_col, text_col, keep, whole_rows)
    joined = (found.withColumn("bin", _bin()).join(F.broadcast(by_bin), "bin", "left")  # BINS rows
              .join(F.broadcast(limits), "lang_pred", "left"))  # one row per language
    return joined.select("doc_id", "lang_pred", F.when(F.col("margin").isNull(), 0.0).otherwise(F.col("sure")).alias("score"),
                         "entropy", "margin",
                         F.coalesce(F.col("entropy") > F.col("limit"), F.col("entropy").isNull()).alias("rejected"), *(keep or {}))
