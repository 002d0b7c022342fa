"""Removal of word windows that occur more than once, by Rabin-Karp hashes.

Every window of ``width`` words is hashed. Tasks collect the hashes of their documents in flushes,
sort them and deal them out in blocks by hash range; whoever has a range counts its hashes and answers
each flush with the places of repeated ones. Places become maximal intervals per document.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from riskcohort.llm.common import batch, id_and_text, texts_as_bytes

WIDTH = 35
# An odd multiplier has an inverse modulo 2^64, so a window's hash is a difference of prefix sums.
BASE = 0x9E3779B97F4A7C15
FLUSH_WINDOWS = 1 << 21
BUCKET_WINDOWS = 1 << 18
MULTIPLE = np.uint32(0xFFFFFFFF)
NO_ID = -(1 << 63)

# kind 0: documents of a flush; 1: hashes and places; 2: places already known to repeat
_BLOCK = pa.schema([("bucket", pa.int64()), ("flush", pa.int64()), ("kind", pa.int32()),
                    ("a", pa.binary()), ("b", pa.binary())])
_BLOCK_DDL = "bucket long, flush long, kind int, a binary, b binary"


class WordHashes(dict):
    """XXH64 of words, computed once per word and forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > 500_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, width: int, powers: np.ndarray, inverses: np.ndarray) -> np.ndarray:
    """Polynomial hash modulo 2^64 of every window of ``width`` word hashes."""
    n = len(words)
    if n < width:
        return np.empty(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * powers[:n], out=sums[1:])
    mixed = (sums[width:] - sums[:-width]) * inverses[:n - width + 1]
    # Multiplication leaves low bits weak; fold the high ones in before ranges are cut by the top bits.
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(29))


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(10, (n - 1).bit_length())
            inverse = pow(BASE, -1, 1 << 64)
            self.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, BASE, np.uint64))])
            self.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, inverse, np.uint64))])
        return self.up, self.down


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal significance side by side, which compresses well for small or sorted values."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _unplanes(data: bytes, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def _flush_rows(flush: int, buckets: int, docs: list[tuple[int, int, int]], hashes: list[np.ndarray]) -> pa.RecordBatch:
    """Blocks of one flush; ``docs`` has (id, text key, number of windows)."""
    h = np.concatenate(hashes)
    order = np.argsort(h)
    h, places = h[order], order.astype(np.uint32)
    new = np.r_[True, h[1:] != h[:-1]]
    first = np.flatnonzero(new)
    single = np.diff(np.r_[first, len(h)]) == 1
    known = places[~single[np.cumsum(new) - 1]]
    h, places = h[first], np.where(single, places[first], MULTIPLE)
    edges = np.searchsorted(h, (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64))
    rows: dict[str, list] = {f.name: [] for f in _BLOCK}

    def add(*values: object) -> None:
        for k, v in zip(rows, values):
            rows[k].append(v)

    add(flush % buckets, flush, 0, np.array(docs, np.int64).tobytes(), b"")
    if len(known):
        add(flush % buckets, flush, 2, b"", _planes(known))
    for k, (x, y) in enumerate(zip(np.r_[0, edges], np.r_[edges, len(h)])):
        if y > x:
            add(k, flush, 1, _planes(np.diff(h[x:y], prepend=np.uint64(0))), _planes(places[x:y]))
    return batch(_BLOCK, **rows)


def _repeated(flushes: list[int], a: list[bytes], b: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """Places, by flush, of the hashes that occur more than once in one bucket."""
    parts = [np.cumsum(_unplanes(x, "<u8"), dtype=np.uint64) for x in a]
    h, places = np.concatenate(parts), np.concatenate([_unplanes(x, "<u4") for x in b])
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.r_[s[1:] == s[:-1], False]
    hit = np.zeros(len(h), bool)
    hit[order] = same | np.r_[False, same[:-1]]
    hit &= places != MULTIPLE
    ends = np.cumsum([len(p) for p in parts])
    for flush, start, end in zip(flushes, np.r_[0, ends[:-1]], ends):
        found = places[start:end][hit[start:end]]
        if len(found):
            yield flush, found


def _intervals(docs: np.ndarray, places: np.ndarray, width: int) -> Iterator[tuple[int, int, list[int], list[int]]]:
    """Maximal covered word intervals of each document of a flush: id, text key, starts, ends."""
    ends = np.cumsum(docs[:, 2])
    places = np.sort(places).astype(np.int64)
    owner = np.searchsorted(ends, places, side="right")
    for k, (i, j) in zip(*(lambda u, s: (u, zip(s, np.r_[s[1:], len(owner)])))(*np.unique(owner, return_index=True))):
        at = places[i:j] - (ends[k] - docs[k, 2])
        gap = np.flatnonzero(np.diff(at) > width) + 1
        starts, last = at[np.r_[0, gap]], at[np.r_[gap - 1, len(at) - 1]]
        yield int(docs[k, 0]), int(docs[k, 1]), starts.tolist(), (last + width).tolist()


def repeated_intervals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                       buckets: int | None = None) -> DataFrame:
    """``id_key, text_key, starts, ends``: maximal word intervals covered by repeated windows, per text.

    ``id_key`` is the id (the smallest long for null), ``text_key`` the hash of the text. Texts without
    repeated windows have no row. ``buckets`` hash ranges; by default as many as keep a range's hashes
    small, from the size of all texts.
    """
    rows = id_and_text(docs, id_col, text_col)
    if buckets is None:
        total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(1, math.ceil(total / 6 / BUCKET_WINDOWS))
    keyed = rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id_key"), F.xxhash64("text").alias("text_key"), "text")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, powers, flush = WordHashes(), _Powers(), TaskContext.get().partitionId() << 24
        held: list[tuple[int, int, int]] = []
        hashes: list[np.ndarray] = []
        size = 0
        for b in batches:
            for i, k, text in zip(b.column("id_key").to_pylist(), b.column("text_key").to_pylist(),
                                  texts_as_bytes(b.column("text"))):
                words = text.split()
                if len(words) < width:
                    continue
                h = window_hashes(cache.of(words), width, *powers.upto(len(words) + 1))
                held.append((i, k, len(h)))
                hashes.append(h)
                size += len(h)
                if size >= FLUSH_WINDOWS:
                    yield _flush_rows(flush, buckets, held, hashes)
                    held, hashes, size, flush = [], [], 0, flush + 1
        if held:
            yield _flush_rows(flush, buckets, held, hashes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, flushes, a, b = None, [], [], []

        def answer() -> Iterator[pa.RecordBatch]:
            for flush, places in _repeated(flushes, a, b) if flushes else ():
                yield batch(_BLOCK, bucket=[bucket], flush=[flush], kind=[2], a=[b""], b=[_planes(places)])

        for part in batches:
            passed = part.filter(pa.compute.not_equal(part.column("kind"), 1))
            if passed.num_rows:
                yield passed.cast(_BLOCK)
            part = part.filter(pa.compute.equal(part.column("kind"), 1))
            for k, f, x, y in zip(*(part.column(c).to_pylist() for c in ("bucket", "flush", "a", "b"))):
                if k != bucket:
                    yield from answer()
                    bucket, flushes, a, b = k, [], [], []
                flushes.append(f)
                a.append(x)
                b.append(y)
        yield from answer()

    schema = pa.schema([("id_key", pa.int64()), ("text_key", pa.int64()), ("starts", pa.list_(pa.int32())),
                        ("ends", pa.list_(pa.int32()))])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flush, held, places = None, None, []

        def answer() -> Iterator[pa.RecordBatch]:
            if places:
                found = list(_intervals(np.frombuffer(held, np.int64).reshape(-1, 3), np.concatenate(places), width))
                yield batch(schema, **dict(zip(schema.names, map(list, zip(*found)))))

        for part in batches:
            for f, kind, x, y in zip(*(part.column(c).to_pylist() for c in ("flush", "kind", "a", "b"))):
                if f != flush:
                    yield from answer()
                    flush, held, places = f, None, []
                if kind == 0:
                    held = x
                else:
                    places.append(_unplanes(y, "<u4"))
        yield from answer()

    blocks = keyed.mapInArrow(collect, _BLOCK_DDL).repartition("bucket").sortWithinPartitions("bucket")
    answers = blocks.mapInArrow(count, _BLOCK_DDL).select("flush", "kind", "a", "b")
    return answers.repartition("flush").sortWithinPartitions("flush", "kind").mapInArrow(
        merge, "id_key long, text_key long, starts array<int>, ends array<int>")


_KEPT = pa.schema([("doc_id", pa.int64()), ("kept", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                   ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                    buckets: int | None = None, digest: bool = False) -> DataFrame:
    """``doc_id, kept, n_words, n_removed, starts, ends``: texts without the windows that occur elsewhere too.

    Words are runs of bytes other than ASCII white space; a window repeats if its word sequence starts
    anywhere else in the table, the same text included, judged on the whole input. ``kept`` holds the
    remaining words joined by one space (its SHA-256 in hex with ``digest``). A null text has no words.
    Texts shorter than a window are unchanged. Rows that repeat with id and text are kept, one row each.
    Windows are compared by 64-bit hashes. An empty table gives an empty result.
    """
    found = repeated_intervals(docs, id_col, text_col, width, buckets)
    # Rows that repeat with id and text give equal intervals.
    found = found.groupBy("id_key", "text_key").agg(F.first("starts").alias("starts"), F.first("ends").alias("ends"))
    rows = id_and_text(docs, id_col, text_col).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("id_key"), F.xxhash64("text").alias("text_key"))
    joined = rows.join(found, ["id_key", "text_key"], "left").select("doc_id", "text", "starts", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, n, removed, starts, ends = [], [], [], b.column("starts").to_pylist(), b.column("ends").to_pylist()
            for text, first, last in zip(texts_as_bytes(b.column("text")), starts, ends):
                words = text.split()
                n.append(len(words))
                if first:
                    words = [w for i, j in zip([0, *last], [*first, len(words)]) for w in words[i:j]]
                removed.append(n[-1] - len(words))
                out = b" ".join(words)
                kept.append(hashlib.sha256(out).hexdigest() if digest else out.decode())
            yield batch(_KEPT, doc_id=b.column("doc_id"), kept=kept, n_words=n, n_removed=removed, starts=starts, ends=ends)

    return joined.mapInArrow(run, "doc_id long, kept string, n_words long, n_removed long, starts array<int>, ends array<int>")
