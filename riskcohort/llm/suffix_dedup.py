"""Removal of byte strings that occur before, by suffix sorting in shards.

Strings of ``length`` bytes meet their equals in one shard: each is dealt out by its anchor, the gram with the smallest
hash inside it, which equal strings share. Neighbouring strings with one anchor form a piece. Pieces whose anchor
occurs once cannot repeat and are left out; the others are sent to their shards, where the suffixes of all pieces are
sorted by induction with the bytes that neighbours share, and of equal strings all but the first are marked.
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
from riskcohort.llm.induced import suffixes
from riskcohort.llm.windows import NO_ID, _planes, _Powers, _unplanes

LENGTH = 100
GRAM = 40
SEGMENT = 1 << 20
FLUSH_PIECES = 1 << 20
FLUSH_BYTES = 32 << 20
BUCKET_PIECES = 1 << 17
SHARD_BYTES = 4 << 20
# Pieces whose anchor occurs more often are dealt out by more of their bytes: OFFSETS neighbouring places of the anchor.
HOT = 2048
OFFSETS = 16
MANY = np.uint32(1 << 31)

_BYTES = np.array([xxhash.xxh64_intdigest(bytes([i]), 7) for i in range(256)], np.uint64)
_BLOCK = pa.schema([("bucket", pa.int64()), ("flush", pa.int64()), ("kind", pa.int32()),
                    ("a", pa.binary()), ("b", pa.binary())])
_BLOCK_DDL = "bucket long, flush long, kind int, a binary, b binary"
# Of a block: documents of a flush; anchors and places; anchors and places of pieces to send; places of pieces that
# are gone; anchors that are hot.
DOCS, ANCHORS, SEND, GONE, HOT_ANCHORS = range(5)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Pieces:
    """Pieces of texts: first and last start of their strings, anchor, hash of the anchor and of all bytes."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM) -> None:
        self.length, self.gram, self.powers = length, gram, _Powers()

    def of(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """Every text's number and its pieces, as rows of (first, last, anchor, anchor hash, hash). The pieces of a
        text do not depend on the other texts."""
        held, numbers, size = [], [], 0
        for number, text in enumerate(texts):
            if len(text) >= SEGMENT:
                yield number, np.concatenate([
                    self._of(text[at:at + SEGMENT + self.length - 1], [0])[0] + np.array([at, at, at, 0, 0], np.uint64)
                    for at in range(0, len(text) - self.length + 1, SEGMENT)])
                continue
            held.append(text)
            numbers.append(number)
            size += len(text)
            if size >= SEGMENT:
                yield from zip(numbers, self._group(held))
                held, numbers, size = [], [], 0
        if held:
            yield from zip(numbers, self._group(held))

    def _group(self, texts: list[bytes]) -> list[np.ndarray]:
        return self._of(b"".join(texts), np.cumsum([0, *map(len, texts)])[:-1].tolist())

    def _of(self, data: bytes, starts: list[int]) -> list[np.ndarray]:
        n, length, gram = len(data), self.length, self.gram
        if n < length:
            return [np.empty((0, 5), np.uint64) for _ in starts]
        up, down = self.powers.upto(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[np.frombuffer(data, np.uint8)] * up[:n], out=sums[1:])
        h = _mixed((sums[gram:] - sums[:-gram]) * down[:n - gram + 1])
        # Smallest hash, leftmost of equal ones, among the grams of each string.
        least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        wanted, width = length - gram + 1, 1
        while width < wanted:
            step = min(width, wanted - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        inside = np.ones(n - length + 1, bool)
        for start in starts[1:]:
            inside[max(0, start - length + 1):start] = False
        at = np.flatnonzero(inside)
        a = anchor[at]
        new = np.r_[True, (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)][:len(at)]
        heads = np.flatnonzero(new)
        first, a = at[heads], a[heads]
        last = at[np.r_[heads[1:] - 1, len(at) - 1]] if len(heads) else first
        content = _mixed((sums[last + length] - sums[first]) * down[first])
        content = _mixed(content + (last - first).astype(np.uint64) * np.uint64(1 << 20) + (a - first).astype(np.uint64))
        owner = np.searchsorted(starts, first, side="right") - 1
        # Texts of no bytes share their start with the next one.
        base = np.array(starts)[owner]
        rows = np.stack([(first - base).astype(np.uint64), (last - base).astype(np.uint64), (a - base).astype(np.uint64),
                         h[a], content], axis=1)
        return np.split(rows, np.searchsorted(owner, np.arange(1, len(starts))))


def _flush_rows(flush: int, buckets: int, docs: list[tuple[int, int]], found: list[np.ndarray]) -> pa.RecordBatch:
    """Blocks of one flush."""
    sizes = np.array([len(x) for x in found])
    all_ = np.concatenate(found)
    order_of = np.empty(len(docs), np.int64)
    order_of[np.lexsort((np.array([k for _, k in docs]), np.array([i for i, _ in docs])))] = np.arange(len(docs))
    place = np.arange(len(all_))
    # Of equal pieces the first stays.
    order = np.lexsort((place, np.repeat(order_of, sizes), all_[:, 4]))
    content = all_[order, 4]
    stays = np.r_[True, content[1:] != content[:-1]]
    gone, kept = order[~stays].astype(np.uint32), order[stays]
    kept = kept[np.argsort(all_[kept, 3], kind="stable")]
    h = all_[kept, 3]
    heads = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    times = np.diff(np.r_[heads, len(h)])
    known = np.repeat(times > 1, times)
    places = np.where(times == 1, kept[heads], 0).astype(np.uint32)
    places[times > 1] = MANY | times[times > 1].astype(np.uint32)
    rows: dict[str, list] = {f.name: [] for f in _BLOCK}

    def add(*values: object) -> None:
        for k, v in zip(rows, values):
            rows[k].append(v)

    add(flush % buckets, flush, DOCS, np.array([(i, k, n) for (i, k), n in zip(docs, sizes)], np.int64).tobytes(), b"")
    if known.any():
        add(flush % buckets, flush, SEND, _planes(h[known]), _planes(kept[known].astype(np.uint32)))
    if len(gone):
        add(flush % buckets, flush, GONE, b"", _planes(np.sort(gone)))
    h = h[heads]
    edges = np.searchsorted(h, (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64))
    for k, (x, y) in enumerate(zip(np.r_[0, edges], np.r_[edges, len(h)])):
        if y > x:
            add(k, flush, ANCHORS, _planes(np.diff(h[x:y], prepend=np.uint64(0))), _planes(places[x:y]))
    return batch(_BLOCK, **rows)


def _answers(flushes: list[int], a: list[bytes], b: list[bytes]) -> Iterator[tuple[int, int, bytes, bytes]]:
    """What each flush of a bucket gets back: flush, kind, anchors, places."""
    parts = [np.cumsum(_unplanes(x, "<u8"), dtype=np.uint64) for x in a]
    h, places = np.concatenate(parts), np.concatenate([_unplanes(x, "<u4") for x in b])
    many = places >= MANY
    distinct, group = np.unique(h, return_inverse=True)
    total = np.bincount(group, np.where(many, places - MANY, 1))[group]
    ends = np.cumsum([len(p) for p in parts])
    for flush, x, y in zip(flushes, np.r_[0, ends[:-1]], ends):
        send = np.flatnonzero((total[x:y] > 1) & ~many[x:y]) + x
        if len(send):
            yield flush, SEND, _planes(h[send]), _planes(places[send])
        hot = np.flatnonzero(total[x:y] > HOT) + x
        if len(hot):
            yield flush, HOT_ANCHORS, _planes(h[hot]), b""


def _merged(spans: np.ndarray) -> np.ndarray:
    """Unions of overlapping or touching (start, end) rows, in order."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.r_[True, spans[1:, 0] > reach[:-1]]
    return np.stack([spans[new, 0], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(spans) - 1]]], axis=1)


def _marked(meta: np.ndarray, texts: bytes, length: int) -> np.ndarray:
    """Starts, in the pieces joined, of strings that another start before them has too."""
    text = np.frombuffer(texts, np.uint8)
    wanted = np.zeros(len(text), bool)
    at = np.cumsum(meta["size"]) - meta["size"]
    for start, n in zip(at.tolist(), meta["strings"].tolist()):
        wanted[start:start + n] = True
    marked = np.zeros(len(text), bool)
    open_ = np.empty(0, np.int64)

    def close(group: np.ndarray, number: np.ndarray) -> None:
        """Marks all but the first of the groups with equal numbers, which are together."""
        if len(group):
            heads = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
            marked[group] = True
            marked[np.minimum.reduceat(group, heads)] = False

    for block, shared in suffixes(text, length):
        number = np.cumsum(shared < length)
        use = wanted[block]
        block, number = block[use].astype(np.int64), number[use]
        goes_on = number == 0
        open_ = np.concatenate([open_, block[goes_on]])
        if shared.min() < length:
            close(open_, np.zeros(len(open_), np.int64))
            block, number = block[~goes_on], number[~goes_on]
            # The last group may go on in the next block.
            end = int((shared < length).sum())
            open_ = block[number == end]
            close(block[number != end], number[number != end])
    close(open_, np.zeros(len(open_), np.int64))
    return marked


_META = np.dtype([("id", "<i8"), ("key", "<i8"), ("start", "<i8"), ("strings", "<i4"), ("size", "<i4")])
_DEALT = pa.schema([("shard", pa.int64()), ("meta", pa.binary()), ("texts", pa.binary())])
_SPANS = pa.schema([("id_key", pa.int64()), ("text_key", pa.int64()), ("spans", pa.binary())])


def repeated_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``id_key, text_key, spans``: packed (start, end) byte ranges covered by strings that occur before.

    ``rows`` has ``id_key, text_key, text``. A text may have several rows, whose ranges may overlap.
    """
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(total / 30 / BUCKET_PIECES))
    shards = max(1, math.ceil(total / SHARD_BYTES))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, flush = Pieces(length, gram), TaskContext.get().partitionId() << 24
        docs, texts, seen, size = [], [], set(), 0

        def out() -> pa.RecordBatch:
            found = dict(pieces.of(texts))
            return _flush_rows(flush, buckets, docs, [found[i] for i in range(len(texts))])

        for b in batches:
            for i, k, text in zip(b.column("id_key").to_pylist(), b.column("text_key").to_pylist(),
                                  texts_as_bytes(b.column("text"))):
                # A row that repeats with id and text is the same text again.
                if len(text) < length or (i, k) in seen:
                    continue
                seen.add((i, k))
                docs.append((i, k))
                texts.append(text)
                size += len(text)
                if size >= FLUSH_BYTES:
                    yield out()
                    docs, texts, seen, size, flush = [], [], set(), 0, flush + 1
        if docs:
            yield out()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, flushes, a, b = None, [], [], []

        def answer() -> Iterator[pa.RecordBatch]:
            if flushes:
                found = list(zip(*_answers(flushes, a, b)))
                if found:
                    yield batch(_BLOCK, bucket=[bucket] * len(found[0]),
                                **dict(zip(("flush", "kind", "a", "b"), map(list, found))))

        for part in batches:
            anchors = pa.compute.equal(part.column("kind"), ANCHORS)
            passed = part.filter(pa.compute.invert(anchors))
            if passed.num_rows:
                yield passed.cast(_BLOCK)
            part = part.filter(anchors)
            for k, f, x, y in zip(*(part.column(c).to_pylist() for c in ("bucket", "flush", "a", "b"))):
                if k != bucket:
                    yield from answer()
                    bucket, flushes, a, b = k, [], [], []
                flushes.append(f)
                a.append(x)
                b.append(y)
        yield from answer()

    wanted = pa.schema([("id_key", pa.int64()), ("text_key", pa.int64()), ("send", pa.binary()), ("hot", pa.binary()),
                        ("gone", pa.binary())])

    def per_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flush, held = None, None

        def answer() -> Iterator[pa.RecordBatch]:
            if held is None or not held[SEND] and not held[GONE]:
                return
            docs = np.frombuffer(held[DOCS][0][0], np.int64).reshape(-1, 3)
            ends = np.cumsum(docs[:, 2])
            none = np.empty(0, np.uint32)
            send = np.concatenate([none, *(_unplanes(y, "<u4") for _, y in held[SEND])])
            anchors = np.concatenate([none.astype(np.uint64), *(_unplanes(x, "<u8") for x, _ in held[SEND])])
            hot = np.concatenate([none.astype(np.uint64), *(_unplanes(x, "<u8") for x, _ in held[HOT_ANCHORS])])
            lists = {"send": send, "hot": send[np.isin(anchors, hot)],
                     "gone": np.concatenate([none, *(_unplanes(y, "<u4") for _, y in held[GONE])])}
            cut = {}
            for name, places in lists.items():
                places = np.sort(places)
                owner = np.searchsorted(places, np.r_[0, ends])
                cut[name] = [(places[x:y] - (e - n)).astype("<u4").tobytes()
                             for x, y, e, n in zip(owner[:-1], owner[1:], ends, docs[:, 2])]
            use = [k for k in range(len(docs)) if cut["send"][k] or cut["gone"][k]]
            yield batch(wanted, id_key=docs[use, 0], text_key=docs[use, 1], **{n: [x[k] for k in use] for n, x in cut.items()})

        for part in batches:
            for f, kind, x, y in zip(*(part.column(c).to_pylist() for c in ("flush", "kind", "a", "b"))):
                if f != flush:
                    yield from answer()
                    flush, held = f, {k: [] for k in (DOCS, SEND, GONE, HOT_ANCHORS)}
                held[kind].append((x, y))
        yield from answer()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(length, gram)
        for b in batches:
            ids, keys, texts = b.column("id_key").to_pylist(), b.column("text_key").to_pylist(), list(texts_as_bytes(b.column("text")))
            lists = [[np.frombuffer(x, "<u4") for x in b.column(c).to_pylist()] for c in ("send", "hot", "gone")]
            out: dict[int, tuple[list, list]] = {}
            size = 0

            def send(shard: int, row: int, start: int, strings: int) -> None:
                text = texts[row][start:start + strings + length - 1]
                meta, parts = out.setdefault(shard, ([], []))
                meta.append((ids[row], keys[row], start, strings, len(text)))
                parts.append(text)

            def packed() -> pa.RecordBatch:
                return batch(_DEALT, shard=list(out), meta=[np.array(m, _META).tobytes() for m, _ in out.values()],
                             texts=[b"".join(t) for _, t in out.values()])

            for row, found in pieces.of(texts):
                sent, hot, gone = (x[row] for x in lists)
                if len(gone):
                    spans = np.stack([found[gone, 0], found[gone, 1] + np.uint64(length)], axis=1).astype(np.int64)
                    meta, parts = out.setdefault(-1 - keys[row] % shards, ([], []))
                    spans = _merged(spans).tobytes()
                    meta.append((ids[row], keys[row], 0, 0, len(spans)))
                    parts.append(spans)
                hot = set(hot.tolist())
                for k in sent.tolist():
                    first, last, anchor, h, _ = found[k].tolist()
                    if k not in hot:
                        send(h % shards, row, first, last - first + 1)
                        continue
                    # Offsets of the anchor in classes; the bytes that all strings of a class share decide.
                    for j in range((anchor - last) // OFFSETS, (anchor - first) // OFFSETS + 1):
                        low, high = max(first, anchor - OFFSETS * (j + 1) + 1), min(last, anchor - OFFSETS * j)
                        shared = texts[row][anchor - OFFSETS * j:anchor - OFFSETS * (j + 1) + 1 + length]
                        send(xxhash.xxh64_intdigest(shared, j) % shards, row, low, high - low + 1)
                size += len(texts[row])
                if size >= FLUSH_BYTES // 2:
                    yield packed()
                    out.clear()
                    size = 0
            if out:
                yield packed()

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, metas, parts = None, [], []

        def answer() -> Iterator[pa.RecordBatch]:
            if not metas:
                return
            meta = np.concatenate(metas)
            at = np.cumsum(meta["size"]) - meta["size"]
            order = np.lexsort((meta["start"], meta["key"], meta["id"]))
            # A text that lies in several flushes sends its pieces more than once.
            same = meta[order[1:]] == meta[order[:-1]]
            order = order[np.r_[True, ~same]]
            joined = b"".join(parts)
            meta, at = meta[order], at[order]
            texts = [joined[i:i + n] for i, n in zip(at.tolist(), meta["size"].tolist())]
            # Copies of a piece are all gone but the first one, whose strings are sorted for all.
            first: dict[bytes, int] = {}
            stays = np.array([first.setdefault(t, i) == i for i, t in enumerate(texts)])
            copies, sorted_ = meta[~stays], meta[stays]
            starts = np.flatnonzero(_marked(sorted_, b"".join(first), length))
            base = np.cumsum(sorted_["size"]) - sorted_["size"]
            owner = np.searchsorted(base, starts, side="right") - 1
            begin = starts - base[owner] + sorted_["start"][owner]
            ids = np.concatenate([copies["id"], sorted_["id"][owner]])
            keys = np.concatenate([copies["key"], sorted_["key"][owner]])
            if not len(ids):
                return
            spans = np.stack([np.concatenate([copies["start"], begin]),
                              np.concatenate([copies["start"] + copies["size"], begin + length])], axis=1)
            order = np.lexsort((keys, ids))
            ids, keys, spans = ids[order], keys[order], spans[order]
            new = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])])
            yield batch(_SPANS, id_key=ids[new], text_key=keys[new],
                        spans=[_merged(x).tobytes() for x in np.split(spans, new[1:])])

        for b in batches:
            for k, m, t in zip(*(b.column(c).to_pylist() for c in ("shard", "meta", "texts"))):
                m = np.frombuffer(m, _META)
                if k < 0:  # ranges already known
                    ends = np.cumsum(m["size"]).tolist()
                    yield batch(_SPANS, id_key=m["id"], text_key=m["key"], spans=[t[i:j] for i, j in zip([0, *ends], ends)])
                    continue
                if k != shard:
                    yield from answer()
                    shard, metas, parts = k, [], []
                metas.append(m)
                parts.append(t)
        yield from answer()

    blocks = rows.mapInArrow(collect, _BLOCK_DDL).repartition("bucket").sortWithinPartitions("bucket")
    answers = blocks.mapInArrow(count, _BLOCK_DDL).select("flush", "kind", "a", "b")
    texts = (answers.repartition("flush").sortWithinPartitions("flush").mapInArrow(
        per_text, "id_key long, text_key long, send binary, hot binary, gone binary"))
    dealt = (rows.join(texts, ["id_key", "text_key"]).select("id_key", "text_key", "text", "send", "hot", "gone")
             .mapInArrow(deal, "shard long, meta binary, texts binary"))
    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(
        sort, "id_key long, text_key long, spans binary")


_KEPT = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                   ("n_spans", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64())))])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   gram: int = GRAM, form: str = "bytes") -> DataFrame:
    """``doc_id, text_key, kept, n_bytes, n_removed, n_spans, spans``: texts without the bytes of strings that occur before.

    Texts are UTF-8 bytes (null: none). A string of ``length`` bytes (at most 254) occurs before if it also starts in a
    text with a smaller id, or earlier in the same text; it never crosses texts, may overlap itself, and is
    judged on the input. ``spans`` are the maximal removed ranges. ``kept`` has, by ``form``, the remaining
    "bytes" (in which characters may be cut), their "sha256" in hex, or as "text" what is whole characters of them. Texts with the same id (null ids come first) are in the order of
    a hash of the text; rows that repeat with id and text are one text and get the same result. ``text_key`` is
    that hash, the xxhash64 of the text (null as empty). An empty table gives an empty result.

    Runs one job, which adds up the sizes of the texts; texts are shuffled once.
    """
    rows = id_and_text(docs, id_col, text_col).select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("id_key"), F.xxhash64("text").alias("text_key"), "text")
    spans = (repeated_spans(rows, length, gram).groupBy("id_key", "text_key")
             .agg(F.collect_list("spans").alias("spans")))  # bounded by the length of the text
    joined = rows.join(spans, ["id_key", "text_key"], "left").select("id_key", "text_key", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {n: [] for n in _KEPT.names}
            for i, key, text, found in zip(b.column("id_key").to_pylist(), b.column("text_key").to_pylist(), texts_as_bytes(b.column("text")),
                                      b.column("spans").to_pylist()):
                ranges = _merged(np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in found])).tolist() if found else []
                ends = [0, *(e for _, e in ranges)]
                kept = b"".join(text[x:y] for x, y in zip(ends, [*(s for s, _ in ranges), len(text)]))
                shown = {"bytes": lambda x: x, "sha256": lambda x: hashlib.sha256(x).hexdigest().encode(),
                         "text": lambda x: x.decode(errors="ignore").encode()}[form](kept)
                row = (None if i == NO_ID else i, key, shown, len(text), len(text) - len(kept), len(ranges), ranges)
                for name, value in zip(out, row):
                    out[name].append(value)
            yield batch(_KEPT, **out)

    return joined.mapInArrow(run, "doc_id long, text_key long, kept binary, n_bytes long, n_removed long, n_spans long, "
                                  "spans array<array<long>>")
