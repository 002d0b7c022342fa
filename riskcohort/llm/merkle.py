"""Merkle fingerprints of documents: pieces, paragraphs, sections, root.

A paragraph ends with a line; long ones are cut into pieces at places that their own bytes choose, so an edit
moves only the cuts around it. A section ends at an empty line or at a paragraph whose digest says so. Every
node's digest is made of its children's; equal roots mean equal texts, and where roots differ the branches
that differ lead to the edit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from riskcohort.llm.common import batch, id_and_text, shuffle_partitions

PIECE_BITS = 6
LONGEST_PIECE = 512
# Pseudo-random values of bytes for the rolling sum of eight bytes that places cuts.
_GEAR = np.frombuffer(b"".join(xxhash.xxh32_digest(bytes([i])) for i in range(256)), ">u4").astype(np.uint32)

Pieces = list[tuple[bytes, int]]


def _cuts(data: bytes) -> list[int]:
    """Ends of the pieces of a text."""
    raw = np.frombuffer(data, np.uint8)
    h = _GEAR[raw]
    for k in (1, 2, 4):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    ends = np.flatnonzero((h >> np.uint32(32 - PIECE_BITS) == 0) | (raw == 10)) + 1
    out, start = [], 0
    for end in [*ends.tolist(), len(data)] if not len(ends) or ends[-1] < len(data) else ends.tolist():
        while end - start > LONGEST_PIECE:
            start += LONGEST_PIECE
            out.append(start)
        out.append(end)
        start = end
    return out


def tree(text: bytes) -> tuple[str, Pieces]:
    """The fingerprint of a text, and its pieces as (digest, bytes).

    ``root s<section> p<paragraph> <piece>.<bytes> ...`` in hex, depth first: 128 bits for the root and
    32 bits for what is below. The empty text is a root alone.
    """
    digest = xxhash.xxh3_128_digest
    pieces: Pieces = []
    out: list[str] = []
    sections: list[bytes] = []
    paragraphs: list[bytes] = []
    names: list[str] = []
    leaves: list[bytes] = []
    start, end_of_text, first, first_name = 0, len(text), 0, 0
    for end in _cuts(text) if text else ():
        piece = text[start:end]
        leaf = digest(piece)
        leaves.append(leaf)
        pieces.append((leaf[:4], end - start))
        start = end
        if text[end - 1] == 10 or end == end_of_text:
            paragraph = digest(b"".join(leaves))
            paragraphs.append(paragraph)
            names.append("p" + paragraph[:4].hex())
            names += [f"{d.hex()}.{n:x}" for d, n in pieces[first:]]
            blank = len(leaves) == 1 and not piece.strip()
            leaves, first = [], len(pieces)
            if end == end_of_text or blank or paragraph[15] < 32:
                section = digest(b"".join(paragraphs))
                sections.append(section)
                out.append("s" + section[:4].hex())
                out += names
                paragraphs, names = [], []
    root = hashlib.blake2b(b"".join(sections) + end_of_text.to_bytes(8, "big"), digest_size=16).hexdigest()
    return " ".join([root, *out]), pieces


def parse(fingerprint: str) -> Pieces:
    """The pieces that a fingerprint holds."""
    return [(bytes.fromhex(p[:8]), int(p[9:], 16)) for p in fingerprint.split(" ")[1:] if p[0] not in "sp"]


def likeness(a: Pieces, b: Pieces) -> float:
    """Share of bytes in pieces that both texts have, 0 to 1 (1 for two empty texts)."""
    total = sum(n for _, n in a) + sum(n for _, n in b)
    if not total:
        return 1.0
    count: dict[tuple[bytes, int], int] = {}
    for p in a:
        count[p] = count.get(p, 0) + 1
    common = 0
    for p in b:
        if left := count.get(p):
            count[p] = left - 1
            common += p[1]
    return 2 * common / total


def changed(a: str, b: str) -> list[tuple[int, int]]:
    """Byte ranges of the second text under branches that the first one does not have, merged.

    Sections and paragraphs that both have are passed over as a whole.
    """
    known, ranges, at, same = set(a.split(" ")[1:]), [], 0, {"s": False, "p": False}
    for node in b.split(" ")[1:]:
        if node[0] in "sp":
            if node[0] == "s":
                same["p"] = False
            same[node[0]] = node in known
            continue
        n = int(node[9:], 16)
        if not (same["s"] or same["p"] or node in known):
            if ranges and ranges[-1][1] == at:
                ranges[-1] = (ranges[-1][0], at + n)
            else:
                ranges.append((at, at + n))
        at += n
    return ranges


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` of every text, one row per input row. A null text is empty; ids may repeat or
    be null. An empty table gives an empty result."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(schema, doc_id=b.column("doc_id"),
                        fingerprint=[tree(t.as_py().encode())[0] for t in b.column("text")])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = 4) -> DataFrame:
    """Fingerprints of each text, of the text edited, and of the next text, with their likeness.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edits``: the edit replaces
    the last ``n_chars // part`` code points by the first as many of the next document (all, if it has fewer);
    ``edits`` are the byte ranges of the edited text where the trees differ. Next is by ascending id, null ids
    last, ties by a hash of the text; the last document is followed by the first. A null text is empty; a single
    document follows itself; rows are kept one for one. An empty table gives an empty result.

    Runs a job for quantiles of the ids and one for the smallest id of each range between them. Texts are shuffled
    once, by range; the first document of a range is also sent to the range before it.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col)
    ranges = 4 * shuffle_partitions(spark)
    at = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(rows.agg(F.percentile_approx("doc_id", at, 20 * ranges)).first()[0] or []))

    def range_of(ids: pd.Series, missing: pd.Series) -> np.ndarray:
        """Null ids come after the last range."""
        found = np.searchsorted(np.array(bounds, np.int64), ids.to_numpy(), side="right")
        return np.where(missing.to_numpy(), len(bounds) + 1, found)

    # Nulls are passed beside the ids, which pandas would else turn into floats.
    ids = (F.coalesce("doc_id", F.lit(0)), F.isnull("doc_id"))

    @F.pandas_udf("int")
    def own_range(ids: pd.Series, missing: pd.Series) -> pd.Series:
        return pd.Series(range_of(ids, missing))

    heads = rows.groupBy(own_range(*ids).alias("range")).agg(F.min("doc_id").alias("head")).collect()  # one row per range
    order = sorted(r["range"] for r in heads)
    before = {r: order[i - 1] for i, r in enumerate(order)}
    head_of = {r["range"]: r["head"] for r in heads}

    @F.pandas_udf("array<int>")
    def own_and_before(ids: pd.Series, missing: pd.Series) -> pd.Series:
        out = []
        for i, r in zip(ids.tolist(), range_of(ids, missing).tolist()):
            head = head_of[r]
            out.append([r, before[r]] if head is None or i == head else [r, -1])
        return pd.Series(out)

    both = rows.withColumn("ranges", own_and_before(*ids)).withColumn("text_key", F.xxhash64("text"))
    dealt = both.select("doc_id", "text", "text_key", F.posexplode("ranges").alias("following", "range")).filter("range >= 0")
    ordered = dealt.repartition(ranges, "range").sortWithinPartitions(
        "range", "following", F.asc_nulls_last("doc_id"), "text_key")
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                        ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
                        ("near_next", pa.float64()), ("edits", pa.list_(pa.list_(pa.int64())))])

    def pair(this: tuple, following: tuple) -> tuple:
        i, text, (print_, pieces) = this
        n = len(text)
        edited = (text[:n - n // part] + following[1][:n // part]).encode()
        edited_print, edited_pieces = tree(edited)
        return (i, n, hashlib.sha256(edited).hexdigest(), print_, edited_print, likeness(pieces, edited_pieces),
                likeness(pieces, following[2][1]), changed(print_, edited_print))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        this, now, ended = None, None, False
        for b in batches:
            found = []
            for i, text, follows, r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "following", "range"))):
                if r != now:
                    this, now, ended = None, r, False
                if ended:
                    continue
                row = (i, text, tree(text.encode()))
                if this is not None:
                    found.append(pair(this, row))
                this, ended = row, bool(follows)
            if found:
                yield batch(schema, **dict(zip(schema.names, map(list, zip(*found)))))

    return ordered.mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, edits array<array<long>>")
