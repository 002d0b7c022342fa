"""SimHash fingerprints and near-duplicate groups.

A fingerprint of 64 bits is embedded as the bit counts of its segments. The Manhattan distance of
two embeddings never exceeds the Hamming distance of the fingerprints, so a range join of the
embeddings on a grid finds every linked pair; the pairs it finds are verified on the bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from riskcohort.llm.common import batch, id_and_text, texts_as_bytes
from riskcohort.llm.components import connected
from riskcohort.session import cut_lineage

SHINGLE = 3
SEED = 42
BITS = 64
LINK_BITS = 3

_SIGNED = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def _fingerprint(text: bytes, words: int, block: int = 1 << 14) -> int:
    found = text.lower().split()
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    votes = np.zeros(BITS, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for start in range(0, n, block):
        stop = min(n, start + block)
        if words == 3 and len(found) >= 3:
            grams = map(b"%b %b %b".__mod__, zip(found[start:stop], found[start + 1:], found[start + 2:]))
        else:
            grams = (join(found[i:i + words]) for i in range(start, stop))
        hashes = np.fromiter((digest(g, SEED) for g in grams), np.uint64, stop - start)
        # Counts of 64 bits: the bytes of a hash are unpacked, least significant bit first.
        votes += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                               bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((votes * 2 > n).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (signed 64 bits) of every text, one row per input row.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. A text of fewer words than
    a shingle is one shingle; a text without words, or a null one, has the fingerprint 0.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(_SIGNED, doc_id=b.column("doc_id"),
                        fp=[_fingerprint(t, words) for t in texts_as_bytes(b.column("text"))])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


# Grid of the range join: the bits are cut into groups of 8, a cell is given by the embeddings of 5
# groups. A distance of at most 3 leaves at least 5 of 8 groups at distance 0, so linked
# fingerprints share a cell. A segment has 2 bits, a group 4 segments.
GROUPS = 8
EVEN = 0x5555555555555555
BLOCK = 256
# Cells above this size are compared inside exact cells of 52 bits, which hold at most 4096 points.
CROWD = 4096

_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _embedded(x: np.ndarray) -> np.ndarray:
    """Bit counts of the 2-bit segments in unary (0: 00, 1: 01, 2: 11), so that the Manhattan distance
    of two embeddings is the number of bits in which they differ."""
    m = np.uint64(EVEN)
    half = x >> np.uint64(1)
    return ((x | half) & m) | ((x & half & m) << np.uint64(1))


def _near(x: np.ndarray, ex: np.ndarray, rows: np.ndarray, columns: np.ndarray, most: int) -> np.ndarray:
    """Which ``columns`` lie within ``most`` bits of any of ``rows``."""
    hit = np.zeros(len(columns), bool)
    for start in range(0, len(rows), BLOCK):
        block = rows[start:start + BLOCK]
        i, j = np.nonzero(np.bitwise_count(ex[block][:, None] ^ ex[columns][None, :]) <= most)
        hit[j[np.bitwise_count(x[block[i]] ^ x[columns[j]]) <= most]] = True
    return hit


def _stars(x: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links that connect the linked points of a cell: index pairs (first of its component, member)."""
    ex, out = _embedded(x), []
    left = np.arange(len(x))
    while len(left) > 1:
        seed, left = left[0], left[1:]
        frontier = np.array([seed])
        while len(frontier) and len(left):
            hit = _near(x, ex, frontier, left, most)
            frontier, left = left[hit], left[~hit]
            out += [(seed, j) for j in frontier.tolist()]
    return out


def _crowd_stars(x: np.ndarray, most: int) -> list[tuple[int, int]]:
    """As ``_stars``, for many points: only points that agree on 13 of 16 groups of 4 bits are compared."""
    parent = np.arange(len(x))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for chosen in combinations(range(16), most):
        keep = np.uint64((1 << 64) - 1 - sum(0xF << (4 * g) for g in chosen))
        key = x & keep
        order = np.argsort(key, kind="stable")
        edges = np.flatnonzero(np.diff(key[order])) + 1
        for run in np.split(order, edges):
            if len(run) > 1:
                for i, j in _stars(x[run], most):
                    a, b = root(int(run[i])), root(int(run[j]))
                    parent[max(a, b)] = min(a, b)
    roots = [root(i) for i in range(len(x))]
    return [(r, i) for i, r in enumerate(roots) if r != i]


def _linked(cell: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of the runs of equal ``cell`` in sorted arrays."""
    x = fp.view(np.uint64)
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[starts, len(cell)])
    two = starts[sizes == 2]
    ex = _embedded(x)
    two = two[np.bitwise_count(ex[two] ^ ex[two + 1]) <= most]
    two = two[np.bitwise_count(x[two] ^ x[two + 1]) <= most]
    a, b = [fp[two]], [fp[two + 1]]
    for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
        run = x[s:s + n]
        found = (_stars if n <= CROWD else _crowd_stars)(run, most)
        if found:
            i, j = np.array(found).T
            a.append(fp[s + i])
            b.append(fp[s + j])
    return np.concatenate(a), np.concatenate(b)


def links(points: DataFrame, most: int = LINK_BITS) -> DataFrame:
    """``a, b``: links between distinct fingerprints ``fp`` that connect all that differ in at most ``most`` bits.

    A cell of n points yields at most n - 1 rows: pairs are compared in blocks inside the task, and only
    a star per connected part leaves it.
    """
    if not 0 <= most <= 3:
        raise ValueError("the grid covers distances up to 3")
    half = F.shiftrightunsigned("fp", 1)
    counts = F.col("fp").bitwiseOR(half).bitwiseAND(EVEN).bitwiseOR(
        F.shiftleft(F.col("fp").bitwiseAND(half).bitwiseAND(EVEN), 1))
    masks = [sum(0xFF << (8 * g) for g in chosen) for chosen in combinations(range(GROUPS), GROUPS - 3)]
    cells = [F.xxhash64(F.lit(k), F.col("n").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)))
             for k, m in enumerate(masks)]
    spread = (points.select("fp", counts.alias("n")).select(F.explode(F.array(*cells)).alias("cell"), "fp")
              .repartition("cell").sortWithinPartitions("cell", "fp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, fp = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            cell = np.concatenate([cell, b.column("cell").to_numpy()])
            fp = np.concatenate([fp, b.column("fp").to_numpy()])
            # The last run may go on in the next batch.
            cut = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
            if cut:
                x, y = _linked(cell[:cut], fp[:cut], most)
                cell, fp = cell[cut:], fp[cut:]
                yield batch(_LINK, a=x, b=y)
        if len(cell):
            x, y = _linked(cell, fp, most)
            yield batch(_LINK, a=x, b=y)

    return spread.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE,
                    most: int = LINK_BITS) -> DataFrame:
    """``doc_id, fp, component_id``: groups of documents whose fingerprints are linked, directly or over others.

    ``component_id`` is the smallest document id of the group. Null and wordless texts share the
    fingerprint 0. Rows with a repeated or null id are kept, one row each (a null id is never the smallest,
    unless all of a group are null). An empty table gives an empty result. Runs jobs: the fingerprints
    and the rounds of the components are checkpointed.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col, words))
    points = prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    parts = connected(links(points.select("fp"), most).toDF("u", "v"))
    labelled = (points.join(parts.withColumnsRenamed({"node": "fp"}), "fp", "left")
                .withColumn("root", F.coalesce("root", "fp")))
    smallest = labelled.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    groups = labelled.join(smallest, "root").select("fp", "component_id")
    return prints.join(groups, "fp").select("doc_id", "fp", "component_id")


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE,
                    most: int = LINK_BITS) -> DataFrame:
    """``doc_id, text_key, n``: one row per group of linked fingerprints, with how many rows share its id and text.

    The group's row has the smallest id (null comes last), then the smallest ``text_key``, the xxhash64 of the text (null
    as empty). Null and wordless texts are one group. An empty table gives an empty result. Runs jobs: the
    fingerprints and the rounds of the components are checkpointed.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    prints = (fingerprints(rows, "text_key", "text", words).withColumnRenamed("doc_id", "text_key")
              .groupBy("text_key").agg(F.min("fp").alias("fp")))
    keys = rows.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).join(prints, "text_key")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "n")
    points = cut_lineage(keys.groupBy("fp").agg(F.min(first).alias("first")))
    parts = connected(links(points.select("fp"), most).toDF("u", "v"))
    grouped = (points.join(parts.withColumnsRenamed({"node": "fp"}), "fp", "left")
               .groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first")))
    return grouped.select("first.doc_id", "first.text_key", "first.n")
