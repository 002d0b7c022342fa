"""A trie of conversation prefixes as tables of minimal-perfect-hash slots.

A prefix is named by two 64-bit sums over its turns of a hash of the turn and its place; sums run along a range-sorted
table in two levels, so a conversation of any length is spread over tasks. One row per distinct name is a node. Nodes of one
run (a chain of the same members) are totalled first, which leaves at most two runs a conversation. Runs are dealt out by
subtrees of few members. A task gives every run a slot by a minimal perfect hash whose slots hold the whole name, so that a
foreign name is noticed; counts go into flat arrays by slot and are added up through an array of parent slots, the deepest
first. The few runs above these subtrees are added up the same way from what the subtrees report.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskcohort.llm.common import batch, shuffle_partitions
from riskcohort.session import cut_lineage

# A subtree has at most as many members; more where that would leave over TOP nodes above the subtrees.
MEMBERS = 4096
TOP = 1 << 20
# Runs that are put into one table of slots, besides one subtree.
CHUNK = 1 << 18
WORD = r"[^\x20\x09-\x0D]+"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_HEADER, _HEAD, _OWN = 0, 1, 2
_EMPTY = hashlib.sha256(b"").hexdigest()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Slots:
    """A minimal perfect hash of distinct pairs of 64-bit words: a slot from 0 to n - 1 for each.

    Keys that are alone in their cell of a level get a slot there, the others go on to the next level. Slots hold their keys.
    """

    LEVELS = 64

    def __init__(self, first: np.ndarray, second: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, int]] = []
        slot = np.full(len(first), -1, np.int64)
        left, base = np.arange(len(first)), 0
        while len(left):
            if len(self.levels) == self.LEVELS:
                raise RuntimeError("two prefixes have one name")
            size = len(left) + len(left) // 4 + 1
            cell = self._cell(first[left], second[left], len(self.levels), size)
            alone = np.bincount(cell, minlength=size) == 1
            rank = np.where(alone, np.cumsum(alone) - 1 + base, -1)
            slot[left] = rank[cell]
            self.levels.append((rank, size))
            base += int(alone.sum())
            left = left[slot[left] < 0]
        self.slot = slot
        self.first, self.second = np.empty(len(slot), np.uint64), np.empty(len(slot), np.uint64)
        self.first[slot], self.second[slot] = first, second

    @staticmethod
    def _cell(first: np.ndarray, second: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(first ^ mixed(second + np.uint64((level + 1) * int(_STEP) % (1 << 64)))) % np.uint64(size)).astype(np.int64)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Slots of keys; -1 for a key that has none."""
        out, left = np.full(len(first), -1, np.int64), np.arange(len(first))
        for level, (rank, size) in enumerate(self.levels):
            found = rank[self._cell(first[left], second[left], level, size)]
            out[left] = found
            left = left[found < 0]
        known = np.flatnonzero(out >= 0)
        same = (self.first[out[known]] == first[known]) & (self.second[out[known]] == second[known])
        out[known[~same]] = -1
        return out


def _slim(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """A row per turn without its text."""
    r, t = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    return (turns.select(F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"),
                         F.xxhash64(F.lit(1), r, t).alias("t1"), F.xxhash64(F.lit(2), r, t).alias("t2"),
                         F.regexp_count(t, F.lit(WORD)).cast("long").alias("words")).filter("conv is not null"))


def _rebuilt(slim: DataFrame, every: int, head: Column) -> DataFrame:
    """Rows of the rebuilt conversations in their order, some own turns still to be left out: those up to ``skip``."""
    heads = (slim.filter(F.col("conv") % every == 0)
             .withColumn("turn", F.row_number().over(Window.partitionBy("conv").orderBy("turn", "t1", "t2")))
             .filter("turn <= 3").groupBy(F.col("conv").alias("donor"))
             .agg(F.array_sort(F.collect_list(F.struct("turn", "t1", "t2", "words"))).alias("heads")))  # three at most
    convs = slim.groupBy("conv").agg(F.count("*").alias("own")).withColumns(
        {"skip": head.cast("int"), "donor": F.col("conv") - F.col("conv") % every}).join(heads, "donor", "left")
    taken = F.slice(F.coalesce("heads", F.array().cast("array<struct<turn:int,t1:bigint,t2:bigint,words:bigint>>")), F.lit(1), F.col("skip"))
    length = F.size(taken) + F.greatest(F.col("own") - F.col("skip"), F.lit(0))
    convs = cut_lineage(convs.select("conv", "skip", taken.alias("heads"), length.cast("long").alias("len")))
    zero = F.lit(0).cast("long")
    headers = convs.select("conv", F.lit(_HEADER).alias("kind"), zero.alias("turn"), zero.alias("t1"), zero.alias("t2"),
                           zero.alias("words"), "len", "skip")
    given = convs.select("conv", F.explode("heads").alias("h"), "len", "skip").select(
        "conv", F.lit(_HEAD).alias("kind"), F.col("h.turn").cast("long").alias("turn"), "h.t1", "h.t2", "h.words", "len", "skip")
    own = slim.select("conv", F.lit(_OWN).alias("kind"), "turn", "t1", "t2", "words", zero.alias("len"), head.cast("int").alias("skip"))
    return headers.unionByName(given).unionByName(own)


def _in_ranges(rows: DataFrame, *order: str) -> DataFrame:
    """Stored in one order over all partitions, with the number of the partition."""
    n = shuffle_partitions(rows.sparkSession)
    return cut_lineage(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))


def _columns(b: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [b.column(n).to_numpy(zero_copy_only=False) for n in names]


def _starts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and the number of the run of each row."""
    new = np.r_[True, values[1:] != values[:-1]]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _within(values: np.ndarray, starts: np.ndarray, run: np.ndarray, carried: np.generic) -> np.ndarray:
    """Running sums inside runs; ``carried`` comes before the first one."""
    total = np.cumsum(values, dtype=values.dtype)
    before = (total[starts] - values[starts]).astype(values.dtype)
    before[:1] -= carried
    return total - before[run]


class _Walk:
    """Reads rows of a partition in order; remembers the last conversation and its sums."""

    def __init__(self, conv: int | None = None, own: int = 0, kept: int = 0, length: int = 0, d1: int = 0, d2: int = 0) -> None:
        self.conv, self.own, self.kept, self.length, self.d1, self.d2 = conv, own, kept, length, np.uint64(d1), np.uint64(d2)

    def read(self, b: pa.RecordBatch) -> dict[str, np.ndarray]:
        conv, kind, t1, t2, words, length, skip = _columns(b, "conv", "kind", "t1", "t2", "words", "len", "skip")
        starts, run = _starts(conv)
        if conv[0] != self.conv:
            self.__init__(int(conv[0]))
        own = _within((kind == _OWN).astype(np.int64), starts, run, np.int64(self.own))
        keep = (kind != _OWN) | (own > skip)
        kept = _within(keep.astype(np.int64), starts, run, np.int64(self.kept))
        depth = kept - 1
        lengths = length[starts].copy()  # a conversation begins with its header
        if kind[0] != _HEADER:
            lengths[0] = self.length
        out = {"conv": conv, "depth": depth, "words": words, "ends": depth == lengths[run]}
        for name, t in (("1", t1), ("2", t2)):
            turn = mixed(t.view(np.uint64) + depth.astype(np.uint64) * _STEP)
            turn[~keep | (kind == _HEADER)] = 0
            out[f"d{name}"] = _within(turn, starts, run, getattr(self, f"d{name}"))
            out[f"p{name}"] = out[f"d{name}"] - turn
        self.conv, self.own, self.kept, self.length = int(conv[-1]), int(own[-1]), int(kept[-1]), int(lengths[-1])
        self.d1, self.d2 = out["d1"][-1], out["d2"][-1]
        return {k: v[keep] for k, v in out.items()}


_TAIL = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("own", pa.int64()), ("other", pa.int64()),
                   ("skip", pa.int64()), ("len", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64())])
_TAIL_DDL = "part int, first long, last long, own long, other long, skip long, len long, d1 long, d2 long"
_ROW = pa.schema([("conv", pa.int64()), ("depth", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("p1", pa.int64()),
                  ("p2", pa.int64()), ("words", pa.int64()), ("ends", pa.int64())])
_ROW_DDL = "conv long, depth long, d1 long, d2 long, p1 long, p2 long, words long, ends long"


def _prefixes(ranged: DataFrame) -> DataFrame:
    """A row per conversation and depth with the names of the prefix and of the one before. Runs two small jobs."""
    def tails(carried: dict[int, tuple]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            walk, first, part, tail, own, other, skip, length = None, 0, 0, None, 0, 0, 0, 0
            for b in batches:
                if not b.num_rows:
                    continue
                conv, kind, len_, skips = _columns(b, "conv", "kind", "len", "skip")
                if walk is None:
                    first, part = int(conv[0]), b.column("part")[0].as_py()
                    walk = _Walk(*carried.get(part, (None,)))
                if conv[-1] != tail:
                    tail, own, other, length = int(conv[-1]), 0, 0, 0
                same = conv == tail
                own, other = own + int((same & (kind == _OWN)).sum()), other + int((same & (kind != _OWN)).sum())
                skip, length = int(skips[-1]), max(length, int(len_[same].max()))
                walk.read(b)
            if walk is not None:
                yield batch(_TAIL, part=[part], first=[first], last=[tail], own=[own], other=[other], skip=[skip], len=[length],
                            d1=np.array([walk.d1], np.uint64).view(np.int64), d2=np.array([walk.d2], np.uint64).view(np.int64))

        return run

    def read(carried: dict[int, tuple]) -> list:
        # One row per partition.
        return sorted(ranged.mapInArrow(tails(carried), _TAIL_DDL).collect(), key=lambda r: r.part)

    # What the partitions before have of a partition's first conversation: counts first, for a turn's part of the sums
    # depends on its place.
    placed: dict[int, tuple] = {}
    at, own, other, length, skip = None, 0, 0, 0, 0
    for r in read({}):
        if at is not None and r.first < at:
            raise RuntimeError("partitions are not in order")
        if r.first == at:
            placed[r.part] = (at, own, other + max(0, own - skip), length)
        if r.first != at or r.last != r.first:
            own = other = length = 0
        at, own, other, length, skip = r.last, own + r.own, other + r.other, max(length, r.len), r.skip
    at, d1, d2, carried = None, 0, 0, {}
    for r in read(placed):
        if r.first == at:
            carried[r.part] = (*placed[r.part], d1, d2)
        whole = r.first == at and r.last == r.first
        d1, d2 = ((d1 if whole else 0) + r.d1) % (1 << 64), ((d2 if whole else 0) + r.d2) % (1 << 64)
        at = r.last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        for b in batches:
            if b.num_rows:
                walk = walk or _Walk(*carried.get(b.column("part")[0].as_py(), (None,)))
                found = walk.read(b)
                yield batch(_ROW, **{k: v.view(np.int64) if v.dtype == np.uint64 else v.astype(np.int64) for k, v in found.items()})

    return ranged.mapInArrow(run, _ROW_DDL)


_NODE = pa.schema([*[(n, pa.int64()) for n in ("conv", "depth", "d1", "d2", "p1", "p2", "words", "ends", "n")], ("part", pa.int32()),
                   ("start", pa.int64()), ("upto", pa.int64())])
_NODE_DDL = ("conv long, depth long, d1 long, d2 long, p1 long, p2 long, words long, ends long, n long, part int, start long, "
             "upto long")


def _runs(nodes: DataFrame) -> DataFrame:
    """Nodes with the depth at which their run starts, and the words of the run up to them. A partition cuts a run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, 0, 0, 0)  # conversation, members, start, words so far
        for b in batches:
            if not b.num_rows:
                continue
            conv, n, depth, words = _columns(b, "conv", "n", "depth", "words")
            starts, piece = _pairs(conv, n)
            start, upto = depth[starts].copy(), np.int64(0)
            if last[:2] == (int(conv[0]), int(n[0])):
                start[0], upto = last[2], np.int64(last[3])
            total = _within(words, starts, piece, upto)
            last = (int(conv[-1]), int(n[-1]), int(start[-1]), int(total[-1]))
            yield batch(_NODE, **{k: b.column(k) for k in _NODE.names[:10]}, start=start[piece], upto=total)

    ranged = _in_ranges(nodes, "conv", "depth")
    return ranged.select(*_NODE.names[:10]).mapInArrow(run, _NODE_DDL)


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    return np.flatnonzero(new), np.cumsum(new) - 1


_PIECE = ("part", "conv", "start", "n", "words", "d1", "d2", "p1", "p2", "u1", "u2", "leaves", "saved", "children")
_DONE = pa.schema([("part", pa.int32()), *[(n, pa.int64()) for n in ("conv", "start", "leaves", "below", "children", "saved", "parent", "p1", "p2")],
                   ("root", pa.bool_())])
_DONE_DDL = "part int, conv long, start long, leaves long, below long, children long, saved long, parent long, p1 long, p2 long, root boolean"


def totals(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Totals over subtrees of runs, whatever of them is here. ``leaves, saved, children``: what others report below a run.

    ``saved`` becomes the total with the run's own words, ``below`` is without; ``parent`` is the parent's conversation,
    meaningful where ``root`` (no parent here) is false.
    """
    names = {k: np.ascontiguousarray(x[k]).view(np.uint64) for k in ("d1", "d2", "p1", "p2")}
    table = Slots(names["d1"], names["d2"])
    slot, n = table.slot, len(table.slot)
    above = table.find(names["p1"], names["p2"])
    above[above == slot] = -1  # the root's own name is its parent's
    parent, flat = np.empty(n, np.int64), {}
    parent[slot] = above
    for k in ("conv", "n", "words", "start", "leaves", "saved", "children"):
        flat[k] = np.empty(n, np.int64)
        flat[k][slot] = x[k]
    inner = np.flatnonzero(parent >= 0)
    children = flat["children"] + np.bincount(parent[inner], minlength=n)
    leaves = flat["leaves"] + (children == 0)
    below, own = flat["saved"], (flat["n"] - 1) * flat["words"]
    # The deepest first: a run's parent starts higher.
    order = inner[np.argsort(-flat["start"][inner], kind="stable")]
    for level in np.split(order, np.flatnonzero(np.diff(flat["start"][order])) + 1):
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(below, parent[level], below[level] + own[level])
    found = {"leaves": leaves, "below": below, "children": children, "saved": below + own,
             "parent": np.where(parent >= 0, flat["conv"][np.maximum(parent, 0)], -1), "root": parent < 0}
    return {k: v[slot] for k, v in found.items()}


def _totalled(pieces: DataFrame) -> DataFrame:
    """Totals of every subtree; rows of a subtree lie together in a partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(parts: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
            x = {k: np.concatenate([p[k] for p in parts]) for k in _PIECE}
            return batch(_DONE, **{k: x[k] for k in ("part", "conv", "start", "p1", "p2")}, **totals(x))

        held: list[dict[str, np.ndarray]] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(dict(zip(_PIECE, _columns(b, *_PIECE))))
            if sum(len(h["u1"]) for h in held) < CHUNK:
                continue
            x = held[-1]
            cut = int(_pairs(x["u1"], x["u2"])[0][-1])  # the last subtree may go on
            if cut:
                yield told([*held[:-1], {k: v[:cut] for k, v in x.items()}])
                held = [{k: v[cut:] for k, v in x.items()}]
        if held:
            yield told(held)

    return pieces.select(*_PIECE).mapInArrow(run, _DONE_DDL)


def _ended(rows: DataFrame) -> DataFrame:
    """``d1, d2, ends_sha256``: ids of the conversations that end at a prefix, read in order and never held together."""
    schema = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, hashlib.sha256()
        for b in batches:
            if not b.num_rows:
                continue
            d1, d2, conv = _columns(b, "d1", "d2", "conv")
            out: list[tuple[int, int, str]] = []
            starts, _ = _pairs(d1, d2)
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(d1)]):
                name, ids = (int(d1[s]), int(d2[s])), ",".join(map(str, conv[s:e].tolist()))
                if name == last:
                    state.update(f",{ids}".encode())
                else:
                    if last is not None:
                        out.append((*last, state.hexdigest()))
                    last, state = name, hashlib.sha256(ids.encode())
            if out:
                yield batch(schema, **dict(zip(schema.names, map(list, zip(*out)))))
        if last is not None:
            yield batch(schema, d1=[last[0]], d2=[last[1]], ends_sha256=[state.hexdigest()])

    dealt = rows.filter("ends = 1").select("d1", "d2", "conv").repartition("d1", "d2").sortWithinPartitions("d1", "d2", "conv")
    return dealt.mapInArrow(run, "d1 long, d2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                every: int = 1, head: Column | None = None, members: int = MEMBERS) -> DataFrame:
    """A row per distinct prefix of the conversations: ``conv_id`` (the smallest member), ``depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256``.

    Turns are ordered by their number, null first, then by hashes of role and text; rows that repeat are turns each. A null
    role or text is empty; turns are equal if both are. Rows without a conversation take no part; an empty table gives no
    rows, any other one the textless root. ``head`` (at most 3, a column of ``conv``) replaces the first turns of conversation
    c by as many of conversation ``c - c % every``; by default conversations are taken as they are. Names of prefixes have
    128 bits, and runs are told apart by whole names.

    Runs jobs; turns, rows, nodes and runs are checkpointed. ``ends_sha256`` reads the ids of one node in one task, one after
    the other: a digest of a list has no other way.
    """
    head = F.lit(0) if head is None else head
    slim = cut_lineage(_slim(turns, conv_col, turn_col, role_col, text_col))
    ranged = _in_ranges(_rebuilt(slim, every, head), "conv", "kind", "turn", "t1", "t2")
    rows = cut_lineage(_prefixes(ranged))
    nodes = rows.groupBy("depth", "d1", "d2").agg(
        F.min("conv").alias("conv"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("words").alias("words"),
        F.sum("ends").alias("ends"), F.count("*").alias("n"))
    nodes = cut_lineage(_runs(nodes.select("conv", "depth", "d1", "d2", "p1", "p2", "words", "ends", "n")))
    # Each depth of a conversation is in one node, so no more than TOP nodes have more members than this.
    many = max(members, rows.count() // TOP)
    pieces = cut_lineage(nodes.groupBy("part", "conv", "start").agg(
        F.first("n").alias("n"), F.sum("words").alias("words"), F.max("depth").alias("stop"),
        F.max_by(F.struct("d1", "d2"), "depth").alias("d"), F.min_by(F.struct("p1", "p2"), "depth").alias("p"))
        .select("part", "conv", "start", "stop", "n", "words", "d.d1", "d.d2", "p.p1", "p.p2"))
    crowded = nodes.filter(F.col("n") > many).select("d1", "d2")
    subtree = (rows.join(F.broadcast(crowded), ["d1", "d2"], "left_anti").groupBy("conv")
               .agg(F.min(F.struct("depth", "d1", "d2")).alias("u")).select("conv", F.col("u.d1").alias("u1"), F.col("u.d2").alias("u2")))
    zero = F.lit(0).cast("long")
    nothing = {"leaves": zero, "saved": zero, "children": zero}
    low = (pieces.filter(F.col("n") <= many).join(subtree, "conv").withColumns(nothing)
           .repartition("u1", "u2").sortWithinPartitions("u1", "u2"))
    low = cut_lineage(_totalled(low))
    reports = (low.filter("root").groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2"))
               .agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count("*").alias("children")))
    upper = pieces.filter(F.col("n") > many).join(reports, ["d1", "d2"], "left").fillna(0, ["leaves", "saved", "children"])
    # At most TOP nodes, and one run more for each partition.
    high = cut_lineage(_totalled(upper.withColumns({"u1": zero, "u2": zero}).repartition(1)))
    names = F.broadcast(pieces.filter(F.col("n") > many).select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv").alias("above")))
    low = low.join(names, ["p1", "p2"], "left").withColumn("parent", F.when(F.col("root"), F.col("above")).otherwise(F.col("parent")))
    columns = ["part", "conv", "start", "leaves", "below", "children", "parent"]
    done = low.select(*columns).unionByName(high.select(*columns)).join(
        pieces.select("part", "conv", "start", "stop", F.col("words").alias("all_words")), ["part", "conv", "start"])
    met = nodes.join(done, ["part", "conv", "start"]).join(_ended(rows), ["d1", "d2"], "left")
    return met.select(
        F.col("conv").alias("conv_id"), "depth",
        F.when(F.col("depth") == 0, None).when(F.col("depth") > F.col("start"), F.col("conv")).otherwise(F.col("parent")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(F.col("depth") < F.col("stop"), 1).otherwise(F.col("children")).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        ((F.col("n") - 1) * (F.col("all_words") - F.col("upto") + F.col("words")) + F.col("below")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
