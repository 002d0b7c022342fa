"""Suffix sorting of a byte string by induction, with common-prefix values, in bounded memory.

Suffixes are compared up to ``depth`` bytes only, which is all that a search for repeats of that length needs.
The queues hold tuples of a suffix and its common prefix with the tuple before it; what exceeds the memory given
to them is on disk until its bucket comes up.
"""

from __future__ import annotations

import tempfile
from collections import deque
from collections.abc import Iterator

import numpy as np

MEMORY = 64 << 20


class BucketQueue:
    """A priority queue of (suffix, common prefix) tuples with byte keys.

    Tuples of a key come in the order in which they leave, so every key has a queue of its own, and the smallest
    (or largest) key that is not empty is taken as a whole. Blocks beyond ``memory`` bytes are written to one
    temporary file, which is gone when the queue is.
    """

    def __init__(self, memory: int = MEMORY) -> None:
        self.memory, self.held, self.file = memory, 0, None
        self.blocks: list[deque] = [deque() for _ in range(256)]

    def push(self, key: int, suffixes: np.ndarray, prefixes: np.ndarray) -> None:
        size = suffixes.nbytes + prefixes.nbytes
        if self.held + size <= self.memory:
            self.held += size
            self.blocks[key].append((suffixes, prefixes))
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        suffixes.tofile(self.file)
        prefixes.tofile(self.file)
        self.blocks[key].append((at, len(suffixes), suffixes.dtype, prefixes.dtype))

    def pop(self, key: int, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray] | None:
        """The next tuples of a key, about ``most``, or None."""
        found, size = [], 0
        while self.blocks[key] and size < most:
            found.append(self._load(self.blocks[key].popleft()))
            size += len(found[-1][0])
        if len(found) > 1:
            return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
        return found[0] if found else None

    def pop_last(self, key: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The last block of a key, or None."""
        return self._load(self.blocks[key].pop()) if self.blocks[key] else None

    def _load(self, block: tuple) -> tuple[np.ndarray, np.ndarray]:
        if len(block) == 2:
            self.held -= block[0].nbytes + block[1].nbytes
            return block
        at, n, kind, prefix_kind = block
        self.file.seek(at)
        return np.fromfile(self.file, kind, n), np.fromfile(self.file, prefix_kind, n)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class _Pusher:
    """Hands predecessors on to a queue, with the common prefix of neighbours in their new order.

    The suffixes before two sorted ones share one byte more than these do, if they begin alike; and what two sorted
    ones share is the smallest value between them in the order.
    """

    def __init__(self, text: np.ndarray, small: np.ndarray, want_small: bool, queue: BucketQueue, depth: int | None) -> None:
        self.text, self.small, self.want_small, self.queue, self.depth = text, small, want_small, queue, depth
        self.least = np.full(256, 255, np.uint8)  # smallest value since the last tuple of each key
        self.seen = np.zeros(256, bool)

    def push(self, suffixes: np.ndarray, values: np.ndarray) -> None:
        """Predecessors of the sorted ``suffixes``; ``values`` are what each shares with the one before it."""
        before = suffixes - 1
        rows = np.flatnonzero(before >= 0)
        rows = rows[self.small[before[rows]] == self.want_small]
        done = np.zeros(256, bool)
        if len(rows):
            keys = self.text[before[rows]]
            order = np.argsort(keys, kind="stable")
            rows, keys = rows[order], keys[order]
            starts = np.r_[0, np.flatnonzero(np.diff(keys)) + 1]
            for key, part in zip(keys[starts].tolist(), np.split(rows, starts[1:])):
                if self.depth is None:
                    self.queue.push(key, before[part], np.zeros(len(part), np.uint8))
                    continue
                # Segments: after the previous tuple of the key up to each new one, and what follows the last.
                cut = np.r_[0, part + 1]
                tail = cut[-1] < len(values)
                smallest = np.minimum.reduceat(values, cut if tail else cut[:-1])
                new = np.minimum(smallest[:len(part)], self.depth - 1) + np.uint8(1)
                first = min(int(smallest[0]), int(self.least[key]))
                new[0] = min(first + 1, self.depth) if self.seen[key] else 0
                self.queue.push(key, before[part], new)
                self.least[key] = smallest[-1] if tail else 255
                self.seen[key] = done[key] = True
        if self.depth is not None and len(values):
            np.minimum(self.least, values.min(), out=self.least, where=~done)


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that the suffixes ``a`` and ``b`` share, up to ``depth``."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    eights = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
    out = np.zeros(len(a), np.int64)
    rows = np.arange(len(a))
    for at in range(0, depth, 8):
        x = (np.ascontiguousarray(eights[a[rows] + at]).view("<u8") ^ np.ascontiguousarray(eights[b[rows] + at]).view("<u8")).ravel()
        same = x == 0
        out[rows] += np.where(same, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) // 8)
        rows = rows[same]
        rows = rows[np.maximum(a[rows], b[rows]) + at + 8 < n]
        if not len(rows):
            break
    return np.minimum(np.minimum(out, depth), n - np.maximum(a, b)).astype(np.uint8)


def types(text: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the one that follows them; the last one is larger than the empty one."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1] = -1
    known = np.flatnonzero(step)
    return np.repeat(step[known], np.diff(known, prepend=-1)) > 0


def induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, prefixes: np.ndarray | None, depth: int,
           memory: int = MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes from the sorted leftmost small ones ``seeds``, largest first: blocks of (suffix, value).

    Large suffixes are induced with ascending keys, and small ones from all of these with descending keys. A value is
    what the suffix shares with the one given out before it, up to ``depth``; without ``prefixes`` (what each seed
    shares with the one before it) the values mean nothing.
    """
    carried = None if prefixes is None else depth

    def seam(a: int, b: int) -> int:
        return int(common_prefixes(text, np.array([a]), np.array([b]), depth)[0]) if carried else 0

    edges = np.searchsorted(text[seeds], np.arange(257))
    values_of_seeds = np.zeros(len(seeds), np.uint8) if prefixes is None else prefixes
    rising, large, falling = BucketQueue(memory), BucketQueue(memory), BucketQueue(memory)
    try:
        to = _Pusher(text, small, False, rising, carried)
        last = np.array([len(text)], seeds.dtype)  # the empty suffix
        to.push(last, np.zeros(1, np.uint8))
        for key in range(256):
            before = -1
            while (block := rising.pop(key)) is not None:
                suffixes, values = block
                if before < 0:
                    values[0] = 0
                before = int(suffixes[-1])
                to.push(suffixes, values)
                large.push(key, suffixes, values)
            i, j = edges[key], edges[key + 1]
            if i < j:
                values = values_of_seeds[i:j].copy()
                values[0] = seam(before, int(seeds[i])) if before >= 0 else 0
                to.push(seeds[i:j], values)
        to = _Pusher(text, small, True, falling, carried)
        for key in range(255, -1, -1):
            before = -1
            while (block := falling.pop(key)) is not None:
                suffixes, values = block
                if before < 0:
                    values[0] = 0
                before = int(suffixes[-1])
                to.push(suffixes, values)
                yield suffixes, values
            shared = -1
            while (block := large.pop_last(key)) is not None:
                suffixes, values = block[0][::-1], block[1]
                if shared < 0:
                    shared = seam(before, int(suffixes[0])) if before >= 0 else 0
                turned = np.r_[np.uint8(shared), values[:0:-1]]
                shared = int(values[0])
                to.push(suffixes, turned)
                yield suffixes, turned
    finally:
        for q in (rising, large, falling):
            q.close()


def _names(text: np.ndarray, leftmost: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Ranks of the substrings between neighbouring ``leftmost`` small suffixes, which ``ordered`` has in order."""
    n, m = len(text), len(leftmost)
    ends = np.minimum(np.r_[leftmost[1:], n - 1] + 1, n)
    place = np.empty(n, np.int64)
    place[leftmost] = np.arange(m)
    rows = place[ordered]
    size = (ends - leftmost)[rows]
    start = leftmost[rows]
    same = np.r_[False, size[1:] == size[:-1]]
    check = np.flatnonzero(same)
    # Equal lengths: compare the bytes, 248 at a time.
    at = np.zeros(len(check), np.int64)
    while len(check):
        left = np.minimum(size[check] - at, 248)
        equal = common_prefixes(text, start[check] + at, start[check - 1] + at, int(left.max())) >= left
        same[check[~equal]] = False
        at += left
        go = equal & (at < size[check])
        check, at = check[go], at[go]
    names = np.empty(m, np.int64)
    names[rows] = np.cumsum(~same)
    return names


def _doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes of a string of names; a name stands for two bytes or more, and ``depth`` bytes count.

    Equal suffixes share the place of the first of them, so that a round sorts only those not yet told apart.
    """
    m = len(names)
    order = np.argsort(names, kind="stable")
    rows, covered = order, 1
    sorted_names = names[order]
    heads = np.flatnonzero(np.r_[True, sorted_names[1:] != sorted_names[:-1]])
    rank = np.empty(m, np.int64)
    rank[order] = np.repeat(heads, np.diff(np.r_[heads, m]))
    while 2 * covered < depth:
        # Of the rows sorted so far, those whose place is shared.
        places = rank[rows]
        shared = np.r_[False, places[1:] == places[:-1]]
        rows = rows[shared | np.r_[shared[1:], False]]
        if not len(rows):
            break
        following = rows + covered
        pair = rank[rows] << 32 | np.where(following < m, rank[np.minimum(following, m - 1)] + 1, 0)
        order = np.argsort(pair, kind="stable")
        rows, pair = rows[order], pair[order]
        base = pair >> 32
        new = np.r_[True, pair[1:] != pair[:-1]]
        first_of_base = np.flatnonzero(np.r_[True, base[1:] != base[:-1]])
        at = np.arange(len(rows)) - np.repeat(first_of_base, np.diff(np.r_[first_of_base, len(rows)]))
        heads = np.flatnonzero(new)
        rank[rows] = base + np.repeat(at[heads], np.diff(np.r_[heads, len(rows)]))
        covered *= 2
    return rank


def suffixes(text: np.ndarray, depth: int, memory: int = MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes of ``text`` in the order of their first ``depth`` bytes (at most 254), largest first.

    Blocks of (suffix, bytes shared with the suffix given out before it, at most ``depth``). Leftmost small suffixes
    are sorted first: inducing sorts the substrings between them, the names of these form a shorter string, and its
    suffixes are ranked by doubling, which ends when ranks differ or ``depth`` bytes are covered.
    """
    if not len(text):
        return
    small = types(text)
    kind = np.int32 if len(text) < 1 << 31 else np.int64
    leftmost = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(kind)
    prefixes = np.zeros(len(leftmost), np.uint8)
    if len(leftmost) > 1:
        rough = leftmost[np.argsort(text[leftmost], kind="stable")]
        is_leftmost = np.zeros(len(text), bool)
        is_leftmost[leftmost] = True
        found = [block[is_leftmost[block]] for block, _ in induce(text, small, rough, None, depth, memory)]
        rank = _names(text, leftmost, np.concatenate(found)[::-1])
        rank = _doubled(rank, depth)
        leftmost = leftmost[np.argsort(rank, kind="stable")]
        prefixes[1:] = common_prefixes(text, leftmost[1:], leftmost[:-1], depth)
    yield from induce(text, small, leftmost, prefixes, depth, memory)
