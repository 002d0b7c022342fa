"""Sharding, hard negatives and the prefix trie against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskcohort.llm import hard_negatives, kd_shards, prefix_trie

SCHEMA = "vec_id long, embedding array<double>, label int, rank string, anchor_id int"


def plain_negatives(rows, positives, negatives, anchors):
    def good(r):
        return r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])

    rows = [(r[0], [math.floor(256 * x) for x in r[1]], r[2]) for r in rows if good(r)]
    asked = {}
    for r in rows:
        if anchors(r[0]):
            asked[r[0]] = min(asked.get(r[0], r), r, key=lambda r: (r[2], r[1]))
    out = []
    for a in asked.values():
        scored = sorted(((-sum(x * y for x, y in zip(a[1], r[1])), r[0], r[2]) for r in rows if r[0] != a[0] and len(r[1]) == len(a[1])))
        for ps, p, _ in [s for s in scored if s[2] == a[2]][:positives]:
            fits = [s for s in scored if s[2] != a[2] and 30 * -ps <= 100 * -s[0] <= 90 * -ps][:negatives]
            out += [(a[0], p, k, n, -ps, -ns) for k, (ns, n, _) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("block,most", [(4, 3), (64, 1000)])
def test_negatives(spark, block, most):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(3, 6))
    rows = [(i, [float(x) for x in np.round((centres[i % 3] + rng.normal(size=6) * 0.8) * 4) / 64], i % 3) for i in range(150)]
    rows += [(200, None, 1), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (202, [float("nan")] * 6, 1), (203, [float("inf")] * 6, 0),
             (204, [0.5] * 6, None), (None, [0.5] * 6, 1), (205, [0.0] * 6, 2), (210, [0.25, 0.5], 0), (211, [0.5, 0.5], 0), (212, [0.25, 0.25], 1),
             (20, rows[21][1], 0), (20, rows[20][1], 2), (33, rows[33][1], 0), (213, [], 1), (220, [], 0)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA).repartition(3)
    found = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, positives=3, negatives=4, block=block, most=most)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(map(tuple, found.collect()))
    assert got == plain_negatives(rows, 3, 4, lambda i: i % 10 == 0) and len(got) > 50


def test_negatives_of_large_components_and_no_rows(spark):
    rows = [(0, [3e6, 1.0], 0), (1, [2e6, -5.0], 0), (2, [1e6, 9.0], 1), (3, [1.5e6, 9.0], 1), (4, [-1e6, 0.0], 1)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA)
    got = sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") == 0).collect()))
    assert got == plain_negatives(rows, 5, 10, lambda i: i == 0) and len(got) == 2
    assert hard_negatives.mine(df.filter("false"), F.col("vec_id") == 0).count() == 0
    assert hard_negatives.mine(df, F.lit(False)).count() == 0


def test_one_label_and_equal_vectors(spark):
    rows = [(i, [0.5, 0.25], 0) for i in range(40)] + [(50 + i, [0.25, 0.25], 1) for i in range(40)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA).repartition(4)
    got = sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") == 7, block=8).collect()))
    assert got == plain_negatives(rows, 5, 10, lambda i: i == 7) and len(got) == 50
    assert hard_negatives.mine(df.filter("label = 0"), F.col("vec_id") == 7).count() == 0


def plain_trie(rows, every=1, head=lambda c: 0):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(t, key=lambda x: x[:2])] for c, t in turns.items()}
    whole = {c: turns.get(c - int(math.fmod(c, every)), [])[:head(c)] + t[head(c):] for c, t in turns.items()}
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p in members:
        words = len(re.findall(rb"[^\x20\x09-\x0D]+", p[-1][1].encode())) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members[p]) - 1) * words
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in m if len(whole[c]) == len(p)).encode()).hexdigest()) for p, m in members.items())


def conversations():
    rng = random.Random(9)
    say = lambda: rng.choice(["hello there", "a b\tc", "", None, "yes", "no\nnever"])
    rows = []
    for c in [*range(60), -3, -25, 1000]:
        rows += [(c, t, rng.choice(["user", "assistant", None]), say()) for t in range(rng.choice([1, 1, 2, 3, 6]))]
    rows += [(c, t, "user", "same words again") for c in range(100, 130) for t in range(4)]  # copies
    rows += [(c, t, "user", f"step {t}") for c in range(200, 215) for t in range(c - 199)]  # prefixes of one another
    rows += [(c, t, "user", f"long {t % 7} {t}") for c in (300, 301) for t in range(400 + c % 2)]
    rows += [(302, t, "user", f"long {t % 7} {t}" if t < 150 else f"other {t}") for t in range(333)]
    rows += [(40, None, "user", "first of all"), (None, 1, "user", "lost")]
    return rows


@pytest.mark.parametrize("members,chunk", [(4096, 1 << 18), (3, 5), (1, 1)])
def test_trie(spark, monkeypatch, members, chunk):
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    rows = conversations()
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, conv string").repartition(5)
    got = prefix_trie.prefix_trie(df, members=members)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    key = lambda r: tuple(-1e9 if x is None else x for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_trie(rows), key=key)
    crc = lambda c: zlib.crc32(str(c).encode()) % 4
    got = prefix_trie.prefix_trie(df, every=20, head=F.crc32(F.col("conv").cast("string")) % 4, members=members)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_trie(rows, 20, crc), key=key)


def test_trie_of_few_rows(spark):
    df = spark.createDataFrame([(7, 0, "user", "a b"), (7, 0, "user", "a b")], "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, prefix_trie.prefix_trie(df).collect()))[1:] == plain_trie([(7, 0, "user", "a b")] * 2)[1:]
    assert prefix_trie.prefix_trie(df.filter("false")).count() == 0
    # Own turns that are all replaced by those of a conversation that is not there.
    only = prefix_trie.prefix_trie(df, every=20, head=F.lit(3)).collect()
    assert [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_leaves) for r in only] == [(7, 0, None, 1, 1)]


def test_slots_are_minimal_and_perfect():
    keys = np.random.default_rng(1).integers(0, 2**63, (2, 5000)).astype(np.uint64)
    table = prefix_trie.Slots(*keys)
    assert sorted(table.slot.tolist()) == list(range(5000))
    assert (table.find(*keys) == table.slot).all() and (table.find(keys[0], keys[0]) == -1).all()
    assert len(prefix_trie.Slots(keys[0][:0], keys[1][:0]).find(*keys)) == 5000
    with pytest.raises(RuntimeError):
        prefix_trie.Slots(np.array([1, 1], np.uint64), np.array([2, 2], np.uint64))


def sharded(df, **options):
    rows = kd_shards.assign(df, **options).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    return rows, {k: sum(r.size for r in part) for k, part in by.items()}


@pytest.mark.parametrize("interval", [1, 3, 1 << 16])
def test_shards(spark, docs, texts, monkeypatch, interval):
    monkeypatch.setattr(kd_shards, "INTERVAL", interval)
    rows, _ = sharded(docs, shards=5)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts)
    rng = random.Random(3)
    many = [(i, " ".join(["word"] * rng.randint(1, 60)) + str(i), rng.choice("abc"), rng.choice(["en", None])) for i in range(3000)]
    many += [(5000 + i, f"a pair {i // 2}", "b", "fr") for i in range(600)]
    df = spark.createDataFrame(many, "doc_id long, text string, source string, lang string").repartition(4)
    rows, sizes = sharded(df, shards=7)
    mean = sum(sizes.values()) / 7
    assert len(sizes) == 7 and max(sizes.values()) < 1.01 * mean and min(sizes.values()) > 0.99 * mean
    at = defaultdict(set)
    for r in rows:
        if r.doc_id >= 5000:
            at[(r.doc_id - 5000) // 2].add(r.shard)
    assert all(len(s) == 1 for s in at.values())


def test_shards_of_a_hot_group(spark):
    rows = [(None, "the same text", None, None)] * 1500 + [(i, f"text {i} " * (i % 9), "s", "en") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(6)
    _, sizes = sharded(df, target_bytes=6000)
    mean = sum(sizes.values()) / len(sizes)
    assert len(sizes) == -(-sum(sizes.values()) // 6000) and max(sizes.values()) < 1.05 * mean and min(sizes.values()) > 0.95 * mean


def test_shards_of_odd_rows(odd_docs, no_docs, docs, tmp_path, spark):
    rows, _ = sharded(odd_docs, shards=40)
    assert sorted(r.size for r in rows) == [16, 21, 27, 31, 31, 31]
    assert kd_shards.assign(no_docs, shards=3).count() == 0
    kd_shards.write(docs, str(tmp_path / "out"), shards=4, files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select("document.*").exceptAll(docs).count() == 0 and back.count() == docs.count()
