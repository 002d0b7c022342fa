"""The near-duplicate stage against brute-force Jaccard."""

import random

import pytest

import corpus_pipeline
from riskcohort.llm import near_copies


def plain_shingles(text, words=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def plain_groups(texts, likeness=0.8):
    """Group number of each text."""
    sets = [plain_shingles(t) for t in texts]
    group = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if (len(x & y) >= likeness * len(x | y) - 1e-9) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    return group


def edited_texts():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    line = " ".join(rng.choice(vocabulary) for _ in range(20))
    out = []
    for n in (5, 9, 20, 40, 90, 150, 300, 700):
        for _ in range(3):
            words = [rng.choice(vocabulary) for _ in range(n)]
            for edits in (0, 0, 1, 2, n // 60, n // 45, n // 40, n // 30):
                copy = list(words)
                for k in rng.sample(range(n), min(n, edits)):
                    copy[k] = rng.choice(vocabulary)
                out.append(" ".join(copy) + (" " + line if rng.random() < 0.3 else ""))
    out += [line, line + " one more word", " ".join(vocabulary[:3]), None, "", " \n"]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("frequent", [1 << 18, 40, 1])
def test_stage_equals_brute_force(spark, tmp_path, monkeypatch, frequent):
    monkeypatch.setattr(near_copies, "FREQUENT", frequent)
    monkeypatch.setattr(near_copies, "SAMPLED", 3)
    texts = edited_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    group, want = plain_groups(texts), {}
    for i, g in enumerate(group):
        want.setdefault(g, i)
    got = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(want.values())


def test_stage_of_small_tables(spark, small_dir, tmp_path):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    first = {}
    for (i, _), g in zip(rows, plain_groups([t for _, t in rows])):
        first.setdefault(g, i)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, small_dir).collect()) == sorted(first.values())
    assert corpus_pipeline.drop_near_copies(spark, docs.filter("false"), small_dir).count() == 0
