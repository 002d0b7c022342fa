"""Operators that fit or search, against brute force or held-out rows."""

import math
import zlib

import numpy as np
import pytest

from riskcohort.llm import language, mixing, neighbours, quality


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(i, rows[5][1]) for i in range(300, 340)]  # many equal ones
    rows += [(400, None), (401, [0.0] * 8), (402, [float("nan")] + [1.0] * 7), (403, [None] + [1.0] * 7), (None, [1.0] * 8),
             (405, []), (406, [1.0, 2.0]), (407, [2.0, 2.0]), (408, [1e8] * 8)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)


@pytest.mark.parametrize("block", [2048, 16])
def test_nearest(vectors, block):
    got = {}
    for r in neighbours.nearest(vectors, vectors.filter("vec_id % 20 in (0, 6)"), 10, block=block).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in vectors.collect()
            if r.vec_id is not None and r.embedding and None not in r.embedding]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and v.any()]
    want = {}
    for q, v in rows:
        if q % 20 in (0, 6):
            near = sorted((math.sqrt(((v - w) ** 2).sum()), i) for i, w in rows if i != q and len(w) == len(v))[:10]
            want[q] = [(k, i, s) for k, (s, i) in enumerate(near, 1)]
    assert set(got) == set(want)
    for q in want:
        assert [x[:2] for x in sorted(got[q])] == [x[:2] for x in want[q]]
        assert np.allclose([x[2] for x in sorted(got[q])], [x[2] for x in want[q]], rtol=1e-14)


def test_nearest_of_nothing(vectors):
    none = vectors.filter("false")
    assert neighbours.nearest(none, none).count() == 0
    assert neighbours.nearest(vectors, none).count() == 0
    assert neighbours.nearest(none, vectors).count() == 0


def test_targets_stop_at_twice_a_source():
    assert mixing.targets([10, 100, 100], [5, 2, 1], 240) == [20.0, pytest.approx(2 / 3 * 220), pytest.approx(220 / 3)]
    assert mixing.targets([0, 0], [5, 2], 0) == [0.0, 0.0]
    assert sum(mixing.targets([7, 1, 50, 3], [5, 2, 1, 5], 61 * 1.5)) == pytest.approx(91.5)


def test_mixing(docs, texts):
    rows = mixing.mix(docs).collect()
    size = {i: len((t or "").encode().split()) for i, t in texts}
    assert {r.doc_id: r["size"] for r in rows} == size
    source = {r.doc_id: r.source for r in docs.collect()}
    for name in set(source.values()):
        part = [r for r in rows if source[r.doc_id] == name]
        assert {r.source_size for r in part} == {sum(r["size"] for r in part)}
        # Copies are whole: one document that outweighs its source leaves at most half its size.
        assert abs(sum(r.taken for r in part) - part[0].target) <= max(4, max(r["size"] for r in part) / 2)
        assert part[0].target <= 2 * part[0].source_size + 1e-9
    assert all(r.taken == r.copies * r["size"] and 0 <= r.copies <= 2 for r in rows)
    assert sum({r.source: r.target for r in rows}.values()) == pytest.approx(1.5 * sum(size.values()))
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in mixing.mix(docs.repartition(5)).collect())


def test_mixing_of_nothing(no_docs, spark):
    assert mixing.mix(no_docs).count() == 0
    empty = spark.createDataFrame([(1, None, None), (None, "", "a")], "doc_id long, text string, source string")
    assert sorted((r["size"], r.taken, r.target) for r in mixing.mix(empty).collect()) == [(0, 0, 0.0), (0, 0, 0.0)]


def test_language(spark, small_dir):
    from pyspark.sql import functions as F
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    rows = language.identify(docs, fold != 2, keep={"held_out": fold == 2, "truth": F.col("lang")}).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == r.truth for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(docs, no_docs, spark):
    from pyspark.sql import functions as F
    got = {r.doc_id: r for r in language.identify(docs, F.lit(True)).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, t in texts.items():
        assert (got[i].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
    assert got.keys() == texts.keys()
    assert {r.lang_pred for r in language.identify(docs, F.lit(False)).collect()} == {"und"}
    assert language.identify(no_docs, F.lit(True)).count() == 0


def _counts(spark, rows):
    from pyspark.sql import functions as F
    docs = spark.createDataFrame([(x, 0, t) for x, t in rows], "lang string, part int, text string")
    return language.gram_counts(docs).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _model(learned):
    t = learned.table.toArrow()
    return language.Model(len(learned.languages), learned.uniform, *[t.column(c).to_numpy() for c in ("code", "gram", "at", "log")])


def test_kneser_ney_sums_to_one(spark):
    text = "the cat sat on the mat and that was that"
    grams = np.unique(language._grams(language._symbols(text)))
    model = _model(language.learn(_counts(spark, [("en", text)])))
    symbols = np.array([*range(97, 123), 32, 300], np.uint64)  # 300 is unseen
    context = np.uint64((32 << 48) | (116 << 32) | (104 << 16))
    p = np.exp(model.score(context | symbols)[:, 0])
    seen = {int(g & np.uint64(0xFFFF)) for g in grams}
    assert sum(x for s, x in zip(symbols.tolist(), p) if s in seen or s == 300) == pytest.approx(1, abs=1e-4)


def _plain_kneser_ney(text, places, ending):
    """Probability of the last symbol of ``ending``, by dictionaries of strings."""
    from collections import Counter
    padded = "  " + "".join(chr(c) for c in language._symbols(text))
    tables = {4: Counter(padded[i:i + 4] for i in range(len(padded) - 3))}
    for k in (3, 2, 1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])

    def p(k):
        if k == 0:
            return 1 / places
        g, table = ending[-k:], tables[k]
        ones, twos = (sum(n == x for n in table.values()) for x in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        after = {x: n for x, n in table.items() if x[:-1] == g[:-1]}
        if not after:
            return p(k - 1)
        total = sum(after.values())
        return max(after.get(g, 0) - d, 0) / total + d * len(after) / total * p(k - 1)

    return p(4)


def test_kneser_ney_equals_dictionaries(spark):
    texts = {"a": "the cat sat on the mat and that was that, the end of the tale", "b": "der hund sah den mann und der mann den hund"}
    learned = language.learn(_counts(spark, list(texts.items())))
    model = _model(learned)
    places = len(set("".join(texts.values())) - {","}) + 1
    for ending in ("  th", " the", "that", "und ", "zzzz", "qthe", " der", "mann", "hatx"):
        gram = np.array([sum(ord(c) << 16 * (3 - i) for i, c in enumerate(ending))], np.uint64)
        got = np.exp(model.score(gram)[0].astype(float))
        want = [_plain_kneser_ney(texts[x], places, ending) for x in learned.languages]
        assert got == pytest.approx(want, rel=1e-4)


def test_language_by_buckets_is_the_same(spark, small_dir):
    from pyspark.sql import functions as F
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string")))
    whole = language.identify(docs, F.lit(True)).collect()
    parts = language.identify(docs, F.lit(True), whole_rows=0).collect()
    key = lambda r: (r.doc_id, r.lang_pred, round(r.entropy or 0, 6), round(r.margin or 0, 6), round(r.score, 6), r.rejected)
    assert sorted(map(key, whole)) == sorted(map(key, parts))


def test_language_tables_have_few_partitions(spark):
    """However many partitions shuffles have: each of them is small files in every checkpoint and shuffle."""
    kept = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        learned = language.learn(_counts(spark, [("en", "one two three"), ("fr", "un deux trois")]))
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    assert learned.rows > 40
    assert learned.table.rdd.getNumPartitions() <= 2


def test_language_of_many_labels_or_one(spark):
    from pyspark.sql import functions as F
    rows = [(i, f"{'abcdefghij'[i % 10] * 3} {'klmnopqrst'[i // 10 % 10] * 3} {'uvwxyz'[i // 100 % 6] * 3}", f"l{i:03d}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(docs, F.lit(True)).collect()
    assert np.mean([r.lang_pred == f"l{r.doc_id:03d}" for r in got]) > 0.95
    one = language.identify(docs.withColumn("lang", F.lit("x")), F.lit(True)).collect()
    assert {(r.lang_pred, r.margin) for r in one} == {("x", 0.0)}
    twice = docs.limit(20).unionByName(docs.limit(20).withColumn("lang", F.lit("other")))
    assert language.identify(twice, F.lit(True)).count() == 40


def test_quality(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    rows = []
    for i in range(900):
        text = " ".join(word() for _ in range(40))
        grade = int(rng.integers(0, 3))
        text = {0: text + " slur", 1: text.replace(" ", " %%% "), 2: text}[grade]
        rows.append((i, text, grade))
    docs = spark.createDataFrame(rows, "doc_id long, text string, truth int")
    model = quality.fit(docs, docs.filter("doc_id < 600").selectExpr("doc_id", "truth as grade"), 3)
    got = [r for r in quality.rate(docs, model, 3).collect() if r.doc_id >= 600]
    assert np.mean([r.keep == (rows[r.doc_id][2] == 2) for r in got]) > 0.95
    assert np.all(np.diff(model.thresholds) > 0)
    by_grade = [np.mean([r.expected_grade for r in got if rows[r.doc_id][2] == g]) for g in range(3)]
    assert by_grade[0] < by_grade[1] < by_grade[2]


def test_quality_of_odd_rows(docs, odd_docs, no_docs, spark):
    none = spark.createDataFrame([(None, 1), (3, None), (4, 9), (77, 1)], "doc_id long, grade int")
    assert quality.fit(docs, none, 3) is None
    assert all(r.keep and r.p_best is None for r in quality.rate(docs, None, 3).collect())
    model = quality.Model(np.zeros(1 << quality.BITS, np.float32), np.array([-1.0, 1.0]))
    assert quality.rate(odd_docs, model, 3).count() == 6
    assert quality.rate(no_docs, model, 3).count() == 0


def test_gradient_of_the_ordinal_likelihood():
    rows = [quality.features(t) for t in (b"a b", b"a c", b"b c", b"a b c", b"c c")]
    model = quality.fit_rows(rows, np.array([0, 1, 2, 2, 1]), 3, min_rows=1)
    better = model.weights[rows[2]].sum()
    assert model.weights[rows[0]].sum() < better and model.thresholds[0] < model.thresholds[1]


def test_quality_limits_the_lowest_grade():
    """Held-out toxic texts that share a few words with the learned ones."""
    rng = np.random.default_rng(9)
    bad = [f"slur{i}" for i in range(60)]
    rows, grades = [], []
    for _ in range(5500):
        grade = int(rng.choice(3, p=[0.12, 0.14, 0.74]))
        text = [f"w{i}" for i in rng.integers(0, 500, 30)]
        text += list(rng.choice(bad, 1 + int(rng.integers(0, 2)))) if grade == 0 else ["%%%"] if grade == 1 else []
        rows.append(quality.features(" ".join(text).encode()))
        grades.append(grade)
    grades = np.array(grades)
    model = quality.calibrated(rows[:4000], grades[:4000], 3)
    tails = model.tails(model.score(rows[4000:]))
    truth, old = grades[4000:], tails[:, -1] >= quality.CUT
    kept = model.keep(tails)
    assert kept[truth == 0].sum() < old[truth == 0].sum()
    assert kept[truth == 2].mean() >= 0.97


def test_quality_sample_is_bounded_after_the_join(spark, monkeypatch):
    """Repeated rows of a rated id do not multiply the sample, and ratings without documents do not use it up."""
    rows = [(1, "the one text")] * 50 + [(i, f"text {i}") for i in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    ratings = spark.createDataFrame([(i, i % 3) for i in range(1, 3000)], "doc_id long, grade int")
    got = []
    monkeypatch.setattr(quality, "calibrated", lambda found, grades, *_: got.append(len(found)))
    quality.fit(docs, ratings, 3)
    quality.fit(docs, ratings, 3, fit_rows_=20)
    assert got == [29, 20]
