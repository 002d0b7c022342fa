"""The pipeline's stages keep columns, take effect and leave clean documents alone."""

import corpus_pipeline
from riskcohort.llm import queries


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5


def test_stages(spark, small_dir, tmp_path):
    docs = first = spark.read.parquet(f"{small_dir}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = docs
        if k < 4:
            assert docs.dtypes == first.dtypes
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{small_dir}/labels.parquet").collect()}
    stays = {r.doc_id for r in kept["quality classifier"].collect()}
    good = [i for i, x in labels.items() if x == (1, 0)]
    bad = [i for i, x in labels.items() if x[1] == 1 or x[0] == 0]
    assert sum(i in stays for i in good) >= 0.97 * len(good) and sum(i in stays for i in bad) <= 0.1 * len(bad)
    one = kept["SimHash near-dedup"]
    assert one.count() == one.select("doc_id").distinct().count() == one.select("text").distinct().count()
    shorter = kept["suffix-array dedup"]
    assert shorter.filter("n_chars != length(text)").count() == 0
    words = lambda df: sum(len(r.text.split()) for r in df.select("text").collect())
    mixed = kept["mixing sources to target weights"]
    assert abs(words(mixed) - 1.5 * words(shorter)) < 0.02 * words(mixed)
    packed = kept["packing"].collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed.select("doc_id").distinct().collect()}


def test_queries_with_sql(spark, small_dir):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {name} as select * from '{small_dir}/{name}.parquet'")
    assert set(queries.SQL) <= set(queries.QUERIES)
    for name, sql in queries.SQL.items():
        got = queries.QUERIES[name](spark, small_dir)
        cursor = con.execute(sql)
        columns = [d[0] for d in cursor.description]
        assert sorted(columns) == sorted(got.columns)
        key = lambda r: tuple((x is not None, x) for x in r)
        assert sorted(map(tuple, got.select(columns).collect()), key=key) == sorted(cursor.fetchall(), key=key)


def test_stages_keep_texts_of_null_and_repeated_ids(spark, odd_docs, tmp_path):
    from pyspark.sql import functions as F

    docs = odd_docs.withColumns({"source": F.lit("a"), "lang": F.lit("en"), "n_chars": F.length("text").cast("long")})
    one = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    texts = lambda df: sorted((r.doc_id or -1, r.text or "") for r in df.collect())
    alike = [(-1, ""), (-1, "lost words here"), (5, "same text twice"), (6, "first"), (6, "second text")]
    assert texts(one) == alike and one.dtypes == docs.dtypes
    assert texts(corpus_pipeline.drop_repeats(spark, one, str(tmp_path))) == alike
    # Rows that repeat are not multiplied by the joins.
    assert texts(corpus_pipeline.drop_repeats(spark, docs, str(tmp_path))) == sorted([*alike, (5, "same text twice")])
    tail = "a passage of more than a hundred bytes that both texts of one id and one without an id have, word by word, in full"
    shared = spark.createDataFrame([(6, "x1 " + tail, "a", "en", 0), (6, "y2 " + tail, "a", "en", 0), (None, "z3 " + tail, "a", "en", 0),
                                    (None, "plain", "a", "en", 0)],
                                   "doc_id long, text string, source string, lang string, n_chars long")
    left = [r.text for r in corpus_pipeline.drop_repeats(spark, shared, str(tmp_path)).collect()]
    assert len(left) == 4 and sum(tail in t for t in left) == 1
    mixed = corpus_pipeline.mix_sources(spark, docs, str(tmp_path))
    from riskcohort.llm import mixing
    taken = mixing.mix(docs).selectExpr("sum(copies) as n").first().n
    assert mixed.count() == taken and mixed.select("doc_id", "text").distinct().count() <= 6


CLASHING = ("n", "text_key", "kept", "copies", "row", "id", "key", "doc", "found_id", "source_of", "mixed_source", "copy", "carried", "point", "size")


def test_stages_with_clashing_columns_and_empty_tables(spark, small_dir, tmp_path):
    """Columns of the names that the stages use inside, an array and a map, a very long text, nulls and a repeated row."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{small_dir}/documents.parquet").limit(60)
    more = spark.createDataFrame([(7000, "word " * 30000, "en", "a", 1), (7001, None, None, None, None), (None, "", "en", "b", 0),
                                  (7002, "twice the same row", "en", "b", 18), (7002, "twice the same row", "en", "b", 18)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(more).withColumns({c: F.lit("x") for c in CLASHING} | {
        "list": F.array(F.lit(1)), "pairs": F.create_map(F.lit("k"), F.lit(1)), "a.b": F.lit(1)})
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small_dir)
        out.write.parquet(f"{tmp_path}/{k}")
        assert spark.read.parquet(f"{tmp_path}/{k}").count() > 0
        assert k == 4 or out.dtypes == docs.dtypes, name
        assert stage(spark, docs.filter("false"), small_dir).count() == 0, name


def test_bitmap_of_wanted_rows(spark):
    from pyspark.sql import functions as F
    from riskcohort.llm import near_copies

    rows = spark.range(20000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("text_key"), F.lit("t").alias("text"))
    keys = rows.filter("doc_id % 100 = 3").select("doc_id", "text_key")
    for most in (1 << 27, 1 << 10):
        found = near_copies._wanted(rows, keys, most)
        assert keys.join(found, ["doc_id", "text_key"]).count() == 200
        assert found.count() < (5000 if most > 1 << 20 else 20001)


def test_near_copies_are_those_of_the_fingerprints(spark, tmp_path):
    from riskcohort.llm import simhash

    def apart(a, b):
        return ((simhash._fingerprint(a.encode(), 3) ^ simhash._fingerprint(b.encode(), 3)) & (2 ** 64 - 1)).bit_count()

    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base)] + [" ".join([*base[:i], "x", *base[i + 1:]]) for i in range(0, 120, 4)]
    left, want = list(range(len(texts))), []
    while left:  # groups by plain search; the first of each has the smallest id
        group = [left.pop(0)]
        want.append(group[0])
        for i in group:
            near = [j for j in left if apart(texts[i], texts[j]) <= 3]
            group += near
            left = [j for j in left if j not in near]
    assert 1 < len(want) < len(texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()) == want
