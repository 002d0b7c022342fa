"""Queries of the operators of this package, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskcohort.llm import (hard_negatives, kd_shards, language, merkle, mixing, neighbours, packing, prefix_trie,
                             quality, simhash, suffix_dedup, token_counts, windows)
from riskcohort.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op8_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.remove_repeated(table(spark, sf_dir, "documents"), digest=True)
    return found.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.token_counts(table(spark, sf_dir, "documents"), token_counts.word_tokenizer_path())
    return found.withColumn("over_limit", F.col("n_tokens") > 2048)


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), token_counts.word_tokenizer_path())


@query
def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op2_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited_neighbours(table(spark, sf_dir, "documents")).drop("edits")


@query
def op4_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.filter("vec_id % 100 = 0"), 10)


@query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), form="sha256")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").cast("string").alias("kept_sha256"))


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A null id is not held out, and nothing is learned from it.
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    found = language.identify(table(spark, sf_dir, "documents"), fold != 2,
                              keep={"held_out": F.coalesce(fold == 2, F.lit(False))})
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, quality.graded(table(spark, sf_dir, "labels")), quality.GRADES)
    return quality.rate(docs, model, quality.GRADES)


@query
def op11_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kd_shards.assign(table(spark, sf_dir, "documents"), shards=40)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), every=20, head=F.crc32(F.col("conv").cast("string")) % 4)


SQL["op4_nearest_vectors"] = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings where vec_id is not null and embedding is not null),
good as (select * from v where list_bool_and(list_transform(e, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(e, lambda x: x <> 0))),
near as (select q.vec_id as query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) as score
from good q join good c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 100 = 0)
select query_id, cast(rank as int) as rank, vec_id, score from (
select *, row_number() over (partition by query_id order by score, vec_id) as rank from near) r where rank <= 10
"""

SQL["op8_repeated_windows"] = r"""
with words as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
wins as (select r, i, array_to_string(ws[i:i + 34], ' ') as s from words, unnest(range(1, len(ws) - 33)) as t(i)),
again as (select s from wins group by s having count(*) > 1),
gone as (select distinct r, p from (select r, unnest(range(i, i + 35)) as p from wins join again using (s)) x),
kept as (select w.r, string_agg(w.word, ' ' order by w.p) as k, count(*) as n from (
select r, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from words) w
left join gone g on g.r = w.r and g.p = w.p where g.p is null group by w.r)
select doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(k, '')) as kept_sha256
from words left join kept using (r)
"""

SQL["op12_hard_negatives"] = """
with v as (select vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label,
list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
where vec_id is not null and label is not null and embedding is not null
and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
scored as (select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same, cast(list_inner_product(a.e, r.e) as bigint) as score
from v a join v r on a.vec_id <> r.vec_id and len(a.e) = len(r.e) where a.vec_id % 100 = 0),
positives as (select * from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as place
from scored where same) p where place <= 5),
met as (select p.anchor_id, p.vec_id as positive_id, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score,
row_number() over (partition by p.anchor_id, p.place order by n.score desc, n.vec_id) as rank
from positives p join scored n on p.anchor_id = n.anchor_id and not n.same
and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from met where rank <= 10
"""

# The inner reductions are CRC-32 of the digits of an id, bit by bit.
SQL["op13_prefix_trie"] = r"""
with own as (select conv_id as c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} order by turn nulls first) as turns
from conversations where conv_id is not null group by conv_id),
skips as (select c, turns, cast(xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(cast(c as varchar), ''),
lambda x: cast(ascii(x) as bigint))), lambda a, b: list_reduce(list_concat([xor(a, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
lambda y, k: case when y & 1 = 1 then xor(y >> 1, 3988292384) else y >> 1 end)), 4294967295) % 4 as int) as h from own),
rebuilt as (select s.c, list_concat(coalesce(d.turns[1:s.h], []), s.turns[s.h + 1:]) as seq from skips s left join own d on d.c = s.c - s.c % 20),
members as (select c, d, seq[1:d] as p, len(seq) = d as ends from rebuilt, unnest(range(0, len(seq) + 1)) as t(d)),
nodes as (select p, d, min(c) as c, count(*) as n, coalesce(string_agg(c, ',' order by c) filter (ends), '') as ids,
case when d = 0 then 0 else len(regexp_extract_all(p[d].t, '[^\x20\x09-\x0D]+')) end as words from members group by p, d),
below as (select p[1:d - 1] as p, d - 1 as d, count(*) as n from nodes where d > 0 group by all),
rated as (select nodes.*, coalesce(below.n, 0) as children from nodes left join below using (p, d)),
sums as (select p[1:a] as p, a as d, count(*) filter (children = 0) as leaves, sum((n - 1) * words) as saved
from rated, unnest(range(0, d + 1)) as t(a) group by all)
select r.c as conv_id, r.d as depth, u.c as parent_conv_id, r.n as n_convs, r.children as n_children, s.leaves as n_leaves,
cast(s.saved as bigint) as saved_tokens, sha256(r.ids) as ends_sha256
from rated r join sums s using (p, d) left join nodes u on r.d > 0 and u.d = r.d - 1 and u.p = r.p[1:r.d - 1]
"""
