"""A corpus from documents to packed sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor kept and returns documents with the columns
it got; the last one returns the pieces of the packed sequences. ``run`` writes every stage as Parquet to
the shared folder and goes on from the written copy.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from riskcohort.llm import mixing, packing, quality, simhash, suffix_dedup, token_counts
from riskcohort.llm.common import table
from riskcohort.session import ensure_checkpoint_dir


def _row(docs: DataFrame) -> Column:
    """A whole row as one value, so that its columns may have any names and types."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose best grade is likely; toxic and poor ones go. A null text is empty; rows that repeat are graded
    alike; without documents or labels nothing goes."""
    model = quality.fit(docs, quality.graded(table(spark, sf_dir, "labels")), quality.GRADES)
    rated = quality.rate(docs, model, quality.GRADES, carry=_row(docs))
    return rated.filter("keep").select("carried.*")


def _found(docs: DataFrame, found: DataFrame, how: str = "inner") -> DataFrame:
    """``row, source_of, id, key`` of ``docs`` with the columns of ``found``, whose rows name a ``doc_id`` and ``text_key`` each."""
    source = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    keyed = docs.select(_row(docs).alias("row"), source.alias("source_of"), F.col("doc_id").alias("id"),
                        F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    named = found.withColumnRenamed("doc_id", "found_id")
    return keyed.join(named, keyed["id"].eqNullSafe(named["found_id"]) & (keyed["key"] == named["text_key"]), how)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts whose SimHash fingerprints differ in at most three bits, directly or over others: the
    smallest id (null last), of one id the smallest hash of the text. Rows that repeat with id and text are one, the first by its
    JSON; texts without words, null or not, are one group. No documents give none."""
    kept = _found(docs, simhash.first_of_groups(docs))
    once = kept.filter("n > 1").groupBy("id", "key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.filter("n = 1").select("row.*").unionByName(once.select("row.*"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that occur before; characters that a cut splits go, and texts that lose all go. Rows that
    repeat with id and text have one result; null and empty texts stay as they are. No documents give none."""
    found = (suffix_dedup.remove_repeats(docs, form="text").filter("n_removed > 0").groupBy("doc_id", "text_key")
             .agg(F.first("kept").cast("string").alias("kept")))
    joined = _found(docs, found, "left").filter("kept is null or kept != ''")
    changed = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return joined.select(*[F.coalesce(changed[c], F.col("row")[c]).alias(c) if c in changed else F.col("row")[c].alias(c)
                           for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: rows of two copies come twice, of none go. A null source is a source;
    rows of one source that repeat with id and text share their copies out evenly. No documents give none."""
    mixed = mixing.mix(docs).groupBy("doc_id", "text_key", F.col("source").alias("mixed_source")).agg(
        F.sum("copies").alias("copies"), F.count("*").alias("n")).filter("copies > 0")
    joined = _found(docs, mixed).filter(F.col("source_of").eqNullSafe(F.col("mixed_source")))
    place = F.row_number().over(Window.partitionBy("id", "key", "source_of").orderBy(F.to_json("row")))
    several = joined.filter("n > 1").withColumn("copies", F.expr("copies div n") + (place <= F.expr("copies % n")).cast("int"))
    return joined.filter("n = 1").unionByName(several).filter("copies > 0").withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of 4096. A null or empty text is one end token; rows that repeat are
    packed each; no documents give no pieces."""
    return packing.pack(docs, token_counts.word_tokenizer_path())


STAGES = [
    ("quality classifier", drop_low_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", drop_repeats),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

# Models, suffix sorting and tokens are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
