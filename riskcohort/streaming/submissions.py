"""Arriving submissions, scored by the same functions as stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from riskcohort import schemas
from riskcohort.operators import assessment, submissions
from riskcohort.operators.scoring import Scorer, future_risk_score, scorecard

Sink = Callable[[DataFrame, int], None]


def submission_stream(spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    """Landing folder as a stream; event time is a TIMESTAMP so that it can be watermarked."""
    return (
        spark.readStream.schema(schemas.SUBMISSION).format(fmt)
        .option("maxFilesPerTrigger", files_per_trigger).load(path)
    )


def first_submissions(stream: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Repeats of a submission id inside the lateness bound are dropped.

    Rows later than the bound are dropped too; ``split_late`` keeps them instead.
    """
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["submission_id"])


def split_late(stream: DataFrame, answer: Sink, late: Sink, checkpoint: str, lateness: str = "1 hour") -> DataStreamWriter:
    """Every row to exactly one sink: to ``late`` if it is more than ``lateness`` behind the newest time of the batches
    before, else, if its id was not answered within that time, to ``answer``; repeats go to neither.

    Times and ids of a batch are written beside the checkpoint once its rows are out, and a batch reads only those of
    batches before it. A batch that is run again after a restart, or a new session, therefore decides the same.
    Ids are kept for as long as ``lateness``. A row without a time is never late; a null id is never a repeat.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = spark.read.schema(_SEEN).parquet(f"{checkpoint}/seen").filter(F.col("batch") < batch_id) if batch_id else None
        newest = seen.agg(F.max("newest")).first()[0] if seen is not None else None
        limit = F.lit(newest) - F.expr(f"interval {lateness}")
        is_late = F.coalesce(F.col("ts") < limit, F.lit(False)) if newest is not None else F.lit(False)
        kept = batch.withColumn("_late", is_late).persist()
        try:
            late(kept.filter("_late").drop("_late"), batch_id)
            fresh = kept.filter("not _late").drop("_late")
            # The first of a repeated id by time; the rest of the row settles ties.
            row = F.struct("ts", *[c for c in batch.columns if c != "ts"])
            known = fresh.filter("submission_id is not null").groupBy("submission_id").agg(F.min(row).alias("_row")).select("_row.*")
            if newest is not None:
                recent = seen.filter(F.col("ts") >= limit).select("submission_id").distinct()
                known = known.join(recent, "submission_id", "left_anti")
            answer(known.select(batch.columns).unionByName(fresh.filter("submission_id is null")), batch_id)
            top = F.lit(kept.agg(F.max("ts")).first()[0]).cast("timestamp")
            newest_now = top if newest is None else F.greatest(top, F.lit(newest))
            ids = fresh.groupBy("submission_id").agg(F.max("ts").alias("ts"))
            mark = spark.range(1).select(F.lit(None).cast("long").alias("submission_id"), F.lit(None).cast("timestamp").alias("ts"))
            out = ids.unionByName(mark).withColumn("newest", newest_now)
            out.write.mode("overwrite").parquet(f"{checkpoint}/seen/batch={batch_id}")
        finally:
            kept.unpersist()

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)


_SEEN = "submission_id long, ts timestamp, newest timestamp, batch long"


def parquet_sink(path: str) -> Sink:
    """Rerunning a batch replaces that batch's folder, so a restart writes nothing twice."""
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def _routed(answers: Callable[[DataFrame], DataFrame], good: Sink, bad: Sink) -> Sink:
    """Answers to one sink, rejected rows with their code to the other."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        out = answers(batch).persist()
        try:
            good(out.filter("error_code is null").drop("error_code"), batch_id)
            bad(submissions.rejected(out), batch_id)
        finally:
            out.unpersist()

    return handle


def _assessed(scorer: Scorer):
    def answers(batch: DataFrame) -> DataFrame:
        out = assessment.assess_submissions(batch, scorer)
        return out.select(
            "submission_id", "user_id", "ts", "error_code", "tier", "rule", "p_high", "stage3_eligible",
            assessment.assessment_response(out).alias("response"),
        )

    return answers


def _future(scorer: Scorer, risk):
    def answers(batch: DataFrame) -> DataFrame:
        out = assessment.future_risk(batch, scorer, risk)
        return out.select(
            "submission_id", "user_id", "ts", "error_code", "risk_probability", "risk_category",
            "reliability", assessment.future_risk_response().alias("response"),
        )

    return answers


def assess_stream(stream: DataFrame, good: Sink, bad: Sink, checkpoint: str,
                  scorer: Scorer = scorecard) -> DataStreamWriter:
    """Assessment of every arriving submission; start the returned writer."""
    handle = _routed(_assessed(scorer), good, bad)
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)


def future_risk_stream(stream: DataFrame, good: Sink, bad: Sink, checkpoint: str,
                       scorer: Scorer = scorecard, risk=future_risk_score) -> DataStreamWriter:
    handle = _routed(_future(scorer, risk), good, bad)
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
