"""Writing datasets, scored rows and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskcohort import schemas
from riskcohort.sources.tables import exact_columns, reject_forbidden

LAB_NAMES = ("hba1c", "lbxgh", "glucose", "fasting_glucose", "lbxglu")


def write_dataset(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet by cycle, ordered by participant inside each file. No lab column may pass."""
    reject_forbidden(df.columns, LAB_NAMES)
    exact_columns(df, schemas.DATASET.names, table="dataset")
    (
        df.repartitionByRange("cycle", "SEQN")
        .sortWithinPartitions("cycle", "SEQN")
        .write.mode(mode).partitionBy("cycle").parquet(path)
    )


def export_csv(df: DataFrame, path: str, order: tuple[str, ...] = ("cycle", "SEQN"),
               mode: str = "errorifexists") -> None:
    """Globally ordered CSV parts with a header; part order is row order."""
    reject_forbidden(df.columns, LAB_NAMES)
    df.orderBy(*order).write.mode(mode).option("header", True).csv(path)


def write_scored(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.select(*schemas.SCORED.names).write.mode(mode).parquet(path)


def write_out_of_fold(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.select(*schemas.OUT_OF_FOLD.names).write.mode(mode).parquet(path)


def metric_report(metrics: DataFrame, group: str = "group") -> DataFrame:
    """One JSON document: the ``all`` row on top, the named subgroups as a list.

    ``metrics`` has one row per named group, a handful of rows by construction.
    """
    body = F.struct(*[F.col(c) for c in metrics.columns])
    is_all = F.col(group) == "all"
    return metrics.agg(F.to_json(F.struct(
        F.max(F.when(is_all, body)).alias("validation"),
        F.array_sort(F.collect_list(F.when(~is_all, body))).alias("subgroups"),
    )).alias("report"))


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    report.write.mode(mode).text(path)
