"""Checks inside a plan: the rows pass, and the first row that breaks a rule stops the job that reads it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def must(df: DataFrame, broken: dict[str, Column], table: str) -> DataFrame:
    """``df``; a row for which one of ``broken`` is true is an error that names the table and the rule. No extra pass."""
    rule = F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in broken.items()], F.lit(None).cast("string"))
    return df.filter(F.when(rule.isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{table}: "), rule))))


def one_per_key(df: DataFrame, keys: list[str], table: str) -> DataFrame:
    """``df``; two rows with one key are an error. The shuffle is the one that a join on the keys needs anyway."""
    others = [c for c in df.columns if c not in keys]
    rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in others])
    return must(rows, {"a key repeats": F.col("_n") > 1}, table).select(df.columns)
