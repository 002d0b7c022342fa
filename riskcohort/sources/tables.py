"""Reading survey modules, datasets, follow-up tables and landing files, with their contracts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskcohort import constants as K, schemas
from riskcohort.functions.checks import must
from riskcohort.functions.recode import as_number
from riskcohort.sources.audit import landed_files


class ContractError(ValueError):
    """A table does not have the columns or values it promised."""


def normalise_names(df: DataFrame) -> DataFrame:
    """Trimmed, upper-case column names."""
    names = [c.strip().upper() for c in df.columns]
    repeated = {n for n in names if names.count(n) > 1}
    if repeated:
        raise ContractError(f"column names collide once normalised: {sorted(repeated)}")
    return df.toDF(*names)


def require_columns(df: DataFrame, columns: Iterable[str], table: str = "table") -> DataFrame:
    """Fail at plan time when a column is missing; runs no job."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"{table} is missing required columns: {missing}")
    return df


def exact_columns(df: DataFrame, columns: Iterable[str], optional: Iterable[str] = (),
                  table: str = "table") -> DataFrame:
    """Required columns must be there; nothing beyond required and optional may be."""
    columns = list(columns)
    require_columns(df, columns, table)
    extra = [c for c in df.columns if c not in {*columns, *optional}]
    if extra:
        raise ContractError(f"{table} has unexpected columns: {extra}")
    return df


def reject_forbidden(columns: Iterable[str], forbidden: Iterable[str] = K.FORBIDDEN_FEATURES) -> None:
    """Leakage guard on feature or output names."""
    blocked = {f.lower() for f in forbidden}
    leaked = sorted(c for c in columns if c.lower() in blocked)
    if leaked:
        raise ContractError(f"forbidden columns: {leaked}")


def scan_module(spark: SparkSession, name: str, path: str, fmt: str = "parquet",
                cycle: str | None = None, **options: str) -> DataFrame:
    """One survey module: normalised names, contract, numeric columns, ``cycle`` kept."""
    reader = spark.read.options(**options)
    if fmt == "csv":
        reader = reader.option("header", True)
    df = normalise_names(reader.format(fmt).load(path))
    return conform_module(df, name, cycle)


def conform_module(df: DataFrame, name: str, cycle: str | None = None) -> DataFrame:
    """Prune to the module's columns and coerce them; unusable values become NULL."""
    columns = K.MODULE_COLUMNS[name]
    require_columns(df, columns, name)
    tag = F.lit(cycle) if cycle is not None else None
    if tag is None:
        present = [c for c in df.columns if c.lower() == "cycle"]
        if not present:
            raise ContractError(f"{name} has no cycle column and none was given")
        tag = F.col(present[0])
    values = [as_number(F.col(c)).alias(c) for c in columns if c != "SEQN"]
    return df.select(tag.alias("cycle"), F.col("SEQN").cast("long").alias("SEQN"), *values)


def scan_cycles(spark: SparkSession, name: str, paths: dict[str, str], fmt: str = "parquet",
                **options: str) -> DataFrame:
    """One file set per cycle, united with the cycle as a column."""
    out = None
    for cycle, path in paths.items():
        part = scan_module(spark, name, path, fmt, cycle, **options)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ContractError(f"{name}: no cycles given")
    return out


def read_dataset(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Supervised dataset with its exact-column contract and explicit types."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        # Names are taken from the header so that the contract can be checked against it.
        reader = reader.option("header", True)
    df = exact_columns(
        reader.load(path), (*K.PREDICTORS, K.TARGET), optional=("diq010", *K.ID_COLUMNS),
        table="dataset",
    )
    kinds = {f.name: f.dataType for f in schemas.DATASET}
    return df.select(*[F.col(c).cast(kinds[c]).alias(c) for c in schemas.DATASET.names if c in df.columns])


def read_followup(df: DataFrame) -> DataFrame:
    """Wide-header follow-up table to typed columns; sex 1/2 becomes male 1/0."""
    require_columns(df, K.FOLLOWUP_HEADERS, "follow-up table")
    kinds = {f.name: f.dataType for f in schemas.FOLLOWUP}
    quoted = {new: F.col(f"`{old}`") for old, new in K.FOLLOWUP_HEADERS.items()}
    out = {n: c.cast(kinds[n]) for n, c in quoted.items()}
    out["male"] = (quoted["male"].cast("int") == 1).cast("int")
    return df.select(*[out[n].alias(n) for n in schemas.FOLLOWUP.names])


def eligible_followup(df: DataFrame) -> DataFrame:
    """Baseline FPG inside the eligible range; a missing value drops the row. Any other value that is missing there stops
    the job that reads the row."""
    eligible = df.filter(F.col("fpg_mmol_l").between(*K.FPG_ELIGIBLE))
    missing = {f"{c} is missing": F.col(c).isNull() for c in schemas.FOLLOWUP.names if c in df.columns}
    return must(eligible, missing, "follow-up table")


def landing_audit(spark: SparkSession, path: str, magic: str, pattern: str = "*") -> DataFrame:
    """One row per landed file: size, leading bytes, SHA-256 of the whole content.

    ``magic`` is the expected leading text. Files are read in parallel and in pieces, so their size does not matter;
    an empty file is a row, an empty folder gives none, and a missing one is an error.
    """
    files = landed_files(spark, path, pattern, len(magic.encode()))
    return files.select(
        "file", "bytes", (F.col("bytes") >= K.MIN_FILE_BYTES).alias("size_ok"),
        (F.col("head") == F.lit(magic.encode())).alias("magic_ok"), "sha256",
    )
