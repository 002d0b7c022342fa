"""Saved assessments as an event table: current state, valid and stale results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

WRITES = ("create", "edit")
CLEAR = "clear"


def latest(df: DataFrame, key: list[str], order: list[str], value: list[str]) -> DataFrame:
    """Last row per key in an explicit order; reduced on the map side, so hot keys are cheap."""
    kept = df.groupBy(*key).agg(F.max_by(F.struct(*value), F.struct(*order)).alias("_v"))
    return kept.select(*key, *[F.col(f"_v.{v}").alias(v) for v in value])


def current_assessments(events: DataFrame) -> DataFrame:
    """Snapshot of each assessment after its last create or edit."""
    writes = events.filter(F.col("action").isin(*WRITES))
    return latest(writes, ["assessment_id"], ["ts", "event_id"], ["snapshot", "ts", "event_id"])


def current_records(events: DataFrame, key: str = "assessment_id") -> DataFrame:
    """Records that exist now: the last write or delete is a write, and no clear came later.

    A clear removes every record of its ``owner_id``; without that column, nobody's.
    """
    acts = events.filter(F.col("action").isin(*WRITES, "delete"))
    if "owner_id" not in events.columns:
        state = latest(acts, [key], ["ts", "event_id"], ["action", "snapshot", "ts", "event_id"])
        return state.filter("action <> 'delete'").drop("action")
    state = latest(acts, ["owner_id", key], ["ts", "event_id"], ["action", "snapshot", "ts", "event_id"])
    clears = events.filter(F.col("action") == CLEAR).groupBy("owner_id").agg(
        F.max(F.struct("ts", "event_id")).alias("_clear")
    )
    kept = state.filter("action <> 'delete'").join(clears, "owner_id", "left")
    newer = F.col("_clear").isNull() | (F.struct("ts", "event_id") > F.col("_clear"))
    return kept.filter(newer).drop("action", "_clear")


def newest_first(records: DataFrame) -> DataFrame:
    """All records in the order of the list."""
    return records.orderBy(F.desc("ts"), F.desc("event_id"))


def results(events: DataFrame) -> DataFrame:
    return events.filter("action = 'result'").select("event_id", "ts", "assessment_id", "snapshot")


def valid_results(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Stored results whose snapshot is still the assessment's: give ``current_records``, so that results of
    deleted and cleared records are not valid."""
    return stored.join(current.select("assessment_id", "snapshot"), ["assessment_id", "snapshot"], "left_semi")


def stale_results(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Stored results whose assessment changed, went away or never had a snapshot."""
    return stored.join(current.select("assessment_id", "snapshot"), ["assessment_id", "snapshot"], "left_anti")
