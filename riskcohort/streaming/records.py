"""Record events as a stream: current list and stale results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from riskcohort import schemas
from riskcohort.operators import records


def record_stream(spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    return (
        spark.readStream.schema(schemas.RECORD_EVENT).format(fmt)
        .option("maxFilesPerTrigger", files_per_trigger).load(path)
    )


def last_actions(stream: DataFrame) -> DataFrame:
    """Running state per assessment: last write or delete. Use output mode ``update``."""
    acts = stream.filter(F.col("action").isin(*records.WRITES, "delete"))
    return records.latest(acts, ["assessment_id"], ["ts", "event_id"], ["action", "snapshot", "ts", "event_id"])


def current_list_writer(stream: DataFrame, publish: Callable[[DataFrame, int], None],
                        checkpoint: str) -> DataStreamWriter:
    """Publish changed assessments per batch; deleted ones arrive with action ``delete``."""
    return (
        last_actions(stream).writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint).foreachBatch(publish)
    )


def last_clears(stream: DataFrame) -> DataFrame:
    """Running time of the last clear of each owner. Use output mode ``update``.

    A list drops every record of the owner that is not newer, as ``records.current_records`` does for a table.
    """
    cleared = stream.filter(F.col("action") == records.CLEAR)
    return cleared.groupBy("owner_id").agg(F.max(F.struct("ts", "event_id")).alias("_at")).select("owner_id", "_at.*")


# What leaves the state of an owner: changes of the list, and results that no longer hold.
LISTED, UNLISTED, STALE = "listed", "unlisted", "stale"
REJECT = "reject"
_OUT = "kind string, owner_id long, assessment_id long, result_id long, ts timestamp, snapshot string"
_RECORD = "ts long, event_id long, snapshot string, reject_ts long, reject_id long, first int, next int"
_NEVER = (-1, -1)
# Timers are rounded up to this many milliseconds, so that an owner has few of them.
_GRAIN = 600_000


class OwnerState(StatefulProcessor):
    """Everything of one owner: records, results and the last clear, in whatever order they arrive.

    A result holds while its snapshot is that of its record. It stops holding by a later edit, delete, clear or rejection,
    or if what came before it, once the watermark has passed it, has another snapshot or none. Each is told once.
    Results leave the state when they stop holding or are older than ``keep_ms``; records that are gone leave it after
    the same time. Records that are there stay: the state is the owner's list and what is recent.
    """

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.records = handle.getMapState("records", "assessment_id long", _RECORD)
        self.results = handle.getMapState("results", "assessment_id long, place int", "result_id long, ts long, snapshot string")
        self.cleared = handle.getValueState("cleared", "ts long, event_id long")

    def _record(self, assessment: int) -> list:
        found = self.records.getValue((assessment,)) if self.records.containsKey((assessment,)) else None
        return list(found) if found else [*_NEVER, None, *_NEVER, 0, 0]

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // _GRAIN) * _GRAIN)

    def _take(self, action: str, assessment: int, at: tuple[int, int], snapshot: str | None) -> bool:
        """Notes an event of a record; whether the list changed."""
        r = self._record(assessment)
        changed = False
        if action == "result":
            self.results.updateValue((assessment, r[6]), (at[1], at[0], snapshot))
            r[6] += 1
            self._wake(at[0] + 1)
            self._wake(at[0] + self.keep_ms)
        elif action == REJECT:
            r[3:5] = max(tuple(r[3:5]), at)
        elif at > tuple(r[:2]):
            gone = action == "delete" or (self.cleared.exists() and tuple(self.cleared.get()) > at)
            r[:3] = [*at, None if gone else snapshot]
            changed = True
            if gone:
                self._wake(at[0] + self.keep_ms)
        self.records.updateValue((assessment,), tuple(r))
        return changed

    def _clear(self, at: tuple[int, int]) -> list[int]:
        """Notes a clear; the records that it takes."""
        if self.cleared.exists() and tuple(self.cleared.get()) >= at:
            return []
        self.cleared.update(at)
        taken = []
        for (assessment,) in list(self.records.keys()):
            r = self._record(assessment)
            if _NEVER < tuple(r[:2]) < at and r[2] is not None:
                r[:3] = [*at, None]
                self.records.updateValue((assessment,), tuple(r))
                taken.append(assessment)
        self._wake(at[0] + self.keep_ms)
        return taken

    def _stale(self, owner: int, assessment: int, watermark: int) -> list[tuple]:
        """Results of a record that stopped holding; they and old ones leave the state."""
        r, out = self._record(assessment), []
        for place in range(r[5], r[6]):
            if not self.results.containsKey((assessment, place)):
                continue
            result, ts, snapshot = self.results.getValue((assessment, place))
            holds = r[2] is not None and r[2] == snapshot
            later = tuple(r[:2]) > (ts, result) or ts < watermark
            gone = tuple(r[3:5]) > (ts, result) or (not holds and later)
            if gone:
                out.append((STALE, owner, assessment, result, max(r[0], r[3]) if max(r[0], r[3]) >= 0 else None, snapshot))
            if gone or ts + self.keep_ms <= watermark:
                self.results.removeKey((assessment, place))
                if place == r[5]:
                    r[5] += 1
        if r[5] == r[6] and r[2] is None and r[0] + self.keep_ms <= watermark and self.records.containsKey((assessment,)):
            self.records.removeKey((assessment,))
        else:
            self.records.updateValue((assessment,), tuple(r))
        return out

    @staticmethod
    def _rows(found: list[tuple]) -> Iterator[pd.DataFrame]:
        if found:
            out = pd.DataFrame(found, columns=["kind", "owner_id", "assessment_id", "result_id", "ts", "snapshot"])
            out["result_id"] = out["result_id"].astype("Int64")
            out["ts"] = pd.to_datetime(out["ts"], unit="ms")
            yield out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        owner, watermark = int(key[0]), timerValues.getCurrentWatermarkInMs()
        touched, listed = {}, {}
        for part in rows:
            for row in part.itertuples(index=False):
                at = (int(row.at_ms), int(row.event_id))
                if row.action == records.CLEAR:
                    for assessment in self._clear(at):
                        touched[assessment] = listed[assessment] = True
                elif not pd.isna(row.assessment_id):
                    assessment = int(row.assessment_id)
                    snapshot = None if row.snapshot is None or row.snapshot != row.snapshot else str(row.snapshot)
                    touched[assessment] = True
                    if self._take(row.action, assessment, at, snapshot):
                        listed[assessment] = True
        out = []
        for assessment in touched:
            if assessment in listed:
                r = self._record(assessment)
                out.append((UNLISTED if r[2] is None else LISTED, owner, assessment, None, r[0], r[2]))
            out += self._stale(owner, assessment, watermark)
        yield from self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark, out = timerValues.getCurrentWatermarkInMs(), []
        for (assessment,) in list(self.records.keys()):
            out += self._stale(int(key[0]), assessment, watermark)
        yield from self._rows(out)


def owner_changes(stream: DataFrame, keep: str = "30 days", lateness: str = "1 hour") -> DataFrame:
    """``kind, owner_id, assessment_id, result_id, ts, snapshot``: ``listed`` and ``unlisted`` records, ``stale`` results.

    One keyed state per owner in which create, edit, delete, clear, rejection and results meet; events without an owner
    take no part, and events later than the watermark are dropped by Spark. Needs the RocksDB state store
    (``use_rocksdb``). A write without a snapshot cannot be told from a record that is gone.
    """
    keep_ms = int(stream.sparkSession.sql(f"select unix_millis(timestamp_seconds(0) + interval {keep})").first()[0])
    acts = stream.filter(F.col("action").isin(*records.WRITES, "delete", "result", records.CLEAR, REJECT) & F.col("owner_id").isNotNull())
    rows = acts.withWatermark("ts", lateness).select(
        "owner_id", "assessment_id", "event_id", "ts", F.unix_millis("ts").alias("at_ms"), "action", "snapshot")
    return rows.groupBy("owner_id").transformWithStateInPandas(OwnerState(keep_ms), _OUT, "append", "eventTime")


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that keyed map states and timers need; set it before the query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def owner_changes_writer(changes: DataFrame, lists: Callable[[DataFrame, int], None], stale: Callable[[DataFrame, int], None],
                         checkpoint: str) -> DataStreamWriter:
    """Changes of lists to one sink, stale results to the other."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            lists(kept.filter(F.col("kind") != STALE).drop("result_id"), batch_id)
            stale(kept.filter(F.col("kind") == STALE).drop("kind"), batch_id)
        finally:
            kept.unpersist()

    return changes.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(handle)
