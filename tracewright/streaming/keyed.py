"""The incremental export with its memory as keyed state: one value per session, not the tables that were written."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Settings of a session that runs such a stream: where its state is kept, and no batches without rows. State with a time to live asks
#: for one after the other, so that a stream of what is there now would not end; what has expired goes with the next rows.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: A session that has not moved on for so long is forgotten; the readers do not look further back either.
HORIZON = timedelta(days=14)


class LatestExport(StatefulProcessor):
    """Of each session the second of its latest export. A batch's latest row passes if there is none or that row is later. Rows have
    their time in microseconds as __at."""

    def __init__(self, horizon: timedelta):
        self.horizon = horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "second long", int(self.horizon.total_seconds() * 1000))

    def _keep(self, key: tuple, second: int | None) -> None:
        if second is not None and key[0] is not None:
            self.last.update((second,))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        latest = max(rows, key=lambda r: (r["__at"] is not None, r["__at"] or 0))
        second = latest["__at"] // 1_000_000 if latest["__at"] is not None else None
        had = self.last.get()[0] if self.last.exists() else None
        if had is None or (second is not None and second > had):
            self._keep(key, second)
            yield latest

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        self._keep(key, initialState["second"])

    def close(self) -> None:
        pass


def unseen(stream: DataFrame, session: str = "session_id", ts: str = "ts", exported: DataFrame | None = None, horizon: timedelta = HORIZON) -> DataFrame:
    """The rows of a stream to export: of each batch and session the latest one, if the session is new or has moved on by a second.

    What has been exported is state, keyed by session: a batch costs as much as it has sessions, however much was exported before,
    and a restart from its checkpoint goes on from the same state. `exported` (session, ts) is what a first start finds exported
    already; one row per session of it is read, once. State is dropped `horizon` after its last change. A row without a session is
    always exported, one without a time while its session has no export with a time. The session needs SETTINGS.
    """
    known = None
    if exported is not None:
        known = exported.groupBy(session).agg(F.unix_seconds(F.max(F.col(ts).cast("timestamp"))).alias("second")).groupBy(session)
    timed = stream.withColumn("__at", F.unix_micros(F.col(ts).cast("timestamp")))
    return timed.groupBy(session).transformWithState(LatestExport(horizon), timed.schema, "Append", "ProcessingTime", known).drop("__at")
