"""Progress of streaming queries as rows."""

from __future__ import annotations

import datetime
import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

PROGRESS = """query_id string, run_id string, name string, batch_id long, at timestamp, input_rows long, input_per_sec double, processed_per_sec double,
 batch_ms long, add_batch_ms long, planning_ms long, commit_ms long, watermark timestamp, newest_event timestamp, watermark_lag_sec double, state_rows long, state_bytes long, late_rows long"""


def _time(text: str | None) -> datetime.datetime | None:
    """A progress time; the epoch stands for none."""
    if not text or text.startswith("1970-01-01T00:00:00"):
        return None
    return datetime.datetime.fromisoformat(text.replace("Z", "+00:00"))


class ProgressLog(StreamingQueryListener):
    """Collects the progress of the queries of a session: rows read and processed a second, durations, watermark lag, state.

    Attach with `with ProgressLog(spark) as log:`; at its end it waits for the events of queries that have ended, which
    arrive after them and in order, `patience_s` at most. Rows wait in memory until `write` moves them to a table, which also
    happens by itself every `flush` rows where a path is given.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, flush: int = 1000, patience_s: float = 30.0):
        self.spark, self.path, self.flush, self.patience_s = spark, path, flush, patience_s
        self.open: set[str] = set()
        self.found: list[tuple] = []
        self.lock = threading.Lock()

    def __enter__(self) -> ProgressLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *error) -> None:
        deadline = time.monotonic() + self.patience_s
        while time.monotonic() < deadline and self.open - {str(q.runId) for q in self.spark.streams.active}:
            time.sleep(0.05)
        self.spark.streams.removeListener(self)
        if self.path:
            self.write(self.path)

    def onQueryStarted(self, event) -> None:
        self.open.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        ms, times = dict(p.durationMs), dict(p.eventTime or {})
        mark, newest = _time(times.get("watermark")), _time(times.get("max"))
        lag = (newest - mark).total_seconds() if mark and newest else None
        states = list(p.stateOperators)
        row = (str(p.id), str(p.runId), p.name, int(p.batchId), _time(p.timestamp), int(p.numInputRows), float(p.inputRowsPerSecond), float(p.processedRowsPerSecond),
               ms.get("triggerExecution"), ms.get("addBatch"), ms.get("queryPlanning"), ms.get("commitOffsets"), mark, newest, lag,
               sum(int(s.numRowsTotal) for s in states), sum(int(s.memoryUsedBytes) for s in states), sum(int(s.numRowsDroppedByWatermark) for s in states))
        with self.lock:
            self.found.append(row)
            full = self.path is not None and len(self.found) >= self.flush
        if full:
            self.write(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.open.discard(str(event.runId))

    def rows(self) -> DataFrame:
        """What has not been written yet."""
        with self.lock:
            return self.spark.createDataFrame(list(self.found), PROGRESS)

    def write(self, path: str) -> None:
        """Append to a table and forget."""
        with self.lock:
            rows, self.found = self.found, []
        if rows:
            self.spark.createDataFrame(rows, PROGRESS).write.mode("append").parquet(path)
