"""Telling that a run has fallen silent, from its log alone.

A run that writes nothing cannot report it, so every line sets a timer in Spark's keyed
state. When the log of all runs has gone on past it, the run is reported; a line that
comes later reports its return. What is kept for a run is its newest line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from palindra.operators import runlog

REPORT = "run_id bigint, state string, seq bigint, since_us bigint, until_us bigint"
#: The state store of Spark that has timers.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SilenceWatch(StatefulProcessor):
    """One run. Rows are (run_id, seq, at_us, at); ``at`` carries the watermark."""

    def __init__(self, quiet_us: int, started_us: int | None = None, grace_us: int = 0):
        self.quiet_us, self.graced_until = quiet_us, (started_us or 0) + grace_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Newest line, and whether its silence is reported.
        self.newest = handle.getValueState("newest", "seq bigint, at_us bigint, silent boolean")

    def due_ms(self, at_us: int) -> int:
        """The timer of a newest line at ``at_us``; watermarks are whole milliseconds."""
        return -(-max(at_us + self.quiet_us, self.graced_until) // 1000) + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = self.newest.get()
        seq, at, silent = kept if kept is not None else (None, None, False)
        parts = list(rows)
        lines = parts[0] if len(parts) == 1 else pd.concat(parts)
        times, seqs = lines["at_us"].to_numpy(), lines["seq"].to_numpy()
        order = np.lexsort((seqs, times))
        times, seqs = times[order], seqs[order]
        if at is not None:
            # the run was heard of since the others
            since = times >= at
            times, seqs = times[since], seqs[since]
        if len(times) == 0:
            return
        if at is not None:
            times, seqs = np.append(at, times), np.append(seq, seqs)
        due = np.maximum(times[:-1] + self.quiet_us, self.graced_until)
        found = []
        for i in np.flatnonzero(times[1:] > due).tolist():
            if i or not silent:
                found.append((key[0], "silent", seqs[i], times[i], None))
            found.append((key[0], "returned", seqs[i + 1], times[i], times[i + 1]))
        if kept is not None and not silent:
            # The one timer of a run is that of its newest line until it goes off.
            self.handle.deleteTimer(self.due_ms(at))
        seq, at = int(seqs[-1]), int(times[-1])
        self.newest.update((seq, at, False))
        self.handle.registerTimer(self.due_ms(at))
        if found:
            yield _report(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seq, at, silent = self.newest.get()
        if not silent:
            self.newest.update((seq, at, True))
            yield _report([(key[0], "silent", seq, at, None)])

    def close(self) -> None:
        pass


_TYPES = {"run_id": "int64", "state": "object", "seq": "int64", "since_us": "int64", "until_us": "Int64"}


def _report(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=list(_TYPES)).astype(_TYPES)


def silences(
    log: DataFrame,
    quiet_seconds: float = runlog.STALE_SECONDS,
    late: str = "0 seconds",
    started_us: int | None = None,
    grace_seconds: float = 0,
) -> DataFrame:
    """(run_id, state, seq, since_us, until_us): ``silent`` rows of runs that wrote nothing for
    longer than ``quiet_seconds`` after line ``seq`` at ``since_us``, ``returned`` rows of those
    that went on with line ``seq`` at ``until_us``.

    ``log`` is a stream of (run_id, seq, at_us), the last in microseconds since 1970. A run that is silent at its
    start is left alone until ``grace_seconds`` after ``started_us``. Lines of a run that
    come later than a newer one say nothing. The newest line of each run is all that is kept.
    """
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    watch = SilenceWatch(round(quiet_seconds * 1e6), started_us, round(grace_seconds * 1e6))
    return (
        log.select("run_id", "seq", "at_us", F.timestamp_micros("at_us").alias("at"))
        .withWatermark("at", late)
        .groupBy("run_id")
        .transformWithStateInPandas(watch, REPORT, "Append", "EventTime")
    )


def follow(reports: DataFrame, folder: str) -> StreamingQuery:
    """Append the reports of what has arrived, with those that are due by then, to ``out``."""
    return (
        reports.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
