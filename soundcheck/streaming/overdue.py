"""Overdue monitors as a stream: alert when silence lasts too long, recover on arrival.

State is one row per (tenant, target); event-time timers end the silence. Time advances with the
watermark, so the stream needs a heartbeat: any row, of any tenant, carries time forward.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from soundcheck.streaming.run import timed, use_rocksdb

WATERMARK = "10 minutes"
EVENTS = "tenant_id string, target string, monitor_id string, event string, at_s bigint, freshest bigint"
STATE = "monitor_id string, freshest bigint, seen boolean, deadline_after bigint, alerting boolean"


class Overdue(StatefulProcessor):
    """Keyed by (tenant, target); a key without a monitor is ignored."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("monitor", STATE)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState.iloc[0]
        # A monitor without entries is measured from its creation.
        self._put(str(row["monitor_id"]), int(row["created_at"]), False,
                  int(row["interval_s"]) + int(row["grace_s"]), row["alert_state"] == "alerting")

    def _put(self, monitor_id, freshest, seen, after, alerting) -> None:
        for old in self.handle.listTimers():
            self.handle.deleteTimer(int(old))
        self.state.update((monitor_id, freshest, seen, after, alerting))
        if not alerting:
            self.handle.registerTimer((freshest + after + 1) * 1000)  # overdue means strictly later

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark, arrivals = timerValues.getCurrentWatermarkInMs(), []
        known = self.state.get() if self.state.exists() else None
        for pdf in rows:  # a part at a time, however many a key has
            late = pdf["at_ms"] < watermark
            arrivals.append(pdf.loc[~late, "at_ms"].unique() // 1000)
            if late.any():
                at = pdf.loc[late, "at_ms"] // 1000
                yield pd.DataFrame({"tenant_id": key[0], "target": key[1], "monitor_id": known[0] if known else None, "event": "late",
                                    "at_s": at, "freshest": None}).astype({"freshest": "Int64"})
        if not known:
            return
        monitor_id, freshest, seen, after, alerting = known
        out = []
        for at in np.unique(np.concatenate(arrivals)).tolist():
            if at <= freshest and seen:
                continue
            late = at - freshest > after
            if late and not alerting:  # the alert fell between two arrivals of one batch
                out.append((*key, monitor_id, "overdue", freshest + after + 1, freshest if seen else None))
            if late or alerting:
                out.append((*key, monitor_id, "recovered", at, at))
            alerting, freshest, seen = False, at, True
        self._put(monitor_id, freshest, seen, after, alerting)
        if out:
            yield pd.DataFrame(out, columns=["tenant_id", "target", "monitor_id", "event", "at_s", "freshest"]).astype(
                {"freshest": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        monitor_id, freshest, seen, after, alerting = self.state.get()
        if alerting or expiredTimerInfo.getExpiryTimeInMs() != (freshest + after + 1) * 1000:
            return  # a timer from before the newest arrival
        self.state.update((monitor_id, freshest, seen, after, True))
        yield pd.DataFrame({"tenant_id": [key[0]], "target": [key[1]], "monitor_id": [monitor_id], "event": ["overdue"],
                            "at_s": [freshest + after + 1], "freshest": [freshest if seen else None]}).astype(
            {"freshest": "Int64"})

    def close(self) -> None:
        pass


def overdue_stream(attestations: DataFrame, monitors: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Transitions (``overdue``, ``recovered``) as they happen, with the time of each, and every ``late`` arrival.

    ``attestations``: a stream of tenant_id, target, created_at (epoch seconds). ``monitors``: a table;
    its rows seed the state, so that monitors that never hear anything alert too. An arrival older than the
    watermark changes nothing any more and is told as ``late``, row by row, also where no monitor waits for it
    (``transitions_and_late`` parts the two). One without a time counts as one of 1970.
    """
    use_rocksdb(monitors.sparkSession)
    placed = timed(attestations.select("tenant_id", "target", (F.coalesce(F.col("created_at"), F.lit(0)) * 1000).cast("long").alias("at_ms")), watermark)
    seeds = monitors.select("tenant_id", "target", "monitor_id", "created_at", "interval_s", "grace_s", "alert_state")
    return placed.groupBy("tenant_id", "target").transformWithStateInPandas(
        statefulProcessor=Overdue(), outputStructType=EVENTS, outputMode="append", timeMode="eventTime",
        initialState=seeds.groupBy("tenant_id", "target"))


def transitions_and_late(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The transitions, and the side table of late arrivals (tenant_id, target, monitor_id, at_s)."""
    return events.filter("event <> 'late'"), events.filter("event = 'late'").select("tenant_id", "target", "monitor_id", "at_s")
