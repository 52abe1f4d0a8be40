"""Alert deliveries without duplicates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from soundcheck.streaming.run import timed, use_rocksdb


class First(StatefulProcessor):
    """Keyed by (destination, key). State says until when the key is remembered."""

    def __init__(self, within_s: int):
        self.within_s = within_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "at_ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark, until = timerValues.getCurrentWatermarkInMs(), self.until.get()[0] if self.until.exists() else None
        for pdf in rows:  # a part at a time, however often a key comes
            late = pdf["at_ms"] < watermark
            told = [pdf[late].assign(outcome="late")]
            on_time = pdf[~late].drop_duplicates("at_ms").sort_values("at_ms")
            times, i = on_time["at_ms"].to_numpy(), 0 if until is None else on_time["at_ms"].searchsorted(until)
            while i < len(times):  # the key is not known, or forgotten by then
                told.append(on_time.iloc[i:i + 1].assign(outcome="first"))
                until = int(times[i]) + 1000 * self.within_s
                i = on_time["at_ms"].searchsorted(until)
            if len(out := pd.concat(told)):
                yield out[["row", "outcome"]]
        if until is not None and (not self.until.exists() or self.until.get()[0] != until):
            for old in self.handle.listTimers():
                self.handle.deleteTimer(int(old))
            self.until.update((until,))
            self.handle.registerTimer(until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.until.clear()
        yield from ()

    def close(self) -> None:
        pass


def dedupe_alerts_stream(deliveries: DataFrame, within_s: int = 86400, delay: str | None = None) -> DataFrame:
    """The first arrival per destination and idempotency key, and every late row: the columns of ``deliveries`` and ``outcome``.

    ``deliveries``: a stream with destination, idempotency_key and at_s (epoch seconds). A key is remembered for ``within_s``
    seconds of event time. A row older than the watermark (``delay`` behind the newest, by default ``within_s``) may have
    outlived its key, so it is not delivered but told: its ``outcome`` is ``late``, that of a delivery ``first``. A row
    without a time counts as one of 1970, so it is late as soon as there is a watermark.
    """
    use_rocksdb(deliveries.sparkSession)
    packed = deliveries.select("destination", "idempotency_key", F.to_json(F.struct(*deliveries.columns)).alias("row"),
                               (F.coalesce(F.col("at_s"), F.lit(0)) * 1000).cast("long").alias("at_ms"))
    found = timed(packed, delay or f"{within_s} seconds").groupBy("destination", "idempotency_key").transformWithStateInPandas(
        statefulProcessor=First(within_s), outputStructType="row string, outcome string", outputMode="append", timeMode="eventTime")
    return found.select(F.from_json("row", deliveries.schema).alias("row"), "outcome").select("row.*", "outcome")
