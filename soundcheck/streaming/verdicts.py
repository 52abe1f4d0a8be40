"""Verdicts of runs whose check results arrive in any number of micro-batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from soundcheck.operators.verdict import failing
from soundcheck.streaming.run import use_rocksdb

COUNTS = "run_id string, checks long, failed_required long, revision long"
BUCKETS = 16_384


class Counts(StatefulProcessor):
    """Keyed by bucket of runs. State is, for each run, how many results there were, how many of them fail the run, and how often it was told."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("runs", "runs string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        runs = dict(json.loads(self.counts.get()[0])) if self.counts.exists() else {}
        found: dict[str | None, list[int]] = {}
        for pdf in rows:
            for run, fails in zip(pdf["run_id"].tolist(), pdf["fails"].tolist()):
                now = found.setdefault(run if isinstance(run, str) else None, [0, 0])
                now[0], now[1] = now[0] + 1, now[1] + int(fails)
        for run, (checks, failed) in found.items():
            before = runs.get(run, (0, 0, 0))
            runs[run] = (before[0] + checks, before[1] + failed, before[2] + 1)
        self.counts.update((json.dumps(list(runs.items())),))
        told = [runs[run] for run in found]
        yield pd.DataFrame({"run_id": pd.Series(list(found), dtype="object"), "checks": [t[0] for t in told],
                            "failed_required": [t[1] for t in told], "revision": [t[2] for t in told]})

    def close(self) -> None:
        pass


def verdict_stream(results: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """run_id, checks, failed_required and revision whenever results of a run arrive; a later revision replaces an earlier one.

    A micro-batch reads its own results only; what came before is two counts per run in the state, one state row for each
    of ``buckets`` buckets of runs, so that a batch makes at most that many calls, however many runs it has. Replayed
    batches count once, as state and output are committed together. ``buckets`` stays as it is for a checkpoint.
    """
    use_rocksdb(results.sparkSession)
    return results.select("run_id", F.pmod(F.xxhash64("run_id"), F.lit(buckets)).alias("bucket"), failing().alias("fails")).groupBy(
        "bucket").transformWithStateInPandas(
        statefulProcessor=Counts(), outputStructType=COUNTS, outputMode="append", timeMode="none")


def newest_verdicts(counts: DataFrame, load: DataFrame) -> DataFrame:
    """run_id, verdict, checks and failed_required of every run of ``load`` (run_id, ok), by what was told of it last."""
    newest = counts.groupBy("run_id").agg(F.max_by(F.struct("checks", "failed_required"), "revision").alias("n"))
    zero = F.lit(0).cast("long")
    known = load.select("run_id", "ok").join(newest, "run_id", "left").select(
        "run_id", "ok", F.coalesce("n.checks", zero).alias("checks"), F.coalesce("n.failed_required", zero).alias("failed_required"))
    passed = F.coalesce("ok", F.lit(False)) & (F.col("failed_required") == 0)
    return known.select("run_id", F.when(passed, F.lit("pass")).otherwise(F.lit("fail")).alias("verdict"), "checks", "failed_required")
