"""Streams lose no row: what comes behind the watermark is told, and verdicts follow any split."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from soundcheck.operators.verdict import verdicts
from soundcheck.streaming.alerts import dedupe_alerts_stream
from soundcheck.streaming.overdue import overdue_stream, transitions_and_late
from soundcheck.streaming.run import read_files, run_available
from soundcheck.streaming.verdicts import newest_verdicts, verdict_stream

MONITORS = "tenant_id string, target string, monitor_id string, created_at bigint, interval_s bigint, grace_s bigint, alert_state string"


def batches_of(spark, tmp_path, parts, schema, make):
    """Run ``make(stream)`` over ``parts``, one run (and at least one micro-batch) each, and return the table."""
    for rows in parts:
        frame = spark.createDataFrame(rows, schema)
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = run_available(make(read_files(spark, str(tmp_path / "in"), frame.schema)), "x", str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    return out


def test_late_arrivals_are_told_and_change_nothing(spark, tmp_path):
    monitors = spark.createDataFrame([("t", "a", "m", 0, 100, 0, "ok"), ("t", "quiet", "q", 0, 10**9, 0, "ok")], MONITORS)
    parts = [[("t", "a", 50), ("t", "a", 50), ("t", "b", 60)], [("t", "a", 10_000)], [("t", "a", 70), ("t", "a", 70), ("t", "b", 80), ("t", "a", 10_050)],
             [("t", "a", None), ("t", "quiet", 90), ("t", "a", 10_060)]]
    told = batches_of(spark, tmp_path, parts, "tenant_id string, target string, created_at bigint", lambda s: overdue_stream(s, monitors, "60 seconds"))
    moves, late = transitions_and_late(told)
    assert Counter((r.target, r.monitor_id, r.at_s) for r in late.collect()) == {("a", "m", 70): 2, ("b", None, 80): 1, ("a", "m", 0): 1, ("quiet", "q", 90): 1}
    assert [(r.event, r.at_s) for r in moves.orderBy("at_s").collect()] == [("overdue", 151), ("recovered", 10_000)]


def test_every_alert_is_delivered_told_or_a_repetition(spark, tmp_path):
    schema = "id string, destination string, idempotency_key string, at_s bigint, note string, n int"
    row = lambda i, k, at, d="x": (i, d, k, at, None, None)
    parts = [[row("1", "k", 1000), row("2", "k", 1001), row("3", "j", 1000)], [row("4", "k", 9000), row("5", "late", 10, None), row("6", "new", 9000)],
             [row("7", "late", 20), row("8", "k", 1002), row("9", "k", 9001), row("10", "new", None), row("11", "far", 9500, None)]]
    told = batches_of(spark, tmp_path, parts, schema, lambda s: dedupe_alerts_stream(s, 500))
    got = {r.id: r.outcome for r in told.collect()}
    assert told.schema.names == [*schema.replace(" string", "").replace(" bigint", "").replace(" int", "").split(", "), "outcome"]
    assert {i for i, o in got.items() if o == "first"} == {"1", "3", "4", "6", "11"}  # 4: the key is forgotten by then
    assert {i for i, o in got.items() if o == "late"} == {"5", "7", "8", "10"}
    assert {"2", "9"}.isdisjoint(got)


@pytest.mark.parametrize("split", [1, 2, 5])
def test_verdicts_from_state_equal_the_batch_answer_over_any_split(spark, tmp_path, split):
    schema = "run_id string, ok boolean, severity string"
    rows = [("r%d" % (i % 7), None if i % 11 == 0 else i % 5 > 0, [None, "", "advisory", "required"][i % 4]) for i in range(60)] + [("good", True, "")]
    load = spark.createDataFrame([(f"r{i}", i != 3) for i in range(7)] + [("good", True), ("none", True), ("bad", False), ("unknown", None)], "run_id string, ok boolean")
    told = batches_of(spark, tmp_path, [rows[i::split] for i in range(split)], schema, verdict_stream)
    again = run_available(verdict_stream(read_files(spark, str(tmp_path / "in"), told.sparkSession.createDataFrame([], schema).schema)), "x",
                          str(tmp_path / "out"), str(tmp_path / "checkpoint"))  # nothing new: nothing is told twice
    want = verdicts(spark.createDataFrame(rows, schema), load).select("run_id", "verdict").collect()
    got = newest_verdicts(again, load)
    assert {r.run_id: r.verdict for r in got.collect()} == {r.run_id: r.verdict for r in want}
    assert got.agg(F.sum("checks")).first()[0] == len(rows)
    assert again.groupBy("run_id").agg(F.max("revision").alias("r")).filter(F.col("r") > split).count() == 0
