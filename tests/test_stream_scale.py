"""Streams over many small keys: few calls per batch, and inputs whose files stay bounded."""

import pandas as pd

from soundcheck.catalog.streams import stream_of
from soundcheck.catalog.base import Data
from soundcheck.streaming.run import run_available
from soundcheck.streaming.verdicts import Counts, newest_verdicts, verdict_stream


class _State:
    def __init__(self):
        self.row = None

    def exists(self):
        return self.row is not None

    def get(self):
        return self.row

    def update(self, row):
        self.row = row


def test_one_call_counts_many_runs():
    c = Counts()
    c.counts = _State()
    told = lambda runs, fails: {r[0]: r[1:] for r in next(iter(c.handleInputRows((1,), iter([pd.DataFrame(
        {"run_id": runs, "bucket": 1, "fails": fails})]), None))).astype(object).itertuples(index=False, name=None)}
    assert told(["a", "b", "a", None], [True, False, True, False]) == {"a": (2, 2, 1), "b": (1, 0, 1), None: (1, 0, 1)}
    assert told(["b", None], [True, True]) == {"b": (2, 1, 2), None: (2, 1, 2)}


def test_files_and_batches_grow_with_the_rows(spark):
    rows = spark.range(1000).selectExpr("concat('r', id % 50) AS run_id", "id % 7 > 0 AS ok", "'required' AS severity")
    stream = stream_of(Data(spark, ""), rows, "grown", rows, files_per_batch=1, rows_per_file=50)
    out = run_available(verdict_stream(stream, buckets=8), "verdicts")
    assert out.groupBy("run_id").agg({"revision": "max"}).filter("`max(revision)` > 4").count() == 0  # still four batches
    load = rows.select("run_id").distinct().selectExpr("run_id", "true AS ok")
    assert {tuple(r) for r in newest_verdicts(out, load).select("checks", "verdict").collect()} == {(20, "fail")}
