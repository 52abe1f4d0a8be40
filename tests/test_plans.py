"""The shape of plans: one scan per table, no nested loops, no row-at-a-time Python."""

import soundcheck.catalog  # noqa: F401 - registers the queries
from soundcheck.catalog.base import QUERIES, Data
from soundcheck.operators import checks as B
from soundcheck.operators.registry import Snapshot
from soundcheck.plans.sizing import may_be_among

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_are_fused(spark):
    d = Data(spark, SMALL)
    rows = [dict(name=str(i), kind="count", table_name="lineitem", filter=f"l_linenumber = {i}", expect_min=0) for i in range(20)]
    text = plan(B.count_checks(spark, B.checks_table(spark, rows), Snapshot({"lineitem": d.lineitem})))
    assert text.count("FileScan") == 1 and "ReadSchema: struct<l_linenumber:int>" in text


def test_no_cross_joins_and_no_row_python(spark):
    for name in ("B5_file_exists", "B6_file_count", "B7_checksum", "C3_foreign_key", "C6_overlaps", "C9_snapshot_diff", "F2_last_good", "F6_fleet",
                 "F9_asof_recovery_point", "H2_scrub", "H9_scan_credentials", "L6_verify_chain", "L9_evidence_by_target", "M1_overdue", "M7_rate_limit"):
        text = plan(QUERIES[name](spark, SMALL))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "BatchEvalPython" not in text, name


def test_bounded_walk_prunes_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(QUERIES["F2_last_good_bounded"](spark, SMALL))


def test_functions_travel_without_the_package():
    import subprocess
    import sys

    from pyspark import cloudpickle

    from soundcheck.operators.ledger import _fold
    from soundcheck.sources.files import _list

    code = "import pickle, sys; fs = pickle.loads(sys.stdin.buffer.read()); assert 'soundcheck' not in sys.modules; print(len(fs))"
    done = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps([_fold, _list]), capture_output=True, cwd="/")
    assert done.stdout.strip() == b"2", done.stderr


def test_map_of_keys_holds_every_key_and_few_others(spark):
    rows = spark.range(4000).selectExpr("if(id = 7, null, struct(id)) AS k", "id", "repeat('x', 50) AS wide")
    keys = rows.where("id % 10 = 7").select("k")
    marked = may_be_among(rows, "k", keys)
    assert marked.columns == ["k", "id", "wide", "_maybe"] and marked.count() == 4000
    found = {r.id for r in marked.where("_maybe").collect()}
    assert {i for i in range(4000) if i % 10 == 7} <= found and len(found) < 410
    assert may_be_among(rows, "k", keys.limit(0)).where("_maybe").count() == 0
    assert "Exchange hashpartitioning(k" not in marked._jdf.queryExecution().executedPlan().toString()
