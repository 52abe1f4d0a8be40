"""Headline queries, timed: prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the cores, BENCH_RUNS the timed runs (median is taken),
BENCH_ONLY a comma-separated choice of queries.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def headline():
    from soundcheck.catalog import QUERIES
    from soundcheck.catalog.base import AS_OF, Data
    from soundcheck.catalog.discovery import snapshot
    from soundcheck.operators import checks as B, discovery as D, ledger as L
    from soundcheck.operators.registry import Snapshot

    def fused_checks(spark, folder):
        d = Data(spark, folder)
        tables = ["customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations"]
        rows = [dict(name=f"{t}_{i}", kind="count", table_name=t, filter=f, expect_min=0) for t in tables for i, f in enumerate((None, "1 = 1"))]
        rows += [dict(name="discount", kind="count", table_name="lineitem", filter="l_discount > 0.1", equals="0"),
                 dict(name="price", kind="count", table_name="orders", filter="o_totalprice < 0", equals="0"),
                 dict(name="tax", kind="count", table_name="lineitem", filter="l_tax IS NULL", equals="0"),
                 dict(name="recent", kind="count", table_name="events", filter="ts > TIMESTAMP_NTZ '2024-01-20 00:00:00'", expect_min=1)]
        return B.count_checks(spark, B.checks_table(spark, rows), Snapshot({t: d.table(t) for t in tables}), AS_OF)

    def scaffold(spark, folder):
        return D.scaffold(spark, snapshot(Data(spark, folder)), "mysql", as_of=AS_OF)

    def ledger_build_verify(spark, folder):
        return L.verify_chain(L.build_ledger(Data(spark, folder).attestations))

    named = {"fused_checks": fused_checks, "scaffold": scaffold, "ledger_build_verify": ledger_build_verify}
    picked = ["H9_scan_credentials", "H2_scrub", "H6_redact_got", "F2_last_good", "F4_snapshot_verdicts",
              "F6_fleet", "F9_asof_recovery_point", "V1_verdicts", "V4_build_reports", "C3_foreign_key", "C6_overlaps", "C9_snapshot_diff",
              "L9_evidence_by_target", "L8_accept_submissions", "M1_overdue", "M7_rate_limit", "B5_file_exists", "B6_file_count",
              "B8_responses", "E5_evaluate_expectations", "A9_effective_settings", "D18_cap_candidates"]
    chosen = {**named, **{n: QUERIES[n] for n in picked}}
    only = os.environ.get("BENCH_ONLY")
    return {n: f for n, f in chosen.items() if not only or n in only.split(",")}


def main() -> None:
    from soundcheck.session import local_session
    spark = local_session(CPUS, int(CPUS))
    times = {}
    for name, fn in headline().items():
        took = []
        for _ in range(RUNS + 1):  # the first run warms up
            start = time.perf_counter()
            fn(spark, FOLDER).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        times[name] = round(statistics.median(took[1:]), 3)
        print(f"{name:28s} {times[name]:8.3f}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"), "cpus": int(CPUS)}))


if __name__ == "__main__":
    main()
