"""Backup chains, fleets and points in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundcheck.catalog.base import AS_OF, AS_OF_EPOCH, query
from soundcheck.functions.messages import failure_reason
from soundcheck.functions.scalars import epoch
from soundcheck.operators import chains as Ch
from soundcheck.operators.checks import checks_table
from soundcheck.operators.registry import Snapshot

CHAIN = "c AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY ts DESC, ord) AS rn FROM backups)"


def _tested(max_try=0):
    bound = f" WHERE rn <= {max_try}" if max_try else ""
    return f"""{CHAIN}, w AS (SELECT *, coalesce(sum(CASE WHEN verdict = 'pass' THEN 1 ELSE 0 END)
        OVER (PARTITION BY unit ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c{bound}),
      tested AS (SELECT unit, rn, label, ts, verdict, verdict = 'pass' AS is_recovery_point FROM w WHERE before = 0)"""


@query("F1_chain", f"WITH {CHAIN} SELECT unit, rn, label, type FROM c", "backups")
def _(d):
    return Ch.chain(d.backups).select("unit", "rn", "label", "type")


@query("F1_chain_of_unit", f"""WITH {CHAIN} SELECT unit, rn, label, NULL AS error FROM c WHERE unit = 'unit_3'
    UNION ALL SELECT 'unit_none', NULL, NULL, 'stanza "unit_none" not found'""", "backups")
def _(d):
    cols = ["unit", "rn", "label", "error"]
    return Ch.chain(d.backups, "unit_3").select(*cols).unionByName(Ch.chain(d.backups, "unit_none").select(*cols))


@query("F2_last_good", f"WITH {_tested()} SELECT unit, rn, label, verdict, is_recovery_point FROM tested", "backups")
def _(d):
    return Ch.last_good(d.backups).select("unit", "rn", "label", "verdict", "is_recovery_point")


@query("F2_last_good_bounded", f"WITH {_tested(3)} SELECT unit, rn, label, verdict, is_recovery_point FROM tested", "backups")
def _(d):
    return Ch.last_good(d.backups, max_try=3).select("unit", "rn", "label", "verdict", "is_recovery_point")


@query("F3_last_good_search", f"""WITH {_tested()} SELECT rn, label, verdict, is_recovery_point FROM tested WHERE unit = 'unit_11'""", "backups")
def _(d):
    backups = d.backups.filter("unit = 'unit_11'")

    def check(label):  # a job of its own per candidate
        row = backups.filter(F.col("label") == label).select("verdict").first()
        return "" if row["verdict"] == "pass" else "a required check failed"

    return Ch.last_good_search(d.spark, Ch.chain(backups), check, parallel=4).drop("reason")


SNAPSHOT_CHECKS = [
    dict(name="rows", severity="required", sql="count(1)", expect_min=1),
    dict(name="no_negative", severity="required", sql="count_if(o_totalprice < 0)", equals="0"),
    dict(name="some_urgent", severity="advisory", sql="max(o_orderkey)", expect_min=1e15),
    dict(name="enough", severity="required", sql="count(1)", expect_min=1000),
    dict(name="open_orders", severity="required", sql="bool_or(o_orderstatus = 'O')", bool=True),
    dict(name="age", severity="required", sql="CAST(max(o_orderdate) AS STRING)", max_age_s=26 * 365 * 86400),
]
SNAP = f"""
    s AS (SELECT snapshot_id, count(*) AS n, count(*) FILTER (WHERE o_totalprice < 0) AS neg, bool_or(o_orderstatus = 'O') AS open,
            {AS_OF_EPOCH} - epoch_us(max(o_orderdate)) // 1000000 AS age FROM snapshots GROUP BY 1),
    sv AS (SELECT snapshot_id, (n < 1)::INT + (neg <> 0)::INT + (n < 1000)::INT + (NOT open)::INT + (age > {26 * 365 * 86400})::INT AS bad FROM s)"""


@query("F4_snapshot_verdicts", f"""WITH {SNAP} SELECT snapshot_id, 6 AS checks, bad AS failed_required,
    CASE WHEN bad > 0 THEN 'fail' ELSE 'pass' END AS verdict FROM sv""", "snapshots")
def _(d):
    return Ch.snapshot_verdicts(d.snapshots, checks_table(d.spark, SNAPSHOT_CHECKS), as_of=AS_OF)


@query("F4_last_good_snapshot", f"""WITH {SNAP}, r AS (SELECT *, row_number() OVER (ORDER BY snapshot_id DESC) AS rn FROM sv)
    SELECT rn, snapshot_id AS label, bad = 0 AS is_recovery_point FROM r
    WHERE rn <= coalesce((SELECT min(rn) FROM r WHERE bad = 0), 1000000)""", "snapshots")
def _(d):
    verdicts = Ch.snapshot_verdicts(d.snapshots, checks_table(d.spark, SNAPSHOT_CHECKS), as_of=AS_OF)
    year = F.substring_index("snapshot_id", "_", -1)
    backups = verdicts.select(F.lit("orders").alias("unit"), F.lit(0).alias("ord"), F.col("snapshot_id").alias("label"), "verdict",
                              F.to_timestamp(F.concat(year, F.lit("-12-31 00:00:00"))).alias("ts"))
    return Ch.last_good(backups).select("rn", "label", "is_recovery_point")


# Checks of three kinds, for every snapshot by itself.
EVERY_CHECKS = [
    dict(name="orders", severity="required", kind="sql", sql="SELECT count(*) FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')", expect_min=5),
    dict(name="open", severity="required", kind="count", table_name="orders", filter='{"o_orderstatus": "O"}', expect_min=1),
    dict(name="first", severity="advisory", kind="field", table_name="orders", filter="o_totalprice > 0", field="o_orderstatus", order_by="o_orderkey", equals="F"),
]


@query("F4_run_every", """
    WITH s AS (SELECT snapshot_id, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM snapshots p WHERE p.snapshot_id = o.snapshot_id AND p.o_custkey = o.o_custkey AND p.o_orderstatus = 'P')) AS n,
        count(*) FILTER (WHERE o_orderstatus = 'O') AS open, arg_min(o_orderstatus, o_orderkey) FILTER (WHERE o_totalprice > 0) AS first FROM snapshots o GROUP BY 1)
    SELECT snapshot_id, 'orders' AS name, CAST(n AS VARCHAR) AS got, n >= 5 AS ok FROM s UNION ALL SELECT snapshot_id, 'open', CAST(open AS VARCHAR), open >= 1 FROM s
    UNION ALL SELECT snapshot_id, 'first', first, first = 'F' FROM s""", "snapshots")
def _(d):
    labels = [r[0] for r in d.snapshots.select("snapshot_id").distinct().collect()]  # as many as the chain has members
    members = {label: lambda label=label: Snapshot({"orders": d.snapshots.filter(F.col("snapshot_id") == label)}) for label in labels}
    return Ch.run_every(d.spark, checks_table(d.spark, EVERY_CHECKS), members, AS_OF).select("snapshot_id", "name", "got", "ok")


@query("F5_recovery_age", f"""WITH {_tested()} SELECT unit, label,
      CAST(round(({AS_OF_EPOCH} - epoch_us(ts) // 1000000) / 60) * 60 AS BIGINT) AS age_s,
      concat((({AS_OF_EPOCH} - epoch_us(ts) // 1000000) // 3600), 'h0m0s') AS age FROM tested WHERE is_recovery_point""", "backups")
def _(d):
    return Ch.recovery_age(Ch.last_good(d.backups), AS_OF)


FLEET = """
    f AS (SELECT u.unit, CASE WHEN status_message <> '' THEN status_message WHEN status_code = 0 THEN 'ok' ELSE concat('status ', status_code) END AS status,
            count(b.label) AS backup_count, arg_max(b.label, (b.ts, -b.ord)) AS newest_label, epoch_us(max(b.ts)) // 1000000 AS newest_backup
          FROM units u LEFT JOIN backups b ON u.unit = b.unit GROUP BY 1, 2)"""


@query("F6_fleet", f"WITH {FLEET} SELECT * FROM f", "units backups")
def _(d):
    return Ch.fleet(d.units, d.backups).withColumn("newest_backup", epoch("newest_backup"))


REPOSITORIES = """
    SELECT doc_id, doc_id % 3 AS exit_code, doc_id % 4 AS backups, concat('Error: ', lang) AS out,
      CASE WHEN doc_id % 5 = 0 THEN source ELSE '' END AS location, CASE WHEN doc_id % 2 = 0 THEN lang END AS target FROM documents"""


@query("F7_unit_status", f"""
    WITH r AS ({REPOSITORIES}) SELECT doc_id, CASE WHEN exit_code <> 0 THEN out WHEN backups = 0 THEN 'empty' ELSE 'ok' END AS status,
      CASE WHEN location <> '' THEN location WHEN target <> '' THEN target ELSE 'repository' END AS name FROM r""")
def _(d):
    r = d.sql(REPOSITORIES)
    reason = failure_reason("out", "restic", F.col("exit_code"))
    return r.select("doc_id", Ch.repository_status(F.col("exit_code"), reason, F.col("backups")).alias("status"),
                    Ch.repository_name(F.col("location"), F.col("target")).alias("name"))


@query("F8_fleet_degraded", f"""
    WITH {FLEET} SELECT 'all' AS part, bool_or(status <> 'ok' OR backup_count = 0) AS degraded FROM f
    UNION ALL SELECT 'healthy', bool_or(status <> 'ok' OR backup_count = 0) FROM f WHERE backup_count > 0
    UNION ALL SELECT 'none', true""", "units backups")
def _(d):
    known = Ch.fleet(d.units, d.backups)
    part = lambda name, df: Ch.fleet_degraded(df).withColumn("part", F.lit(name))
    return part("all", known).unionByName(part("healthy", known.filter("backup_count > 0"))).unionByName(
        part("none", known.filter("backup_count < 0")))


TARGETS = """
    SELECT concat('unit_', l_partkey % 26) AS unit, concat(l_orderkey, '_', l_linenumber) AS target_id, l_shipdate AS target_ts FROM lineitem"""


@query("F9_asof_recovery_point", f"""
    WITH t AS ({TARGETS}), b AS (SELECT unit, ts, arg_min(label, ord) AS label FROM backups GROUP BY 1, 2)
    SELECT t.unit, target_id, b.label, <EPOCH(target_ts)> - <EPOCH(ts)> AS gap_s
    FROM t ASOF LEFT JOIN b ON t.unit = b.unit AND t.target_ts >= b.ts""", "backups")
def _(d):
    return Ch.asof_recovery_point(d.sql(TARGETS), d.backups).select("unit", "target_id", "label", "gap_s")


@query("F10_pitr_assert", """
    SELECT count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-20 00:00:00') AS rows_after, <EPOCH(max(ts))> AS achieved_epoch,
           count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-20 00:00:00') = 0 AS ok FROM events
    UNION ALL SELECT 0, <EPOCH(max(ts))>, true FROM events""")
def _(d):
    return Ch.pitr_assert(d.events, "ts", "2024-01-20 00:00:00").unionByName(Ch.pitr_assert(d.events, "ts", "2024-02-20 00:00:00"))


@query("F11_recovery_coverage", """
    WITH w AS (SELECT unit, <EPOCH(min(ts))> AS lo, <EPOCH(max(ts))> AS hi FROM backups GROUP BY 1),
    t AS (SELECT unit, lo + CAST(floor((hi - lo) * i / 19) AS BIGINT) AS at FROM w, range(20) r(i)),
    b AS (SELECT unit, <EPOCH(ts)> AS at, arg_min(verdict, ord) AS verdict FROM backups GROUP BY 1, 2)
    SELECT t.unit, count(*) AS targets, count(*) FILTER (WHERE verdict = 'pass') AS covered, count(*) FILTER (WHERE verdict = 'pass') / count(*) AS coverage
    FROM t ASOF LEFT JOIN b ON t.unit = b.unit AND t.at >= b.at GROUP BY 1""", "backups")
def _(d):
    return Ch.recovery_coverage(d.backups, 20)
