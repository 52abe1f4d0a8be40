"""Streams over the given tables, run to the end, against the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundcheck.catalog.base import query
from soundcheck.catalog.evidence import LEDGER, ZERO, _tampered_chain
from soundcheck.catalog.monitoring import NOW
from soundcheck.catalog.redaction import FOLD, SCAN, captured, scrubbed, with_line
from soundcheck.catalog.checks import NUM, SCALARS
from soundcheck.operators import checks as B
from soundcheck.operators.redact import redact_captures
from soundcheck.session import shared_path
from soundcheck.streaming.alerts import dedupe_alerts_stream
from soundcheck.streaming.ledger import newest_links, verify_ledger_stream
from soundcheck.streaming.overdue import overdue_stream, transitions_and_late
from soundcheck.streaming.run import read_files, run_available
from soundcheck.streaming.stateless import check_stream, redact_stream, scan_stream
from soundcheck.streaming.verdicts import newest_verdicts, verdict_stream


def stream_of(d, df, label, of, files=4, files_per_batch=None, rows_per_file=1_000_000):
    """Write a derived table once and read it as a file stream.

    ``of`` is the given table that it grows with. Beyond ``files * rows_per_file`` rows there are more files, and as many
    more in a batch.
    """
    path = shared_path(d.spark, label)
    more = max(1, -(-of.count() // (files * rows_per_file)))
    df.repartition(files * more).write.parquet(path)
    return read_files(d.spark, path, df.schema, files_per_batch and files_per_batch * more)


def _heartbeat(d, at):
    """A row of no monitor that carries time to ``at``."""
    return d.spark.createDataFrame([("-", "-", at)], "tenant_id string, target string, created_at bigint")


# All alerts and recoveries up to NOW, from the gaps between entries.
@query("S1_overdue_stream", f"""
    WITH a AS (SELECT tenant_id, target, created_at FROM attestations WHERE created_at <= {NOW}),
    m AS (SELECT *, interval_s + grace_s AS after FROM monitors),
    p AS (SELECT m.monitor_id, m.tenant_id, m.target, m.created_at AS at_s, m.after, m.alert_state = 'alerting' AS was, 0 AS k FROM m
      UNION ALL SELECT DISTINCT m.monitor_id, m.tenant_id, m.target, a.created_at, m.after, false, 1 FROM a JOIN m USING (tenant_id, target)),
    g AS (SELECT *, lead(at_s) OVER w AS nxt, row_number() OVER w AS r FROM p WINDOW w AS (PARTITION BY monitor_id ORDER BY k, at_s))
    SELECT monitor_id, 'overdue' AS event, at_s + after + 1 AS at_s FROM g WHERE NOT was AND coalesce(nxt, {NOW}) - at_s > after
    UNION ALL SELECT monitor_id, 'recovered', nxt FROM g WHERE nxt IS NOT NULL AND (was OR nxt - at_s > after)""", "attestations monitors")
def _(d):
    rows = d.attestations.filter(F.col("created_at") <= NOW).select("tenant_id", "target", "created_at")
    # One file per stretch of time, in order, as an append-only table would grow; the heartbeat comes last.
    path = shared_path(d.spark, "attestations")
    rows.repartitionByRange(6, "created_at").sortWithinPartitions("created_at").write.parquet(f"{path}/a")
    _heartbeat(d, NOW + 600).coalesce(1).write.parquet(f"{path}/b")
    stream = read_files(d.spark, f"{path}/*", rows.schema)
    found, _ = transitions_and_late(run_available(overdue_stream(stream, d.monitors), "overdue"))
    return found.filter(F.col("at_s") <= NOW).select("monitor_id", "event", "at_s")


# A second delivery of everything, long after the first: each of its rows is in the side table.
@query("S1_late_arrivals", "SELECT tenant_id, target, created_at AS at_s, count(*) AS arrivals FROM attestations GROUP BY ALL", "attestations monitors")
def _(d):
    path, stored = shared_path(d.spark, "attestations"), (shared_path(d.spark, "late"), shared_path(d.spark, "late-checkpoint"))
    rows = d.attestations.select("tenant_id", "target", "created_at")
    rows.unionByName(_heartbeat(d, 4_000_000_000)).write.parquet(f"{path}/a")
    for again in range(2):
        stream = read_files(d.spark, f"{path}/*", rows.schema)
        told = run_available(overdue_stream(stream, d.monitors), "late", *stored)
        if not again:
            rows.write.parquet(f"{path}/b")
    return transitions_and_late(told)[1].groupBy("tenant_id", "target", "at_s").agg(F.count(F.lit(1)).alias("arrivals"))


@query("S2_verify_ledger_stream", f"""
    WITH {LEDGER}, m AS (SELECT tenant_id, seq, entry_hash, CASE WHEN tenant_id = 't_3' AND seq = 20 THEN '00' WHEN tenant_id = 't_5' AND seq = 1 THEN '11' ELSE prev_hash END AS prev_hash
      FROM ledger WHERE NOT (tenant_id = 't_1' AND seq = 5)),
    w AS (SELECT *, lag(seq) OVER o AS pseq, lag(entry_hash) OVER o AS phash FROM m WINDOW o AS (PARTITION BY tenant_id ORDER BY seq))
    SELECT tenant_id, seq, CASE WHEN seq = 1 AND prev_hash <> {ZERO} THEN 'genesis prev_hash is not zero' WHEN seq > 1 AND coalesce(pseq, -1) <> seq - 1 THEN 'missing seq before'
      WHEN seq > 1 AND prev_hash <> phash THEN 'prev_hash does not match' END AS reason FROM w""", "attestations")
def _(d):
    ledger = _tampered_chain(d).filter("NOT (tenant_id IN ('t_2', 't_4'))").unionByName(
        _tampered_chain(d).filter("tenant_id IN ('t_2', 't_4')").dropDuplicates(["tenant_id", "seq"]))
    ledger = ledger.withColumn("created_at", F.when((F.col("tenant_id") == "t_4") & (F.col("seq") == 30), F.col("created_at") + 10_000_000)
                               .otherwise(F.col("created_at")))
    return newest_links(run_available(verify_ledger_stream(stream_of(d, ledger, "entries", d.events)), "links"))


# The whole tampered chain of L6, every file a batch of its own.
@query("S2_verify_tampered_stream", f"""
    WITH {LEDGER}, k AS (SELECT * FROM ledger WHERE NOT (tenant_id = 't_1' AND seq = 5) UNION ALL SELECT * FROM ledger WHERE tenant_id = 't_2' AND seq = 9),
    m AS (SELECT tenant_id, seq, count(*) AS copies, min(entry_hash) AS entry_hash,
      min(CASE WHEN tenant_id = 't_3' AND seq = 20 THEN '00' WHEN tenant_id = 't_5' AND seq = 1 THEN '11' ELSE prev_hash END) AS prev_hash,
      min(CASE WHEN tenant_id = 't_4' AND seq = 30 THEN created_at - 10000000 ELSE created_at END) AS created_at FROM k GROUP BY 1, 2),
    w AS (SELECT *, lag(seq) OVER o AS pseq, lag(entry_hash) OVER o AS phash, lag(created_at) OVER o AS pat FROM m WINDOW o AS (PARTITION BY tenant_id ORDER BY seq))
    SELECT tenant_id, seq, CASE WHEN copies > 1 THEN 'duplicate seq' WHEN seq = 1 AND prev_hash <> {ZERO} THEN 'genesis prev_hash is not zero'
      WHEN seq > 1 AND coalesce(pseq, -1) <> seq - 1 THEN 'missing seq before' WHEN seq > 1 AND prev_hash <> phash THEN 'prev_hash does not match'
      WHEN seq > 1 AND created_at < pat THEN 'created_at runs back' END AS reason FROM w""", "attestations")
def _(d):
    stream = stream_of(d, _tampered_chain(d), "tampered", d.events, files_per_batch=1)
    return newest_links(run_available(verify_ledger_stream(stream, seqs_per_key=16), "tampered-links"))


@query("S3_scan_stream", SCAN, "planted")
def _(d):
    return run_available(scan_stream(stream_of(d, d.planted, "planted", d.documents, rows_per_file=50_000), "text"), "found")


@query("S3_redact_stream", f"""
    WITH {FOLD}, s AS (SELECT doc_id, {scrubbed('text')} AS t, doc_id % 5 = 0 AS keep FROM documents, f), l AS (SELECT doc_id, keep, {with_line('t')} FROM s)
    SELECT doc_id, CASE WHEN keep OR (strlen(t) <= 256 AND NOT regexp_matches(t, '[\\n\\r]')) THEN t ELSE {captured('t')} END AS got, true AS as_in_batch
    FROM l""", "secrets")
def _(d):
    rows = d.documents.select("doc_id", F.col("text").alias("got"), (F.col("doc_id") % 5 == 0).alias("keep"))
    stored = run_available(redact_stream(stream_of(d, rows, "captures", d.documents, rows_per_file=50_000), "got", "keep", d.secrets), "redacted")
    batch = redact_captures(rows, "got", "keep", d.secrets)
    return stored.join(batch.withColumnRenamed("got", "batch"), "doc_id").select(
        "doc_id", "got", (F.col("got") == F.col("batch")).alias("as_in_batch"))


@query("S4_dedupe_alerts_stream", "SELECT DISTINCT destination, idempotency_key FROM deliveries", "deliveries")
def _(d):
    told = run_available(dedupe_alerts_stream(stream_of(d, d.deliveries, "deliveries", d.events), 60 * 86400), "alerts")
    return told.filter("outcome = 'first'").select("destination", "idempotency_key")


CAPTURED = f"SELECT *, CASE WHEN id % 2 = 0 THEN 'bounds' ELSE 'text' END AS check_id FROM (SELECT id, got FROM ({SCALARS}) s) t"


@query("S5_check_stream", f"""
    WITH r AS (SELECT *, {NUM} AS num FROM ({CAPTURED})) SELECT id, check_id, CASE check_id WHEN 'bounds' THEN coalesce(num >= 100 AND num <= 500, false) ELSE got = 'O' END AS ok,
      check_id = 'bounds' AND num IS NULL AS failed FROM r""")
def _(d):
    checks = B.checks_table(d.spark, [dict(check_id="bounds", name="b", severity="required", expect_min=100, expect_max=500),
                                      dict(check_id="text", name="t", severity="advisory", equals="O")])
    out = run_available(check_stream(stream_of(d, d.sql(CAPTURED), "scalars", d.orders), checks), "results")
    return out.select("id", "check_id", "ok", F.col("error").isNotNull().alias("failed"))


@query("S5_verdict_batches", """
    SELECT run_id, CASE WHEN l.ok AND coalesce(bool_and(coalesce(r.ok, false) OR r.severity = 'advisory'), true) THEN 'pass' ELSE 'fail' END AS verdict,
      count(r.run_id) AS checks FROM loads l LEFT JOIN results r USING (run_id) GROUP BY run_id, l.ok""", "loads results")
def _(d):
    # The results of a run are spread over files, and every file is a batch of its own.
    stream = stream_of(d, d.results, "results", d.lineitem, files_per_batch=1)
    return newest_verdicts(run_available(verdict_stream(stream), "verdicts"), d.loads).select("run_id", "verdict", "checks")
