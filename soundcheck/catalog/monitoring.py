"""Cadence monitors and alert routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundcheck.catalog.base import AS_OF_EPOCH, query
from soundcheck.catalog.verdicts import RUNS, runs_of
from soundcheck.operators import monitors as M

NOW = AS_OF_EPOCH - 86400
OVERDUE = f"""
    f AS (SELECT tenant_id, target, max(created_at) AS freshest FROM attestations GROUP BY 1, 2),
    o AS (SELECT m.*, f.freshest, {NOW} - coalesce(f.freshest, m.created_at) > interval_s + grace_s AS overdue FROM monitors m LEFT JOIN f USING (tenant_id, target)),
    ev AS (SELECT *, CASE WHEN freshest IS NULL THEN 'never' WHEN overdue THEN 'overdue' ELSE 'ok' END AS status FROM o),
    ch AS (SELECT *, CASE WHEN overdue THEN 'alerting' ELSE 'ok' END AS state, CASE WHEN overdue THEN 'overdue' ELSE 'recovered' END AS event FROM ev
           WHERE alert_state <> CASE WHEN overdue THEN 'alerting' ELSE 'ok' END)"""


def evaluated(d):
    return M.overdue(d.monitors, d.attestations, NOW)


def changed(d):
    return M.transitions(evaluated(d), NOW)


@query("M1_overdue", f"WITH {OVERDUE} SELECT monitor_id, freshest, overdue, status FROM ev", "attestations monitors")
def _(d):
    return evaluated(d).select("monitor_id", "freshest", "overdue", "status")


@query("M2_transitions", f"WITH {OVERDUE} SELECT monitor_id, state AS alert_state, event, {NOW} AS last_alert_at FROM ch", "attestations monitors")
def _(d):
    return changed(d).select("monitor_id", "alert_state", "event", "last_alert_at")


HISTORY = "SELECT concat('m_', user_id % 20) AS monitor_id, event_id AS at_s, value < 20 AS overdue FROM events"


@query("M2_transitions_over_time", f"""
    WITH h AS ({HISTORY}), b AS (SELECT *, coalesce(lag(overdue) OVER (PARTITION BY monitor_id ORDER BY at_s), false) AS before FROM h)
    SELECT monitor_id, at_s, CASE WHEN overdue THEN 'overdue' ELSE 'recovered' END AS event FROM b WHERE overdue <> before""")
def _(d):
    return M.transitions_over_time(d.sql(HISTORY))


@query("M3_alert_payloads", f"""
    WITH {OVERDUE} SELECT monitor_id, to_json({{schema_version: 1, monitor_id: monitor_id, target: target, state: event, interval_seconds: interval_s,
      grace_seconds: grace_s, freshest_attestation_at: freshest, notice: '{M.PAYLOAD_NOTICE}'}})::VARCHAR AS payload FROM ch""", "attestations monitors")
def _(d):
    return M.alert_payloads(changed(d)).select("monitor_id", "payload")


@query("M4_idempotency_key", f"""
    WITH {OVERDUE} SELECT monitor_id, sha256(concat(monitor_id, <NL>, event, <NL>, freshest)) AS k FROM ch""", "attestations monitors")
def _(d):
    return changed(d).select("monitor_id", M.idempotency_key().alias("k"))


@query("M5_dedupe_deliveries", """
    SELECT destination, idempotency_key, min(at_s) AS at_s, arg_min(id, (at_s, id)) AS id FROM deliveries GROUP BY 1, 2""", "deliveries")
def _(d):
    return M.dedupe_deliveries(d.deliveries).select("destination", "idempotency_key", "at_s", "id")


# Some deliveries have no time, and some no destination.
GAPS = """SELECT id, CASE WHEN CAST(substr(id, 3) AS BIGINT) % 89 > 0 THEN destination END AS destination,
    CASE WHEN CAST(substr(id, 3) AS BIGINT) % 97 > 0 THEN at_s END AS at_s FROM deliveries"""


@query("M6_damp_flaps", f"""
    WITH g AS MATERIALIZED ({GAPS}), s AS MATERIALIZED (SELECT coalesce(destination, '') AS dest, at_s, min(id) AS first_id FROM g WHERE at_s IS NOT NULL GROUP BY 1, 2),
    w AS (SELECT dest, min(at_s) AS at_s FROM s GROUP BY 1
      UNION ALL SELECT w.dest, (SELECT min(s.at_s) FROM s WHERE s.dest = w.dest AND s.at_s >= w.at_s + 20000) FROM w WHERE w.at_s IS NOT NULL)
    SELECT id, g.destination, g.at_s IS NULL OR first_id IS NOT NULL AS sent FROM g LEFT JOIN
      (SELECT s.dest, s.at_s, s.first_id FROM s JOIN w ON s.dest = w.dest AND s.at_s = w.at_s) k ON k.dest = coalesce(g.destination, '') AND k.first_id = g.id""", "deliveries")
def _(d):
    return M.damp_flaps(d.sql(GAPS), min_gap_s=20000).select("id", "destination", "sent")


@query("M7_rate_limit", """
    SELECT id, count(*) OVER w AS in_window, count(*) OVER w <= 3 AS allowed FROM deliveries
    WINDOW w AS (PARTITION BY tenant_id, destination ORDER BY at_s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)""", "deliveries")
def _(d):
    return M.rate_limit(d.deliveries, n=3, window_s=3600).select("id", "in_window", "allowed")


def span(x):
    return (f"CASE WHEN {x} >= 3600 THEN concat({x} // 3600, 'h', {x} % 3600 // 60, 'm', {x} % 60, 's') WHEN {x} >= 60 THEN concat({x} // 60, 'm', {x} % 60, 's') "
            f"ELSE concat({x}, 's') END")


@query("M8_shape_slack", f"""
    WITH {OVERDUE}, t AS (SELECT monitor_id, CASE WHEN state = 'alerting' THEN concat('OVERDUE: no passing attestation for ', target, ' in ',
      {span(f'({NOW} - coalesce(freshest, created_at))')}) ELSE concat('RECOVERED: a fresh attestation for ', target, ' arrived') END AS text FROM ch)
    SELECT monitor_id, to_json({{text: text, blocks: [{{type: 'section', text: {{type: 'mrkdwn', text: text}}}}]}})::VARCHAR AS message FROM t""", "attestations monitors")
def _(d):
    return M.shape_slack(changed(d), NOW).select("monitor_id", "message")


@query("M8_shape_pagerduty", f"""
    WITH {OVERDUE}, t AS (SELECT monitor_id, target, CASE WHEN state = 'alerting' THEN 'trigger' ELSE 'resolve' END AS event_action, concat('monitor-', monitor_id) AS dedup_key FROM ch)
    SELECT monitor_id, event_action, dedup_key, to_json({{event_action: event_action, dedup_key: dedup_key,
      payload: {{summary: concat('No passing attestation received for ', target), source: target, severity: 'error'}}}})::VARCHAR AS message FROM t""", "attestations monitors")
def _(d):
    return M.shape_pagerduty(changed(d))


HOOKS = """
    SELECT concat('target_', n_nationkey) AS target, CASE WHEN n_nationkey % 3 > 0 THEN concat('notify ', n_name) ELSE '' END AS on_fail,
      CASE WHEN n_nationkey % 4 = 0 THEN concat('https://hooks.example.org/', n_nationkey) END AS on_success FROM nation"""


@query("M9_route_hooks", f"""
    WITH {RUNS}, h AS ({HOOKS}), x AS (SELECT run_id, target, CASE WHEN operational_error IS NOT NULL OR verdict <> 'pass' THEN on_fail ELSE on_success END AS hook,
      CASE WHEN operational_error IS NULL THEN 'fire' ELSE 'skipped' END AS state FROM runs JOIN h USING (target))
    SELECT * FROM x WHERE hook <> ''""", "loads results")
def _(d):
    runs = runs_of(d).withColumn("rendered", F.col("operational_error").isNull())
    return M.route_hooks(runs, d.sql(HOOKS))


SPECS = """
    SELECT event_id, CASE event_id % 8 WHEN 0 THEN concat('mail -s ', user_id, ' x@y') WHEN 1 THEN concat('https://h/', user_id, '?token_ref=env:TOKEN_', user_id)
      WHEN 2 THEN concat('https://h/', user_id, '?a=1&token_ref=', user_id) WHEN 3 THEN concat('https://u', user_id, ':p@h/x') WHEN 4 THEN 'http://' WHEN 5 THEN
      concat('https://h/x?b_ref=env:&a%5Fref=env:N_', user_id) WHEN 6 THEN concat('https://h/?q=%zz', user_id) ELSE concat('http://h/', user_id, '?q=a@b#f') END AS hook FROM events"""


@query("M10_validate_hooks", """
    SELECT event_id, CASE event_id % 8 WHEN 2 THEN 'token_ref names no environment variable'
      WHEN 3 THEN 'the URL holds a user or password' WHEN 4 THEN 'the URL cannot be parsed'
      WHEN 5 THEN 'b_ref names no environment variable' WHEN 6 THEN 'the query cannot be decoded' END AS violation FROM events""")
def _(d):
    return M.validate_hooks(d.sql(SPECS)).select("event_id", "violation")


@query("M10_hook_env_names", """
    SELECT DISTINCT concat(CASE event_id % 8 WHEN 1 THEN 'TOKEN_' ELSE 'N_' END, user_id) AS name FROM events WHERE event_id % 8 IN (1, 5)""")
def _(d):
    return M.hook_env_names(d.sql(SPECS))
