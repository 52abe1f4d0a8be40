"""Verdicts, reports and fleet views over runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundcheck.catalog.base import query
from soundcheck.catalog.sources import reports_of
from soundcheck.functions.scalars import epoch
from soundcheck.operators import verdict as V

BAD = "(NOT coalesce(r.ok, false) AND r.severity <> 'advisory')"
VERDICTS = f"""
    v AS (SELECT l.run_id, l.ok AS load_ok, count(r.run_id) AS checks, count(*) FILTER (WHERE r.run_id IS NOT NULL AND {BAD}) AS failed_required,
            count(*) FILTER (WHERE r.run_id IS NOT NULL AND NOT coalesce(r.ok, false) AND NOT {BAD}) AS failed_advisory,
            CASE WHEN l.ok AND count(*) FILTER (WHERE r.run_id IS NOT NULL AND {BAD}) = 0 THEN 'pass' ELSE 'fail' END AS verdict
          FROM loads l LEFT JOIN results r ON l.run_id = r.run_id GROUP BY l.run_id, l.ok)"""


@query("V1_verdicts", f"WITH {VERDICTS} SELECT * FROM v", "loads results")
def _(d):
    return V.verdicts(d.results, d.loads)


@query("V2_first_failure", f"""
    SELECT run_id, arg_min(concat(name, ': ', coalesce(error, detail)), ord) AS reason FROM results r WHERE {BAD} GROUP BY 1""", "results")
def _(d):
    return V.first_failure(d.results)


def runs_of(d):
    load = d.loads
    verdict = V.verdicts(d.results, load).select("run_id", "verdict")
    return load.join(verdict, "run_id").select(
        "run_id", "target", "finished_at", "verdict",
        F.when(F.pmod(F.substring_index("run_id", "_", -1).cast("bigint"), F.lit(9)) == 0, F.lit("root not found")).alias("operational_error"))


RUNS = f"""
    {VERDICTS}, runs AS (SELECT l.run_id, l.target, l.finished_at, v.verdict,
      CASE WHEN CAST(l.run_id[3:] AS BIGINT) % 9 = 0 THEN 'root not found' END AS operational_error FROM loads l JOIN v USING (run_id))"""


@query("V3_exit_codes", f"""
    WITH {RUNS} SELECT run_id, CASE WHEN operational_error IS NOT NULL THEN 2 WHEN verdict = 'pass' THEN 0 ELSE 1 END AS exit_code FROM runs""",
       "loads results")
def _(d):
    return V.exit_codes(runs_of(d)).select("run_id", "exit_code")


@query("V4_build_reports", f"""
    WITH {VERDICTS}, c AS (SELECT run_id, string_agg(concat(name, '=', coalesce(CAST(ok AS VARCHAR), 'null')), ',' ORDER BY ord) AS checks
      FROM results GROUP BY 1)
    SELECT run_id, target, verdict, coalesce(c.checks, '') AS checks, 1 AS schema_version, 90000 AS duration_ms,
      epoch_us(started_at) // 1000000 AS started, l.ok AS load_ok FROM loads l JOIN v USING (run_id) LEFT JOIN c USING (run_id)""", "loads results")
def _(d):
    line = F.transform("checks", lambda c: F.concat(c["name"], F.lit("="), F.coalesce(c["ok"].cast("string"), F.lit("null"))))
    return reports_of(d).select("run_id", "target", "verdict", F.array_join(line, ",").alias("checks"), "schema_version",
                                "duration_ms", epoch("started_at").alias("started"), F.col("load.ok").alias("load_ok"))


@query("V5_validate_reports", """
    WITH x AS (SELECT run_id, CAST(run_id[3:] AS BIGINT) AS n FROM loads)
    SELECT run_id, 'target is required' AS violation FROM x WHERE n % 11 = 0
    UNION ALL SELECT run_id, 'schema_version must be 1' FROM x WHERE n % 13 = 0
    UNION ALL SELECT run_id, 'verdict must be pass or fail' FROM x WHERE n % 17 = 0
    UNION ALL SELECT run_id, 'load.duration_ms must not be negative' FROM x WHERE n % 19 = 0
    UNION ALL SELECT DISTINCT run_id, 'a check needs name and ok' FROM results WHERE ok IS NULL
    UNION ALL SELECT DISTINCT run_id, 'severity must be required or advisory' FROM results WHERE severity = ''
    UNION ALL SELECT DISTINCT run_id, 'load.database is required' FROM x WHERE n % 23 = 0""", "loads results")
def _(d):
    n = F.substring_index("run_id", "_", -1).cast("bigint")
    spoiled = reports_of(d).withColumns({
        "target": F.when(n % 11 > 0, F.col("target")),
        "schema_version": F.when(n % 13 > 0, F.col("schema_version")).otherwise(F.lit(2)),
        "verdict": F.when(n % 17 > 0, F.col("verdict")).otherwise(F.lit("maybe")),
        "load": F.col("load").withField("duration_ms", F.when(n % 19 > 0, F.col("load.duration_ms")).otherwise(F.lit(-1)))
        .withField("database", F.when(n % 23 > 0, F.col("load.database")))})
    return V.validate_reports(spoiled).select("run_id", "violation")


@query("V6_render_summary", f"""
    WITH {VERDICTS}
    SELECT run_id, concat('target "', target, '"') AS line FROM loads
    UNION ALL SELECT run_id, CASE WHEN ok THEN '  load      ok    (1500ms)' ELSE concat('  load      FAIL  ', error) END FROM loads
    UNION ALL SELECT run_id, concat('  load      warn  ', warnings) FROM loads WHERE ok AND warnings IS NOT NULL
    UNION ALL SELECT run_id, concat('  verdict   ', upper(verdict)) FROM v
    UNION ALL SELECT run_id, CASE WHEN error IS NOT NULL THEN concat('  check     ERR   ', rpad(name, 26, ' '), ' ', error)
      WHEN ok THEN concat('  check     ok    ', rpad(name, 26, ' '), ' ', detail)
      ELSE concat('  check     FAIL  ', rpad(name, 26, ' '), ' got=', got, ' ', detail) END FROM results""", "loads results")
def _(d):
    return V.render_summary(reports_of(d)).select("run_id", "line")


@query("V7_fleet_view", f"""
    WITH {RUNS} SELECT target, arg_max(verdict, (finished_at, run_id)) AS status, epoch_us(max(finished_at)) // 1000000 AS last_run,
      epoch_us(max(finished_at) FILTER (WHERE verdict = 'pass')) // 1000000 AS last_green,
      count(*) FILTER (WHERE verdict = 'pass') / count(*) AS pass_rate, count(*) AS runs FROM runs GROUP BY 1""", "loads results")
def _(d):
    view = V.fleet_view(runs_of(d))
    return view.withColumns({"last_run": epoch("last_run"), "last_green": epoch("last_green")})
