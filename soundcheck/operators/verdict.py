"""From check results to verdicts, reports and fleet views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from soundcheck.schemas import SCHEMA_VERSION

def failing(ok: Column | str = "ok", severity: Column | str = "severity") -> Column:
    """A result that fails the verdict: not ok and not advisory (blank severity counts as required)."""
    ok = F.col(ok) if isinstance(ok, str) else ok
    severity = F.col(severity) if isinstance(severity, str) else severity
    return ~F.coalesce(ok, F.lit(False)) & (F.coalesce(severity, F.lit("")) != "advisory")


def verdicts(results: DataFrame, load: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """One verdict per load: fail when the load failed or a required check did; no checks pass.

    ``load`` has the ``by`` columns and ``ok``.
    """
    by = list(by)
    checked = results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(failing()).alias("failed_required"),
        F.count_if(~F.coalesce(F.col("ok"), F.lit(False)) & ~failing()).alias("failed_advisory"))
    loaded = load.select(*by, F.coalesce(F.col("ok"), F.lit(False)).alias("load_ok"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    bad = ~F.col("load_ok") | (zero("failed_required") > 0)
    return loaded.join(checked, by, "left").select(
        *by, "load_ok", zero("checks").alias("checks"), zero("failed_required").alias("failed_required"),
        zero("failed_advisory").alias("failed_advisory"),
        F.when(bad, F.lit("fail")).otherwise(F.lit("pass")).alias("verdict"))


def first_failure(results: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Reason of the first failing required check in definition order: ``name: error`` or ``name: detail``."""
    told = F.concat(F.col("name"), F.lit(": "), F.when(F.coalesce(F.col("error"), F.lit("")) != "", F.col("error"))
                    .otherwise(F.coalesce(F.col("detail"), F.lit(""))))
    return results.filter(failing()).groupBy(*by).agg(F.min_by(told, F.col("ord")).alias("reason"))


def exit_codes(df: DataFrame, verdict: str = "verdict", operational_error: str = "operational_error") -> DataFrame:
    """0 pass, 1 fail, 2 operational error."""
    return df.withColumn("exit_code", F.when(F.coalesce(F.col(operational_error), F.lit("")) != "", F.lit(2))
                         .when(F.col(verdict) == "pass", F.lit(0)).otherwise(F.lit(1)))


def build_reports(results: DataFrame, load: DataFrame) -> DataFrame:
    """Nested reports, one per run. ``load``: run_id, target, tool_version, started_at, finished_at and the load fields.

    A report lists all checks of its run, so its size follows the number of definitions, not of data rows.
    ``part`` is always 0.
    """
    check = F.struct("ord", "name", "ok", "severity", "got", "detail", "error", "keep_literal")
    checked = results.groupBy("run_id").agg(F.sort_array(F.collect_list(check)).alias("checks"), F.count_if(failing()).alias("_failed"))
    bad = ~F.coalesce(F.col("ok"), F.lit(False)) | (F.coalesce("_failed", F.lit(0)) > 0)
    verdict = F.when(bad, F.lit("fail")).otherwise(F.lit("pass")).alias("verdict")
    millis = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1000
    return (
        load.join(checked, "run_id", "left")
        .select(
            F.lit(SCHEMA_VERSION).alias("schema_version"), "run_id", F.lit(0).alias("part"),
            "tool_version", "target", "started_at", "finished_at", F.floor(millis).alias("duration_ms"),
            F.struct("ok", "method", "database", F.col("load_ms").alias("duration_ms"), "warnings", "error").alias("load"),
            F.coalesce("checks", F.array().cast(checked.schema["checks"].dataType)).alias("checks"), verdict))


def validate_reports(reports: DataFrame) -> DataFrame:
    """One row per violated rule of the report schema: run_id, part, violation."""
    missing = lambda c: F.when(F.col(c).isNull(), F.lit(f"{c} is required"))
    bad_check = lambda c: c["name"].isNull() | c["ok"].isNull()
    bad_severity = lambda c: ~F.coalesce(c["severity"].isin("required", "advisory"), F.lit(True))
    checks = F.coalesce(F.col("checks"), F.array().cast(reports.schema["checks"].dataType))
    rules = [
        missing("schema_version"), missing("tool_version"), missing("target"), missing("started_at"),
        missing("finished_at"), missing("duration_ms"), missing("load"), missing("verdict"),
        F.when(F.col("schema_version") != SCHEMA_VERSION, F.lit(f"schema_version must be {SCHEMA_VERSION}")),
        F.when(~F.col("verdict").isin("pass", "fail"), F.lit("verdict must be pass or fail")),
        F.when(F.col("duration_ms") < 0, F.lit("duration_ms must not be negative")),
        F.when(F.col("load.ok").isNull() & F.col("load").isNotNull(), F.lit("load.ok is required")),
        F.when(F.col("load.database").isNull() & F.col("load").isNotNull(), F.lit("load.database is required")),
        F.when(F.col("load.duration_ms").isNull() & F.col("load").isNotNull(), F.lit("load.duration_ms is required")),
        F.when(F.col("load.duration_ms") < 0, F.lit("load.duration_ms must not be negative")),
        F.when(F.exists(checks, bad_check), F.lit("a check needs name and ok")),
        F.when(F.exists(checks, bad_severity), F.lit("severity must be required or advisory")),
    ]
    found = F.filter(F.array(*[F.struct(F.lit(i + 1).alias("rule_no"), r.alias("violation")) for i, r in enumerate(rules)]),
                     lambda r: r["violation"].isNotNull())
    return reports.select("run_id", "part", F.explode_outer(found).alias("_v")).filter("_v IS NOT NULL").select(
        "run_id", "part", "_v.rule_no", "_v.violation")


def render_summary(reports: DataFrame) -> DataFrame:
    """Readable lines of a report: run_id, part, line_no, line."""
    text = lambda c: F.coalesce(c, F.lit(""))
    check_line = lambda c: F.rtrim(
        F.when(text(c["error"]) != "", F.format_string("  check     ERR   %-26s %s", c["name"], c["error"]))
        .when(c["ok"], F.format_string("  check     ok    %-26s %s", c["name"], text(c["detail"])))
        .otherwise(F.format_string("  check     FAIL  %-26s got=%s %s", c["name"], text(c["got"]), text(c["detail"]))))
    head = F.array(
        F.concat(F.lit('target "'), F.col("target"), F.lit('"')),
        F.when(F.col("load.ok"), F.format_string("  load      ok    (%dms)", F.col("load.duration_ms")))
        .otherwise(F.concat(F.lit("  load      FAIL  "), text(F.col("load.error")))),
        F.when(F.col("load.ok") & (text(F.col("load.warnings")) != ""),
               F.concat(F.lit("  load      warn  "), F.col("load.warnings"))).otherwise(F.lit("")))
    foot = F.array(F.concat(F.lit("  verdict   "), F.upper("verdict")))
    lines = F.concat(F.filter(head, lambda line: line != ""), F.transform("checks", check_line), foot)
    return reports.select("run_id", "part", F.posexplode_outer(lines).alias("line_no", "line"))


def fleet_view(runs: DataFrame, by: Sequence[str] = ("target",), ts: str = "finished_at", id_col: str = "run_id",
               ) -> DataFrame:
    """Per target: newest status, last green time, share of passes, number of runs."""
    newest = F.struct(F.col(ts), F.col(id_col))
    green = F.col("verdict") == "pass"
    return runs.groupBy(*by).agg(
        F.max_by("verdict", newest).alias("status"), F.max(ts).alias("last_run"),
        F.max(F.when(green, F.col(ts))).alias("last_green"),
        (F.count_if(green) / F.count(F.lit(1))).alias("pass_rate"), F.count(F.lit(1)).alias("runs"))
