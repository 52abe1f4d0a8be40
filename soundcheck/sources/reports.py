"""Stored reports: one redacting writer, a strict reader, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from soundcheck.functions.scalars import instant
from soundcheck.operators.redact import redact_reports
from soundcheck.plans.ordered import over_groups, row_number
from soundcheck.schemas import REPORT, SCHEMA_VERSION

TOP_K = 1000  # up to here Spark prunes a row_number filter before the shuffle


def write_reports(reports: DataFrame, path: str, secrets: DataFrame, fmt: str = "json", mode: str = "errorifexists") -> None:
    """The only way to store reports: redacted before any byte is written, schema version always set."""
    if fmt not in ("json", "parquet"):
        raise ValueError(f"format {fmt!r} unsupported (json|parquet)")
    redact_reports(reports, secrets).withColumn("schema_version", F.lit(SCHEMA_VERSION)).write.mode(mode).format(fmt).save(path)


def read_reports(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Reports with the declared schema; a document that does not fit fails the read."""
    reader = spark.read.schema(REPORT)
    return reader.option("mode", "FAILFAST").json(path) if fmt == "json" else reader.format(fmt).load(path)


def retain_reports(reports: DataFrame, keep_n: int | None = None, keep_days: int | None = None, as_of=None,
                   ts: str = "finished_at", id_col: str = "run_id") -> DataFrame:
    """The newest ``keep_n`` reports per target that are at most ``keep_days`` old."""
    if keep_days is not None:
        oldest = F.unix_micros(instant(as_of)) - keep_days * 86_400_000_000
        reports = reports.filter(F.unix_micros(F.col(ts).cast("timestamp")) >= oldest)
    if keep_n is None:
        return reports
    order = [F.col(ts).desc(), F.col(id_col).desc()]
    if keep_n <= TOP_K:
        ranked = reports.withColumn("_rn", F.row_number().over(Window.partitionBy("target").orderBy(*order)))
    else:
        ranked = over_groups(reports, ["target"], order, [row_number("_rn")])
    return ranked.filter(F.col("_rn") <= keep_n).drop("_rn")
