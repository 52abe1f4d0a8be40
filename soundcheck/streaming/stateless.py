"""Streams that need no state: the same columns as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from soundcheck.operators.expect import evaluate_expectations
from soundcheck.operators.redact import redact_captures, scan_credentials
from soundcheck.plans.sizing import broadcast_if_small


def scan_stream(texts: DataFrame, col: str, id_col: str = "id") -> DataFrame:
    """Credential shapes in arriving texts; never the matched text."""
    return scan_credentials(texts, col, id_col)


def redact_stream(captures: DataFrame, got: str, keep_literal, secrets: DataFrame) -> DataFrame:
    """Arriving output in its stored form. ``secrets`` is a table, read when the stream starts."""
    return redact_captures(captures, got, keep_literal, secrets)


def check_stream(captures: DataFrame, checks: DataFrame, as_of=None) -> DataFrame:
    """Evaluate arriving scalars (check_id, got, and any other columns) against their definitions."""
    wanted = checks.select("check_id", "name", "severity", "expect_min", "expect_max", "equals", "max_age_s", "bool")
    return evaluate_expectations(captures.join(broadcast_if_small(wanted), "check_id"), as_of)
