"""Expectations: one scalar as text against one configured expectation. Pure columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from soundcheck.functions.scalars import (duration_text, instant, number_text, parse_bool_text,
                                          parse_num_text, parse_ts_text)
from soundcheck.functions.text import as_col, quoted



def _outcome(ok: Column, detail: Column, error: Column) -> Column:
    ok = F.coalesce(ok & error.isNull(), F.lit(False))
    return F.struct(ok.alias("ok"), F.when(error.isNull(), detail).alias("detail"), error.alias("error"))


def _unreadable(value: Column, got: Column, wanted: str) -> Column:
    return F.when(value.isNull(), F.concat(F.lit(f"expected a {wanted}, got "), quoted(F.coalesce(got, F.lit("")))))


def expect_bounds(got, lo, hi, number: Column | None = None) -> Column:
    """Inclusive bounds; the lower one is tested first. ``number``: the reading of ``got``, if it is at hand."""
    got, lo, hi = as_col(got), as_col(lo), as_col(hi)
    v = parse_num_text(got) if number is None else number
    shown = number_text(v)
    below, above = v < lo, v > hi
    detail = (F.when(below, F.concat(shown, F.lit(" < min "), number_text(lo)))
              .when(above, F.concat(shown, F.lit(" > max "), number_text(hi)))
              .otherwise(F.concat(shown, F.lit(" within bounds"))))
    ok = ~F.coalesce(below, F.lit(False)) & ~F.coalesce(above, F.lit(False))
    return _outcome(ok, detail, _unreadable(v, got, "number"))


def expect_equals(got, equals) -> Column:
    got, equals = as_col(got), as_col(equals)
    ok = got == equals
    detail = F.when(~F.coalesce(ok, F.lit(False)), F.concat(F.lit("want "), quoted(equals)))
    return _outcome(ok, detail, F.lit(None).cast("string"))


def expect_max_age(got, max_age_s, as_of=None, time: Column | None = None) -> Column:
    """Age at ``as_of`` at most ``max_age_s``; a time in the future has a negative age and passes."""
    got, max_age_s = as_col(got), as_col(max_age_s)
    ts = parse_ts_text(got) if time is None else time
    age = (F.unix_micros(instant(as_of)) - F.unix_micros(ts)) / F.lit(1_000_000)
    ok = F.unix_micros(instant(as_of)) - F.unix_micros(ts) <= max_age_s * 1_000_000
    detail = F.concat(F.lit("age "), duration_text(age), F.lit(" (max "), duration_text(max_age_s), F.lit(")"))
    return _outcome(ok, detail, _unreadable(ts, got, "timestamp"))


def expect_bool(got, wanted) -> Column:
    got, wanted = as_col(got), as_col(wanted)
    v = parse_bool_text(got)
    ok = v == wanted
    return _outcome(ok, F.when(~ok, F.concat(F.lit("want "), wanted.cast("string"))),
                    _unreadable(v, got, "boolean"))


def evaluate_expectations(df: DataFrame, as_of=None, no_expectation: Column | str = "no expectation configured",
                          ) -> DataFrame:
    """Add ok, detail, error, got_num and got_ts. Precedence: bounds, equals, max age, boolean.

    An ``error`` already present (the subject could not be read) wins over any expectation.
    """
    none = F.lit(no_expectation) if isinstance(no_expectation, str) else no_expectation
    nothing = F.struct(F.lit(False).alias("ok"), F.lit(None).cast("string").alias("detail"), none.alias("error"))
    result = (
        F.when(F.col("expect_min").isNotNull() | F.col("expect_max").isNotNull(),
               expect_bounds("got", "expect_min", "expect_max", F.col("got_num")))
        .when(F.col("equals").isNotNull(), expect_equals("got", "equals"))
        .when(F.col("max_age_s").isNotNull(), expect_max_age("got", "max_age_s", as_of, F.col("got_ts")))
        .when(F.col("bool").isNotNull(), expect_bool("got", "bool"))
        .otherwise(nothing)
    )
    if "error" in df.columns:
        unread = F.struct(F.lit(False).alias("ok"), F.lit(None).cast("string").alias("detail"),
                          F.col("error").alias("error"))
        result = F.when(F.col("error").isNotNull(), unread).otherwise(result)
    # The readings are columns of their own, so that they are computed once.
    return (
        df.withColumns({"got_num": parse_num_text("got"), "got_ts": parse_ts_text("got")})
        .withColumn("_r", result)
        .withColumns({"ok": F.col("_r.ok"), "detail": F.col("_r.detail"), "error": F.col("_r.error")})
        .drop("_r")
    )
