"""Readings of a scalar that arrives as text: number, boolean, timestamp, duration."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from soundcheck.functions.text import as_col, trim_space

# Accepted spellings.
TRUE_WORDS = ("t", "true", "1")
FALSE_WORDS = ("f", "false", "0")
NUMBER = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
CLOCK = r"[0-9]{1,2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?"
DURATION_PART = r"([0-9]+(\.[0-9]*)?|\.[0-9]+)(ns|us|µs|μs|ms|h|m|s)"
UNIT_SECONDS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "μs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
INTERVAL_SECONDS = {"h": 3600, "d": 86400, "w": 604800}


def instant(as_of) -> Column:
    """The evaluation clock as a timestamp column: None is now; naive values are UTC."""
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of)
    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=dt.timezone.utc)
    return F.timestamp_micros(F.lit(round(as_of.timestamp() * 1_000_000)))


def epoch(c: Column | str) -> Column:
    """Whole seconds since 1970 of a timestamp with or without zone (without: UTC)."""
    return F.floor(micros(c) / F.lit(1_000_000)).cast("bigint")


def micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp, a timestamp without zone (read as UTC) or a date, in any session zone.

    The type is a constant to the optimizer, so one of the readings is left.
    """
    c = as_col(c)
    day = F.unix_date(c.cast("date")) * F.lit(86_400_000_000)
    clock = F.hour(c) * F.lit(3_600_000_000) + F.minute(c) * F.lit(60_000_000).cast("bigint") + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
    return F.when(F.typeof(c) == "timestamp_ntz", day + clock).when(F.typeof(c) == "date", day).otherwise(F.unix_micros(c.cast("timestamp")))


def utc(c: Column | str) -> Column:
    """A timestamp as its wall clock in UTC, without zone."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(as_col(c)), F.lit("1970-01-01").cast("timestamp_ntz"))


def parse_num_text(c: Column | str) -> Column:
    """A finite decimal number; anything else, NaN and infinities included, is null."""
    c = as_col(c)
    value = F.when(c.rlike(NUMBER), c.try_cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def parse_bool_text(c: Column | str) -> Column:
    word = F.lower(trim_space(c))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def parse_ts_text(c: Column | str) -> Column:
    """A date, a date-time with optional fraction and ±hh, or RFC 3339. Text without zone is UTC."""
    c = as_col(c)
    return (
        F.when(c.rlike(rf"\A{DATE}\z"), F.try_to_timestamp(F.concat(c, F.lit("T00:00:00Z"))))
        .when(c.rlike(rf"\A{DATE} {CLOCK}\z"), F.try_to_timestamp(F.concat(c, F.lit("Z"))))
        .when(c.rlike(rf"\A{DATE} {CLOCK}[+-][0-9]{{2}}\z"), F.try_to_timestamp(c))
        .when(c.rlike(rf"\A{DATE}T{CLOCK}(Z|[+-][0-9]{{2}}:[0-9]{{2}})\z"), F.try_to_timestamp(c))
    )


def parse_archive_ts(c: Column | str) -> Column:
    """RFC 3339, or the same without a zone (then UTC)."""
    c = as_col(c)
    return F.when(c.rlike(rf"\A{DATE}T{CLOCK}(Z|[+-][0-9]{{2}}:[0-9]{{2}})\z"), F.try_to_timestamp(c)).when(
        c.rlike(rf"\A{DATE}T{CLOCK}\z"), F.try_to_timestamp(F.concat(c, F.lit("Z"))))


def scalar_int(c: Column | str) -> Column:
    """A whole number as text; empty, null or unparseable reads as 0."""
    t = trim_space(c)
    return F.coalesce(F.when(t.rlike(r"\A[+-]?[0-9]+\z"), t.try_cast("bigint")), F.lit(0).cast("bigint"))


def parse_duration_text(c: Column | str) -> Column:
    """``1h30m``, ``90s``, ``1.5h`` … as seconds; null when malformed."""
    c = as_col(c)
    parts = F.regexp_extract_all(c, F.lit(f"({DURATION_PART})"), F.lit(1))
    factors = F.create_map(*[F.lit(x) for kv in UNIT_SECONDS.items() for x in kv])
    amount = lambda p: F.regexp_extract(p, DURATION_PART, 1).try_cast("double")
    unit = lambda p: F.regexp_extract(p, DURATION_PART, 3)
    total = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + amount(p) * F.element_at(factors, unit(p)))
    sign = F.when(c.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.when(c.rlike(r"\A[+-]?0\z"), F.lit(0.0)).when(
        c.rlike(rf"\A[+-]?({DURATION_PART})+\z"), F.round(sign * total, 9))


def parse_interval_text(c: Column | str) -> Column:
    """``12h``, ``7d``, ``2w`` as seconds; null unless a positive whole number with one unit."""
    c = as_col(c)
    n = F.regexp_extract(c, r"\A\+?([0-9]+)[hdw]\z", 1)
    factors = F.create_map(*[F.lit(x) for kv in INTERVAL_SECONDS.items() for x in kv])
    value = F.when(n != "", n.try_cast("bigint"))
    return F.when(value > 0, value * F.element_at(factors, F.right(c, F.lit(1))))


# From the shortest Java form to the wanted one, step by step (pattern, replacement).
_NUMBER_STEPS = (
    (r"\A(-?)([0-9])\.([0-9]+)E-4\z", "$10.000$2$3"),       # 5.1E-4    -> 0.00051
    (r"\A(-?0\.000[0-9]*?)0+\z", "$1"),
    (r"\A(-?[0-9])([0-9]{6})\.([0-9]+)\z", "$1.$2$3E6"),     # 1234567.5 -> 1.2345675E6
    (r"(\.[0-9]*?)0*E", "$1E"),
    (r"\.E", "E"),
    (r"\.0\z", ""),
    (r"E(-?)([0-9])\z", "E$10$2"),
    (r"E([0-9])", "e+$1"),
    (r"E-", "e-"),
)


def number_text(c: Column | str) -> Column:
    """A double in its shortest form: plain from 1e-4 up to below 1e6, else with an exponent."""
    text = as_col(c).cast("double").cast("string")
    for pattern, replacement in _NUMBER_STEPS:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def duration_text(seconds: Column) -> Column:
    """Seconds as ``36h0m0s``, ``5m0s``, ``9s``; rounded to the second."""
    s = F.abs(F.round(seconds.cast("double"))).cast("bigint")
    h, m, rest = F.floor(s / 3600).cast("string"), F.floor(s % 3600 / 60).cast("string"), (s % 60).cast("string")
    body = F.when(s >= 3600, F.concat(h, F.lit("h"), m, F.lit("m"), rest, F.lit("s"))).when(
        s >= 60, F.concat(m, F.lit("m"), rest, F.lit("s"))).otherwise(F.concat(rest, F.lit("s")))
    return F.concat(F.when((seconds < 0) & (s > 0), F.lit("-")).otherwise(F.lit("")), body)
