"""The telling line of captured tool output."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from soundcheck.functions.text import as_col, trim_space

# What marks the cause of a failure, per flavor (tested on the lower-cased, trimmed line).
FAILURE_LINE = {
    "restic": r"\A(fatal:|error:)|unable to open",
    "restic_listing": r"\A(fatal:|error:)",
    "borg": r"\A(error:|error )|passphrase supplied|does not exist|does not seem to be a valid repository",
}
IGNORED_ERRORS = "errors ignored on restore:"


def failure_reason(c: Column | str, flavor: str, exit_code: Column | None = None) -> Column:
    """First line that names a cause.

    Without ``exit_code`` (a load that failed) the fallback is blank; with it (a listing that failed)
    the fallback is the first non-empty line, then ``exited N``.
    """
    lines = F.split(as_col(c), "\n")
    if flavor == "pgbackrest":
        told = F.filter(lines, lambda x: x.contains("ERROR:"))
        told = F.transform(told, lambda x: trim_space(F.regexp_extract(x, r"(?s)(ERROR:.*)\z", 1)))
    else:
        key = "restic_listing" if flavor == "restic" and exit_code is not None else flavor
        told = F.filter(F.transform(lines, trim_space), lambda x: F.lower(x).rlike(FAILURE_LINE[key]))
    reason = F.try_element_at(told, F.lit(1))
    if exit_code is None:
        return F.coalesce(reason, F.lit(""))
    any_line = F.filter(F.transform(lines, trim_space), lambda x: x != "")
    return F.coalesce(reason, F.try_element_at(any_line, F.lit(1)),
                      F.concat(F.lit("exited "), exit_code.cast("string")))


def load_warnings(c: Column | str) -> Column:
    """Ignored errors of a load that went through: the reported count, or ``some``."""
    c = as_col(c)
    said = F.regexp_extract(c, r"(?s)errors ignored on restore:([^\n]*)", 1)
    count = F.when(c.contains(IGNORED_ERRORS), trim_space(said)).otherwise(F.lit("some"))
    return F.concat(F.lit("load ignored "), count, F.lit(" error(s)"))
