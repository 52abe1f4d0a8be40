"""Configuration lines of database units: effective values, required libraries, unit inspection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from soundcheck.functions.text import let, trim_space

LIBRARIES_KEY = "shared_preload_libraries"


def setting_line(line: Column) -> Column:
    """struct(key, value) of ``key = value  # comment``; null for any other line.

    A ``#`` inside single quotes is no comment; one layer of single quotes around the value is removed.
    """
    def split(code):
        at = F.instr(code, "=")
        key = F.lower(trim_space(code.substr(F.lit(1), at - 1)))
        value = F.regexp_replace(trim_space(code.substr(at + 1, F.length(code))), r"(?s)\A'(.*)'\z", "$1")
        return F.when(at > 0, F.struct(key.alias("key"), value.alias("value")))

    code = F.regexp_extract(line, r"(?s)\A((?:[^'#]++|'[^']*+(?:'|\z))*+)", 1)
    return let(trim_space(code), split)


def effective_settings(lines: DataFrame) -> DataFrame:
    """unit, key, value from lines (unit, file_rank, line_no, line): a later file beats an earlier one, and
    within a file the last assignment wins. Combined map-side."""
    parsed = lines.withColumn("_s", setting_line(F.col("line"))).filter("_s.key <> ''")
    return parsed.groupBy("unit", F.col("_s.key").alias("key")).agg(
        F.max_by("_s.value", F.struct("file_rank", "line_no")).alias("value"))


def split_libraries(value: Column) -> Column:
    """A list value cut at commas, blanks and quotes trimmed, empty entries dropped."""
    clean = F.transform(F.split(value, ","), lambda p: trim_space(F.btrim(trim_space(p), F.lit("'\""))))
    return F.filter(clean, lambda p: p != "")


def required_libraries(settings: DataFrame, key: str = LIBRARIES_KEY) -> DataFrame:
    """unit, position, library of the effective list setting."""
    return settings.filter(F.col("key") == key).select(
        "unit", F.posexplode(split_libraries(F.col("value"))).alias("position", "library"))


def inspect_units(files: DataFrame, lines: DataFrame, key: str = LIBRARIES_KEY) -> DataFrame:
    """unit, version, databases, libraries, error.

    ``files``: unit, path, is_dir, content (text of the version marker, else null). A missing or empty
    marker is an error; missing settings or folders are not.
    """
    marker = F.col("path") == "PG_VERSION"
    database = F.col("is_dir") & F.col("path").rlike(r"\Abase/[+-]?[0-9]+\z")
    units = files.groupBy("unit").agg(
        F.max(F.when(marker, trim_space(F.coalesce("content", F.lit(""))))).alias("version"),
        F.count_if(database).alias("databases"))
    setting = effective_settings(lines).filter(F.col("key") == key).select(
        "unit", F.array_join(split_libraries(F.col("value")), ",").alias("libraries"))
    error = (F.when(F.col("version").isNull(), F.lit("version marker not found"))
             .when(F.col("version") == "", F.lit("version marker is empty")))
    return units.join(setting, "unit", "left").select(
        "unit", F.when(error.isNull(), F.col("version")).alias("version"), "databases",
        F.coalesce("libraries", F.lit("")).alias("libraries"), error.alias("error"))
