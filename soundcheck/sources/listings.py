"""Listings of backup repositories, as captured JSON text, to one row per backup.

A listing that cannot be read is one row with an ``error``; it never turns into an empty chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from soundcheck.functions.scalars import parse_archive_ts
from soundcheck.functions.text import as_col, first_line, quoted

STANZAS = ("array<struct<name:string,status:struct<code:int,message:string>,"
           "backup:array<struct<label:string,type:string,timestamp:struct<stop:bigint>>>>>")
SNAPSHOTS = "array<struct<time:string,id:string,short_id:string>>"
ARCHIVES = "struct<archives:array<struct<name:string,archive:string,time:string,start:string>>>"
BACKUP = "struct<ord:int,label:string,type:string,ts:timestamp>"


def parse_pgbackrest_info(df: DataFrame, col: str) -> DataFrame:
    """unit, status_code, status_message, ord, label, type, ts, error: one row per (stanza, backup)."""
    is_array = F.col(col).rlike(r"\A\s*\[")
    parsed = F.when(is_array, F.from_json(col, STANZAS))
    rest = [c for c in df.columns if c != col]
    wide = df.select(*rest, parsed.alias("_p"))
    stanzas = wide.select(*rest, F.col("_p").isNull().alias("_bad"), F.explode_outer("_p").alias("_s"))
    rows = stanzas.filter(F.col("_bad") | F.col("_s").isNotNull()).select(
        *rest, "_bad", F.col("_s.name").alias("unit"), F.coalesce("_s.status.code", F.lit(0)).alias("status_code"),
        F.coalesce("_s.status.message", F.lit("")).alias("status_message"),
        F.posexplode_outer("_s.backup").alias("ord", "_b"))
    return rows.select(
        *rest, "unit", "status_code", "status_message", "ord", F.col("_b.label").alias("label"),
        F.col("_b.type").alias("type"), F.timestamp_seconds("_b.timestamp.stop").alias("ts"),
        F.when(F.col("_bad"), F.lit("parse pgbackrest info json")).alias("error"))


def _rows(df: DataFrame, rest: list[str]) -> DataFrame:
    """Explode ``_items`` (BACKUP) of good listings; a bad one gives a single row with its error."""
    items = F.when(F.col("_error").isNull(), F.col("_items"))
    out = df.select(*rest, F.col("_error").alias("error"), F.explode_outer(items).alias("_i"))
    return out.filter(F.col("error").isNotNull() | F.col("_i").isNotNull()).select(
        *rest, "_i.ord", "_i.label", "_i.type", "_i.ts", "error")


def parse_restic_snapshots(df: DataFrame, col: str) -> DataFrame:
    """ord, label, type ``snapshot``, ts, error. Text before the first ``[`` and after the last ``]`` is ignored."""
    rest = [c for c in df.columns if c != col]
    text = F.regexp_extract(col, r"(?s)(\[.*\])", 1)
    parsed = F.from_json(F.when(text != "", text), SNAPSHOTS)
    label = lambda s: F.coalesce(_given(s["short_id"]), F.left(s["id"], F.lit(8)))
    items = F.transform(parsed, lambda s, i: F.struct(
        i.cast("int").alias("ord"), label(s).alias("label"), F.lit("snapshot").alias("type"),
        parse_archive_ts(_zoned(s["time"])).alias("ts")))
    error = (F.when(text == "", F.concat(F.lit("restic snapshots: no JSON array in output "), quoted(first_line(col))))
             .when(parsed.isNull() | F.exists(items, lambda i: i["ts"].isNull()), F.lit("parse restic snapshots json")))
    return _rows(df.select(*rest, error.alias("_error"), items.alias("_items")), rest)


def parse_borg_archives(df: DataFrame, col: str) -> DataFrame:
    """ord, label, type ``archive``, ts, error. Text outside the outermost braces is ignored.

    A time that cannot be read makes the whole listing an error, since the order of a chain is its point.
    """
    rest = [c for c in df.columns if c != col]
    text = F.regexp_extract(col, r"(?s)(\{.*\})", 1)
    parsed = F.from_json(F.when(text != "", text), ARCHIVES)
    ok = parsed.isNotNull() & F.try_parse_json(F.when(text != "", text)).isNotNull()
    archives = F.coalesce(parsed["archives"], F.array().cast("array<struct<name:string,archive:string,time:string,start:string>>"))
    name = lambda a: F.coalesce(_given(a["name"]), a["archive"], F.lit(""))
    raw = lambda a: F.coalesce(_given(a["time"]), a["start"], F.lit(""))
    items = F.transform(archives, lambda a, i: F.struct(
        i.cast("int").alias("ord"), name(a).alias("label"), F.lit("archive").alias("type"),
        parse_archive_ts(raw(a)).alias("ts")))
    bad = F.get(F.filter(archives, lambda a: parse_archive_ts(raw(a)).isNull()), F.lit(0))
    error = (
        F.when(text == "", F.concat(F.lit("borg list: no JSON object in output "), quoted(first_line(col))))
        .when(~ok, F.lit("parse borg list json"))
        .when(bad.isNotNull(), F.concat(F.lit("archive "), quoted(name(bad)), F.lit(": unparseable archive time "),
                                        quoted(raw(bad)))))
    return _rows(df.select(*rest, error.alias("_error"), items.alias("_items")), rest)


def _given(c: Column) -> Column:
    return F.when(c != "", c)


def _zoned(c: Column) -> Column:
    return F.when(as_col(c).rlike(r"(Z|[+-][0-9]{2}:[0-9]{2})\z"), c)
