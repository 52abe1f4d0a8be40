"""Run a registered query in Spark and its SQL in DuckDB, and compare columns and values."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter

import duckdb

from soundcheck.catalog.base import ORACLE, QUERIES, TABLES


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return norm(float(v)) if v % 1 else int(v)
    if isinstance(v, dt.datetime) and v.tzinfo:
        return v.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return v


def family(v):
    return {bool: "bool", int: "number", float: "number", decimal.Decimal: "number", str: "text"}.get(
        type(v), type(v).__name__)


CLASSES = {"tinyint": "int", "smallint": "int", "int": "int", "integer": "int", "bigint": "int", "double": "float", "float": "float",
           "string": "text", "varchar": "text", "boolean": "bool", "timestamp": "time", "timestamp_ntz": "time",
           "timestamp with time zone": "time"}


def type_class(name: str) -> str:
    return CLASSES.get(name.lower(), name.lower())


def compare(spark, con, name: str, folder: str) -> list[str]:
    """Differences, none when both engines agree."""
    df = QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    mine = [tuple(r) for r in df.select(*["`" + c.replace("`", "``") + "`" for c in cols]).collect()]
    rel = con.sql(ORACLE[name])
    theirs_cols = sorted(rel.columns)
    if cols != theirs_cols:
        return [f"columns {cols} != {theirs_cols}"]
    theirs = rel.project(", ".join(f'"{c}"' for c in cols)).fetchall()
    problems = []
    if not mine:
        problems.append("no rows")
    kinds = dict(zip(rel.columns, map(str, rel.types)))
    for i, c in enumerate(cols):
        x, y = type_class(df.schema[c].dataType.simpleString()), type_class(kinds[c])
        if x != y and any(r[i] is not None for r in mine):
            problems.append(f"type of {c}: {x} != {y}")
        a = {family(r[i]) for r in mine if r[i] is not None}
        b = {family(r[i]) for r in theirs if r[i] is not None}
        if a != b:
            problems.append(f"types of {c}: {a} != {b}")
    a = Counter(tuple(norm(v) for v in r) for r in mine)
    b = Counter(tuple(norm(v) for v in r) for r in theirs)
    if a != b:
        problems.append(f"{len(mine)} rows vs {len(theirs)}; only spark {list((a - b).items())[:3]}; "
                        f"only duckdb {list((b - a).items())[:3]}")
    return problems
