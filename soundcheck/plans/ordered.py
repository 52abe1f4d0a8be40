"""Window results over groups that may be far too large for one task.

A plain window sends a whole group to one task. ``over_groups`` counts the largest group first
(a map-side combined count of the key columns). Small groups use the plain window. Otherwise the
rows are range-partitioned by key *and* order, so that a hot key spans many blocks, and written
once so that the block numbers are fixed; each block is windowed on its own, and what one block
hands to the next is worked out over one summary row per (key, block).

The order must be total within a key (end it with a unique column).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from soundcheck.session import materialise

ROWS_PER_TASK = 2_000_000


@dataclass(frozen=True)
class Derived:
    """One derived column: what to compute over the rows before (and up to) the current one."""

    name: str
    kind: str  # row_number | lag | prior_max | last_known
    expr: Column | None = None


def row_number(name: str) -> Derived:
    return Derived(name, "row_number")


def lag(name: str, expr: Column) -> Derived:
    """Value of ``expr`` on the previous row; null on the first."""
    return Derived(name, "lag", expr)


def prior_max(name: str, expr: Column) -> Derived:
    """Largest ``expr`` over all earlier rows; null on the first."""
    return Derived(name, "prior_max", expr)


def last_known(name: str, expr: Column) -> Derived:
    """Newest non-null ``expr`` up to and including the current row."""
    return Derived(name, "last_known", expr)


def largest_group(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """(rows of the largest group, rows in all): two numbers, combined map-side."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if keys else df.agg(
        F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.max("n").alias("hi"), F.sum("n").alias("total")).first()
    return int(row["hi"] or 0), int(row["total"] or 0)


def over_groups(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                derived: Sequence[Derived], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Add the ``derived`` columns, computed per ``keys`` in ``order``."""
    largest, total = largest_group(df, keys)
    if largest <= rows_per_task:
        return _plain(df, keys, order, derived)
    return _by_blocks(df, keys, order, derived, math.ceil(total / rows_per_task) + 1)


def _plain(df, keys, order, derived):
    w = Window.partitionBy(*keys).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    made = {
        "row_number": lambda d: F.row_number().over(w).cast("bigint"),
        "lag": lambda d: F.lag(d.expr).over(w),
        "prior_max": lambda d: F.max(d.expr).over(before),
        "last_known": lambda d: F.last(d.expr, ignorenulls=True).over(upto),
    }
    return df.withColumns({d.name: made[d.kind](d) for d in derived})


def _by_blocks(df, keys, order, derived, blocks):
    inputs = {f"_in_{d.name}": d.expr for d in derived if d.expr is not None}
    ranged = (df.withColumns(inputs) if inputs else df).repartitionByRange(
        blocks, *[F.col(k) for k in keys], *order)
    fixed = materialise(ranged.withColumn("_block", F.spark_partition_id()), "blocks")

    w = Window.partitionBy(*keys, "_block").orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    local = fixed.withColumn("_n", F.row_number().over(w).cast("bigint"))

    # One summary row per (key, block): what the block hands on.
    hands_on = [F.count(F.lit(1)).alias("_rows")]
    for d in derived:
        col = F.col(f"_in_{d.name}")
        if d.kind == "lag":
            hands_on.append(F.max_by(F.struct(col.alias("v")), F.col("_n")).alias(f"_out_{d.name}"))
        elif d.kind == "prior_max":
            hands_on.append(F.max(col).alias(f"_out_{d.name}"))
        elif d.kind == "last_known":
            hands_on.append(F.max_by(col, F.when(col.isNotNull(), F.col("_n"))).alias(f"_out_{d.name}"))
    summary = local.groupBy(*keys, "_block").agg(*hands_on)

    # At most one row per block and key reaches this window.
    across = Window.partitionBy(*keys).orderBy("_block")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    carry = {}
    for d in derived:
        out = F.col(f"_out_{d.name}")
        if d.kind == "row_number":
            carry[f"_c_{d.name}"] = F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
        elif d.kind == "lag":
            carry[f"_c_{d.name}"] = F.lag(out).over(across)
        elif d.kind == "prior_max":
            carry[f"_c_{d.name}"] = F.max(out).over(earlier)
        else:
            carry[f"_c_{d.name}"] = F.last(out, ignorenulls=True).over(earlier)
    carried = summary.withColumns(carry).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_k_block"), *carry)

    on = F.col("_block") == F.col("_k_block")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = local.join(carried, on, "left")
    result = {}
    for d in derived:
        c, v = F.col(f"_c_{d.name}"), F.col(f"_in_{d.name}")
        if d.kind == "row_number":
            result[d.name] = F.col("_n") + c
        elif d.kind == "lag":
            result[d.name] = F.when(F.col("_n") == 1, c["v"]).otherwise(F.lag(v).over(w))
        elif d.kind == "prior_max":
            result[d.name] = F.greatest(c, F.max(v).over(before))
        else:
            result[d.name] = F.coalesce(F.last(v, ignorenulls=True).over(upto), c)
    return joined.withColumns(result).select(*df.columns, *[d.name for d in derived])
