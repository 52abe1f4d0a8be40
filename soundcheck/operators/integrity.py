"""Integrity of tables and of snapshots against each other.

Violations are counted in one pass, together with the smallest and the largest offending key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from soundcheck.functions.text import quote_ident
from soundcheck.plans.ordered import over_groups, prior_max

VIOLATIONS = ("name", "ok", "violations", "first_key", "last_key")


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(quote_ident(n)) for n in names]


def _key_text(keys: Sequence[Column]) -> Column:
    return F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])


def _verdict(df: DataFrame, name: str, keys: Sequence[str], violations: Column) -> DataFrame:
    """Fold offending rows into one result row."""
    order = F.struct(*_cols(keys))
    first, last = F.min(order), F.max(order)
    text = lambda s: F.concat_ws("|", *[F.coalesce(s[k].cast("string"), F.lit("")) for k in keys])
    return df.agg(F.coalesce(violations, F.lit(0)).cast("bigint").alias("violations"), first.alias("f"),
                  last.alias("l")).select(
        F.lit(name).alias("name"), (F.col("violations") == 0).alias("ok"), "violations",
        F.when(F.col("f").isNotNull(), text(F.col("f"))).alias("first_key"),
        F.when(F.col("l").isNotNull(), text(F.col("l"))).alias("last_key"))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, rows, nulls for every column, in one aggregation."""
    columns = list(columns or df.columns)
    row = df.agg(F.count(F.lit(1)).alias("rows"),
                 *[F.count_if(c.isNull()).alias(f"n{i}") for i, c in enumerate(_cols(columns))])
    return row.select("rows", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("nulls")) for i, c in enumerate(columns)
    ])).alias("s")).select("s.column", "rows", "s.nulls")


def predicate_check(df: DataFrame, rules: Mapping[str, Column | str], keys: Sequence[str]) -> DataFrame:
    """Rows for which a rule is false (null passes, as in a SQL CHECK): all rules in one aggregation."""
    order = F.struct(*_cols(keys))
    aggs = []
    for i, rule in enumerate(rules.values()):
        rule = F.expr(rule) if isinstance(rule, str) else rule
        bad = ~F.coalesce(rule, F.lit(True))
        aggs += [F.count_if(bad).alias(f"n{i}"), F.min(F.when(bad, order)).alias(f"f{i}"),
                 F.max(F.when(bad, order)).alias(f"l{i}")]
    text = lambda s: F.when(s.isNotNull(), F.concat_ws(
        "|", *[F.coalesce(s[k].cast("string"), F.lit("")) for k in keys]))
    return df.agg(*aggs).select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), (F.col(f"n{i}") == 0).alias("ok"), F.col(f"n{i}").alias("violations"),
                 text(F.col(f"f{i}")).alias("first_key"), text(F.col(f"l{i}")).alias("last_key"))
        for i, name in enumerate(rules)])).alias("s")).select("s.*")


def not_null_check(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return predicate_check(df, {f"{c}_not_null": F.col(quote_ident(c)).isNotNull() for c in columns}, keys)


def generated_column_check(df: DataFrame, generated: Mapping[str, Column | str], keys: Sequence[str]) -> DataFrame:
    """Stored values that differ from their recomputation; two nulls agree."""
    rules = {f"{c}_generated": F.col(quote_ident(c)).eqNullSafe(F.expr(e) if isinstance(e, str) else e)
             for c, e in generated.items()}
    return predicate_check(df, rules, keys)


def unique_check(df: DataFrame, keys: Sequence[str], name: str | None = None) -> DataFrame:
    """Keys that occur more than once; a key with a null in it is never a duplicate."""
    whole = df.na.drop(subset=list(keys))
    twice = whole.groupBy(*_cols(keys)).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    return _verdict(twice, name or "_".join(keys) + "_unique", keys, F.count(F.lit(1)))


def foreign_key_check(child: DataFrame, child_keys: Sequence[str], parent: DataFrame, parent_keys: Sequence[str],
                      name: str | None = None) -> DataFrame:
    """Child rows whose non-null key has no parent row.

    Child keys are counted first (map-side), so a key that most rows share costs one row in the join.
    """
    counted = child.na.drop(subset=list(child_keys)).groupBy(*_cols(child_keys)).agg(
        F.count(F.lit(1)).alias("_n"))
    p = parent.select(*[c.alias(f"_p{i}") for i, c in enumerate(_cols(parent_keys))])
    on = [F.col(quote_ident(c)) == F.col(f"_p{i}") for i, c in enumerate(child_keys)]
    orphans = counted.join(p, on, "left_anti")
    return _verdict(orphans, name or "_".join(child_keys) + "_references", child_keys, F.sum("_n"))


def overlaps(df: DataFrame, key: Sequence[str], lower: str, upper: str, id_col: str, **plan) -> DataFrame:
    """Rows that start inside an earlier half-open range of the same key; touching ends are allowed.

    Empty ranges overlap nothing.
    """
    real = df.filter(F.col(lower) < F.col(upper))
    seen = over_groups(real, list(key), [F.col(lower).asc(), F.col(id_col).asc()],
                       [prior_max("_reach", F.col(upper))], **plan)
    return seen.filter(F.col("_reach") > F.col(lower)).withColumnRenamed("_reach", "earlier_upper")


def no_overlap_check(df: DataFrame, key: Sequence[str], lower: str, upper: str, id_col: str,
                     name: str = "no_overlap", **plan) -> DataFrame:
    return _verdict(overlaps(df, key, lower, upper, id_col, **plan), name, [id_col], F.count(F.lit(1)))


def expected_partition(key: Column, spec: Sequence[Mapping]) -> Column:
    """Partition a row belongs to. Entries: {name, from, to} (half-open), {name, values},
    {name, modulus, remainder} or {name, default: True}; the first that fits wins."""
    out, default = None, F.lit(None).cast("string")
    for part in spec:
        if part.get("default"):
            default = F.lit(part["name"])
            continue
        if "values" in part:
            fits = key.isin(list(part["values"]))
        elif "modulus" in part:
            fits = F.pmod(F.xxhash64(key), F.lit(part["modulus"])) == part["remainder"]
        else:
            fits = F.lit(True)
            if part.get("from") is not None:
                fits = fits & (key >= F.lit(part["from"]))
            if part.get("to") is not None:
                fits = fits & (key < F.lit(part["to"]))
        out = F.when(fits, F.lit(part["name"])) if out is None else out.when(fits, F.lit(part["name"]))
    return default if out is None else out.otherwise(default)


def partition_routing_check(df: DataFrame, stored: Column | str, key: Column | str, spec: Sequence[Mapping],
                            ) -> DataFrame:
    """Per stored partition: rows and rows that belong elsewhere."""
    stored = F.col(stored) if isinstance(stored, str) else stored
    key = F.col(key) if isinstance(key, str) else key
    return df.groupBy(stored.alias("partition")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~stored.eqNullSafe(expected_partition(key, spec))).alias("misrouted"))


def derived_table_check(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Rows of a stored rollup that its recomputation does not give, and the reverse.

    One shuffle: rows of both sides are counted together and kept where the counts differ.
    """
    cols = stored.columns
    both = stored.select(*_cols(cols), F.lit(1).alias("_s"), F.lit(0).alias("_r")).unionByName(
        recomputed.select(*_cols(cols), F.lit(0).alias("_s"), F.lit(1).alias("_r")))
    net = both.groupBy(*_cols(cols)).agg((F.sum("_s") - F.sum("_r")).alias("_net")).filter(F.col("_net") != 0)
    return net.select(*_cols(cols), F.when(F.col("_net") > 0, F.lit("stored_only")).otherwise(
        F.lit("recomputed_only")).alias("side"), F.abs("_net").alias("copies"))


def row_digest(df: DataFrame, columns: Sequence[str]) -> Column:
    """SHA-256 of a row: every value as text with its length in front, so no two rows share a text."""
    parts = []
    for c in columns:
        kind, col = df.schema[c].dataType, F.col(quote_ident(c))
        if isinstance(kind, T.BinaryType):
            text = F.hex(col)
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            stamp = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
            text = F.to_json(col, {"ignoreNullFields": "false", "timestampFormat": stamp + "XXX",
                                   "timestampNTZFormat": stamp})
        elif isinstance(kind, T.VariantType):
            text = F.to_json(col)
        else:
            text = col.cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def snapshot_diff(a: DataFrame, b: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """How snapshot ``b`` differs from ``a``: missing, extra and changed keys.

    Only the keys and a digest per row are shuffled, both sides together. Rows that occur alike in both
    cancel out before the keys are compared. Without keys, the digest itself is the key.
    """
    columns = list(a.columns)

    def side(df, na, nb):
        named = [c.alias(f"{k}") for k, c in zip(keys or [], _cols(keys or []))]
        return df.select(*named, row_digest(df, columns).alias("digest"), F.lit(na).alias("_a"),
                         F.lit(nb).alias("_b"))

    group = [*(keys or []), "digest"]
    net = (side(a, 1, 0).unionByName(side(b.select(*_cols(columns)), 0, 1))
           .groupBy(*group).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
           .withColumn("_net", F.col("_a") - F.col("_b")).filter(F.col("_net") != 0))
    by = list(keys) if keys else ["digest"]
    return net.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("_net") > 0, F.col("_net"))), F.lit(0)).alias("only_a"),
        F.coalesce(F.sum(F.when(F.col("_net") < 0, -F.col("_net"))), F.lit(0)).alias("only_b"),
    ).withColumn("change", F.when((F.col("only_a") > 0) & (F.col("only_b") > 0), F.lit("changed"))
                 .when(F.col("only_a") > 0, F.lit("missing")).otherwise(F.lit("extra")))


def table_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """rows and an order-free content hash: the sum of a 60-bit slice of every row's digest."""
    columns = list(columns or df.columns)
    part = F.conv(F.left(row_digest(df, columns), F.lit(15)), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.coalesce(F.sum(part), F.lit(0).cast("decimal(38,0)")).cast("string").alias("fingerprint"))
