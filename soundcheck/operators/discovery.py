"""Discovery: profile a snapshot and propose checks whose thresholds come from the observed data.

A candidate is a check definition with a group, a subject and a weight. The profile costs one
aggregation per table, whatever the number of proposed checks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from soundcheck.functions.scalars import epoch, instant
from soundcheck.functions.text import (blank_to, check_name, is_temp_name, quote_ident, quote_literal, sanitize,
                                       skeleton_file_name)
from soundcheck.operators.checks import run_checks
from soundcheck.operators.registry import Snapshot
from soundcheck.operators.views import COMPONENTS_VIEW, PARTITIONS_VIEW, TABLES_VIEW, split_name, user_tables
from soundcheck.plans.sizing import broadcast_if_small, hold
from soundcheck.schemas import CHECK_FIELDS, CHECKS

# Obvious time columns, components, thresholds and caps.
TIME_COLUMN_NAMES = ("created_at", "updated_at", "inserted_at", "ts", "time", "event_time")
PRELOAD_COMPONENTS = ("timescaledb",)
FRESHNESS_MARGIN = 5
FRESHNESS_FLOOR_S = 86400
MAX_ANCHORS = 5

CANDIDATE_FIELDS = [*CHECK_FIELDS, "cap_group", "subject", "weight"]
CANDIDATES = CHECKS + ", cap_group string, subject string, weight bigint"


def _qualified(table: str) -> str:
    return quote_ident(table)


def time_columns(df: DataFrame) -> list[tuple[str, bool]]:
    """(column, zoned) of the time columns in ordinal order."""
    return [(f.name, isinstance(f.dataType, T.TimestampType)) for f in df.schema.fields
            if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]


def freshness_column(df: DataFrame, rule: str = "single", allow_ntz: bool = True) -> str | None:
    """The column that tells how fresh a table is.

    ``single``: exactly one zoned column with an obvious name. ``prefer_updated``: ``updated_at`` if
    there is one, else the first obvious name by position, zoned or not.
    """
    obvious = [(c, z) for c, z in time_columns(df) if c.lower() in TIME_COLUMN_NAMES]
    if rule == "single":
        found = [c for c, z in obvious if z or allow_ntz]
        return found[0] if len(found) == 1 else None
    updated = [c for c, _ in obvious if c.lower() == "updated_at"]
    return (updated + [c for c, _ in obvious] + [None])[0]


def profile_time_columns(spark: SparkSession, snapshot: Snapshot) -> DataFrame:
    """schema, name, position, column, zoned, and the number of known values and the newest one."""
    parts = []
    for t in user_tables(snapshot):
        df, found = snapshot.tables[t], time_columns(snapshot.tables[t])
        if not found:
            continue
        schema, name = split_name(t)
        row = df.agg(*[x for i, (c, _) in enumerate(found) for x in (
            F.count(quote_ident(c)).alias(f"n{i}"), F.max(epoch(quote_ident(c))).alias(f"m{i}"))])
        parts.append(row.select(F.explode(F.array(*[
            F.struct(F.lit(schema).alias("schema"), F.lit(name).alias("name"), F.lit(i + 1).alias("position"),
                     F.lit(c).alias("column"), F.lit(z).alias("zoned"), F.col(f"n{i}").alias("known"),
                     F.col(f"m{i}").alias("newest_epoch")) for i, (c, z) in enumerate(found)])).alias("s")).select("s.*"))
    empty = "schema string, name string, position int, column string, zoned boolean, known bigint, newest_epoch bigint"
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], empty)


def observed_age(df: DataFrame, column: str, as_of=None) -> DataFrame:
    """Seconds since the newest value; none, or one in the future, counts as 0."""
    return df.agg(_age(F.max(epoch(quote_ident(column))), as_of).alias("age_s"))


def _age(newest: Column, as_of) -> Column:
    now = F.floor(F.unix_micros(instant(as_of)) / F.lit(1_000_000)).cast("bigint")
    return F.greatest(F.lit(0).cast("bigint"), F.coalesce(now - newest, F.lit(0).cast("bigint")))


def freshness_threshold(age: Column) -> Column:
    return F.greatest(age * FRESHNESS_MARGIN, F.lit(FRESHNESS_FLOOR_S).cast("bigint"))


def profile_tables(spark: SparkSession, snapshot: Snapshot, rule: str = "single", as_of=None,
                   allow_ntz: bool = True) -> DataFrame:
    """ord, schema, name, rows, time_column, newest_epoch, age_s, max_age_s: one aggregation per table."""
    parts = []
    for i, t in enumerate(user_tables(snapshot)):
        df = snapshot.tables[t]
        schema, name = split_name(t)
        col = freshness_column(df, rule, allow_ntz)
        newest = F.max(epoch(quote_ident(col))) if col else F.lit(None).cast("bigint")
        parts.append(df.agg(F.count(F.lit(1)).alias("rows"), newest.alias("newest_epoch")).select(
            F.lit(i).alias("ord"), F.lit(schema).alias("schema"), F.lit(name).alias("name"), "rows",
            F.lit(col).cast("string").alias("time_column"), "newest_epoch"))
    empty = "ord int, schema string, name string, rows bigint, time_column string, newest_epoch bigint"
    profile = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], empty)
    age = F.when(F.col("time_column").isNotNull(), _age(F.col("newest_epoch"), as_of))
    return profile.withColumn("age_s", age).withColumn(
        "max_age_s", F.when(F.col("age_s").isNotNull(), freshness_threshold(F.col("age_s"))))


# -- candidates ----------------------------------------------------------------------------------

def _candidates(df: DataFrame, **fields: Column) -> DataFrame:
    """Shape a DataFrame into candidates; fields not given are null."""
    kinds = {f.name: f.dataType for f in T._parse_datatype_string(CANDIDATES).fields}
    return df.select(*[fields.get(f, F.lit(None)).cast(kinds[f]).alias(f) for f in CANDIDATE_FIELDS])


def _table_sql() -> Column:
    qualified = F.when(F.col("schema") == "", F.col("name")).otherwise(F.concat("schema", F.lit("."), "name"))
    return F.concat(F.lit("`"), F.replace(qualified, F.lit("`"), F.lit("``")), F.lit("`"))


def _name_of(suffix: str) -> Column:
    return check_name("schema", "name", suffix)


def structural_checks(profile: DataFrame, flavor: str = "postgres") -> DataFrame:
    """Required presence checks, over the table in which every snapshot lists its user tables."""
    spark = profile.sparkSession
    made = [("server_reachable", "SELECT 1", "1", None)]
    if flavor == "postgres":
        made.append(("has_user_database", f"SELECT count(DISTINCT `schema`) FROM {TABLES_VIEW}", None, 1.0))
    made.append(("schema_present", f"SELECT count(*) FROM {TABLES_VIEW}", None, 1.0))
    base = spark.createDataFrame([(i, *m) for i, m in enumerate(made)],
                                 "i int, n string, q string, eq string, lo double")
    return _candidates(base, name=F.col("n"), sql=F.col("q"), equals=F.col("eq"), expect_min=F.col("lo"),
                       kind=F.lit("sql"), severity=F.lit("required"), ord=F.col("i") - 1000)


def nonempty_checks(profile: DataFrame, cap: int | None = None) -> DataFrame:
    """Non-empty tables, at most ``cap`` if given, in catalog order; each check reads a single row."""
    first = profile.filter("rows > 0")
    first = first if cap is None else first.orderBy("ord").limit(cap)
    return _candidates(
        first, name=_name_of("nonempty"), expect_min=F.lit(1.0), kind=F.lit("sql"), severity=F.lit("advisory"),
        sql=F.concat(F.lit("SELECT count(*) FROM (SELECT 1 FROM "), _table_sql(), F.lit(" LIMIT 1) x")),
        ord=F.col("ord"))


def row_floor_checks(profile: DataFrame) -> DataFrame:
    """The observed row count as a floor, for every non-empty table."""
    return _candidates(
        profile.filter("rows > 0"), name=F.concat(sanitize("name"), F.lit("_min_rows")), kind=F.lit("sql"),
        sql=F.concat(F.lit("SELECT count(*) FROM "), _table_sql()), expect_min=F.col("rows").cast("double"),
        severity=F.lit("advisory"), ord=F.col("ord") * 2, cap_group=F.lit("table"), subject=F.col("name"),
        weight=F.col("rows"))


def freshness_checks(profile: DataFrame, grouped: bool = True) -> DataFrame:
    """Newest value at most 5 times its observed age old, and never less than a day."""
    base = profile.filter("time_column IS NOT NULL" + (" AND rows > 0" if grouped else ""))
    column = F.concat(F.lit("`"), F.replace("time_column", F.lit("`"), F.lit("``")), F.lit("`"))
    name = F.concat(sanitize("name"), F.lit("_fresh")) if grouped else _name_of("fresh")
    return _candidates(
        base, name=name, kind=F.lit("sql"), severity=F.lit("advisory"), max_age_s=F.col("max_age_s"),
        sql=F.concat(F.lit("SELECT max("), column, F.lit(") FROM "), _table_sql()),
        ord=F.col("ord") * 2 + 1 if grouped else F.col("ord") + 100_000,
        cap_group=F.lit("table" if grouped else None), subject=F.col("name") if grouped else F.lit(None),
        weight=F.col("rows") if grouped else F.lit(None))


def partition_floor_checks(df: DataFrame, table: str, time_col: str, grain: str = "day", as_of=None) -> DataFrame:
    """Checks for a table partitioned by time: still partitioned (by what the snapshot says of itself), at least
    the observed number of chunks (left out when there are none), and fresh."""
    chunk = F.date_trunc(grain, F.col(quote_ident(time_col)))
    seen = df.groupBy(chunk.alias("chunk")).agg(F.max(epoch(quote_ident(time_col))).alias("newest")).agg(
        F.count("chunk").alias("chunks"), F.max("newest").alias("newest"))
    schema, name = split_name(table)
    source = F.lit(_qualified(table))
    chunk_sql = F.concat(F.lit(f"SELECT count(DISTINCT date_trunc('{grain}', {quote_ident(time_col)})) FROM "), source)
    rows = seen.select("chunks", "newest", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("i"))
    rows = rows.filter((F.col("i") != 1) | (F.col("chunks") > 0))
    pick = lambda a, b, c: F.when(F.col("i") == 0, a).when(F.col("i") == 1, b).otherwise(c)
    named = lambda suffix: check_name(F.lit(schema), F.lit(name), suffix)
    return _candidates(
        rows, name=pick(named("is_partitioned"), named("chunks"), named("fresh")), kind=F.lit("sql"),
        severity=F.lit("advisory"), ord=F.col("i"),
        sql=pick(F.lit(f"SELECT count(*) > 0 FROM {PARTITIONS_VIEW} WHERE table_name = {quote_literal(table)}"), chunk_sql,
                 F.concat(F.lit(f"SELECT max({quote_ident(time_col)}) FROM "), source)),
        bool=pick(F.lit(True), F.lit(None), F.lit(None)),
        expect_min=pick(F.lit(None), F.col("chunks").cast("double"), F.lit(None)),
        max_age_s=pick(F.lit(None), F.lit(None), freshness_threshold(_age(F.col("newest"), as_of))))


def component_checks(installed: DataFrame, required: DataFrame) -> DataFrame:
    """A ``<x>_loaded`` check for every known required component that is installed (column ``component``)."""
    hit = installed.select("component").distinct().join(required.select("component").distinct(), "component", "left_semi")
    escaped = F.replace(F.replace("component", F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    sql = F.concat(F.lit(f"SELECT count(*) > 0 FROM {COMPONENTS_VIEW} WHERE component = '"), escaped, F.lit("'"))
    return _candidates(hit, name=F.concat(sanitize("component"), F.lit("_loaded")), sql=sql, bool=F.lit(True),
                       kind=F.lit("sql"), severity=F.lit("advisory"), subject=F.col("component"))


# -- files ---------------------------------------------------------------------------------------

def anchor_checks(files: DataFrame, n: int = MAX_ANCHORS) -> DataFrame:
    """The first ``n`` lasting top-level files in byte order must exist."""
    is_dir = F.col("is_dir") if "is_dir" in files.columns else F.lit(False)
    top = files.filter(~F.contains("path", F.lit("/")) & ~is_dir & ~is_temp_name("path"))
    first = top.select("path").distinct().orderBy("path").limit(n)
    return _candidates(first, name=F.concat(F.lit("anchor_"), sanitize("path", "entry"), F.lit("_exists")),
                       kind=F.lit("file_exists"), path=F.col("path"), bool=F.lit(True), severity=F.lit("advisory"),
                       cap_group=F.lit("anchor"), subject=F.col("path"), weight=F.lit(0))


def directory_floor_checks(files: DataFrame, dialect: str = "path") -> DataFrame:
    """Per lasting top-level directory, the observed number of matches of ``d/*`` as a floor."""
    is_dir = F.col("is_dir") if "is_dir" in files.columns else F.lit(False)
    segments = F.split("path", "/")
    inside = files.filter((F.size(segments) > 1) if dialect == "find" else ((F.size(segments) == 2) & ~is_dir))
    dirs = inside.groupBy(F.element_at(segments, 1).alias("dir")).agg(F.count(F.lit(1)).alias("n"))
    return _candidates(
        dirs.filter(~is_temp_name("dir")), kind=F.lit("file_count"), severity=F.lit("advisory"),
        name=F.concat(F.lit("dir_"), sanitize("dir", "entry"), F.lit("_files")),
        path=F.concat("dir", F.lit("/*")), dialect=F.lit(dialect), expect_min=F.col("n").cast("double"),
        cap_group=F.lit("dir"), subject=F.col("dir"), weight=F.col("n"))


def discover_files(files: DataFrame, dialect: str = "path") -> DataFrame:
    """Root not empty (required), anchors and directory floors."""
    spark = files.sparkSession
    root = skeleton_checks(spark, "files").withColumn("name", F.lit("restore_root_nonempty"))
    return root.unionByName(anchor_checks(files)).unionByName(directory_floor_checks(files, dialect))


def skeleton_checks(spark: SparkSession, kind: str = "sql") -> DataFrame:
    """The starter checks of a unit that was not profiled: structural only."""
    if kind == "sql":
        empty = spark.createDataFrame([], "ord int, schema string, name string, rows bigint")
        return structural_checks(empty)
    one = spark.range(1)
    return _candidates(one, name=F.lit("restore_not_empty"), kind=F.lit("file_count"), path=F.lit("*"),
                       expect_min=F.lit(1.0), severity=F.lit("required"), ord=F.lit(-1000))


def skeletons(units: DataFrame, kind: str = "sql") -> DataFrame:
    """unit, file_name and the starter checks of every unit (column ``unit``)."""
    starters = skeleton_checks(units.sparkSession, kind)
    made = F.array(*[F.struct(*[F.lit(r[f]).cast(t).alias(f) for f, t in
                                (("name", "string"), ("kind", "string"), ("sql", "string"), ("path", "string"),
                                 ("expect_min", "double"), ("equals", "string"), ("severity", "string"))])
                     for r in starters.collect()])  # two or three rows
    return units.select("unit", skeleton_file_name("unit").alias("file_name"), F.explode(made).alias("c")).select(
        "unit", "file_name", "c.*")


# -- cap, verify, scaffold -------------------------------------------------------------------------

def cap_candidates(candidates: DataFrame, n: int | None = None) -> DataFrame:
    """Keep, per group, the ``n`` heaviest subjects with all their candidates; ungrouped ones always stay.

    Ties go to the subject that appeared first; a null subject is one of its own. ``truncated`` tells
    whether anything was dropped. Without ``n`` nothing is.
    """
    if n is None:
        return candidates.withColumn("truncated", F.lit(False))
    columns = candidates.columns
    candidates = candidates.withColumns({"_subject": F.col("subject"), "subject": F.to_json(F.struct("subject"))})
    grouped = F.coalesce(F.col("cap_group"), F.lit("")) != ""
    subjects = candidates.filter(grouped).groupBy("cap_group", "subject").agg(
        F.max("weight").alias("w"), F.min("ord").alias("first"))
    rank = F.row_number().over(Window.partitionBy("cap_group").orderBy(F.desc("w"), "first", "subject"))
    kept = subjects.withColumn("r", rank).filter(F.col("r") <= n).select("cap_group", "subject")
    sizes = subjects.groupBy("cap_group").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.max(F.col("n") > n), F.lit(False)).alias("truncated"))
    survivors = candidates.filter(~grouped).unionByName(
        candidates.filter(grouped).join(kept, ["cap_group", "subject"], "left_semi").select(*candidates.columns))
    return survivors.withColumn("subject", F.col("_subject")).select(*columns, F.lit(bool(sizes.first()["truncated"])).alias("truncated"))


def verify_candidates(spark: SparkSession, candidates: DataFrame, snapshot: Snapshot, as_of=None) -> DataFrame:
    """Run every candidate and keep those that execute and pass."""
    passed = run_checks(spark, candidates.select(*CHECK_FIELDS), snapshot, as_of).filter("ok").select("check_id")
    return candidates.join(broadcast_if_small(passed), "check_id", "left_semi")


def _numbered(candidates: DataFrame) -> DataFrame:
    """Give candidates an id from group, subject and name, which is unique per proposal."""
    key = F.concat_ws("/", F.coalesce("cap_group", F.lit("")), F.coalesce("subject", F.lit("")), F.col("name"))
    return candidates.withColumn("check_id", key)


def scaffold(spark: SparkSession, snapshot: Snapshot, flavor: str = "postgres", cap: int | None = None, as_of=None,
             allow_ntz: bool = True) -> DataFrame:
    """Profile, propose, cap and verify: the checks that hold on this snapshot, with a ``truncated`` note.

    ``postgres``: presence, non-empty tables, freshness by the ``single`` rule, partitions and components. ``mysql``: presence, row
    floors and freshness by the ``prefer_updated`` rule.
    """
    rule = "single" if flavor == "postgres" else "prefer_updated"
    profile = hold(profile_tables(spark, snapshot, rule, as_of, allow_ntz))  # one row per table
    if flavor == "postgres":
        stored = F.concat_ws(".", F.nullif("schema", F.lit("")), "name").isin(list(snapshot.partitions))  # partitions propose it below
        proposed = [structural_checks(profile), nonempty_checks(profile), freshness_checks(profile.filter(~stored), grouped=False)]
    else:
        proposed = [structural_checks(profile, "mysql"), row_floor_checks(profile), freshness_checks(profile)]
    if flavor == "postgres":
        for i, (table, column) in enumerate(sorted(snapshot.partitions.items())):
            floors = partition_floor_checks(snapshot.tables[table], table, column, as_of=as_of)
            proposed.append(floors.withColumns({"ord": F.col("ord") + F.lit(200_000 + 10 * i), "subject": F.lit(f"{table} partitions")}))
        named = lambda xs: spark.createDataFrame([(x,) for x in xs], "component string")
        proposed.append(component_checks(named(snapshot.components), named(PRELOAD_COMPONENTS)).withColumn("ord", F.lit(300_000)))
    if snapshot.files is not None:
        proposed.append(discover_files(snapshot.files).withColumn("ord", F.coalesce("ord", F.lit(1_000_000))))
    candidates = hold(_numbered(reduce(DataFrame.unionByName, proposed)))
    capped = cap_candidates(candidates, cap)
    return verify_candidates(spark, capped, snapshot, as_of).orderBy("ord", "name")


def environment_mismatch(required: DataFrame, provided: DataFrame) -> DataFrame:
    """What units need and their target does not offer: unit, message.

    ``required``: unit, version, library (null for none). ``provided``: unit, version, library.
    """
    need_v = required.select("unit", "version").distinct()
    have_v = provided.select("unit", F.col("version").alias("have")).distinct()
    versions = need_v.join(have_v, "unit", "left").filter(~F.col("version").eqNullSafe(F.col("have"))).select(
        "unit", F.concat(F.lit("needs major version "), "version", F.lit(", target provides "),
                         blank_to("have", "none")).alias("message"))
    need_l = required.filter("library IS NOT NULL").select("unit", "library").distinct()
    have_l = provided.filter("library IS NOT NULL").select("unit", "library").distinct()
    libraries = need_l.join(have_l, ["unit", "library"], "left_anti").select(
        "unit", F.concat(F.lit("needs library "), "library", F.lit(", target does not provide it")).alias("message"))
    return versions.unionByName(libraries)
