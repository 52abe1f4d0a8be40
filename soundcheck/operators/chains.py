"""Backup chains, fleets and points in time."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from soundcheck.functions.scalars import duration_text, epoch, instant
from soundcheck.operators.checks import FUSED, default_checks, results, run_checks
from soundcheck.operators.expect import evaluate_expectations
from soundcheck.operators.registry import Snapshot
from soundcheck.operators.verdict import failing
from soundcheck.plans.ordered import last_known, over_groups, row_number
from soundcheck.plans.sizing import batches, hold
from soundcheck.schemas import CHECK_FIELDS, RESULT_FIELDS, RESULTS

TOP_K = 1000  # up to here Spark prunes a row_number filter before the shuffle


def _newest_first() -> list[Column]:
    return [F.col("ts").desc(), F.col("ord").asc()]


def chain(backups: DataFrame, unit: str | None = None, **plan) -> DataFrame:
    """Backups with ``rn``: newest first per unit, ties in input order.

    For a single ``unit`` that does not occur the result is one row with an ``error``.
    """
    if unit is None:
        return over_groups(backups, ["unit"], _newest_first(), [row_number("rn")], **plan)
    ranked = over_groups(backups.filter(F.col("unit") == unit), ["unit"], _newest_first(), [row_number("rn")], **plan)
    asked = backups.sparkSession.createDataFrame([(unit,)], "unit string")
    return asked.join(ranked, "unit", "left").withColumn("error", F.when(
        F.col("rn").isNull(), F.concat(F.lit('stanza "'), "unit", F.lit('" not found'))))


def last_good(backups: DataFrame, max_try: int = 0, **plan) -> DataFrame:
    """The walk from the newest backup to the first that passes: the tested rows, ``rn`` and
    ``is_recovery_point``. ``max_try`` bounds the walk (0: no bound).

    The newest pass of each unit is an aggregate, combined map-side; only tested rows are ranked.
    """
    if 0 < max_try <= TOP_K:
        w = Window.partitionBy("unit").orderBy(*_newest_first())
        backups = backups.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max_try).drop("_r")
    elif max_try > 0:
        backups = chain(backups, **plan).filter(F.col("rn") <= max_try).drop("rn")
    place = lambda: F.struct(F.col("ts").alias("ts"), (-F.col("ord")).alias("neg_ord"))
    good = backups.filter(F.col("verdict") == "pass").groupBy("unit").agg(F.max(place()).alias("_good"))
    tested = backups.join(good, "unit", "left").filter(F.col("_good").isNull() | (place() >= F.col("_good")))
    tested = tested.withColumn("is_recovery_point", F.coalesce(place() == F.col("_good"), F.lit(False))).drop("_good")
    return over_groups(tested, ["unit"], _newest_first(), [row_number("rn")], **plan)


def last_good_search(spark: SparkSession, ranked: DataFrame, check_fn: Callable[[str], str], max_try: int = 0,
                     parallel: int = 1) -> DataFrame:
    """Test one chain lazily, newest first, so that old snapshots are not read once one passes.

    ``check_fn(label)`` returns a reason, blank for a pass. ``parallel`` candidates are tested at a
    time; only the chain's labels reach the driver, and only as far as the walk goes.
    """
    tested, found = [], False
    walk = ranked.orderBy("rn") if max_try <= 0 else ranked.orderBy("rn").limit(max_try)
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        for group in batches(walk.select("rn", "label"), parallel, ordered=True):
            for row, reason in zip(group, pool.map(lambda r: check_fn(r["label"]), group)):
                if found:
                    break
                found = reason == ""
                tested.append((row["rn"], row["label"], "pass" if found else "fail", reason or None, found))
            if found:
                break
    return spark.createDataFrame(tested, "rn bigint, label string, verdict string, reason string, "
                                         "is_recovery_point boolean")


def snapshot_results(snapshots: DataFrame, checks: DataFrame, by: Sequence[str] = ("snapshot_id",), as_of=None,
                     ) -> DataFrame:
    """Evaluate aggregate checks for every snapshot in one pass.

    ``sql`` of a check is an aggregate expression such as ``count_if(price < 0)``. One that does not
    analyse is an error row for every snapshot. Without checks there are no rows.
    """
    by, out = list(by), None
    for batch in batches(checks.select(*CHECK_FIELDS), FUSED):
        wrong, aggs = [], []
        for i, c in enumerate(batch):
            try:
                expression = F.expr(c["sql"] or "").cast("string").alias(f"a{i}")
                snapshots.groupBy(*by).agg(expression)  # analyses only
                wrong.append(None)
            except Exception as error:  # noqa: BLE001 - any failure of a check is its result
                expression = F.max(F.lit(None).cast("string")).alias(f"a{i}")
                wrong.append(str(error).strip())
            aggs.append(expression)
        fields = ("check_id", "ord", "name", "severity", "expect_min", "expect_max", "equals", "max_age_s", "bool")
        kinds = {"ord": "int", "expect_min": "double", "expect_max": "double", "max_age_s": "bigint", "bool": "boolean"}
        stacked = snapshots.groupBy(*by).agg(*aggs).select(*by, F.explode(F.array(*[
            F.struct(*[F.lit(c[f]).cast(kinds.get(f, "string")).alias(f) for f in fields],
                     F.coalesce(F.col(f"a{i}"), F.lit("")).alias("got"), F.lit(wrong[i]).cast("string").alias("error"))
            for i, c in enumerate(batch)])).alias("s"))
        part = evaluate_expectations(stacked.select(*by, "s.*"), as_of)
        out = part if out is None else out.unionByName(part)
    return out


def snapshot_verdicts(snapshots: DataFrame, checks: DataFrame, by: Sequence[str] = ("snapshot_id",), as_of=None,
                      ) -> DataFrame:
    """One verdict per snapshot of a chain, all snapshots in one job. A snapshot without checks passes."""
    found = snapshot_results(snapshots, checks, by, as_of)
    if found is None:
        judged = snapshots.select(*by).distinct().withColumns({"checks": F.lit(0).cast("bigint"), "failed_required": F.lit(0).cast("bigint")})
    else:
        judged = found.groupBy(*by).agg(F.count(F.lit(1)).alias("checks"), F.count_if(failing()).alias("failed_required"))
    return judged.withColumn("verdict", F.when(F.col("failed_required") > 0, F.lit("fail")).otherwise(F.lit("pass")))


def run_every(spark: SparkSession, checks: DataFrame, members: Mapping[str, Callable[[], Snapshot]], as_of=None,
              unit_col: str = "snapshot_id", together: int = 4) -> DataFrame:
    """``run_checks`` for every member of a chain: ``unit_col`` and the columns of a result, for checks of any kind.

    ``members`` opens each label's snapshot when its turn comes, so a member's own files are all that is read for it;
    ``together`` members run side by side, each in a session that holds nothing else. A member that cannot be opened
    fails every check. Without checks or members there are no rows.
    """
    checks = hold(checks)

    def one(label: str) -> DataFrame:
        try:
            found = run_checks(spark, checks, members[label](), as_of)
        except Exception as error:  # noqa: BLE001 - a snapshot that cannot be read is a failing one
            found = results(default_checks(checks).withColumns({"ok": F.lit(False), "got": F.lit(""), "error": F.lit(f"snapshot not readable: {error}".strip())}))
        return found.select(F.lit(label).alias(unit_col), *RESULT_FIELDS)

    with ThreadPoolExecutor(together) as pool:
        parts = list(pool.map(one, members))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"{unit_col} string, {RESULTS}")


def verdict_of_every(found: DataFrame, unit_col: str = "snapshot_id") -> DataFrame:
    """One verdict per member with results of ``run_every``, as ``snapshot_verdicts`` gives it."""
    judged = found.groupBy(unit_col).agg(F.count(F.lit(1)).alias("checks"), F.count_if(failing()).alias("failed_required"))
    return judged.withColumn("verdict", F.when(F.col("failed_required") > 0, F.lit("fail")).otherwise(F.lit("pass")))


def recovery_age(last_good_df: DataFrame, as_of=None) -> DataFrame:
    """Age of every unit's recovery point, rounded to the minute."""
    seconds = (F.unix_micros(instant(as_of)) - F.unix_micros(F.col("ts").cast("timestamp"))) / F.lit(1_000_000)
    return last_good_df.filter("is_recovery_point").select(
        "unit", "label", (F.round(seconds / 60) * 60).cast("bigint").alias("age_s")).withColumn(
        "age", duration_text(F.col("age_s")))


def unit_status(code: Column, message: Column) -> Column:
    """The message if there is one, else ``ok`` for code 0, else ``status N``."""
    return F.when(F.coalesce(message, F.lit("")) != "", message).when(F.coalesce(code, F.lit(0)) == 0, F.lit("ok")).otherwise(
        F.concat(F.lit("status "), code.cast("string")))


def repository_status(exit_code: Column, reason: Column, backups: Column) -> Column:
    """A file repository: the failure reason, ``empty``, or ``ok``."""
    return F.when(exit_code != 0, reason).when(F.coalesce(backups, F.lit(0)) == 0, F.lit("empty")).otherwise(F.lit("ok"))


def repository_name(location: Column, target: Column) -> Column:
    """Location, else target name, else ``repository``; never a value that was passed as a secret."""
    known = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    return F.coalesce(known(location), known(target), F.lit("repository"))


def fleet(units: DataFrame, backups: DataFrame) -> DataFrame:
    """Per unit: status, number of backups, newest label and time. Metadata only; units without
    backups stay."""
    newest = F.struct(F.col("ts").alias("ts"), (-F.col("ord")).alias("neg_ord"), F.col("label").alias("label"))
    known = backups.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.max(newest).alias("m"))
    return units.join(known, "unit", "left").select(
        "unit", unit_status(F.col("status_code"), F.col("status_message")).alias("status"),
        F.coalesce("n", F.lit(0)).alias("backup_count"), F.col("m.label").alias("newest_label"),
        F.col("m.ts").alias("newest_backup"))


def fleet_degraded(fleet_df: DataFrame) -> DataFrame:
    """One row: degraded when there are no units, a status is not ok, or a unit has no backup."""
    return fleet_df.agg(F.coalesce(
        F.bool_or((F.col("status") != "ok") | (F.col("backup_count") == 0)), F.lit(True)).alias("degraded"))


def asof_recovery_point(targets: DataFrame, backups: DataFrame, carry: Sequence[str] = (), **plan) -> DataFrame:
    """For each requested time the newest backup at or before it: label, time and gap in seconds; or null.

    ``targets``: unit, target_id, target_ts. Both sides are put in one order, so no range join is needed.
    ``carry`` names further columns of the backup to return.
    """
    hit = F.struct(F.col("label").alias("label"), F.col("ts").alias("ts"), *carry)
    b = backups.select("unit", F.col("ts").alias("_at"), F.lit(0).alias("_side"), (-F.col("ord")).alias("_tie"),
                       F.lit(None).cast("string").alias("target_id"), hit.alias("_hit"))
    t = targets.select("unit", F.col("target_ts").alias("_at"), F.lit(1).alias("_side"),
                       F.xxhash64("target_id").alias("_tie"), F.col("target_id").cast("string").alias("target_id"),
                       F.lit(None).cast(b.schema["_hit"].dataType).alias("_hit"))
    order = [F.col(c).asc() for c in ("_at", "_side", "_tie", "target_id")]
    seen = over_groups(b.unionByName(t), ["unit"], order, [last_known("_point", F.col("_hit"))], **plan)
    return seen.filter("_side = 1").select(
        "unit", "target_id", F.col("_at").alias("target_ts"), F.col("_point.label").alias("label"),
        F.col("_point.ts").alias("backup_ts"), (epoch("_at") - epoch(F.col("_point.ts"))).alias("gap_s"),
        *[F.col(f"_point.{c}").alias(c) for c in carry])


def pitr_assert(df: DataFrame, ts_col: str, target) -> DataFrame:
    """Rows written after the recovery target must be absent; the achieved point is the newest time."""
    late = F.count_if(F.col(ts_col).cast("timestamp") > instant(target))
    return df.agg(late.alias("rows_after"), F.max(epoch(ts_col)).alias("achieved_epoch")).select(
        "rows_after", "achieved_epoch", (F.col("rows_after") == 0).alias("ok"))


def recovery_targets(backups: DataFrame, n: int) -> DataFrame:
    """``n`` evenly spaced targets per unit from its oldest to its newest backup, both included."""
    window = backups.groupBy("unit").agg(F.min(epoch("ts")).alias("lo"), F.max(epoch("ts")).alias("hi"))
    steps = F.sequence(F.lit(0), F.lit(max(n - 1, 0)))
    return window.select("unit", "lo", "hi", F.explode(steps).alias("i")).select(
        "unit", F.col("i").cast("string").alias("target_id"),
        F.timestamp_seconds(F.col("lo") + F.floor((F.col("hi") - F.col("lo")) * F.col("i") / max(n - 1, 1))).alias("target_ts"))


def recovery_coverage(backups: DataFrame, n: int, **plan) -> DataFrame:
    """Per unit: sampled targets, how many fall on a backup that passes, and their share."""
    stamped = backups.withColumn("ts", F.col("ts").cast("timestamp"))
    points = asof_recovery_point(recovery_targets(stamped, n), stamped, ["verdict"], **plan)
    return points.groupBy("unit").agg(
        F.count(F.lit(1)).alias("targets"), F.count_if(F.col("verdict") == "pass").alias("covered"),
    ).withColumn("coverage", F.col("covered") / F.col("targets"))
