"""Cadence monitors and the routing of their alerts. Output is a table; nothing is sent."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from soundcheck.functions.scalars import duration_text
from soundcheck.plans.ordered import lag, over_groups
from soundcheck.plans.sizing import broadcast_if_small
from soundcheck.session import materialise
from soundcheck.schemas import SCHEMA_VERSION

# Fixed values.
PAYLOAD_NOTICE = "No passing attestation was received in time; this does not say that the backup failed."
MIN_GAP_S = 900
RATE_LIMIT = 60
RATE_WINDOW_S = 3600

DAMP_BLOCK_S = 86400  # seconds of a destination that one task folds


def overdue(monitors: DataFrame, ledger: DataFrame, as_of_epoch: int) -> DataFrame:
    """Monitors with ``freshest``, ``overdue`` and the shown ``status``: ok, overdue, or never (no entry yet).

    Overdue when the silence since the newest entry (or, without one, since the monitor was created) is
    longer than interval plus grace.
    """
    newest = ledger.groupBy("tenant_id", "target").agg(F.max("created_at").alias("freshest"))
    met = monitors.join(newest, ["tenant_id", "target"], "left")
    silence = F.lit(as_of_epoch) - F.coalesce("freshest", "created_at")
    late = silence > F.col("interval_s") + F.col("grace_s")
    return met.withColumns({
        "overdue": late,
        "status": F.when(F.col("freshest").isNull(), F.lit("never")).when(late, F.lit("overdue")).otherwise(F.lit("ok"))})


def transitions(evaluated: DataFrame, as_of_epoch: int) -> DataFrame:
    """Monitors whose alert state changes now, with the new state; silent while nothing changes."""
    new = F.when(F.col("overdue"), F.lit("alerting")).otherwise(F.lit("ok"))
    known = F.coalesce(F.nullif("alert_state", F.lit("")), F.lit("ok"))  # a monitor that was never judged counts as ok
    changed = evaluated.withColumn("new_state", new).filter(known != F.col("new_state"))
    return changed.withColumns({
        "event": F.when(F.col("overdue"), F.lit("overdue")).otherwise(F.lit("recovered")),
        "alert_state": F.col("new_state"), "last_alert_at": F.lit(as_of_epoch).cast("bigint")}).drop("new_state")


def transitions_over_time(evaluations: DataFrame, **plan) -> DataFrame:
    """Rows of a history of evaluations (monitor_id, at_s, overdue) where the state changes; it starts as ok."""
    before = over_groups(evaluations, ["monitor_id"], [F.col("at_s").asc(), F.col("overdue").asc()], [lag("_before", F.col("overdue"))], **plan)
    changed = F.col("overdue") != F.coalesce("_before", F.lit(False))
    return before.filter(changed).select(
        "monitor_id", "at_s", F.when(F.col("overdue"), F.lit("overdue")).otherwise(F.lit("recovered")).alias("event"))


def idempotency_key(monitor_id="monitor_id", state="event", freshest="freshest") -> Column:
    """A stable key of (monitor, transition, freshest entry)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.sha2(F.concat_ws("\n", text(monitor_id), text(state), text(freshest)).cast("binary"), 256)


def alert_payloads(changed: DataFrame) -> DataFrame:
    """Transitions with ``idempotency_key`` and a versioned JSON ``payload``."""
    body = F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"), "monitor_id", "target", F.col("event").alias("state"),
        F.col("interval_s").alias("interval_seconds"), F.col("grace_s").alias("grace_seconds"),
        F.col("freshest").alias("freshest_attestation_at"), F.lit(PAYLOAD_NOTICE).alias("notice"))
    return changed.withColumns({"idempotency_key": idempotency_key(),
                                "payload": F.to_json(body, {"ignoreNullFields": "false"})})


def dedupe_deliveries(deliveries: DataFrame, order: str = "at_s") -> DataFrame:
    """The first delivery per destination and key; copies are combined map-side."""
    rest = [c for c in deliveries.columns if c not in ("destination", "idempotency_key")]
    first = F.min_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order]))
    return deliveries.groupBy("destination", "idempotency_key").agg(first.alias("d")).select(
        "destination", "idempotency_key", *[F.col(f"d.{c}").alias(c) for c in rest])


def damp_flaps(deliveries: DataFrame, min_gap_s: int = MIN_GAP_S, id_col: str = "id", block_s: int = DAMP_BLOCK_S) -> DataFrame:
    """Add ``sent``: false when closer than ``min_gap_s`` to the last delivery *sent* to the destination.

    ``at_s`` is in whole seconds; of one second, the smallest id is sent (null only where there is no other), with its copies. A null
    destination is a destination. A delivery without a time is sent and holds back no other.

    Whether a second is sent depends on those sent before it. Blocks of ``block_s`` seconds are folded side by
    side all the same: a block is entered with the time from which sending is allowed again, and there are at
    most ``min_gap_s`` such times that matter, so it is a map from that time to the one it hands on. The maps are
    applied in order, one row per block; then every block marks what it sends.
    """
    if min_gap_s <= 0:
        return deliveries.withColumn("sent", F.lit(True))
    block_s = max(block_s, min_gap_s)
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"))
    seconds = materialise(deliveries.where("at_s IS NOT NULL").groupBy("destination", F.col("at_s").cast("long").alias("at_s")).agg(
        F.min(key)["id"].alias("_first")).withColumn("_block", F.floor(F.col("at_s") / F.lit(block_s)).cast("long")), "seconds")

    def to_map(pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.sort(pdf["at_s"].to_numpy())
        last = np.arange(len(at))
        after = np.searchsorted(at, at + min_gap_s)
        step = np.where(after < len(at), after, last)
        while (step != step[step]).any():
            step = step[step]  # twice as many sent ones on
        n = np.searchsorted(at, pdf["_block"].iloc[0] * block_s + min_gap_s) + 1  # sending is allowed again by then
        return pd.DataFrame({"destination": pdf["destination"].iloc[:1], "_block": pdf["_block"].iloc[:1],
                             "_at": [at[:n].tolist()], "_out": [(at[step] + min_gap_s)[:n].tolist()]})

    def enter(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, allowed, entered = pdf.sort_values("_block"), None, []
        for at, out in zip(pdf["_at"], pdf["_out"]):
            entered.append(allowed if allowed is not None else int(at[0]))
            i = int(np.searchsorted(at, entered[-1]))
            allowed = int(out[i]) if i < len(at) else entered[-1]
        return pd.DataFrame({"destination": pdf["destination"], "_block": pdf["_block"], "_from": entered})

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at_s")
        at, sent = pdf["at_s"].to_numpy(), []
        i = int(np.searchsorted(at, pdf["_from"].iloc[0]))
        while i < len(at):
            sent.append(i)
            i = int(np.searchsorted(at, at[i] + min_gap_s))
        return pdf.iloc[sent][["destination", "at_s", "_first"]]

    kind = deliveries.schema["destination"].dataType.simpleString()
    maps = seconds.groupBy("destination", "_block").applyInPandas(to_map, f"destination {kind}, _block long, _at array<long>, _out array<long>")
    entered = maps.groupBy("destination").applyInPandas(enter, f"destination {kind}, _block long, _from long")
    known = entered.select(F.col("destination").alias("_d"), F.col("_block").alias("_b"), "_from")
    met = seconds.join(known, F.col("destination").eqNullSafe(F.col("_d")) & (F.col("_block") == F.col("_b"))).drop("_d", "_b")
    hit = met.groupBy("destination", "_block").applyInPandas(mark, seconds.drop("_block").schema).select(
        F.col("destination").alias("_d"), F.col("at_s").alias("_s"), "_first", F.lit(True).alias("_sent"))
    # ``hit`` has one row per destination and second.
    same = F.col("destination").eqNullSafe(F.col("_d")) & (F.col("at_s") == F.col("_s")) & F.col(id_col).eqNullSafe(F.col("_first"))
    return deliveries.join(hit, same, "left").withColumn(
        "sent", F.col("at_s").isNull() | F.coalesce("_sent", F.lit(False))).drop("_d", "_s", "_first", "_sent")


def rate_limit(deliveries: DataFrame, n: int = RATE_LIMIT, window_s: int = RATE_WINDOW_S) -> DataFrame:
    """Add ``in_window`` (deliveries of the tenant to the destination in the last ``window_s`` seconds, this
    second included) and ``allowed``. A delivery without tenant, destination or time is in no window and allowed.

    Deliveries are counted per second first. A window reaches back into the block before at most, so each
    count is handed to its own block and to the next; a block group has at most 2 x ``window_s`` rows.
    """
    key = ["tenant_id", "destination"]
    seconds = deliveries.groupBy(*key, "at_s").agg(F.count(F.lit(1)).alias("n"))
    own = F.floor(F.col("at_s") / window_s)
    spread = seconds.withColumn("_own", own).withColumn("_block", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    w = Window.partitionBy(*key, "_block").orderBy("at_s").rangeBetween(-window_s, 0)
    counted = spread.withColumn("in_window", F.sum("n").over(w)).filter("_own = _block").select(*key, "at_s", "in_window")
    return deliveries.join(counted, [*key, "at_s"], "left").withColumn("allowed", F.coalesce(F.col("in_window") <= n, F.lit(True)))


def shape_slack(changed: DataFrame, as_of_epoch: int) -> DataFrame:
    """A Slack message per transition, derived from the same fields as the payload."""
    late = F.lit(as_of_epoch) - F.coalesce("freshest", "created_at")
    text = F.when(F.col("alert_state") == "alerting", F.concat(
        F.lit("OVERDUE: no passing attestation for "), "target", F.lit(" in "), duration_text(late))).otherwise(
        F.concat(F.lit("RECOVERED: a fresh attestation for "), "target", F.lit(" arrived")))
    block = F.struct(F.lit("section").alias("type"),
                     F.struct(F.lit("mrkdwn").alias("type"), text.alias("text")).alias("text"))
    return changed.select("monitor_id", "target", F.to_json(F.struct(text.alias("text"), F.array(block).alias("blocks"))).alias("message"))


def shape_pagerduty(changed: DataFrame) -> DataFrame:
    """A trigger or a resolve per transition, tied together by a key made from the monitor."""
    action = F.when(F.col("alert_state") == "alerting", F.lit("trigger")).otherwise(F.lit("resolve"))
    summary = F.concat(F.lit("No passing attestation received for "), "target")
    event = F.struct(
        action.alias("event_action"), F.concat(F.lit("monitor-"), "monitor_id").alias("dedup_key"),
        F.struct(summary.alias("summary"), F.col("target").alias("source"), F.lit("error").alias("severity")).alias("payload"))
    return changed.select("monitor_id", action.alias("event_action"),
                          F.concat(F.lit("monitor-"), "monitor_id").alias("dedup_key"), F.to_json(event).alias("message"))


def route_hooks(runs: DataFrame, hooks: DataFrame) -> DataFrame:
    """Which hook a finished run fires: run_id, target, hook, state (fire or skipped).

    ``runs``: run_id, target, verdict, operational_error, rendered. ``hooks``: target, on_fail, on_success.
    A blank hook gives no row; a run whose report was not rendered is skipped.
    """
    met = runs.join(broadcast_if_small(hooks), "target")
    failed = (F.coalesce("operational_error", F.lit("")) != "") | (F.coalesce("verdict", F.lit("")) != "pass")
    hook = F.when(failed, F.col("on_fail")).otherwise(F.col("on_success"))
    state = F.when(F.coalesce("rendered", F.lit(False)), F.lit("fire")).otherwise(F.lit("skipped"))
    return met.withColumns({"hook": hook, "state": state}).filter(F.coalesce("hook", F.lit("")) != "").select(
        "run_id", "target", "hook", "state")


def validate_hooks(hooks: DataFrame, col: str = "hook") -> DataFrame:
    """Add ``violation`` (null when fine). Commands have no rules. A URL must parse, carry no user:pass@, and
    give every ``*_ref`` parameter as ``env:NAME``."""
    c = F.col(col)
    is_url = c.rlike(r"\Ahttps?://")
    authority = F.regexp_extract(c, r"\A[^:]+://([^/?#]*)", 1)
    query = F.regexp_extract(c, r"\A[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    name = lambda p: F.try_url_decode(F.substring_index(p, "=", 1))
    value = lambda p: F.try_url_decode(F.when(p.contains("="), F.regexp_replace(p, r"\A[^=]*=", "")).otherwise(F.lit("")))
    bad_query = F.exists(pairs, lambda p: p.contains(";") | name(p).isNull() | value(p).isNull())
    literal = F.filter(pairs, lambda p: name(p).endswith("_ref") & ~value(p).rlike(r"(?s)\Aenv:.+\z"))
    first = F.array_min(F.transform(literal, name))
    violation = (
        F.when(~is_url, F.lit(None))
        .when((authority == "") | c.rlike(r"[\x00-\x1f\x7f]") | F.regexp_replace(authority, r".*@", "").rlike(r"[ <>\"]"),
              F.lit("the URL cannot be parsed"))
        .when(F.contains(authority, F.lit("@")), F.lit("the URL holds a user or password"))
        .when(bad_query, F.lit("the query cannot be decoded"))
        .when(F.size(literal) > 0, F.concat(first, F.lit(" names no environment variable"))))
    return hooks.withColumn("violation", violation)


def hook_env_names(hooks: DataFrame, col: str = "hook") -> DataFrame:
    """Environment names that URL hooks refer to; they belong to the known secrets. Column: name."""
    query = F.regexp_extract(F.col(col), r"\Ahttps?://[^?#]*\?([^#]*)", 1)
    return hooks.select(F.explode(F.split(query, "&")).alias("p")).select(
        F.regexp_extract(F.try_url_decode("p"), r"(?s)\A[^=]*_ref=env:(.+)\z", 1).alias("name")).filter("name <> ''").distinct()
