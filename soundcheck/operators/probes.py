"""Checks over a file inventory and over captured responses and command output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from soundcheck.functions.globs import anchor, glob_regex, split_segments
from soundcheck.functions.jsonpath import json_path, split_path_value
from soundcheck.functions.scalars import number_text
from soundcheck.functions.text import first_line, quoted
from soundcheck.operators.checks import results
from soundcheck.operators.registry import Snapshot, register_check_kind
from soundcheck.plans.sizing import batches, broadcast_if_small

GLOB_BATCH = 10_000


def _mentioned(files: DataFrame, checks: DataFrame, *columns: str) -> DataFrame:
    """Inventory rows of the paths that some check names: the inventory itself is never shuffled
    while the list of paths is small."""
    wanted = broadcast_if_small(checks.select("path").distinct())
    return files.join(wanted, "path", "left_semi").groupBy("path").agg(
        *[F.min(c).alias(f"f_{c}") for c in columns], F.lit(True).alias("present"))


def file_exists_checks(checks: DataFrame, files: DataFrame) -> DataFrame:
    """Present (or, with bool false, absent) paths."""
    present = F.coalesce(F.col("present"), F.lit(False))
    want = F.coalesce(F.col("bool"), F.lit(True))
    found = checks.join(_mentioned(files, checks), "path", "left")
    return results(found.withColumns({
        "got": present.cast("string"), "ok": present == want,
        "detail": F.when(present != want, F.concat(
            F.lit("expected "), F.col("path"), F.when(want, F.lit(" to exist")).otherwise(F.lit(" to be absent"))))}))


def checksum_checks(checks: DataFrame, files: DataFrame) -> DataFrame:
    """SHA-256 of a file against the expected hex digest."""
    found = checks.join(_mentioned(files, checks, "sha256"), "path", "left")
    error = (F.when(F.col("equals").isNull(), F.lit("checksum check needs an expected sha256 in equals"))
             .when(F.col("present").isNull(), F.concat(F.lit("file not found: "), F.col("path")))
             .when(F.col("f_sha256").isNull(), F.concat(F.lit("no digest for "), F.col("path"))))
    ok = F.coalesce(F.col("f_sha256") == F.col("equals"), F.lit(False))
    return results(found.withColumns({
        "error": error, "got": F.when(error.isNull(), F.col("f_sha256")).otherwise(F.lit("")), "ok": ok & error.isNull(),
        "detail": F.when(error.isNull() & ~ok, F.concat(F.lit("want "), F.col("equals")))}))


def _trie(patterns: DataFrame) -> tuple[list[tuple], list[tuple]]:
    """(edges, ends) of the trie of all patterns' segments; definitions, so they are read on the driver.

    An edge leads from a node to a node for names that have ``text`` (as ``kind`` says) and match ``rx``. An end is a
    check whose pattern ends in a node. Patterns with the same first segments share those edges.
    """
    nodes: dict[tuple, int] = {}
    edges, ends = [], []
    for batch in batches(patterns.select("check_id", "path", "dialect"), GLOB_BATCH):
        for p in batch:
            dialect = p["dialect"] or "path"
            at, way = -1 if dialect == "path" else -2, (dialect,)
            for level, segment in enumerate(split_segments(p["path"], dialect)):
                way = (*way, segment)
                if way not in nodes:
                    nodes[way] = len(nodes)
                    kind, text = anchor(segment)
                    edges.append((level, at, nodes[way], kind, text, None if kind == "literal" else glob_regex(segment, dialect)))
                at = nodes[way]
            ends.append((p["check_id"], at))
    return edges, ends


def _texts(kind: Column, n: Column, name: Column) -> Column:
    """What a name could have in common with edges of this kind whose text has ``n`` characters."""
    windows = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(name) - n + 1), lambda i: F.substring(name, i, n)))
    return (F.when(kind == "literal", F.array(name)).when(kind == "any", F.array(F.lit(""))).when(F.length(name) < n, F.array().cast("array<string>"))
            .when(kind == "prefix", F.array(F.left(name, n))).when(kind == "suffix", F.array(F.right(name, n))).otherwise(windows))


def glob_counts(patterns: DataFrame, files: DataFrame) -> DataFrame:
    """Files per (check_id, path pattern, dialect): check_id, n; zero matches have no row.

    Files go down a trie of the patterns' segments, level by level, in hash joins: on the node and on a text that the
    edge requires of the name, which is its whole segment or the longest stretch without a wildcard. So a file meets
    only the patterns that still fit, however many there are below one folder; a regular expression confirms. Only
    segments of nothing but wildcards meet every name of their folder.
    """
    spark = files.sparkSession
    edges, ends = _trie(patterns)
    if not ends:
        return spark.createDataFrame([], "check_id string, n bigint")
    frame = spark.createDataFrame(edges, "level int, node int, child int, kind string, text string, rx string")
    shapes = frame.select("level", "node", "kind", F.when(F.col("kind") == "literal", F.lit(0)).otherwise(F.length("text")).alias("n")).distinct().groupBy(
        "level", "node").agg(F.collect_list(F.struct("kind", "n")).alias("shapes"))  # kinds and lengths of a node's edges: few
    is_dir = F.col("is_dir") if "is_dir" in files.columns else F.lit(False)
    whole = {-1: F.split("path", "/"), -2: F.array("path")}
    front = files.select(F.explode(F.filter(F.array(*[
        F.struct(F.lit(root).alias("node"), names.alias("names"), (F.lit(root == -2) | ~is_dir).alias("fits")) for root, names in whole.items()]),
        lambda s: s["fits"])).alias("s")).select("s.node", "s.names")
    arrived = []
    for level in range(1 + max(e[0] for e in edges)):
        here = frame.filter(F.col("level") == level).select("node", "kind", "text", "child", "rx")
        probes = front.filter(F.size("names") > level).join(broadcast_if_small(shapes.filter(F.col("level") == level).drop("level")), "node").withColumn(
            "name", F.element_at("names", level + 1))
        probes = probes.select("node", "names", "name", F.explode("shapes").alias("shape")).select(
            "node", "names", "name", F.col("shape.kind").alias("kind"), F.explode(_texts(F.col("shape.kind"), F.col("shape.n"), F.col("name"))).alias("text"))
        front = probes.join(broadcast_if_small(here), ["node", "kind", "text"]).filter(F.expr("rx IS NULL OR name RLIKE rx")).select(
            F.col("child").alias("node"), "names")
        arrived.append(front.filter(F.size("names") == level + 1).groupBy("node").agg(F.count(F.lit(1)).alias("n")))
    counts = reduce(DataFrame.unionByName, arrived)
    return counts.join(broadcast_if_small(spark.createDataFrame(ends, "check_id string, node int")), "node").select("check_id", "n")


def file_count_checks(checks: DataFrame, files: DataFrame) -> DataFrame:
    """Number of files that match a glob, within bounds."""
    n = F.coalesce(F.col("n"), F.lit(0))
    below, above = n < F.col("expect_min"), n > F.col("expect_max")
    shown = n.cast("string")
    detail = (F.when(below, F.concat(shown, F.lit(" < min "), number_text("expect_min")))
              .when(above, F.concat(shown, F.lit(" > max "), number_text("expect_max")))
              .otherwise(F.concat(shown, F.lit(" within bounds"))))
    # Checks without a match count zero; both sides hold one row per check.
    found = checks.join(glob_counts(checks, files), "check_id", "left")
    return results(found.withColumns({
        "got": shown, "detail": detail,
        "ok": ~F.coalesce(below, F.lit(False)) & ~F.coalesce(above, F.lit(False))}))


def judge_responses(checks: DataFrame, responses: DataFrame) -> DataFrame:
    """Every captured response against the checks of its URL: status, then body text, then JSON path.

    The first failing expectation decides. ``responses``: url, status, body and any further columns.
    """
    met = responses.join(broadcast_if_small(checks), "url")
    met = met.withColumn("_spec", F.when(F.coalesce(F.col("expect_json"), F.lit("")) != "", split_path_value("expect_json")))
    met = met.withColumn("_found", F.when(F.col("_spec.path").isNotNull(), json_path(F.coalesce("body", F.lit("")), F.col("_spec.path"))))
    want = F.coalesce(F.col("expect_status"), F.lit(200))
    asks_text = F.coalesce(F.col("expect_body_contains"), F.lit("")) != ""
    asks_json = F.coalesce(F.col("expect_json"), F.lit("")) != ""
    spec, found = F.col("_spec"), F.col("_found")
    no_status = F.col("status").isNull()
    status_bad = F.coalesce(F.col("status") != want, F.lit(False))
    text_bad = asks_text & ~F.contains(F.coalesce("body", F.lit("")), F.col("expect_body_contains"))
    value_bad = found["value"] != spec["value"]
    fail = (
        F.when(status_bad, F.concat(F.lit("status "), F.col("status").cast("string"), F.lit(", want "),
                                    want.cast("string")))
        .when(text_bad, F.concat(F.lit("nowhere in the body: "), quoted("expect_body_contains")))
        .when(asks_json & found["error"].isNotNull(), found["error"])
        .when(asks_json & value_bad, F.concat(spec["path"], F.lit(" = "), quoted(found["value"]), F.lit(", want "),
                                              quoted(spec["value"])))
    )
    error = F.when(no_status, F.lit("the captured response has no status")).when(~status_bad & ~text_bad & asks_json, spec["error"])
    return met.withColumns({
        "got": F.coalesce(F.col("status").cast("string"), F.lit("")), "error": error, "detail": F.when(error.isNull(), fail),
        "ok": error.isNull() & fail.isNull()}).drop("_spec", "_found")


def response_checks(checks: DataFrame, responses: DataFrame) -> DataFrame:
    """One result per check over the newest captured response of its URL (by ``captured_at``)."""
    asked = broadcast_if_small(checks.select("url").distinct())
    newest = (responses.join(asked, "url", "left_semi").groupBy("url")
              .agg(F.max_by(F.struct("status", "body"), "captured_at").alias("r"))
              .select("url", "r.status", "r.body"))
    judged = judge_responses(checks, newest).select("check_id", "ok", "got", "detail", "error")
    missing = F.when(F.col("ok").isNull(), F.concat(F.lit("no captured response for "), F.col("url")))
    return results(checks.join(judged, "check_id", "left").withColumns({
        "error": F.coalesce(F.col("error"), missing), "got": F.coalesce(F.col("got"), F.lit("")),
        "ok": F.coalesce(F.col("ok"), F.lit(False))}))


def judge_exits(checks: DataFrame, captures: DataFrame) -> DataFrame:
    """Captured command output: with ``equals`` the output must match, else the exit code must be 0."""
    met = captures.join(broadcast_if_small(checks), "capture")
    literal = F.col("equals").isNotNull()
    ok = F.when(literal, F.col("stdout") == F.col("equals")).otherwise(F.col("exit_code") == 0)
    ok = F.coalesce(ok, F.lit(False))
    return met.withColumns({
        "ok": ok,
        "got": F.when(literal, F.col("stdout")).otherwise(
            F.concat(F.lit("exit "), F.col("exit_code").cast("string"))),
        "detail": F.when(~ok, F.when(literal, F.concat(F.lit("want "), F.col("equals")))
                         .otherwise(first_line("stdout"))),
        "error": F.lit(None).cast("string"),
        "keep_literal": literal & F.coalesce(F.col("keep_literal"), F.lit(False))})


def exit_checks(checks: DataFrame, captures: DataFrame) -> DataFrame:
    """One result per check over the newest captured output of its name (by ``captured_at``)."""
    asked = broadcast_if_small(checks.select("capture").distinct())
    newest = (captures.join(asked, "capture", "left_semi").groupBy("capture")
              .agg(F.max_by(F.struct("stdout", "exit_code"), "captured_at").alias("r"))
              .select("capture", "r.stdout", "r.exit_code"))
    judged = judge_exits(checks, newest).select("check_id", "ok", "got", "detail", "error")
    missing = F.when(F.col("ok").isNull(), F.concat(F.lit("no captured output for "), F.col("capture")))
    return results(checks.join(judged, "check_id", "left").withColumns({
        "error": F.coalesce(F.col("error"), missing), "got": F.coalesce(F.col("got"), F.lit("")),
        "ok": F.coalesce(F.col("ok"), F.lit(False))}))


def _kind(fn, part: str, what: str):
    def run(spark: SparkSession, checks: DataFrame, snapshot: Snapshot, as_of=None) -> DataFrame:
        subject = getattr(snapshot, part)
        if subject is None:
            return results(checks.withColumns({
                "ok": F.lit(False), "got": F.lit(""), "error": F.lit(f"this check requires a target with {what}")}))
        return fn(checks, subject)
    return run


register_check_kind("file_exists", _kind(file_exists_checks, "files", "a file inventory"))
register_check_kind("file_count", _kind(file_count_checks, "files", "a file inventory"))
register_check_kind("checksum", _kind(checksum_checks, "files", "a file inventory"))
register_check_kind("response", _kind(response_checks, "responses", "captured responses"))
register_check_kind("exit", _kind(exit_checks, "captures", "captured command output"))
