"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundcheck.catalog.base import TABLES, query
from soundcheck.functions.messages import failure_reason, load_warnings
from soundcheck.operators import verdict as V
from soundcheck.session import shared_path
from soundcheck.sources import files, listings, reports, settings, snapshots

TRIM = r"regexp_replace(X, '^[\s\x0b\x{85}\pZ]+|[\s\x0b\x{85}\pZ]+$', '', 'g')"


def trim(x: str) -> str:
    return TRIM.replace("X", x)


@query("A1_load_snapshot", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", count(*) AS rows, true AS load_ok FROM {t}" for t in TABLES))
def _(d):
    _, load, counts = snapshots.load_snapshot(d.spark, d.folder, views=False)
    return counts.withColumn("load_ok", F.lit(load.first()["ok"]))


@query("A2_load_snapshots", """
    SELECT snapshot_id, count(*) AS rows, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key
    FROM snapshots GROUP BY 1""", "snapshots")
def _(d):
    root = shared_path(d.spark, "chain")
    d.snapshots.repartition("snapshot_id", F.pmod("o_orderkey", F.lit(8))).write.partitionBy("snapshot_id").parquet(f"{root}/orders")
    orders = snapshots.load_snapshots(d.spark, root)["orders"]
    return orders.groupBy("snapshot_id").agg(
        F.count(F.lit(1)).alias("rows"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query("A2_damaged_members", """
    SELECT snapshot_id, snapshot_id <> 's_1995' AS ok, CASE WHEN snapshot_id <> 's_1995' THEN count(*) END AS rows FROM snapshots GROUP BY 1""", "snapshots")
def _(d):
    root = shared_path(d.spark, "chain")
    d.snapshots.repartition("snapshot_id").write.partitionBy("snapshot_id").parquet(f"{root}/orders")
    d.snapshots.filter("snapshot_id = 's_1995'").select("o_orderstatus").limit(1).write.mode("append").text(f"{root}/orders/snapshot_id=s_1995")
    tables, loads = snapshots.load_chain(d.spark, root)
    counts = tables["orders"].groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("rows"))
    return loads.join(counts, "snapshot_id", "left").select("snapshot_id", "ok", "rows")


# DuckDB takes no folder as a parameter: its side reads the folder on which both engines are compared.
@query("A3_file_inventory", """
    SELECT parse_filename(filename) AS path, '' AS dir, parse_filename(filename) AS name, size, false AS is_dir, sha256(content) AS sha256, NULL AS error
    FROM read_blob('/root/testdata/sf0.01/*')""")
def _(d):
    return files.file_inventory(d.spark, f"file://{d.folder}", with_hash=True).drop("mtime")


PGB = """
    SELECT o_orderkey AS listing_id, CASE WHEN o_orderkey % 11 = 0 THEN 'oops' WHEN o_orderkey % 13 = 0 THEN '[]' ELSE
      concat('[{"name":"unit_', o_custkey % 25, '","status":{"code":', o_orderkey % 3, ',"message":"m', o_orderkey % 3,
             '"},"backup":[{"label":"a', o_orderkey, '","type":"full","timestamp":{"start":1,"stop":', <EPOCH(o_orderdate)>,
             '}},{"label":"b', o_orderkey, '","type":"incr","timestamp":{"stop":', <EPOCH(o_orderdate)> + 60,
             '}}]},{"name":"none","status":{"code":1,"message":""},"backup":[]}]') END AS out FROM orders"""


@query("A4_parse_pgbackrest_info", """
    SELECT o_orderkey AS listing_id, NULL AS unit, NULL AS status_code, NULL AS label, NULL AS type, NULL AS stop,
           'parse pgbackrest info json' AS error FROM orders WHERE o_orderkey % 11 = 0
    UNION ALL SELECT o_orderkey, 'none', 1, NULL, NULL, NULL, NULL FROM orders WHERE o_orderkey % 11 > 0 AND o_orderkey % 13 > 0
    UNION ALL SELECT o_orderkey, concat('unit_', o_custkey % 25), o_orderkey % 3, concat(k, o_orderkey), t,
           <EPOCH(o_orderdate)> + s, NULL FROM orders, (VALUES ('a', 'full', 0), ('b', 'incr', 60)) b(k, t, s)
           WHERE o_orderkey % 11 > 0 AND o_orderkey % 13 > 0""")
def _(d):
    out = listings.parse_pgbackrest_info(d.sql(PGB), "out")
    return out.select("listing_id", "unit", F.when(F.col("error").isNull(), F.col("status_code")).alias("status_code"),
                      "label", "type", F.unix_seconds("ts").alias("stop"), "error")


RESTIC = """
    SELECT o_orderkey AS listing_id, CASE o_orderkey % 7 WHEN 0 THEN concat('fatal: no repository ', o_orderkey)
      WHEN 1 THEN '[{"time":"yesterday","id":"x"}]'
      ELSE concat('warning: slow cache', <NL>, '[{"time":"', <DAY(o_orderdate)>, 'T10:00:00.5+02:00","id":"',
        <SHA(o_orderpriority)>, '","short_id":"', CASE WHEN o_orderkey % 2 = 0 THEN concat('s', o_orderkey) ELSE '' END,
        '"},{"time":"', <DAY(o_orderdate)>, 'T09:00:00Z","id":"abc"}]', <NL>, 'done') END AS out FROM orders"""


@query("A5_parse_restic_snapshots", """
    SELECT o_orderkey AS listing_id, NULL AS label, NULL AS at,
           CASE o_orderkey % 7 WHEN 0 THEN concat('restic snapshots: no JSON array in output "fatal: no repository ', o_orderkey, '"')
           ELSE 'parse restic snapshots json' END AS error FROM orders WHERE o_orderkey % 7 < 2
    UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN concat('s', o_orderkey) ELSE left(<SHA(o_orderpriority)>, 8) END,
           <EPOCH(o_orderdate)> + 28800, NULL FROM orders WHERE o_orderkey % 7 > 1
    UNION ALL SELECT o_orderkey, 'abc', <EPOCH(o_orderdate)> + 32400, NULL FROM orders WHERE o_orderkey % 7 > 1""")
def _(d):
    return listings.parse_restic_snapshots(d.sql(RESTIC), "out").select(
        "listing_id", "label", F.unix_seconds("ts").alias("at"), "error")


BORG = """
    SELECT o_orderkey AS listing_id, CASE o_orderkey % 7 WHEN 0 THEN 'Repository gone' WHEN 1 THEN '{"archives": [oops]}'
      WHEN 2 THEN concat('{"archives":[{"name":"ok","time":"2024-01-01T00:00:00"},{"name":"n', o_orderkey, '","time":"soon"}]}')
      ELSE concat('note', <NL>, '{"archives":[{"name":"n', o_orderkey, '","time":"', <DAY(o_orderdate)>, 'T01:02:03.000000"},',
                  '{"archive":"old", "start":"', <DAY(o_orderdate)>, 'T01:00:00"}],"repository":{"id":"x"}}') END AS out FROM orders"""


@query("A6_parse_borg_archives", """
    SELECT o_orderkey AS listing_id, NULL AS label, NULL AS at,
           CASE o_orderkey % 7 WHEN 0 THEN 'borg list: no JSON object in output "Repository gone"' WHEN 1 THEN 'parse borg list json'
           ELSE concat('archive "n', o_orderkey, '": unparseable archive time "soon"') END AS error FROM orders WHERE o_orderkey % 7 < 3
    UNION ALL SELECT o_orderkey, concat('n', o_orderkey), <EPOCH(o_orderdate)> + 3723, NULL FROM orders WHERE o_orderkey % 7 > 2
    UNION ALL SELECT o_orderkey, 'old', <EPOCH(o_orderdate)> + 3600, NULL FROM orders WHERE o_orderkey % 7 > 2""")
def _(d):
    return listings.parse_borg_archives(d.sql(BORG), "out").select(
        "listing_id", "label", F.unix_seconds("ts").alias("at"), "error")


OUTPUT = """
    SELECT doc_id, doc_id % 5 AS exit_code, concat(text, CASE doc_id % 4
      WHEN 0 THEN concat(<NL>, '2024 P00  ERROR: [', doc_id, ']: gone  ', <NL>, 'ERROR: later')
      WHEN 1 THEN concat(<NL>, '  Fatal: unable to open ', doc_id, ' ', <NL>, 'end')
      WHEN 2 THEN concat(<NL>, 'Repository /r', doc_id, ' does not exist.') ELSE '' END) AS out FROM documents
    UNION ALL SELECT -item_id, 3, concat(<NL>, '   ', <NL>) FROM benchmark"""
LINES = f"list_transform(string_split(out, <NL>), lambda l: {trim('l')})"


@query("A7_failure_reason", f"""
    WITH o AS ({OUTPUT}), l AS (SELECT *, {LINES} AS lines, string_split(out, <NL>) AS raw FROM o)
    SELECT doc_id,
      coalesce({trim("regexp_extract(list_filter(raw, lambda x: contains(x, 'ERROR:'))[1], '(ERROR:.*)', 1, 's')")}, '') AS pgbackrest,
      coalesce(list_filter(lines, lambda x: regexp_matches(lower(x), '^(fatal:|error:)|unable to open'))[1], '') AS restic,
      coalesce(list_filter(lines, lambda x: regexp_matches(lower(x),
        '^(error:|error )|passphrase supplied|does not exist|does not seem to be a valid repository'))[1], '') AS borg,
      coalesce(list_filter(lines, lambda x: regexp_matches(lower(x), '^(fatal:|error:)'))[1],
               list_filter(lines, lambda x: x <> '')[1], concat('exited ', exit_code)) AS listing FROM l""")
def _(d):
    return d.sql(OUTPUT).select(
        "doc_id", failure_reason("out", "pgbackrest").alias("pgbackrest"), failure_reason("out", "restic").alias("restic"),
        failure_reason("out", "borg").alias("borg"), failure_reason("out", "restic", F.col("exit_code")).alias("listing"))


def reports_of(d):
    stamp = {"started_at": F.col("started_at").cast("timestamp"), "finished_at": F.col("finished_at").cast("timestamp")}
    return V.build_reports(d.results, d.loads.withColumns(stamp))


VERDICT = """
    v AS (SELECT l.run_id, CASE WHEN l.ok AND NOT coalesce(bool_or(NOT coalesce(r.ok, false) AND r.severity <> 'advisory'), false)
                 THEN 'pass' ELSE 'fail' END AS verdict, count(r.run_id) AS checks
          FROM loads l LEFT JOIN results r ON l.run_id = r.run_id GROUP BY l.run_id, l.ok)"""


@query("A8_write_read_reports", f"""
    WITH {VERDICT} SELECT target, verdict, count(*) AS reports, CAST(sum(checks) AS BIGINT) AS checks, 1 AS schema_version
    FROM v JOIN loads USING (run_id) GROUP BY 1, 2""", "loads results")
def _(d):
    path = shared_path(d.spark, "reports")
    reports.write_reports(reports_of(d), path, d.secrets)
    return reports.read_reports(d.spark, path).groupBy("target", "verdict").agg(
        F.count(F.lit(1)).alias("reports"), F.sum(F.size("checks")).alias("checks"),
        F.max("schema_version").alias("schema_version"))


CODE = trim(r"regexp_extract(line, '^((?:[^''#]|''[^'']*(?:''|$))*)', 1, 's')")
SETTING = f"""
    s AS (SELECT unit, file_rank, line_no, {CODE} AS code FROM setting_lines),
    kv AS (SELECT unit, file_rank, line_no, lower({trim("code[1:instr(code, '=') - 1]")}) AS key,
                  regexp_replace({trim("code[instr(code, '=') + 1:]")}, '^''(.*)''$', '\\1', 's') AS value
           FROM s WHERE instr(code, '=') > 0),
    eff AS (SELECT unit, key, arg_max(value, (file_rank, line_no)) AS value FROM kv WHERE key <> '' GROUP BY 1, 2)"""


@query("A9_effective_settings", f"WITH {SETTING} SELECT * FROM eff", "setting_lines")
def _(d):
    return settings.effective_settings(d.setting_lines)


LIBS = f"""
    list_filter(list_transform(string_split(value, ','), lambda p: {trim("trim(" + trim("p") + ", '''\"')")}), lambda p: p <> '')"""


@query("A10_required_libraries", f"""
    WITH {SETTING} SELECT unit, unnest({LIBS}) AS library FROM eff WHERE key = 'shared_preload_libraries'""", "setting_lines")
def _(d):
    return settings.required_libraries(settings.effective_settings(d.setting_lines)).select("unit", "library")


UNIT_FILES = """
    SELECT DISTINCT concat('u_', user_id % 6) AS unit, concat('base/', CASE WHEN event_id % 9 = 0 THEN 'tmp_' ELSE '' END, event_id % 97) AS path,
           event_id % 2 = 0 AS is_dir, CAST(NULL AS VARCHAR(10)) AS content FROM events
    UNION ALL SELECT DISTINCT concat('u_', user_id % 6), 'PG_VERSION', false,
           CASE WHEN user_id % 6 = 1 THEN ' ' ELSE concat(' ', 12 + user_id % 6, <NL>) END FROM events WHERE user_id % 6 <> 2"""


@query("A11_inspect_units", f"""
    WITH {SETTING}, f AS ({UNIT_FILES}),
    u AS (SELECT unit, max(CASE WHEN path = 'PG_VERSION' THEN {trim('content')} END) AS version,
                 count(*) FILTER (WHERE is_dir AND regexp_full_match(path, 'base/[+-]?[0-9]+')) AS databases FROM f GROUP BY 1)
    SELECT u.unit, nullif(version, '') AS version, databases, coalesce(array_to_string({LIBS}, ','), '') AS libraries,
           CASE WHEN version IS NULL THEN 'version marker not found' WHEN version = '' THEN 'version marker is empty' END AS error
    FROM u LEFT JOIN eff ON u.unit = eff.unit AND eff.key = 'shared_preload_libraries'""", "setting_lines")
def _(d):
    return settings.inspect_units(d.sql(UNIT_FILES), d.setting_lines)


@query("A12_retain_reports", """
    SELECT run_id, target FROM loads WHERE finished_at >= TIMESTAMP '2001-08-01 00:00:00' - INTERVAL 900 DAY
    QUALIFY row_number() OVER (PARTITION BY target ORDER BY finished_at DESC, run_id DESC) <= 20""", "loads")
def _(d):
    return reports.retain_reports(d.loads, keep_n=20, keep_days=900, as_of="2001-08-01 00:00:00").select("run_id", "target")


WARNED = """
    SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat(text, <NL>, 'warning: errors ignored on restore: ', doc_id % 40, ' ', <NL>, 'x')
      ELSE text END AS out FROM documents"""


@query("A13_load_warnings", f"""
    WITH o AS ({WARNED}) SELECT doc_id, concat('load ignored ', CASE WHEN contains(out, 'errors ignored on restore:')
      THEN {trim("regexp_extract(out, 'errors ignored on restore:([^' || chr(10) || ']*)', 1)")} ELSE 'some' END, ' error(s)') AS note FROM o""")
def _(d):
    return d.sql(WARNED).select("doc_id", load_warnings("out").alias("note"))
