"""Profiles and proposed checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundcheck.catalog.base import AS_OF, AS_OF_EPOCH, query
from soundcheck.functions import text as T
from soundcheck.operators import discovery as D
from soundcheck.operators.registry import Snapshot

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "benchmark",
         "pages", "embeddings", "conversations")


def snapshot(d, files=False):
    """The given tables, one of them in a schema, some with an obvious time column, one in a system schema."""
    tables = {n: d.table(n) for n in NAMES}
    tables["sales.Order Facts"] = d.orders.withColumnsRenamed({"o_orderdate": "updated_at"}).withColumn(
        "created_at", F.col("updated_at"))
    tables["sales.empty"] = d.orders.filter("o_orderkey < 0").withColumnRenamed("o_orderdate", "ts")
    tables["pg_catalog.pg_class"] = d.nation
    return Snapshot(tables, d.files if files else None)


AGE = f"greatest(0, {AS_OF_EPOCH} - epoch_us(max(ts)) // 1000000)"
ORDER_AGE = f"greatest(0, {AS_OF_EPOCH} - epoch_us(max(o_orderdate)) // 1000000)"
ROWS = " UNION ALL ".join(f"SELECT '' AS \"schema\", '{n}' AS name, count(*) AS rows FROM {n}" for n in NAMES) + """
    UNION ALL SELECT 'sales', 'Order Facts', count(*) FROM orders UNION ALL SELECT 'sales', 'empty', 0"""


@query("D1_profile_tables", ROWS)
def _(d):
    return D.profile_tables(d.spark, snapshot(d), as_of=AS_OF).select("schema", "name", "rows")


@query("D2_profile_time_columns", """
    SELECT '' AS "schema", 'events' AS name, 1 AS position, 'ts' AS "column", false AS zoned, count(ts) AS known, <EPOCH(max(ts))> AS newest_epoch FROM events
    UNION ALL SELECT '', 'lineitem', 1, 'l_shipdate', false, count(l_shipdate), <EPOCH(max(l_shipdate))> FROM lineitem
    UNION ALL SELECT '', 'orders', 1, 'o_orderdate', false, count(o_orderdate), <EPOCH(max(o_orderdate))> FROM orders
    UNION ALL SELECT 'sales', 'Order Facts', 1, 'updated_at', false, count(o_orderdate), <EPOCH(max(o_orderdate))> FROM orders
    UNION ALL SELECT 'sales', 'Order Facts', 2, 'created_at', false, count(o_orderdate), <EPOCH(max(o_orderdate))> FROM orders
    UNION ALL SELECT 'sales', 'empty', 1, 'ts', false, 0, NULL""")
def _(d):
    return D.profile_time_columns(d.spark, snapshot(d))


@query("D3_freshness_column", """
    SELECT 'single' AS rule, '' AS "schema", 'events' AS name, 'ts' AS time_column, <EPOCH(max(ts))> AS newest_epoch FROM events
    UNION ALL SELECT 'single', 'sales', 'empty', 'ts', NULL
    UNION ALL SELECT 'prefer_updated', '', 'events', 'ts', <EPOCH(max(ts))> FROM events
    UNION ALL SELECT 'prefer_updated', 'sales', 'Order Facts', 'updated_at', <EPOCH(max(o_orderdate))> FROM orders
    UNION ALL SELECT 'prefer_updated', 'sales', 'empty', 'ts', NULL""")
def _(d):
    part = lambda rule: D.profile_tables(d.spark, snapshot(d), rule, AS_OF).filter("time_column IS NOT NULL").select(
        F.lit(rule).alias("rule"), "schema", "name", "time_column", "newest_epoch")
    return part("single").unionByName(part("prefer_updated"))


@query("D4_observed_age", f"""SELECT 'events' AS name, {AGE} AS age_s FROM events UNION ALL SELECT 'orders', {ORDER_AGE} FROM orders
    UNION ALL SELECT 'future', 0 FROM (SELECT count(*) FROM events)""")
def _(d):
    part = lambda n, df, c, at: D.observed_age(df, c, at).withColumn("name", F.lit(n))
    return part("events", d.events, "ts", AS_OF).unionByName(part("orders", d.orders, "o_orderdate", AS_OF)).unionByName(
        part("future", d.events, "ts", "2020-01-01 00:00:00"))


@query("D5_freshness_threshold", f"""SELECT event_id, greatest(({AS_OF_EPOCH} - <EPOCH(ts)>) * 5, 86400) AS max_age_s FROM events""")
def _(d):
    from soundcheck.functions.scalars import epoch
    age = F.lit(AS_OF_EPOCH).cast("bigint") - epoch("ts")
    return d.events.select("event_id", D.freshness_threshold(age).alias("max_age_s"))


CHECK = ["name", "severity", "sql", "expect_min", "equals", "max_age_s"]


def shown(df):
    return df.select(*CHECK)


@query("D6_structural_checks", """
    SELECT 'server_reachable' AS name, '1' AS got, true AS ok FROM (SELECT count(*) FROM region)
    UNION ALL SELECT 'has_user_database', '2', true FROM (SELECT count(*) FROM region)
    UNION ALL SELECT 'schema_present', '16', true FROM (SELECT count(*) FROM region)""")
def _(d):
    from soundcheck.operators.checks import run_checks
    from soundcheck.schemas import CHECK_FIELDS
    own = snapshot(d)
    checks = D._numbered(D.structural_checks(D.profile_tables(d.spark, own, as_of=AS_OF))).select(*CHECK_FIELDS)
    return run_checks(d.spark, checks, own, AS_OF).select("name", "got", "ok")


FULL = f"p AS ({ROWS}), q AS (SELECT *, CASE WHEN \"schema\" = '' THEN name ELSE concat(\"schema\", '.', name) END AS qualified, " \
       "CASE name WHEN 'Order Facts' THEN 'order_facts' ELSE name END AS token FROM p)"


@query("D7_nonempty_checks", f"""
    WITH {FULL} SELECT concat(CASE WHEN "schema" = '' THEN '' ELSE 'sales_' END, token, '_nonempty') AS name, 'advisory' AS severity,
      concat('SELECT count(*) FROM (SELECT 1 FROM `', qualified, '` LIMIT 1) x') AS sql, 1.0::DOUBLE AS expect_min, NULL AS equals, NULL AS max_age_s
    FROM q WHERE rows > 0 ORDER BY "schema", q.name LIMIT 9""")
def _(d):
    return shown(D.nonempty_checks(D.profile_tables(d.spark, snapshot(d), as_of=AS_OF), cap=9))


@query("D8_row_floor_checks", f"""
    WITH {FULL} SELECT concat(token, '_min_rows') AS name, 'advisory' AS severity, concat('SELECT count(*) FROM `', qualified, '`') AS sql,
      rows::DOUBLE AS expect_min, NULL AS equals, NULL AS max_age_s FROM q WHERE rows > 0""")
def _(d):
    return shown(D.row_floor_checks(D.profile_tables(d.spark, snapshot(d), as_of=AS_OF)))


@query("D9_freshness_checks", f"""
    SELECT 'events_fresh' AS name, 'advisory' AS severity, 'SELECT max(`ts`) FROM `events`' AS sql, NULL AS expect_min, NULL AS equals,
      greatest({AGE} * 5, 86400) AS max_age_s FROM events
    UNION ALL SELECT 'order_facts_fresh', 'advisory', 'SELECT max(`updated_at`) FROM `sales.Order Facts`', NULL, NULL, greatest({ORDER_AGE} * 5, 86400) FROM orders""")
def _(d):
    return shown(D.freshness_checks(D.profile_tables(d.spark, snapshot(d), "prefer_updated", AS_OF)))


@query("D10_partition_floor", f"""
    SELECT 'events_is_partitioned' AS name, 'advisory' AS severity, NULL AS expect_min, true AS bool, NULL AS max_age_s FROM (SELECT count(*) FROM events)
    UNION ALL SELECT 'events_chunks', 'advisory', count(DISTINCT date_trunc('day', ts))::DOUBLE, NULL, NULL FROM events
    UNION ALL SELECT 'events_fresh', 'advisory', NULL, NULL, greatest({AGE} * 5, 86400) FROM events
    UNION ALL SELECT 'empty_is_partitioned', 'advisory', NULL, true, NULL UNION ALL SELECT 'empty_fresh', 'advisory', NULL, NULL, 86400""")
def _(d):
    part = lambda df, n: D.partition_floor_checks(df, n, "ts", "day", AS_OF)
    return part(d.events, "events").unionByName(part(d.events.filter("event_id < 0"), "empty")).select(
        "name", "severity", "expect_min", "bool", "max_age_s")


@query("D11_component_checks", """
    SELECT DISTINCT concat(regexp_replace(lower(c), '[^a-z0-9]', '_', 'g'), '_loaded') AS name, c AS subject, 'advisory' AS severity
    FROM (SELECT concat('Lib-', event_id % 40) AS c FROM events) WHERE c IN (SELECT concat('Lib-', n_nationkey) FROM nation)""")
def _(d):
    installed = d.events.select(F.concat(F.lit("Lib-"), (F.col("event_id") % 40).cast("string")).alias("component"))
    required = d.nation.select(F.concat(F.lit("Lib-"), F.col("n_nationkey").cast("string")).alias("component"))
    return D.component_checks(installed, required).select("name", "subject", "severity")


ODD = """
    SELECT doc_id, concat(upper(lang), ' ', source, CASE doc_id % 4 WHEN 0 THEN '-É_' WHEN 1 THEN '.x' WHEN 2 THEN '  ' ELSE '_' END) AS raw,
      CASE doc_id % 3 WHEN 0 THEN 'public' WHEN 1 THEN '' ELSE 'Sales-EU' END AS sch FROM documents"""


@query("D12_check_name", f"""
    WITH o AS ({ODD}), t AS (SELECT *, trim(regexp_replace(lower(raw), '[^a-z0-9]', '_', 'g'), '_') AS token FROM o)
    SELECT doc_id, token, concat(CASE WHEN sch IN ('', 'public') THEN '' ELSE 'sales_eu_' END, token, '_nonempty') AS name,
      CASE WHEN doc_id % 2 = 0 THEN 'entry' ELSE token END AS file_token FROM t""")
def _(d):
    o = d.sql(ODD)
    odd = F.when(F.col("doc_id") % 2 == 0, F.lit(" - ")).otherwise(F.col("raw"))
    return o.select("doc_id", T.sanitize("raw").alias("token"), T.check_name("sch", "raw", "nonempty").alias("name"),
                    T.sanitize(odd, "entry").alias("file_token"))


IT_IS = "it's \\"


@query("D13_quoting", """
    SELECT source, count(*) AS "select `odd` name", concat('it''s \\', source) AS literal FROM documents GROUP BY source""")
def _(d):
    name, view = "select `odd` name", T.quote_ident("Weird `Name")
    d.documents.select("source", F.col("doc_id").alias(name)).createOrReplaceTempView(view)
    odd = T.quote_ident(name)
    return d.spark.sql(f"SELECT source, count({odd}) AS {odd}, concat({T.quote_literal(IT_IS)}, source) "
                       f"AS literal FROM {view} GROUP BY source")


TEMP = "(base = '' OR base LIKE '.%' OR base LIKE '%~' OR regexp_matches(lower(base), '\\.(tmp|swp|part|lock)$'))"
ANCHORS = f"""
    a AS (SELECT path FROM (SELECT DISTINCT path, path AS base FROM files WHERE path NOT LIKE '%/%') WHERE NOT {TEMP} ORDER BY path LIMIT 5),
    dirs AS (SELECT string_split(path, '/')[1] AS base, count(*) AS n FROM files WHERE len(string_split(path, '/')) = 2 GROUP BY 1)"""


def tok(x):
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]', '_', 'g'), '_')"


ANCHOR_ROWS = f"SELECT concat('anchor_', {tok('path')}, '_exists') AS name, 'file_exists' AS kind, path, NULL AS expect_min, 'advisory' AS severity FROM a"
DIR_ROWS = f"SELECT concat('dir_', {tok('base')}, '_files') AS name, 'file_count' AS kind, concat(base, '/*') AS path, n::DOUBLE AS expect_min, 'advisory' AS severity FROM dirs WHERE NOT {TEMP}"


def files_shown(df):
    return df.select("name", "kind", "path", "expect_min", "severity")


@query("D14_discover_files", f"""WITH {ANCHORS} {ANCHOR_ROWS} UNION ALL {DIR_ROWS}
    UNION ALL SELECT 'restore_root_nonempty', 'file_count', '*', 1.0::DOUBLE, 'required'""", "files")
def _(d):
    return files_shown(D.discover_files(d.files))


@query("D15_anchors", f"WITH {ANCHORS} {ANCHOR_ROWS}", "files")
def _(d):
    return files_shown(D.anchor_checks(d.files))


@query("D16_directory_floors", f"WITH {ANCHORS} {DIR_ROWS}", "files")
def _(d):
    return files_shown(D.directory_floor_checks(d.files))


@query("D17_is_temp_name", f"""SELECT path, {TEMP} AS temp FROM (SELECT path, string_split(path, '/')[-1] AS base FROM files)""", "files")
def _(d):
    return d.files.select("path", T.is_temp_name("path").alias("temp"))


CANDIDATES = """
    SELECT concat('k_', o_orderkey) AS name, CAST(o_orderkey AS INT) AS ord, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'table' WHEN 2 THEN 'dir' ELSE 'table' END AS cap_group,
      concat('s_', o_custkey) AS subject, <INT(o_totalprice)> // 1000 AS weight FROM orders"""


@query("D18_cap_candidates", f"""
    WITH c AS ({CANDIDATES}), s AS (SELECT cap_group, subject, max(weight) AS w, min(ord) AS f FROM c WHERE cap_group <> '' GROUP BY 1, 2),
    k AS (SELECT cap_group, subject FROM s QUALIFY row_number() OVER (PARTITION BY cap_group ORDER BY w DESC, f) <= 40)
    SELECT name, cap_group, true AS truncated FROM c WHERE cap_group = '' UNION ALL SELECT name, cap_group, true FROM c JOIN k USING (cap_group, subject)""")
def _(d):
    return D.cap_candidates(d.sql(CANDIDATES.replace("//", "DIV")), 40).select("name", "cap_group", "truncated")


@query("D19_verify_candidates", """
    SELECT name FROM (SELECT 'orders_ok' AS name, count(*) >= 1 AS ok FROM orders UNION ALL SELECT 'orders_huge', count(*) >= 1e12 FROM orders
      UNION ALL SELECT 'broken', false UNION ALL SELECT 'region_5', count(*) = 5 FROM region) WHERE ok""")
def _(d):
    from soundcheck.operators.checks import checks_table
    made = checks_table(d.spark, [
        dict(name="orders_ok", sql="SELECT count(*) FROM orders", expect_min=1),
        dict(name="orders_huge", sql="SELECT count(*) FROM orders", expect_min=1e12),
        dict(name="broken", sql="SELECT count(*) FROM nowhere_at_all", expect_min=1),
        dict(name="region_5", sql="SELECT count(*) FROM region", equals="5")])
    return D.verify_candidates(d.spark, made, Snapshot({"orders": d.orders, "region": d.region}), AS_OF).select("name")


@query("D20_scaffold", f"""
    WITH {FULL} SELECT concat(CASE WHEN "schema" = '' THEN '' ELSE 'sales_' END, token, '_nonempty') AS name, 'advisory' AS severity, NULL AS max_age_s, 1.0::DOUBLE AS expect_min
    FROM q WHERE rows > 0
    UNION ALL SELECT 'server_reachable', 'required', NULL, NULL UNION ALL SELECT 'has_user_database', 'required', NULL, 1 UNION ALL SELECT 'schema_present', 'required', NULL, 1
    UNION ALL SELECT 'events_fresh', 'advisory', greatest({AGE} * 5, 86400), NULL FROM events""")
def _(d):
    return D.scaffold(d.spark, snapshot(d), "postgres", as_of=AS_OF).select("name", "severity", "max_age_s", "expect_min")


@query("D20_scaffold_capped", f"""
    WITH {FULL}, big AS (SELECT *, row_number() OVER (ORDER BY rows DESC, "schema", name) AS r FROM q WHERE rows > 0)
    SELECT concat(token, '_min_rows') AS name, 'advisory' AS severity, NULL AS max_age_s, rows::DOUBLE AS expect_min, true AS truncated FROM big WHERE r <= 4
    UNION ALL SELECT 'server_reachable', 'required', NULL, NULL, true UNION ALL SELECT 'schema_present', 'required', NULL, 1, true
    UNION ALL SELECT 'order_facts_fresh', 'advisory', greatest({ORDER_AGE} * 5, 86400), NULL, true FROM orders WHERE 4 >= (SELECT r FROM big WHERE name = 'Order Facts') GROUP BY ALL
    UNION ALL SELECT 'events_fresh', 'advisory', greatest({AGE} * 5, 86400), NULL, true FROM events WHERE 4 >= (SELECT r FROM big WHERE name = 'events') GROUP BY ALL""")
def _(d):
    return D.scaffold(d.spark, snapshot(d), "mysql", cap=4, as_of=AS_OF).select("name", "severity", "max_age_s", "expect_min", "truncated")


@query("D22_skeletons", f"""
    SELECT path AS unit, CASE WHEN stem = '' THEN 'repository' ELSE stem END AS file_name, 'restore_not_empty' AS name, 'file_count' AS kind
    FROM (SELECT path, trim(regexp_replace(path, '[^A-Za-z0-9._-]', '-', 'g'), '-.') AS stem FROM files)""", "files")
def _(d):
    return D.skeletons(d.files.select(F.col("path").alias("unit")), "files").select("unit", "file_name", "name", "kind")


REQUIRED = """
    SELECT concat('u_', user_id) AS unit, concat('', 12 + user_id % 3) AS version, CASE WHEN event_id % 5 > 0 THEN concat('lib_', event_id % 5) END AS library FROM events"""
PROVIDED = """
    SELECT concat('u_', c_custkey) AS unit, '13' AS version, concat('lib_', c_nationkey % 4) AS library FROM customer"""


@query("D23_environment_mismatch", f"""
    WITH r AS ({REQUIRED}), p AS ({PROVIDED}), need AS (SELECT DISTINCT unit, version FROM r), have AS (SELECT DISTINCT unit, version FROM p)
    SELECT need.unit, concat('needs major version ', need.version, ', target provides ', coalesce(have.version, 'none')) AS message
    FROM need LEFT JOIN have USING (unit) WHERE need.version IS DISTINCT FROM have.version
    UNION ALL SELECT DISTINCT r.unit, concat('needs library ', r.library, ', target does not provide it') FROM r
    WHERE r.library IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p WHERE p.unit = r.unit AND p.library = r.library)""")
def _(d):
    return D.environment_mismatch(d.sql(REQUIRED), d.sql(PROVIDED))
