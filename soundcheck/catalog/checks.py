"""Check kinds, expectations, integrity, JSON scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundcheck.catalog.base import AS_OF, AS_OF_EPOCH, query
from soundcheck.functions import jsonpath, scalars
from soundcheck.operators import checks as B
from soundcheck.operators import expect as E
from soundcheck.operators import integrity as C
from soundcheck.operators import probes as P
from soundcheck.operators.registry import Snapshot, check_kinds, register_check_kind

RESULT = ["check_id", "name", "severity", "ok", "got", "failed"]


def shown(df):
    """Result columns that do not depend on wording."""
    return df.withColumn("failed", F.col("error").isNotNull()).select(*RESULT)


SQL_CHECKS = [
    dict(name="orders_present", severity="required", sql="SELECT count(*) FROM orders", expect_min=1),
    dict(name="regions", severity="required", sql="SELECT count(*) FROM region", equals="5"),
    dict(name="no_orphan_lines", severity="required", bool=True, sql="SELECT count(*) = 0 FROM lineitem LEFT ANTI JOIN orders "
         "ON l_orderkey = o_orderkey"),
    dict(name="events_fresh", severity="required", sql="SELECT max(ts) FROM events", max_age_s=2 * 86400),
    dict(name="events_very_fresh", severity="advisory", sql="SELECT max(ts) FROM events", max_age_s=1),
    dict(name="cheap_orders", severity="advisory", sql="SELECT count(*) FROM orders WHERE o_totalprice < 1000", expect_max=10),
    dict(name="no_value", severity="advisory", sql="SELECT max(o_orderkey) FROM orders WHERE o_orderkey < 0", expect_min=1),
    dict(name="bad_table", severity="advisory", sql="SELECT count(*) FROM no_such_table", expect_min=1),
    dict(name="bad_division", severity="advisory", sql="SELECT count(*) / count_if(o_orderkey < 0) FROM orders", expect_min=1),
    dict(name="two_rows", severity="advisory", sql="SELECT DISTINCT l_linestatus FROM lineitem", equals="F"),
    dict(name="newest_status", severity="required", sql="SELECT max_by(o_orderstatus, o_orderkey) FROM orders", equals="O"),
]


def _duck_sql(i, c, got, ok, failed=False):
    return (f"SELECT 'c{i:04d}' AS check_id, '{c['name']}' AS name, '{c['severity']}' AS severity, "
            f"{ok} AS ok, CAST({got} AS VARCHAR) AS got, {'true' if failed else 'false'} AS failed")


_events_at = "(SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM events)"
_events_age = f"(SELECT {AS_OF_EPOCH}000000 - epoch_us(max(ts)) FROM events)"
B1 = " UNION ALL ".join([
    _duck_sql(0, SQL_CHECKS[0], "(SELECT count(*) FROM orders)", "(SELECT count(*) >= 1 FROM orders)"),
    _duck_sql(1, SQL_CHECKS[1], "(SELECT count(*) FROM region)", "(SELECT count(*) = 5 FROM region)"),
    _duck_sql(2, SQL_CHECKS[2], "(SELECT count(*) = 0 FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))",
              "(SELECT count(*) = 0 FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))"),
    _duck_sql(3, SQL_CHECKS[3], _events_at, f"{_events_age} <= {2 * 86400}000000"),
    _duck_sql(4, SQL_CHECKS[4], _events_at, f"{_events_age} <= 1000000"),
    _duck_sql(5, SQL_CHECKS[5], "(SELECT count(*) FROM orders WHERE o_totalprice < 1000)",
              "(SELECT count(*) <= 10 FROM orders WHERE o_totalprice < 1000)"),
    _duck_sql(6, SQL_CHECKS[6], "''", "false", True),
    _duck_sql(7, SQL_CHECKS[7], "''", "false", True),
    _duck_sql(8, SQL_CHECKS[8], "''", "false", True),
    _duck_sql(9, SQL_CHECKS[9], "''", "false", True),
    _duck_sql(10, SQL_CHECKS[10], "(SELECT arg_max(o_orderstatus, o_orderkey) FROM orders)",
              "(SELECT arg_max(o_orderstatus, o_orderkey) = 'O' FROM orders)"),
])


def _snapshot(d, *names):
    return Snapshot({n: d.table(n) for n in names})


def _b1(d):
    snapshot = _snapshot(d, "orders", "region", "lineitem")
    # Whole seconds, so that both engines print the same text.
    snapshot.tables["events"] = d.events.withColumn("ts", F.date_trunc("second", "ts").cast("timestamp_ntz"))
    return B.sql_checks(d.spark, B.checks_table(d.spark, SQL_CHECKS), snapshot, AS_OF)


# Microseconds do not change any outcome above, but the age is taken from the shown text.
@query("B1_sql_checks", B1.replace("epoch_us(max(ts))", "epoch_us(date_trunc('second', max(ts)))"))
def _(d):
    return shown(_b1(d))


COUNT_CHECKS = [
    dict(name="all_orders", kind="count", severity="required", table_name="orders", expect_min=1),
    dict(name="urgent", kind="count", severity="required", table_name="orders", filter="o_orderpriority = '1-URGENT'", expect_min=1),
    dict(name="status_doc", kind="count", severity="advisory", table_name="orders", filter='{"o_orderstatus": "F"}', equals="0"),
    dict(name="empty_doc", kind="count", severity="required", table_name="lineitem", filter="{}", expect_max=10),
    dict(name="two_fields", kind="count", severity="required", table_name="lineitem",
         filter='{"l_returnflag": "R", "l_linenumber": 1}', expect_min=1),
    dict(name="no_table", kind="count", severity="advisory", table_name="nowhere", expect_min=1),
    dict(name="bad_column", kind="count", severity="advisory", table_name="orders", filter="o_nothing > 1", expect_min=1),
    dict(name="operator_doc", kind="count", severity="advisory", table_name="orders", filter='{"o_totalprice": {"$gt": 5}}', expect_min=1),
    dict(name="fresh_events", kind="count", severity="required", table_name="events",
         filter="ts >= TIMESTAMP_NTZ '2024-01-29 00:00:00'", expect_min=1, expect_max=1000000000),
]


def _duck_count(i, table, where, ok):
    c = COUNT_CHECKS[i]
    return (f"SELECT 'c{i:04d}' AS check_id, '{c['name']}' AS name, '{c['severity']}' AS severity, {ok} AS ok, "
            f"CAST(count(*) AS VARCHAR) AS got, false AS failed FROM {table} WHERE {where}")


def _duck_bad(i):
    c = COUNT_CHECKS[i]
    return f"SELECT 'c{i:04d}', '{c['name']}', '{c['severity']}', false, '', true"


B2 = " UNION ALL ".join([
    _duck_count(0, "orders", "true", "count(*) >= 1"),
    _duck_count(1, "orders", "o_orderpriority = '1-URGENT'", "count(*) >= 1"),
    _duck_count(2, "orders", "o_orderstatus = 'F'", "count(*) = 0"),
    _duck_count(3, "lineitem", "true", "count(*) <= 10"),
    _duck_count(4, "lineitem", "l_returnflag = 'R' AND l_linenumber = 1", "count(*) >= 1"),
    _duck_bad(5), _duck_bad(6), _duck_bad(7),
    _duck_count(8, "events", "ts >= TIMESTAMP '2024-01-29 00:00:00'", "count(*) >= 1")])


@query("B2_count_checks", B2)
def _(d):
    return shown(B.count_checks(d.spark, B.checks_table(d.spark, COUNT_CHECKS),
                                _snapshot(d, "orders", "lineitem", "events"), AS_OF))


@query("B3_json_filter", """SELECT o_orderkey, o_orderpriority FROM orders
    WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'""")
def _(d):
    return d.orders.filter(B.json_filter_to_expr('{"o_orderstatus": "O", "o_orderpriority": "1-URGENT"}')).select(
        "o_orderkey", "o_orderpriority")


FIELD_CHECKS = [
    dict(name="first_status", kind="field", severity="required", table_name="orders", filter="{}", field="o_orderstatus",
         order_by="o_orderkey", equals="O"),
    dict(name="first_urgent", kind="field", severity="required", table_name="orders",
         filter='{"o_orderpriority": "1-URGENT"}', field="o_custkey", order_by="o_orderdate, o_orderkey", expect_min=1),
    dict(name="no_match", kind="field", severity="advisory", table_name="orders", filter='{"o_orderkey": -5}',
         field="o_custkey", order_by="o_orderkey", equals="1"),
    dict(name="no_field", kind="field", severity="advisory", table_name="orders", filter="{}", field="o_missing",
         order_by="o_orderkey", equals="1"),
    dict(name="json_field", kind="field", severity="required", table_name="docs", filter="event_id > 10", field="props.k",
         order_by="event_id", expect_min=0),
    dict(name="event_time", kind="field", severity="required", table_name="docs", filter="event_type = 'error'", field="ts",
         order_by="event_id", max_age_s=31 * 86400),
]


def _duck_field(i, got, ok, failed="false"):
    c = FIELD_CHECKS[i]
    return (f"SELECT 'c{i:04d}' AS check_id, '{c['name']}' AS name, '{c['severity']}' AS severity, {ok} AS ok, "
            f"{got} AS got, {failed} AS failed")


_f0 = "(SELECT arg_min(o_orderstatus, o_orderkey) FROM orders)"
_f1 = "(SELECT CAST(arg_min(o_custkey, (o_orderdate, o_orderkey)) AS VARCHAR) FROM orders WHERE o_orderpriority = '1-URGENT')"
_f4 = "(SELECT arg_min(json_extract_string(props, '$.k'), event_id) FROM events WHERE event_id > 10)"
_f5 = "(SELECT arg_min(strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ'), event_id) FROM events WHERE event_type = 'error')"


@query("B4_field_checks", " UNION ALL ".join([
    _duck_field(0, _f0, f"{_f0} = 'O'"), _duck_field(1, _f1, "true"), _duck_field(2, "''", "false", "true"),
    _duck_field(3, "''", "false", "true"), _duck_field(4, _f4, "true"), _duck_field(5, _f5, "true")]))
def _(d):
    docs = d.events.withColumn("props", F.try_parse_json("props"))
    snapshot = Snapshot({"orders": d.orders, "docs": docs})
    return shown(B.field_checks(d.spark, B.checks_table(d.spark, FIELD_CHECKS), snapshot, AS_OF))


# Check definitions that come with the data: one per document.
FILE_CHECKS = """
    SELECT concat('f_', doc_id) AS check_id, CAST(doc_id AS INT) AS ord, concat('file_', doc_id) AS name,
           CASE WHEN doc_id % 4 = 0 THEN 'advisory' ELSE 'required' END AS severity,
           concat(source, '/', lang, '/doc_', doc_id, CASE WHEN doc_id % 5 = 0 THEN '.tmp' ELSE '.txt' END) AS path,
           CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS bool,
           CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'ff' ELSE <SHA(text)> END AS equals FROM documents"""


def _defs(d, text):
    df = d.sql(text)
    kinds = {f.split()[0]: f.split()[1] for f in B.CHECKS.replace("\n", " ").split(",")}
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])


@query("B5_file_exists", f"""
    WITH c AS ({FILE_CHECKS}), f AS (SELECT DISTINCT path FROM files)
    SELECT check_id, name, severity, (f.path IS NOT NULL) = coalesce(bool, true) AS ok,
           CASE WHEN f.path IS NOT NULL THEN 'true' ELSE 'false' END AS got, false AS failed
    FROM c LEFT JOIN f USING (path)""", "files")
def _(d):
    return shown(P.file_exists_checks(_defs(d, FILE_CHECKS), d.files))


GLOBS = ["'/*'", "'/*/*.txt'", "'/en/doc_?[0-4].*'", "'/*'", "'/nothing/*'"]
GLOB_CHECKS = " UNION ALL ".join(f"""
    SELECT concat('g_', source, '_{n}') AS check_id, {n} AS ord, concat(source, '_{n}') AS name, 'required' AS severity, concat(source, {g}) AS path,
           {"'find'" if n == 3 else "NULL"} AS dialect, 3.0 AS expect_min, 40.0 AS expect_max
    FROM (SELECT DISTINCT source FROM documents) s{n}""" for n, g in enumerate(GLOBS)) + """
    UNION ALL SELECT 'g_root', 9, 'root', 'required', '*', NULL, 1.0, NULL FROM (SELECT count(*) FROM documents) x
    UNION ALL SELECT 'g_hidden', 9, 'hidden', 'required', '.*.txt', NULL, 1.0, NULL FROM (SELECT count(*) FROM documents) x"""


@query("B6_file_count", f"""
    WITH c AS ({GLOB_CHECKS}),
    rx AS (SELECT *, CASE WHEN dialect = 'find' THEN replace(replace(path, '.', '\\.'), '*', '.*')
                          ELSE replace(replace(replace(path, '.', '\\.'), '*', '[^/]*'), '?', '[^/]') END AS re FROM c),
    -- The folder before a pattern's first wildcard is the files' own, at that depth, so each pattern meets the files of its folder only.
    ax AS (SELECT *, regexp_extract(split_part(split_part(path, '*', 1), '?', 1), '^(.*)/', 1) AS folder FROM rx),
    fx AS MATERIALIZED (SELECT path, unnest(range(0, len(string_split(path, '/')))) AS k FROM files),
    fk AS MATERIALIZED (SELECT path, array_to_string(string_split(path, '/')[1:k], '/') AS folder FROM fx),
    n AS (SELECT check_id, count(*) AS n FROM ax JOIN fk ON ax.folder = fk.folder WHERE regexp_full_match(fk.path, re, 's') GROUP BY 1)
    SELECT check_id, name, severity, coalesce(n, 0) >= expect_min AND coalesce(coalesce(n, 0) <= expect_max, true) AS ok,
           CAST(coalesce(n, 0) AS VARCHAR) AS got, false AS failed FROM c LEFT JOIN n USING (check_id)""", "files")
def _(d):
    return shown(P.file_count_checks(_defs(d, GLOB_CHECKS), d.files))


@query("B7_checksum", f"""
    WITH c AS ({FILE_CHECKS}), f AS (SELECT path, min(sha256) AS sha256 FROM files GROUP BY 1)
    SELECT check_id, name, severity, coalesce(f.sha256 = equals, false) AS ok,
           CASE WHEN equals IS NULL OR f.path IS NULL THEN '' ELSE f.sha256 END AS got,
           equals IS NULL OR f.path IS NULL AS failed FROM c LEFT JOIN f USING (path)""", "files")
def _(d):
    return shown(P.checksum_checks(_defs(d, FILE_CHECKS), d.files))


RESPONSE_CHECKS = [
    dict(name=f"svc_{i}", severity="required", url=f"http://svc/{i}", expect_status=200 if i % 2 else None,
         expect_body_contains='"k"' if i % 3 == 0 else None, expect_json=["k=7", "k.x=1", "z=1", None][i % 4])
    for i in range(50)
]


def _response_sql(text="k"):
    return """
    SELECT event_id, concat('svc_', event_id % 50) AS name, CAST(status AS VARCHAR) AS got,
           status = 200 AND (event_id % 50 % 3 > 0 OR contains(body, '"k"')) AND
           CASE event_id % 50 % 4 WHEN 0 THEN coalesce(json_extract_string(body, '$.k') = '7', false) WHEN 3 THEN true ELSE false END AS ok,
           CASE WHEN status <> 200 THEN 'status 500, want 200'
                WHEN event_id % 50 % 4 = 0 AND json_extract_string(body, '$.k') <> '7' THEN concat('k = "', json_extract_string(body, '$.k'), '", want "7"')
                WHEN event_id % 50 % 4 = 1 THEN 'at "k.x": a scalar has no "x"'
                WHEN event_id % 50 % 4 = 2 THEN 'at "z": no key "z"' END AS detail FROM responses"""


@query("B8_responses", _response_sql(), "responses")
def _(d):
    checks = B.checks_table(d.spark, [dict(kind="response", **c) for c in RESPONSE_CHECKS])
    return P.judge_responses(checks, d.responses).select("event_id", "name", "got", "ok", "detail")


@query("B8_newest_response", """
    WITH n AS (SELECT max(event_id) AS event_id FROM responses GROUP BY url)
    SELECT event_id % 50 AS service, status = 200 AS up FROM responses JOIN n USING (event_id)
    UNION ALL SELECT 50, false""", "responses")
def _(d):
    checks = B.checks_table(d.spark, [dict(kind="response", name=str(i), url=f"http://svc/{i}") for i in range(51)])
    return P.response_checks(checks, d.responses).select(F.col("ord").alias("service"), F.col("ok").alias("up"))


CAPTURES = """
    SELECT concat('cap_', doc_id % 30) AS capture, doc_id AS captured_at, text AS stdout, doc_id % 4 AS exit_code FROM documents"""
EXITS = [dict(name=f"cap_{i}", severity="required", kind="exit", capture=f"cap_{i}", equals="no such text" if i % 5 == 0 else None)
         for i in range(30)]


@query("B9_exit_codes", f"""
    WITH c AS ({CAPTURES}) SELECT captured_at, capture AS name,
      CASE WHEN captured_at % 30 % 5 = 0 THEN false ELSE exit_code = 0 END AS ok,
      CASE WHEN captured_at % 30 % 5 = 0 THEN stdout ELSE concat('exit ', exit_code) END AS got,
      CASE WHEN captured_at % 30 % 5 = 0 THEN 'want no such text' WHEN exit_code <> 0
           THEN regexp_replace(string_split(stdout, <NL>)[1], '^[\\s\\x0b\\x{{85}}\\pZ]+|[\\s\\x0b\\x{{85}}\\pZ]+$', '', 'g') END AS detail FROM c""")
def _(d):
    return P.judge_exits(B.checks_table(d.spark, EXITS), d.sql(CAPTURES)).select("captured_at", "name", "ok", "got", "detail")


def _row_count_kind(spark, checks, snapshot, as_of):
    """An own kind: the table must have at least ``expect_min`` distinct values of ``field``."""
    out = None
    for c in checks.collect():
        n = snapshot.tables[c["table_name"]].agg(F.count_distinct(c["field"]).alias("n")).withColumn("check_id", F.lit(c["check_id"]))
        out = n if out is None else out.unionByName(n)
    return B.results(checks.join(out, "check_id").withColumns({
        "got": F.col("n").cast("string"), "ok": F.col("n") >= F.col("expect_min")}))


@query("B10_register_check_kind", """
    SELECT 'c0000' AS check_id, 'customers' AS name, 'required' AS severity, count(DISTINCT o_custkey) >= 10 AS ok,
           CAST(count(DISTINCT o_custkey) AS VARCHAR) AS got, false AS failed FROM orders
    UNION ALL SELECT 'c0001', 'who_knows', 'required', false, '', true
    UNION ALL SELECT 'c0002', 'blank_kind', 'required', count(*) >= 1, CAST(count(*) AS VARCHAR), false FROM orders""")
def _(d):
    if "distinct_values" not in check_kinds():
        register_check_kind("distinct_values", _row_count_kind)
    checks = B.checks_table(d.spark, [
        dict(name="customers", kind="distinct_values", table_name="orders", field="o_custkey", expect_min=10),
        dict(name="who_knows", kind="crystal_ball"),
        dict(name="blank_kind", kind="", sql="SELECT count(*) FROM orders", expect_min=1)])
    return shown(B.run_checks(d.spark, checks, Snapshot({"orders": d.orders}), AS_OF))


ALL_CHECKS = ([dict(kind="sql", **c) for c in SQL_CHECKS] + COUNT_CHECKS)


@query("B11_run_checks", f"""
    SELECT * FROM ({B1.replace("epoch_us(max(ts))", "epoch_us(date_trunc('second', max(ts)))")}) UNION ALL
    SELECT concat('c', lpad(CAST(CAST(check_id[2:] AS INT) + {len(SQL_CHECKS)} AS VARCHAR), 4, '0')), name, severity, ok, got, failed FROM ({B2})""")
def _(d):
    snapshot = _snapshot(d, "orders", "region", "lineitem")
    snapshot.tables["events"] = d.events.withColumn("ts", F.date_trunc("second", "ts").cast("timestamp_ntz"))
    return shown(B.run_checks(d.spark, B.checks_table(d.spark, ALL_CHECKS), snapshot, AS_OF))


# One definition per order, with every kind of mistake somewhere.
DEFINITIONS = """
    SELECT concat('v_', o_orderkey) AS check_id, CAST(o_orderkey AS INT) AS ord,
           CASE WHEN o_orderkey % 29 = 0 THEN '' ELSE concat('n_', o_orderkey) END AS name,
           CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'advisory' WHEN 2 THEN 'urgent' ELSE 'required' END AS severity,
           CASE o_custkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'sql' WHEN 2 THEN 'file_exists' WHEN 3 THEN 'file_count' WHEN 4 THEN 'checksum'
             WHEN 5 THEN 'response' WHEN 6 THEN 'count' WHEN 7 THEN 'field' ELSE 'magic' END AS kind,
           CASE WHEN o_orderkey % 5 > 0 THEN 'SELECT 1' END AS sql, CASE WHEN o_orderkey % 3 > 0 THEN 'p' END AS path,
           CASE WHEN o_orderkey % 4 > 0 THEN 'u' END AS url, CASE WHEN o_orderkey % 6 > 0 THEN 't' END AS table_name,
           CASE WHEN o_orderkey % 8 > 0 THEN '{}' END AS filter, CASE WHEN o_orderkey % 10 > 0 THEN 'f' END AS field,
           CASE WHEN o_orderkey % 2 = 0 THEN 1.0 END AS expect_min, CASE WHEN o_orderkey % 12 = 0 THEN 9.0 END AS expect_max,
           CASE WHEN o_orderkey % 11 < 4 THEN 'x' END AS equals, CASE WHEN o_orderkey % 13 = 0 THEN 60 END AS max_age_s,
           CASE WHEN o_orderkey % 17 = 0 THEN true END AS bool, o_orderkey % 19 = 0 AS keep_literal,
           CASE o_custkey % 4 WHEN 0 THEN 'tree' WHEN 1 THEN 'database' WHEN 2 THEN 'documents' ELSE 'service' END AS target_type
    FROM orders"""


@query("B12_validate_checks", f"""
    WITH c AS ({DEFINITIONS}),
    k AS (SELECT *, CASE WHEN kind = '' THEN 'sql' ELSE kind END AS kd,
            (expect_min IS NOT NULL OR expect_max IS NOT NULL) AS bounds FROM c),
    x AS (SELECT *, bounds::INT + (equals IS NOT NULL)::INT + (max_age_s IS NOT NULL)::INT + (bool IS NOT NULL)::INT AS ne,
            CASE WHEN kd IN ('file_exists', 'file_count', 'checksum') THEN target_type <> 'tree' WHEN kd = 'response' THEN target_type <> 'service'
                 WHEN kd IN ('count', 'field') THEN target_type <> 'documents' ELSE false END AS nocap FROM k),
    r AS (SELECT check_id, unnest(list_filter([
        CASE WHEN name = '' THEN 1 END, CASE WHEN severity = 'urgent' THEN 2 END, CASE WHEN keep_literal AND equals IS NULL THEN 3 END,
        CASE WHEN kd = 'magic' THEN 4 END, CASE WHEN nocap THEN 5 END, CASE WHEN kd = 'sql' AND sql IS NULL THEN 6 END,
        CASE WHEN kd = 'sql' AND ne = 0 THEN 7 END, CASE WHEN kd = 'sql' AND ne > 1 THEN 8 END,
        CASE WHEN kd IN ('file_exists', 'file_count', 'checksum') AND path IS NULL THEN 9 END,
        CASE WHEN kd = 'checksum' AND equals IS NULL THEN 10 END, CASE WHEN kd = 'file_count' AND NOT bounds THEN 11 END,
        CASE WHEN kd = 'response' AND url IS NULL THEN 13 END, CASE WHEN kd IN ('count', 'field') AND table_name IS NULL THEN 14 END,
        CASE WHEN kd = 'field' AND filter IS NULL THEN 15 END, CASE WHEN kd = 'field' AND field IS NULL THEN 16 END,
        CASE WHEN kd = 'count' AND NOT bounds AND equals IS NULL THEN 17 END,
        CASE WHEN kd = 'field' AND NOT bounds AND equals IS NULL AND max_age_s IS NULL THEN 18 END], lambda v: v IS NOT NULL)) AS rule_no FROM x)
    SELECT check_id, rule_no, rule_no = min(rule_no) OVER (PARTITION BY check_id) AS is_first FROM r""")
def _(d):
    capabilities = d.spark.createDataFrame(
        [("tree", "file-probe"), ("service", "http-probe"), ("documents", "document")], "target_type string, capability string")
    defs = _defs(d, DEFINITIONS).join(d.sql(DEFINITIONS).select("check_id", "target_type"), "check_id")
    return B.validate_checks(defs, F.col("target_type"), capabilities).select("check_id", "rule_no", "is_first")


@query("B13_default_checks", f"""
    WITH c AS ({DEFINITIONS}) SELECT check_id, CASE WHEN severity = '' THEN 'required' ELSE severity END AS severity,
      CASE WHEN kind = '' THEN 'sql' ELSE kind END AS kind FROM c""")
def _(d):
    return B.default_checks(d.sql(DEFINITIONS)).select("check_id", "severity", "kind")


# -- expectations ----------------------------------------------------------------------------------

# Scalars as text, of every reading, good and bad.
SCALARS = """
    SELECT o_orderkey AS id, CASE o_orderkey % 12
        WHEN 0 THEN CAST(o_custkey AS VARCHAR(20)) WHEN 1 THEN concat(' ', o_custkey) WHEN 2 THEN concat('-', o_custkey, '.50')
        WHEN 3 THEN concat(o_custkey, 'e2') WHEN 4 THEN 'NaN' WHEN 5 THEN concat(<DAY(o_orderdate)>, ' 10:00:00')
        WHEN 6 THEN concat(<DAY(o_orderdate)>, 'T10:00:00.25Z') WHEN 7 THEN concat(<DAY(o_orderdate)>, ' 10:00:00+02')
        WHEN 8 THEN <DAY(o_orderdate)> WHEN 9 THEN CASE WHEN o_custkey % 2 = 0 THEN ' True ' ELSE 'f' END
        WHEN 10 THEN o_orderstatus ELSE concat(o_custkey, 'd') END AS got,
      CASE WHEN o_custkey % 4 = 0 THEN 100.0 END AS expect_min, CASE WHEN o_custkey % 8 = 0 THEN 500.0 END AS expect_max,
      CASE WHEN o_custkey % 4 = 1 THEN 'O' END AS equals, CASE WHEN o_custkey % 4 = 2 THEN CAST(900000000 AS BIGINT) END AS max_age_s,
      CASE WHEN o_custkey % 4 = 3 AND o_custkey % 3 > 0 THEN true END AS bool FROM orders"""
NUM = "CASE WHEN regexp_full_match(got, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(got AS DOUBLE) END"
DATE = "[0-9]{4}-[0-9]{2}-[0-9]{2}"
CLOCK = "[0-9]{1,2}:[0-9]{2}:[0-9]{2}(\\.[0-9]+)?"
TS = f"""CASE WHEN regexp_full_match(got, '{DATE}') OR regexp_full_match(got, '{DATE} {CLOCK}') THEN epoch_us(TRY_CAST(got AS TIMESTAMP))
    WHEN regexp_full_match(got, '{DATE} {CLOCK}[+-][0-9]{{2}}') OR regexp_full_match(got, '{DATE}T{CLOCK}(Z|[+-][0-9]{{2}}:[0-9]{{2}})')
    THEN epoch_us(TRY_CAST(got AS TIMESTAMPTZ)) END"""
BOOL = "CASE WHEN lower(trim(got)) IN ('t', 'true', '1') THEN true WHEN lower(trim(got)) IN ('f', 'false', '0') THEN false END"
READ = f"s AS ({SCALARS}), r AS (SELECT *, {NUM} AS num, {TS} AS us, {BOOL} AS flag FROM s)"


def _expect(d, fn):
    return d.sql(SCALARS).withColumn("r", fn).select("id", "r.ok", F.col("r.error").isNotNull().alias("failed"))


@query("E1_expect_bounds", f"""WITH {READ} SELECT id, coalesce(num >= 100 AND num <= 500, false) AS ok, num IS NULL AS failed FROM r""")
def _(d):
    return _expect(d, E.expect_bounds("got", F.lit(100.0), F.lit(500.0)))


@query("E2_expect_equals", f"WITH {READ} SELECT id, got = 'O' AS ok, CASE WHEN got <> 'O' THEN 'want \"O\"' END AS detail FROM r")
def _(d):
    return d.sql(SCALARS).withColumn("r", E.expect_equals("got", F.lit("O"))).select("id", "r.ok", "r.detail")


@query("E3_expect_max_age", f"""WITH {READ} SELECT id, coalesce({AS_OF_EPOCH}000000 - us <= 900000000000000, false) AS ok,
    us IS NULL AS failed FROM r""")
def _(d):
    return _expect(d, E.expect_max_age("got", F.lit(900000000).cast("bigint"), AS_OF))


@query("E4_expect_bool", f"WITH {READ} SELECT id, coalesce(flag, false) AS ok, flag IS NULL AS failed FROM r")
def _(d):
    return _expect(d, E.expect_bool("got", F.lit(True)))


@query("E5_evaluate_expectations", f"""
    WITH {READ} SELECT id, num AS got_num, CASE WHEN expect_min IS NOT NULL OR expect_max IS NOT NULL
        THEN coalesce(num >= expect_min AND coalesce(num <= expect_max, true), false)
      WHEN equals IS NOT NULL THEN got = equals WHEN max_age_s IS NOT NULL THEN coalesce({AS_OF_EPOCH}000000 - us <= max_age_s * 1000000, false)
      WHEN bool IS NOT NULL THEN coalesce(flag = bool, false) ELSE false END AS ok,
      CASE WHEN expect_min IS NOT NULL THEN num IS NULL WHEN equals IS NOT NULL THEN false
           WHEN max_age_s IS NOT NULL THEN us IS NULL WHEN bool IS NOT NULL THEN flag IS NULL ELSE true END AS failed FROM r""")
def _(d):
    out = E.evaluate_expectations(d.sql(SCALARS), AS_OF)
    return out.select("id", "got_num", "ok", F.col("error").isNotNull().alias("failed"))


@query("E6_parse_text", f"""WITH {READ} SELECT id, num, us, flag,
    coalesce(CASE WHEN regexp_full_match(trim(got), '[+-]?[0-9]+') THEN TRY_CAST(trim(got) AS BIGINT) END, 0) AS whole FROM r""")
def _(d):
    return d.sql(SCALARS).select("id", scalars.parse_num_text("got").alias("num"),
                                 F.unix_micros(scalars.parse_ts_text("got")).alias("us"),
                                 scalars.parse_bool_text("got").alias("flag"), scalars.scalar_int("got").alias("whole"))


SPANS = """
    SELECT event_id AS id, user_id % 50 AS h, event_id % 60 AS m, user_id % 7 AS w, CASE event_id % 8
      WHEN 0 THEN concat(user_id % 50, 'h', event_id % 60, 'm') WHEN 1 THEN concat(event_id % 60, '.5s') WHEN 2 THEN concat('-', user_id % 50, 'h')
      WHEN 3 THEN concat(event_id % 60, 'ms') WHEN 4 THEN concat(user_id % 7, 'd') WHEN 5 THEN concat(user_id % 7, 'w')
      WHEN 6 THEN concat(user_id % 50, ' h') ELSE '0' END AS span FROM events"""


@query("E7_parse_duration", f"""
    WITH s AS ({SPANS}) SELECT id, CASE id % 8 WHEN 0 THEN h * 3600000 + m * 60000 WHEN 1 THEN m * 1000 + 500 WHEN 2 THEN h * -3600000
      WHEN 3 THEN m WHEN 7 THEN 0 END AS millis,
      CASE WHEN id % 8 = 4 AND w > 0 THEN w * 86400 WHEN id % 8 = 5 AND w > 0 THEN w * 604800 END AS every_s FROM s""")
def _(d):
    return d.sql(SPANS).select("id", F.round(scalars.parse_duration_text("span") * 1000).cast("bigint").alias("millis"),
                               scalars.parse_interval_text("span").alias("every_s"))


# -- JSON ------------------------------------------------------------------------------------------

ASSERTIONS = """
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat(' a.b = c=', user_id) WHEN 1 THEN concat('=', user_id)
      WHEN 2 THEN 'nothing' ELSE 'k=' END AS spec FROM events"""


@query("J1_split_path_value", f"""
    WITH a AS ({ASSERTIONS}) SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a.b' WHEN 3 THEN 'k' END AS path,
      CASE event_id % 4 WHEN 0 THEN spec[7:] WHEN 3 THEN '' END AS value, event_id % 4 IN (1, 2) AS failed FROM a""")
def _(d):
    return d.sql(ASSERTIONS).withColumn("s", jsonpath.split_path_value("spec")).select(
        "event_id", "s.path", "s.value", F.col("s.error").isNotNull().alias("failed"))


BODIES = """
    SELECT event_id, CASE WHEN event_id % 23 = 0 THEN 'not json' ELSE concat('{"k":', props, ',"items":[{"id":', event_id, ',"ok":true},null,"x y",',
      event_id % 10, '.50],"0":"zero","n":', user_id, '.0,"name":"', event_type, '"}') END AS body,
      CASE event_id % 10 WHEN 0 THEN 'items.0.id' WHEN 1 THEN 'items.1' WHEN 2 THEN 'items.3' WHEN 3 THEN 'n' WHEN 4 THEN 'k.k'
        WHEN 5 THEN 'items.9' WHEN 6 THEN 'items.a' WHEN 7 THEN 'name.x' WHEN 8 THEN '0' ELSE 'items.0.ok' END AS path FROM events"""


@query("J2_json_path_text", f"""
    WITH b AS ({BODIES}) SELECT event_id, CASE WHEN event_id % 23 = 0 THEN 'the body cannot be parsed as JSON' WHEN event_id % 10 = 5
        THEN 'at "items.9": the array ends before 9' WHEN event_id % 10 = 6 THEN 'at "items.a": an array has no "a"'
        WHEN event_id % 10 = 7 THEN 'at "name.x": a scalar has no "x"' END AS error,
      CASE WHEN event_id % 23 = 0 THEN NULL ELSE CASE event_id % 10 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN 'null'
        WHEN 2 THEN concat(event_id % 10, '.5') WHEN 3 THEN json_extract_string(body, '$.n').replace('.0', '')
        WHEN 4 THEN json_extract_string(body, '$.k.k') WHEN 8 THEN 'zero' WHEN 9 THEN 'true' END END AS value FROM b""")
def _(d):
    return d.sql(BODIES).withColumn("r", jsonpath.json_path("body", "path")).select("event_id", "r.value", "r.error")


@query("J3_json_scalar_text", """
    SELECT event_id, json_extract_string(props, '$.k') AS k, regexp_replace(CAST(user_id AS VARCHAR) || '.25', '^$', '') AS part,
           '{"k":' || json_extract_string(props, '$.k') || '}' AS whole FROM events""")
def _(d):
    part = F.try_parse_json(F.concat(F.col("user_id").cast("string"), F.lit(".250")))
    v = F.try_parse_json("props")
    return d.events.select("event_id", jsonpath.json_scalar_text(F.try_variant_get(v, "$.k", "variant")).alias("k"),
                           jsonpath.json_scalar_text(part).alias("part"), jsonpath.json_scalar_text(v).alias("whole"))


# -- integrity -------------------------------------------------------------------------------------

@query("C1_null_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls FROM results"
    for c in ("run_id", "ord", "ok", "severity", "detail", "error")), "results")
def _(d):
    return C.null_profile(d.results, ["run_id", "ord", "ok", "severity", "detail", "error"])


def _violations(name, source, where, key, count="count(*)"):
    return (f"SELECT '{name}' AS name, count(*) = 0 AS ok, CAST(coalesce({count}, 0) AS BIGINT) AS violations, "
            f"{key('min')} AS first_key, {key('max')} AS last_key FROM {source} WHERE {where}")


@query("C1_not_null", " UNION ALL ".join(
    _violations(f"{c}_not_null", "results", f"{c} IS NULL", lambda f: f"{f}(check_id)") for c in ("ok", "error", "run_id")),
    "results")
def _(d):
    return C.not_null_check(d.results, ["ok", "error", "run_id"], ["check_id"])


def _pair(a, b):
    return lambda f: f"CASE WHEN count(*) > 0 THEN concat(arg_{f}({a}, ({a}, {b})), '|', arg_{f}({b}, ({a}, {b}))) END"


@query("C2_unique", " UNION ALL ".join([
    _violations("line_unique", "(SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)", "true",
                _pair("l_orderkey", "l_linenumber")),
    _violations("part_unique", "(SELECT l_orderkey, l_partkey FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)", "true",
                _pair("l_orderkey", "l_partkey"))]))
def _(d):
    return C.unique_check(d.lineitem, ["l_orderkey", "l_linenumber"], "line_unique").unionByName(
        C.unique_check(d.lineitem, ["l_orderkey", "l_partkey"], "part_unique"))


@query("C3_foreign_key", " UNION ALL ".join([
    _violations("line_order", "lineitem", "l_orderkey NOT IN (SELECT o_orderkey FROM orders)", lambda f: f"CAST({f}(l_orderkey) AS VARCHAR)"),
    _violations("event_customer", "events", "user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)",
                lambda f: f"CAST({f}(user_id) AS VARCHAR)")]))
def _(d):
    return C.foreign_key_check(d.lineitem, ["l_orderkey"], d.orders, ["o_orderkey"], "line_order").unionByName(
        C.foreign_key_check(d.events, ["user_id"], d.customer.filter("c_nationkey < 20"), ["c_custkey"], "event_customer"))


RULES = {"positive": "l_quantity > 0", "small_discount": "l_discount <= 0.09", "flag_enum": "l_returnflag IN ('A', 'N', 'R')",
         "null_passes": "CASE WHEN l_tax > 0.05 THEN l_quantity < 45 END"}


@query("C4_predicates", " UNION ALL ".join(
    _violations(n, "lineitem", f"NOT ({r})", _pair("l_orderkey", "l_linenumber")) for n, r in RULES.items()))
def _(d):
    return C.predicate_check(d.lineitem, RULES, ["l_orderkey", "l_linenumber"])


@query("C5_generated_column", _violations(
    "n_chars_generated", "documents", "n_chars IS DISTINCT FROM length(text)", lambda f: f"CAST({f}(doc_id) AS VARCHAR)")
    + " UNION ALL " + _violations("lang_generated", "documents", "lang <> 'en'", lambda f: f"CAST({f}(doc_id) AS VARCHAR)"))
def _(d):
    return C.generated_column_check(d.documents, {"n_chars": "length(text)", "lang": F.lit("en")}, ["doc_id"])


@query("C6_overlaps", """
    SELECT id, room_id, <EPOCH(earlier)> AS earlier_upper FROM (
      SELECT *, max(upper_ts) OVER (PARTITION BY room_id ORDER BY lower_ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier
      FROM bookings) WHERE earlier > lower_ts""", "bookings")
def _(d):
    return C.overlaps(d.bookings, ["room_id"], "lower_ts", "upper_ts", "id").select(
        "id", "room_id", scalars.epoch("earlier_upper").alias("earlier_upper"))


@query("C6_no_overlap_check", """
    SELECT 'room' AS name, count(*) = 0 AS ok, count(*) AS violations, CAST(min(id) AS VARCHAR) AS first_key, CAST(max(id) AS VARCHAR) AS last_key
    FROM (SELECT *, max(upper_ts) OVER (PARTITION BY room_id ORDER BY lower_ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier
          FROM bookings) WHERE earlier > lower_ts""", "bookings")
def _(d):
    return C.no_overlap_check(d.bookings, ["room_id"], "lower_ts", "upper_ts", "id", "room")


ROUTED = """
    SELECT event_id, event_type, user_id, CASE WHEN event_id % 10 = 0 THEN 'rest' WHEN event_type IN ('view', 'click') THEN 'web'
      WHEN event_type = 'error' THEN 'bad' ELSE 'rest' END AS part, CASE WHEN user_id < 50 THEN 'low' WHEN user_id < 100 THEN 'mid' ELSE 'high' END AS band FROM events"""


@query("C7_partition_routing", f"""
    WITH r AS ({ROUTED}) SELECT part AS partition, count(*) AS rows, count(*) FILTER (WHERE part <> CASE WHEN event_type IN ('view', 'click')
      THEN 'web' WHEN event_type = 'error' THEN 'bad' ELSE 'rest' END) AS misrouted FROM r GROUP BY 1
    UNION ALL SELECT band, count(*), count(*) FILTER (WHERE band <> CASE WHEN user_id < 40 THEN 'low' WHEN user_id < 100 THEN 'mid' ELSE 'high' END)
    FROM r GROUP BY 1""")
def _(d):
    routed = d.sql(ROUTED)
    by_list = C.partition_routing_check(routed, "part", "event_type", [
        {"name": "web", "values": ["view", "click"]}, {"name": "bad", "values": ["error"]}, {"name": "rest", "default": True}])
    by_range = C.partition_routing_check(routed, "band", "user_id", [
        {"name": "low", "to": 40}, {"name": "mid", "from": 40, "to": 100}, {"name": "high", "from": 100}])
    return by_list.unionByName(by_range)


STORED = """
    SELECT l_orderkey, count(*) + CASE WHEN l_orderkey % 50 = 0 THEN 1 ELSE 0 END AS lines, CAST(sum(<INT(l_quantity)>) AS BIGINT) AS quantity
    FROM lineitem GROUP BY l_orderkey"""
FRESH = "SELECT l_orderkey, count(*) AS lines, CAST(sum(<INT(l_quantity)>) AS BIGINT) AS quantity FROM lineitem WHERE l_orderkey % 70 <> 3 GROUP BY l_orderkey"


@query("C8_derived_table", f"""
    WITH s AS ({STORED}), f AS ({FRESH})
    SELECT *, 'stored_only' AS side, 1 AS copies FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM f)
    UNION ALL SELECT *, 'recomputed_only', 1 FROM (SELECT * FROM f EXCEPT ALL SELECT * FROM s)""")
def _(d):
    return C.derived_table_check(d.sql(STORED), d.sql(FRESH))


COPY = """
    SELECT o_orderkey + CASE WHEN o_orderkey % 90 = 1 THEN 100000000 ELSE 0 END AS o_orderkey, o_custkey,
      CASE WHEN o_orderkey % 40 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
    FROM orders WHERE o_orderkey % 60 <> 7"""


@query("C9_snapshot_diff", f"""
    WITH b AS ({COPY}) SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
      CASE WHEN a.o_orderkey IS NULL THEN 'extra' WHEN b.o_orderkey IS NULL THEN 'missing' ELSE 'changed' END AS change
    FROM orders a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus <> b.o_orderstatus""")
def _(d):
    return C.snapshot_diff(d.orders, d.sql(COPY), ["o_orderkey"]).select("o_orderkey", "change")


@query("C9_keyless_diff", f"""
    WITH a AS (SELECT o_custkey, o_orderstatus FROM orders), b AS (SELECT o_custkey, o_orderstatus FROM ({COPY}))
    SELECT CAST(sum(na) AS BIGINT) AS only_a, CAST(sum(nb) AS BIGINT) AS only_b FROM (SELECT greatest(sum(x), 0) AS na, greatest(-sum(x), 0) AS nb FROM
      (SELECT *, 1 AS x FROM a UNION ALL SELECT *, -1 FROM b) GROUP BY o_custkey, o_orderstatus)""")
def _(d):
    narrow = lambda df: df.select("o_custkey", "o_orderstatus")
    return C.snapshot_diff(narrow(d.orders), narrow(d.sql(COPY))).agg(
        F.sum("only_a").alias("only_a"), F.sum("only_b").alias("only_b"))


def _digest(*cols):
    text = " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in cols)
    return f"CAST(sum(('0x' || left(sha256({text}), 15))::BIGINT::HUGEINT) AS VARCHAR)"


@query("C10_table_fingerprint", f"""
    SELECT 'documents' AS "table", count(*) AS rows, {_digest('doc_id', 'text', 'lang', 'source', 'n_chars')} AS fingerprint FROM documents
    UNION ALL SELECT 'results', count(*), {_digest('run_id', 'check_id', 'ord', 'name', 'ok', 'severity', 'got', 'detail', 'error', 'keep_literal')} FROM results""",
       "results")
def _(d):
    make = lambda n, df: C.table_fingerprint(df).withColumn("table", F.lit(n))
    return make("documents", d.documents).unionByName(make("results", d.results))
