"""Registry and derived views. A derived view is one SQL text that both engines run."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")
AS_OF = "2024-01-31 00:00:00"
AS_OF_EPOCH = 1706659200

# Spellings that differ: (Spark, DuckDB); X is the argument.
SPELLING = {
    "SHA": ("sha2(X, 256)", "sha256(X)"),
    "EPOCH": ("(unix_micros(CAST(X AS TIMESTAMP)) DIV 1000000)", "(epoch_us(X) // 1000000)"),
    "DAY": ("date_format(X, 'yyyy-MM-dd')", "strftime(X, '%Y-%m-%d')"),
    "INT": ("CAST(X AS BIGINT)", "CAST(trunc(X) AS BIGINT)"),
    "NL": ("char(10)", "chr(10)"),
}

VIEWS: dict[str, str] = {
    "attestations": """
        SELECT concat('t_', user_id % 10) AS tenant_id, event_type AS target, event_id,
               concat('att_', event_id) AS id, <EPOCH(ts)> AS created_at, 'notary' AS method,
               CASE WHEN value < 5 THEN 'fail' ELSE 'pass' END AS verdict,
               <SHA(props)> AS report_sha256, props AS report_raw
        FROM events""",
    "monitors": """
        SELECT concat('m_', tenant_id, '_', target) AS monitor_id, tenant_id, target,
               CAST(1704067200 AS BIGINT) AS created_at,
               CAST(CASE target WHEN 'error' THEN 3600 WHEN 'click' THEN 7200 ELSE 86400 END AS BIGINT) AS interval_s,
               CAST(1800 AS BIGINT) AS grace_s,
               CASE target WHEN 'view' THEN 'alerting' ELSE 'ok' END AS alert_state
        FROM (SELECT DISTINCT concat('t_', user_id % 10) AS tenant_id, event_type AS target FROM events) d
        UNION ALL
        SELECT 'm_never', 't_0', 'absent', CAST(1704067200 AS BIGINT), CAST(86400 AS BIGINT), CAST(1800 AS BIGINT), 'ok'""",
    "backups": """
        SELECT concat('unit_', o_custkey % 25) AS unit, o_orderkey AS ord, concat('b_', o_orderkey) AS label,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'full' WHEN '2-HIGH' THEN 'diff' ELSE 'incr' END AS type,
               o_orderdate AS ts,
               CASE WHEN o_orderstatus = 'F' OR o_custkey % 25 = 7 THEN 'fail' ELSE 'pass' END AS verdict
        FROM orders""",
    "units": """
        SELECT DISTINCT concat('unit_', o_custkey % 25) AS unit, 0 AS status_code, '' AS status_message FROM orders
        UNION ALL SELECT 'unit_empty', 0, ''
        UNION ALL SELECT 'unit_down', 2, 'missing stanza path'
        UNION ALL SELECT 'unit_odd', 3, ''""",
    "snapshots": """
        SELECT concat('s_', year(o_orderdate)) AS snapshot_id, o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate
        FROM orders""",
    "files": """
        SELECT concat(source, '/', lang, '/doc_', doc_id, CASE WHEN doc_id % 17 = 0 THEN '.tmp' ELSE '.txt' END) AS path,
               n_chars AS size, <SHA(text)> AS sha256 FROM documents
        UNION ALL
        SELECT concat(source, '/note_', doc_id, '.md'), n_chars, <SHA(lang)> FROM documents WHERE n_chars > 2000
        UNION ALL
        SELECT concat(CASE WHEN item_id % 5 = 0 THEN '.' ELSE '' END, 'item_', item_id, '.txt'), length(text), <SHA(text)>
        FROM benchmark""",
    "secrets": """
        SELECT concat('TOKEN_', substr(<SHA(v)>, 1, 8)) AS name, v AS value, <SHA(v)> AS ord
        FROM (SELECT DISTINCT regexp_extract(text, 'token = "([0-9a-f]{40})"', 1) AS v FROM documents) d WHERE v <> ''""",
    # Credential shapes, put together from parts so that no file here contains one.
    "planted": """
        SELECT doc_id AS id, doc_id % 9 AS kind,
               concat(text, CASE doc_id % 9
                 WHEN 0 THEN concat(' key AK', 'IA', repeat('X', 16), ' ok')
                 WHEN 1 THEN concat(' -----BEGIN RSA ', 'PRIVATE', ' KEY----- x')
                 WHEN 2 THEN concat(' Authorization: Be', 'arer ', repeat('a', 24))
                 WHEN 3 THEN concat(' postgres:', '//app:', repeat('p', 8), '@db:5432/prod')
                 WHEN 4 THEN concat(' postgres:', '//app:', '[REDACTED:PGPASS]', '@db:5432/prod')
                 WHEN 5 THEN concat('é', 'AK', 'IA', repeat('Y', 16))
                 ELSE '' END) AS text
        FROM documents""",
    "responses": """
        SELECT event_id, concat('http://svc/', event_id % 50) AS url,
               CASE event_type WHEN 'error' THEN 500 ELSE 200 END AS status, props AS body, event_id AS captured_at
        FROM events""",
    "setting_lines": """
        SELECT concat('u_', user_id % 5) AS unit, event_id % 2 AS file_rank, event_id AS line_no,
               concat(' ', event_type, ' = ''', event_id % 7, ''' # note') AS line FROM events
        UNION ALL
        SELECT concat('u_', user_id % 5), event_id % 2, event_id,
               concat('Shared_Preload_Libraries = ''lib_', event_id % 3, ', "lib#', event_id % 4, '",,'' # x') FROM events""",
    "bookings": """
        SELECT o_orderkey AS id, o_custkey % 50 AS room_id, o_orderdate AS lower_ts,
               o_orderdate + INTERVAL 1 DAY AS upper_ts FROM orders""",
    "versions": """
        SELECT p_partkey, concat(CASE WHEN p_size % 2 = 0 THEN 'v' ELSE '' END, p_partkey % 3, '.', p_size % 5, '.',
               p_partkey % 7, CASE WHEN p_partkey % 11 = 0 THEN '-dev' ELSE '' END) AS version FROM part""",
    "orgs": """
        SELECT concat('t_', n_nationkey) AS org_id, concat('msp_', n_regionkey) AS parent_org_id,
               CASE WHEN n_nationkey % 2 = 0 THEN 'private' ELSE 'public' END AS ledger_visibility FROM nation""",
    "memberships": """
        SELECT concat('a_', c_custkey) AS account_id,
               CASE WHEN c_custkey % 20 = 0 THEN concat('msp_', n_regionkey) ELSE concat('t_', c_nationkey) END AS org_id,
               CASE c_custkey % 4 WHEN 0 THEN 'owner' WHEN 1 THEN 'admin' WHEN 2 THEN 'member' ELSE 'viewer' END AS role
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    # Runs: an order is a run, its lines are the results of the run's checks.
    "loads": """
        SELECT concat('r_', o_orderkey) AS run_id, concat('target_', o_custkey % 40) AS target, '1.0.0' AS tool_version,
               o_orderdate AS started_at, o_orderdate + INTERVAL 90 SECOND AS finished_at,
               o_orderstatus <> 'P' OR o_orderkey % 3 > 0 AS ok, 'copy' AS method, 'db' AS database,
               CAST(1500 AS BIGINT) AS load_ms,
               CASE WHEN o_orderkey % 10 = 0 THEN concat('load ignored ', o_orderkey % 4, ' error(s)') END AS warnings,
               CASE WHEN NOT (o_orderstatus <> 'P' OR o_orderkey % 3 > 0) THEN 'could not read' END AS error
        FROM orders""",
    "results": """
        SELECT concat('r_', l_orderkey) AS run_id, concat('c_', l_orderkey, '_', l_linenumber) AS check_id,
               l_linenumber AS ord, concat('line_', l_linenumber) AS name,
               CASE WHEN l_tax >= 0.08 THEN NULL ELSE l_discount < 0.08 END AS ok,
               CASE l_returnflag WHEN 'A' THEN 'advisory' WHEN 'N' THEN 'required' ELSE '' END AS severity,
               CAST(l_quantity AS VARCHAR(20)) AS got,
               CASE WHEN l_tax < 0.08 THEN concat('discount at ', l_shipdate_text) END AS detail,
               CASE WHEN l_tax >= 0.08 THEN 'tax out of range' END AS error, false AS keep_literal
        FROM (SELECT l_orderkey, l_linenumber, max(l_tax) AS l_tax, max(l_discount) AS l_discount, min(l_returnflag) AS l_returnflag,
                     sum(<INT(l_quantity)>) AS l_quantity, <DAY(max(l_shipdate))> AS l_shipdate_text
              FROM lineitem GROUP BY l_orderkey, l_linenumber) l""",
    # One alert per event and destination; keys repeat, and so do seconds.
    "deliveries": """
        SELECT concat('d_', event_id) AS id, concat('t_', user_id % 10) AS tenant_id, event_type AS destination,
               <SHA(props)> AS idempotency_key, <EPOCH(ts)> AS at_s FROM events""",
}

_BASE = re.compile(r"\b(" + "|".join(TABLES) + r")\b")
_SPELL = re.compile(r"<([A-Z]+)\(([^()]*(?:\([^()]*\))?[^()]*)\)>|<NL>")


def spell(text: str, engine: int) -> str:
    def one(m):
        if m.group(0) == "<NL>":
            return SPELLING["NL"][engine]
        return SPELLING[m.group(1)][engine].replace("X", m.group(2))
    return _SPELL.sub(one, text)


def view_text(name: str, engine: int) -> str:
    return spell(VIEWS[name], engine)


_schemas: dict[tuple[str, str], object] = {}


class Data:
    """The given tables and the derived views of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        key = (self.folder, name)
        if key not in _schemas:
            _schemas[key] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_schemas[key]).parquet(path)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if name in VIEWS:
            return self.sql(VIEWS[name])
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over the given tables and derived views that the text mentions."""
        for view in VIEWS:
            if re.search(rf"\b{view}\b", text) and VIEWS[view] != text:
                getattr(self, view).createOrReplaceTempView(view)
        for table in set(_BASE.findall(text)):
            self.table(table).createOrReplaceTempView(table)
        return self.spark.sql(spell(text, 0))


def duck(views: str, body: str) -> str:
    """DuckDB SQL: the named derived views as common table expressions, then ``body``."""
    ctes = ",\n".join(f"{v} AS ({view_text(v, 1)})" for v in views.split())
    body = spell(body, 1).strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH RECURSIVE {ctes},\n{body[5:].removeprefix('RECURSIVE ')}"
    return f"WITH RECURSIVE {ctes}\n{body}"


def query(name: str, oracle: str | None = None, views: str = ""):
    """Register ``fn(data) -> DataFrame``; ``oracle`` is DuckDB SQL over the tables and ``views``."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Data(spark, folder))
        if oracle is not None:
            ORACLE[name] = duck(views, oracle)
        return fn
    return wrap
