"""Redaction and credential scanning over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundcheck.catalog.base import query
from soundcheck.catalog.sources import trim
from soundcheck.functions import secrets as S
from soundcheck.functions import text as T
from soundcheck.operators import redact as R

NAMES = """
    SELECT event_id AS ord, CASE WHEN event_id % 6 = 0 THEN '' ELSE concat('N_', user_id) END AS name FROM events"""
VALUES = "SELECT concat('N_', c_custkey) AS name, substr(<SHA(c_name)>, 1, <INT(c_custkey % 7 + 1)>) AS value FROM customer"
VALUES = VALUES.replace("<INT(c_custkey % 7 + 1)>", "CAST(c_custkey % 7 + 1 AS INT)")


@query("H1_known_secrets", f"""
    WITH n AS ({NAMES}), v AS ({VALUES}) SELECT min(ord) AS ord, name, value FROM n JOIN v USING (name)
    WHERE name <> '' AND octet_length(encode(value)) >= 4 GROUP BY name, value""")
def _(d):
    return R.known_secrets(d.sql(NAMES), d.sql(VALUES))


# Every secret has the same length, so the order of replacement does not matter to the folded list.
FOLD = """
    f AS (SELECT list(v) AS vs, list(n) AS ns FROM (SELECT value AS v, name AS n FROM secrets ORDER BY value))"""


def scrubbed(x):
    return f"""CASE WHEN regexp_matches({x}, '[0-9a-f]{{40}}') THEN list_reduce(list_prepend([{x}, ''], list_transform(list_zip(vs, ns),
        lambda p: [p[1], p[2]])), lambda a, b: [replace(a[1], b[1], concat('[REDACTED:', b[2], ']')), ''])[1] ELSE {x} END"""


@query("H2_scrub", f"WITH {FOLD} SELECT doc_id, {scrubbed('text')} AS text FROM documents, f", "secrets")
def _(d):
    return R.scrub(d.documents.select("doc_id", "text"), ["text"], d.secrets)


@query("H2_scrub_many", f"WITH {FOLD} SELECT doc_id, {scrubbed('text')} AS text FROM documents, f", "secrets")
def _(d):
    # The way of long secret lists: streamed to the driver in several passes, one broadcast index over them.
    return R.scrub(d.documents.select("doc_id", "text"), ["text"], d.secrets, per_pass=4)


LINE = trim("string_split(X, chr(10))[1]")


@query("H3_first_line", f"SELECT doc_id, {LINE.replace('X', 'text')} AS line FROM documents")
def _(d):
    return d.documents.select("doc_id", T.first_line("text").alias("line"))


def truncated(x, n=120):
    """The longest prefix of whole characters within n bytes; DuckDB finds it by character count."""
    return f"""CASE WHEN strlen({x}) <= {n} THEN {x} ELSE concat(left({x}, list_max(list_filter(range(0, {n} + 1),
        lambda k: strlen(left({x}, k::BIGINT)) <= {n}))), '…') END"""


@query("H4_truncate_utf8", f"SELECT doc_id, {truncated('text')} AS preview FROM documents")
def _(d):
    return d.documents.select("doc_id", T.truncate_utf8("text").alias("preview"))


def captured(x):
    """Preview and fingerprint of the scrubbed text x with the first line x_line."""
    return f"concat(CASE WHEN {x}_line = '' THEN '' ELSE concat({truncated(x + '_line')}, ' ') END, '[sha256:', sha256({x}), ']')"


def with_line(x):
    return f"{x}, {LINE.replace('X', x)} AS {x}_line"


@query("H5_redact_captured", f"""
    WITH {FOLD}, s AS (SELECT doc_id, {scrubbed('text')} AS t FROM documents, f), l AS (SELECT doc_id, {with_line('t')} FROM s)
    SELECT doc_id, {captured('t')} AS stored FROM l""", "secrets")
def _(d):
    fn = R.scrubber(d.secrets).text
    scrubbed = d.documents.select("doc_id", fn(F.col("text")).alias("scrubbed"))
    return scrubbed.select("doc_id", S.redact_captured(F.col("scrubbed")).alias("stored"))


@query("H6_redact_got", f"""
    WITH {FOLD}, s AS (SELECT doc_id, {scrubbed('text')} AS t, doc_id % 5 = 0 AS keep FROM documents, f UNION ALL SELECT -item_id, text, false FROM benchmark),
    l AS (SELECT doc_id, keep, {with_line('t')} FROM s)
    SELECT doc_id, CASE WHEN keep OR (strlen(t) <= 256 AND NOT regexp_matches(t, '[\\n\\r]')) THEN t ELSE {captured('t')} END AS got FROM l""", "secrets")
def _(d):
    rows = d.documents.select("doc_id", F.col("text").alias("got"), (F.col("doc_id") % 5 == 0).alias("keep")).unionByName(
        d.benchmark.select((-F.col("item_id")).alias("doc_id"), F.col("text").alias("got"), F.lit(False).alias("keep")))
    return R.redact_captures(rows, "got", "keep", d.secrets).drop("keep")


def leaky(d):
    """A report per document: the document is the output of its load and of its first check."""
    check = lambda o, name, ok, got, keep: F.struct(
        F.lit(o).alias("ord"), F.lit(name).alias("name"), F.lit(ok).alias("ok"), F.lit("required").alias("severity"),
        got.alias("got"), got.alias("detail"), F.lit(None).cast("string").alias("error"), F.lit(keep).alias("keep_literal"))
    text, none = F.col("text"), F.lit(None).cast("string")
    return d.documents.select(
        F.lit(1).alias("schema_version"), F.concat(F.lit("r_"), "doc_id").alias("run_id"), F.lit(0).alias("part"),
        F.lit("1.0.0").alias("tool_version"), F.col("source").alias("target"), F.lit(None).cast("timestamp").alias("started_at"),
        F.lit(None).cast("timestamp").alias("finished_at"), F.lit(0).cast("bigint").alias("duration_ms"),
        F.struct(F.lit(True).alias("ok"), F.lit("copy").alias("method"), F.lit("db").alias("database"),
                 F.lit(1).cast("bigint").alias("duration_ms"), text.alias("warnings"), text.alias("error")).alias("load"),
        F.array(check(0, "output", False, text, False), check(1, "literal", True, text, True),
                check(2, "nothing", True, none, False)).alias("checks"), F.lit("fail").alias("verdict"))


REDACTED = f"""
    WITH {FOLD}, s AS (SELECT doc_id, text, {scrubbed('text')} AS t FROM documents, f), l AS (SELECT doc_id, text, {with_line('t')} FROM s),
    g AS (SELECT *, CASE WHEN strlen(t) <= 256 AND NOT regexp_matches(t, '[\\n\\r]') THEN t ELSE {captured('t')} END AS got, {captured('t')} AS cap FROM l)"""


@query("H7_redact_reports", f"{REDACTED} SELECT concat('r_', doc_id) AS run_id, cap AS warnings, t AS load_error, got, t AS literal, t AS detail, NULL AS nothing FROM g", "secrets")
def _(d):
    once = R.redact_reports(leaky(d), d.secrets)
    twice = R.redact_reports(once, d.secrets)  # must change nothing
    at = lambda i, f: F.get(F.col("checks"), i)[f]
    return twice.select("run_id", F.col("load.warnings").alias("warnings"), F.col("load.error").alias("load_error"),
                        at(0, "got").alias("got"), at(1, "got").alias("literal"), at(0, "detail").alias("detail"),
                        at(2, "got").alias("nothing"))


@query("H8_raw_output", f"""{REDACTED} SELECT concat('r_', doc_id) AS run_id, 'load warnings' AS name, sha256(text) AS raw FROM g WHERE cap <> text
    UNION ALL SELECT concat('r_', doc_id), 'output', sha256(text) FROM g WHERE got <> text
    UNION ALL SELECT concat('r_', doc_id), 'literal', sha256(text) FROM g WHERE t <> text""", "secrets")
def _(d):
    before = leaky(d)
    return R.raw_output(before, R.redact_reports(before, d.secrets)).select(
        "run_id", "name", F.sha2(F.col("raw").cast("binary"), 256).alias("raw"))


# The four shapes in RE2 syntax.
SHAPES = {
    "aws-access-key-id": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "private-key-pem": r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----",
    "bearer-token": r"(?i)\bbearer[ \t]+[a-z0-9\-._~+/]{20,}=*",
    "url-credentials": r"""\b[a-zA-Z][a-zA-Z0-9+.-]*://[^/\s:@"''`]+:[^@/\s"''`\[\]]{3,}@""",
}
SCAN = " UNION ALL ".join(
    f"SELECT id, '{n}' AS pattern, len(regexp_extract_all(text, '{rx}')) AS count FROM planted WHERE regexp_matches(text, '{rx}')" for n, rx in SHAPES.items())
ANY = " OR ".join(f"regexp_matches(text, '{rx}')" for rx in SHAPES.values())


@query("H9_scan_credentials", SCAN, "planted")
def _(d):
    return R.scan_credentials(d.planted, "text")


@query("H10_credential_gate", f"""
    SELECT id, 'refuse' AS mode, CASE WHEN {ANY} THEN 'refuse' ELSE 'accept' END AS decision FROM planted
    UNION ALL SELECT id, 'warn', CASE WHEN {ANY} THEN 'warn' ELSE 'accept' END FROM planted
    UNION ALL SELECT id, 'off', 'accept' FROM planted""", "planted")
def _(d):
    out = None
    for mode in ("refuse", "warn", "off"):
        for part in R.credential_gate(d.planted, "text", mode):
            rows = part.select("id", F.lit(mode).alias("mode"), "decision")
            out = rows if out is None else out.unionByName(rows)
    return out


@query("H10_gate_summary", f"SELECT CASE WHEN {ANY} THEN 'refuse' ELSE 'accept' END AS decision, count(*) AS rows FROM planted GROUP BY 1", "planted")
def _(d):
    return R.gate_summary(d.planted, "text")


@query("H11_scrub_patterns", r"""
    SELECT id, regexp_replace(regexp_replace(text, '(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{4,}', 'Bearer [REDACTED]', 'g'),
      '(://[^/:@\s]+:)[^@\s]+(@)', '\1[REDACTED]\2', 'g') AS text FROM planted""", "planted")
def _(d):
    return d.planted.select("id", S.scrub_patterns("text").alias("text"))


def bare(x):
    return f"""CASE WHEN regexp_matches({x}, '[0-9a-f]{{40}}') THEN list_reduce(list_prepend({x}, vs), lambda a, b: replace(a, b, '[REDACTED]')) ELSE {x} END"""


def shapes(x):
    return rf"""regexp_replace(regexp_replace({x}, '(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{{4,}}', 'Bearer [REDACTED]', 'g'),
      '(://[^/:@\s]+:)[^@\s]+(@)', '\1[REDACTED]\2', 'g')"""


@query("H12_scrub_payload", f"""
    WITH {FOLD} SELECT id, {shapes(bare('text'))} AS top, {shapes(bare('text'))} AS deep, kind AS key_kept, {shapes(bare('text'))} AS json FROM planted, f""",
       "planted secrets")
def _(d):
    text = F.col("text")
    nested = d.planted.select(
        "id", text.alias("top"), F.struct(F.array(F.struct(text.alias("t"), F.col("kind").alias("k"))).alias("items"),
                                          F.create_map(F.lit("m"), text).alias("m")).alias("payload"),
        F.to_json(F.struct(F.array(F.struct(text.alias("t"))).alias("a"))).alias("raw"))
    clean = R.scrub_payload(nested, d.secrets, json_columns=("raw",))
    item = F.get(F.col("payload.items"), 0)
    return clean.select("id", "top", F.when(item["t"] == F.col("payload.m")["m"], item["t"]).alias("deep"),
                        item["k"].alias("key_kept"), F.from_json("raw", "a array<struct<t:string>>")["a"][0]["t"].alias("json"))


# The last 4096 bytes, by characters: the shortest suffix that is not longer, from its first whole line on.
@query("H13_tail_text", """
    WITH x AS (SELECT doc_id, concat(text, <NL>, <NL>) AS t FROM documents),
    c AS (SELECT doc_id, t, strlen(t) AS n, right(t, 4096) AS r FROM x),
    k AS (SELECT doc_id, t, n, r, CASE WHEN n > 4096 AND strlen(r) > 4096 THEN
            list_min(list_filter(range(0, strlen(r) - 4096 + 1), lambda k: strlen(r) - strlen(left(r, k::BIGINT)) <= 4096)) ELSE 0 END AS k FROM c),
    u AS (SELECT doc_id, t, n, substr(r, (k + 1)::BIGINT) AS r FROM k)
    SELECT doc_id, CASE WHEN n <= 4096 THEN rtrim(t, <NL>) ELSE concat('…', rtrim(CASE WHEN instr(r, <NL>) > 0 AND instr(r, <NL>) < length(r)
      THEN substr(r, instr(r, <NL>) + 1) ELSE r END, <NL>)) END AS tail FROM u""")
def _(d):
    whole = F.concat("text", F.lit("\n\n"))
    return d.documents.select("doc_id", T.tail_text(whole).alias("tail"))
