"""Ledgers, their verification, evidence, access rules."""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import functions as F, types as T

from soundcheck.catalog.base import query
from soundcheck.functions.ed25519 import public_key, sign as sign_message
from soundcheck.functions.text import canonical_entry
from soundcheck.operators import access as A
from soundcheck.operators import ledger as L

CANON = "concat('v1', <NL>, X, <NL>, n.id, <NL>, n.tenant_id, <NL>, n.seq, <NL>, n.created_at, <NL>, n.report_sha256, <NL>, n.verdict)"
ZERO = "repeat('0', 64)"
LEDGER = f"""
    num AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at, id) AS seq FROM attestations),
    chain AS (SELECT n.tenant_id, n.seq, {ZERO} AS prev_hash, sha256({CANON.replace('X', ZERO)}) AS entry_hash FROM num n WHERE seq = 1
      UNION ALL SELECT n.tenant_id, n.seq, c.entry_hash, sha256({CANON.replace('X', 'c.entry_hash')})
      FROM chain c JOIN num n ON n.tenant_id = c.tenant_id AND n.seq = c.seq + 1),
    ledger AS MATERIALIZED (SELECT num.*, chain.prev_hash, chain.entry_hash FROM num JOIN chain USING (tenant_id, seq))"""
MIDDLE = 1705500000


def ledger_of(d):
    return L.build_ledger(d.attestations)


def with_bodies(d, ledger):
    """The ledger with the report bodies, which do not travel through the chaining, joined by id."""
    return ledger.join(d.attestations.select("id", "report_raw", "method"), "id")


@query("L1_canonical_entry", """
    SELECT id, sha256(concat('v1', <NL>, <NL>, id, <NL>, tenant_id, <NL>, event_id, <NL>, created_at, <NL>, report_sha256, <NL>, verdict)) AS digest
    FROM attestations""", "attestations")
def _(d):
    text = canonical_entry(F.lit(None).cast("string"), "id", "tenant_id", "event_id", "created_at", "report_sha256", "verdict")
    return d.attestations.select("id", F.sha2(text.cast("binary"), 256).alias("digest"))


@query("L2_build_ledger", f"WITH {LEDGER} SELECT tenant_id, seq, id, created_at, prev_hash, entry_hash FROM ledger", "attestations")
def _(d):
    return ledger_of(d).select("tenant_id", "seq", "id", "created_at", "prev_hash", "entry_hash")


@query("L2_build_ledger_rounds", f"WITH {LEDGER} SELECT tenant_id, seq, id, created_at, prev_hash, entry_hash FROM ledger", "attestations")
def _(d):
    # The way of large tenants: numbered by blocks, chained in rounds.
    per_round = max(d.attestations.count() // 40, 1)
    return L.build_ledger(d.attestations, entries_per_round=per_round, rows_per_task=per_round).select(
        "tenant_id", "seq", "id", "created_at", "prev_hash", "entry_hash")


def _appended(d):
    old, new = d.attestations.filter(F.col("created_at") < MIDDLE), d.attestations.filter(F.col("created_at") >= MIDDLE)
    again = new.unionByName(old.filter("event_id % 50 = 0")).unionByName(new.filter("event_id % 30 = 0"))
    return L.append_ledger(L.build_ledger(old), again)


@query("L3_append_ledger", f"WITH {LEDGER} SELECT tenant_id, seq, id, prev_hash, entry_hash FROM ledger WHERE created_at >= {MIDDLE}", "attestations")
def _(d):
    return _appended(d)[0].select("tenant_id", "seq", "id", "prev_hash", "entry_hash")


@query("L3_refused", f"SELECT id, 1 AS refused FROM attestations WHERE (created_at < {MIDDLE} AND event_id % 50 = 0) OR (created_at >= {MIDDLE} AND event_id % 30 = 0)",
       "attestations")
def _(d):
    return _appended(d)[1]


def _tampered_entries(d):
    ledger = with_bodies(d, ledger_of(d))
    return ledger.withColumns({
        "verdict": F.when(F.col("seq") % 37 == 0, F.lit("pass")).otherwise(F.col("verdict")),
        "report_raw": F.when(F.col("seq") % 41 == 0, F.lit("{}")).when(F.col("seq") % 43 == 0, F.lit("")).otherwise(F.col("report_raw")),
        "tenant_pubkey": F.when(F.col("seq") % 2 == 0, F.lit("a2V5")), "tenant_sig_ok": F.col("seq") % 4 == 0})


@query("L4_verify_entries", f"""
    WITH {LEDGER} SELECT tenant_id, seq, 'chain hash' AS step, seq % 37 > 0 OR verdict = 'pass' AS ok FROM ledger
    UNION ALL SELECT tenant_id, seq, 'signature', false FROM ledger
    UNION ALL SELECT tenant_id, seq, 'report hash', seq % 41 > 0 FROM ledger WHERE seq % 43 > 0 OR seq % 41 = 0
    UNION ALL SELECT tenant_id, seq, 'tenant signature', seq % 4 = 0 FROM ledger WHERE seq % 2 = 0""", "attestations")
def _(d):
    return L.verify_steps(_tampered_entries(d)).select("tenant_id", "seq", "step", "ok")


# Keys for tests only: the seeds are public and sign nothing but these rows.
SEEDS = {f"key_{i}": bytes([i + 1]) * 32 for i in range(3)}


def trusted_keys(spark, names=("key_0", "key_1")):
    rows = [(k, base64.b64encode(public_key(SEEDS[k])).decode()) for k in names]
    return spark.createDataFrame(rows, "key_id string, public_key string")


def _signed(d):
    seeds = dict(SEEDS)

    @F.pandas_udf(T.StringType())
    def sign(keys: pd.Series, digests: pd.Series) -> pd.Series:
        known = {k: public_key(s) for k, s in seeds.items()}
        return pd.Series([base64.b64encode(sign_message(seeds[k], bytes.fromhex(h), known[k])).decode()
                          for k, h in zip(keys, digests)])

    key = F.col("c_custkey")
    rows = d.customer.select(
        F.concat(F.lit("t_"), (key % 4).cast("string")).alias("tenant_id"), key.alias("seq"), F.col("c_name").alias("id"),
        F.sha2(F.col("c_name"), 256).alias("entry_hash"), F.concat(F.lit("key_"), (key % 3).cast("string")).alias("key_id"))
    good = rows.repartition(d.spark.sparkContext.defaultParallelism).withColumn("signature", sign("key_id", "entry_hash"))
    forged = F.translate("signature", "ABCDEFGHIJKLM", "NOPQRSTUVWXYZ")
    return good.withColumn("signature", F.when(F.col("seq") % 7 == 0, forged).when(
        F.col("seq") % 5 == 0, F.rtrim(F.translate("signature", "=", " "))).otherwise(F.col("signature")))


# A forged signature has its letters exchanged; it has some letter from A to M with near certainty.
@query("L5_verify_signatures", """
    SELECT c_custkey AS seq, c_name AS id, c_custkey % 7 > 0 AND c_custkey % 3 < 2 AS signature_ok FROM customer""")
def _(d):
    return L.verify_signatures(_signed(d), trusted_keys(d.spark)).select("seq", "id", "signature_ok")


def _tampered_chain(d):
    ledger = ledger_of(d)
    t, s = F.col("tenant_id"), F.col("seq")
    kept = ledger.filter(~((t == "t_1") & (s == 5)))
    twice = kept.unionByName(ledger.filter((t == "t_2") & (s == 9)))
    at = lambda tenant, seq: (t == tenant) & (s == seq)
    return twice.withColumns({
        "prev_hash": F.when(at("t_3", 20), F.lit("00")).when(at("t_5", 1), F.lit("11")).otherwise(F.col("prev_hash")),
        "created_at": F.when(at("t_4", 30), F.col("created_at") - 10_000_000).otherwise(F.col("created_at"))})


@query("L6_verify_chain", f"""
    WITH {LEDGER}, k AS (SELECT * FROM ledger WHERE NOT (tenant_id = 't_1' AND seq = 5) UNION ALL SELECT * FROM ledger WHERE tenant_id = 't_2' AND seq = 9),
    m AS (SELECT tenant_id, seq, entry_hash, CASE WHEN tenant_id = 't_3' AND seq = 20 THEN '00' WHEN tenant_id = 't_5' AND seq = 1 THEN '11' ELSE prev_hash END AS prev_hash,
      CASE WHEN tenant_id = 't_4' AND seq = 30 THEN created_at - 10000000 ELSE created_at END AS created_at FROM k),
    w AS (SELECT *, lag(seq) OVER o AS pseq, lag(entry_hash) OVER o AS phash, lag(created_at) OVER o AS pat, count(*) OVER (PARTITION BY tenant_id, seq) AS copies
      FROM m WINDOW o AS (PARTITION BY tenant_id ORDER BY seq)),
    r AS (SELECT *, CASE WHEN copies > 1 THEN 'duplicate seq' WHEN seq = 1 AND prev_hash <> {ZERO} THEN 'genesis prev_hash is not zero'
      WHEN seq > 1 AND coalesce(pseq, -1) <> seq - 1 THEN 'missing seq before' WHEN seq > 1 AND prev_hash <> phash THEN 'prev_hash does not match'
      WHEN seq > 1 AND created_at < pat THEN 'created_at runs back' END AS reason FROM w)
    SELECT tenant_id, count(*) AS entries, min(seq) FILTER (WHERE reason IS NOT NULL) AS first_break_seq,
      arg_min(reason, seq) FILTER (WHERE reason IS NOT NULL) AS reason, count(reason) = 0 AS ok FROM r GROUP BY 1""", "attestations")
def _(d):
    return L.verify_chain(_tampered_chain(d))


@query("L7_verify_verdicts", f"""
    WITH {LEDGER} SELECT id, target, seq, 1 AS schema_version, false AS valid,
      concat('chain hash=', CASE WHEN seq % 37 > 0 OR verdict = 'pass' THEN 'true' ELSE 'false' END, ',signature=false',
        CASE WHEN seq % 43 > 0 OR seq % 41 = 0 THEN concat(',report hash=', CASE WHEN seq % 41 > 0 THEN 'true' ELSE 'false' END) ELSE '' END,
        CASE WHEN seq % 2 = 0 THEN concat(',tenant signature=', CASE WHEN seq % 4 = 0 THEN 'true' ELSE 'false' END) ELSE '' END) AS checks FROM ledger""", "attestations")
def _(d):
    said = F.transform("checks", lambda c: F.concat(c["name"], F.lit("="), c["ok"].cast("string")))
    return L.verify_verdicts(_tampered_entries(d)).select("id", "target", "seq", "schema_version", "valid", F.array_join(said, ",").alias("checks"))


ACCOUNTS = """
    SELECT concat('k_', n_nationkey) AS key_id, concat('t_', n_nationkey % 6) AS tenant_id, n_nationkey = 3 AS revoked, n_nationkey = 4 AS suspended,
      n_nationkey % 6 = 5 AS paid, CASE WHEN n_nationkey % 6 = 2 THEN 500 END AS cap_override FROM nation"""
SUBS = "SELECT event_id AS id, concat('k_', user_id % 28) AS key_id, ts FROM events"
JUDGED = f"""
    a AS ({ACCOUNTS}), s AS ({SUBS}), j AS (SELECT s.id, s.key_id, a.tenant_id, paid, strftime(s.ts, '%Y-%m') AS month, s.ts, coalesce(cap_override, 120) AS cap,
      CASE WHEN a.tenant_id IS NULL OR revoked THEN 401 WHEN suspended THEN 403 ELSE 200 END AS gate FROM s LEFT JOIN a USING (key_id)),
    st AS (SELECT id, tenant_id, month, paid, cap, CASE WHEN gate <> 200 THEN gate WHEN NOT paid AND
      row_number() OVER (PARTITION BY tenant_id, month, gate ORDER BY ts, id) > cap THEN 429 ELSE 200 END AS status FROM j)"""


@query("L8_accept_submissions", f"WITH {JUDGED} SELECT id, tenant_id, status FROM st")
def _(d):
    return A.accept_submissions(d.sql(SUBS), d.sql(ACCOUNTS), default_cap=120).select("id", "tenant_id", "status")


@query("L8_cap_usage", f"""WITH {JUDGED} SELECT tenant_id, month, count(*) FILTER (WHERE status = 200) AS accepted, count(*) FILTER (WHERE status = 429) AS refused,
    max(cap) FILTER (WHERE NOT paid) AS cap FROM st WHERE status IN (200, 429) GROUP BY 1, 2""")
def _(d):
    return A.cap_usage(A.accept_submissions(d.sql(SUBS), d.sql(ACCOUNTS), default_cap=120))


@query("L9_evidence_by_target", """
    WITH g AS (SELECT *, created_at - lag(created_at) OVER (PARTITION BY tenant_id, target ORDER BY created_at, id) AS gap FROM attestations)
    SELECT tenant_id, target, count(*) AS entries, count(*) FILTER (WHERE verdict = 'pass') AS passed, count(*) FILTER (WHERE verdict <> 'pass') AS failed,
      min(created_at) AS first_at, max(created_at) AS last_at, median(gap) / 86400 AS cadence_days FROM g GROUP BY 1, 2""", "attestations")
def _(d):
    return L.evidence_by_target(d.attestations)


@query("L10_evidence_summary", """
    SELECT tenant_id, count(*) AS entries, count(*) FILTER (WHERE verdict = 'pass') AS passed, count(*) FILTER (WHERE verdict <> 'pass') AS failed,
      count(DISTINCT target) AS targets, count(DISTINCT method) AS methods, min(created_at) AS first_at, max(created_at) AS last_at,
      max(created_at) - min(created_at) AS span_s FROM attestations GROUP BY ROLLUP (tenant_id)""", "attestations")
def _(d):
    return L.evidence_summary(d.attestations)


@query("L11_evidence_pack", f"""
    WITH {LEDGER} SELECT tenant_id, target, id, seq, created_at, verdict, report_sha256, prev_hash, entry_hash, concat('https://example.org/a/', id) AS verify_url,
      concat('key_', seq % 2) AS key_id, true AS has_key FROM ledger""", "attestations")
def _(d):
    ledger = ledger_of(d).withColumns({"key_id": F.concat(F.lit("key_"), (F.col("seq") % 2).cast("string")),
                                       "signature": F.lit(None).cast("string")})
    pack = L.evidence_pack(ledger, trusted_keys(d.spark), "https://example.org/a/")
    return pack.withColumn("has_key", F.col("public_key").isNotNull()).drop("signature", "public_key", "verify_hint", "notice")


@query("L12_visible_orgs", """
    WITH p AS (SELECT * FROM orgs WHERE ledger_visibility = 'private'),
    v AS (SELECT account_id, p.org_id, 'member' AS why FROM memberships m JOIN p ON m.org_id = p.org_id
      UNION ALL SELECT account_id, p.org_id, 'managing parent' FROM memberships m JOIN p ON m.org_id = p.parent_org_id)
    SELECT account_id, org_id, max(why) AS why FROM v GROUP BY 1, 2""", "orgs memberships")
def _(d):
    return A.visible_orgs(d.memberships.select("account_id"), d.orgs, d.memberships)


TOKENS = """
    SELECT <SHA(c_name)> AS id, concat('t_', c_nationkey) AS org_id, CASE WHEN c_custkey % 3 = 0 THEN 'evidence' ELSE 'ledger' END AS scope,
      CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey AS BIGINT) END AS expires_at, CASE WHEN c_custkey % 5 = 0 THEN CAST(1 AS BIGINT) END AS revoked_at FROM customer"""


@query("L12_visible_ledger", f"""
    WITH t AS ({TOKENS}), open AS (SELECT org_id FROM t WHERE id IN (SELECT sha256(c_name) FROM customer WHERE c_custkey < 12) AND scope = 'ledger'
        AND revoked_at IS NULL AND (expires_at IS NULL OR expires_at > 5)),
    allowed AS (SELECT org_id FROM orgs WHERE ledger_visibility = 'public' UNION SELECT org_id FROM open
      UNION SELECT o.org_id FROM orgs o JOIN memberships m ON m.account_id = 'a_20' AND (m.org_id = o.org_id OR m.org_id = o.parent_org_id))
    SELECT id, tenant_id FROM attestations WHERE tenant_id IN (SELECT org_id FROM allowed)""", "attestations orgs memberships")
def _(d):
    presented = d.customer.filter("c_custkey < 12").select(F.col("c_name").alias("token"))
    opened = A.token_orgs(presented, d.sql(TOKENS), as_of_epoch=5)
    return A.visible_ledger(d.attestations, d.orgs, d.memberships, "a_20", opened).select("id", "tenant_id")


REQUESTS = """
    SELECT event_id AS request_id, concat('a_', user_id) AS account_id, concat('t_', event_id % 25) AS org_id,
      CASE event_id % 7 WHEN 0 THEN 'read' WHEN 1 THEN 'attest' WHEN 2 THEN 'invite' WHEN 3 THEN 'settings' WHEN 4 THEN 'billing' WHEN 5 THEN 'delete_org' ELSE 'dance' END AS action,
      CASE event_id % 3 WHEN 0 THEN 'sso' WHEN 1 THEN 'private_ledger' END AS capability FROM events"""


@query("L13_role_allows", f"""
    WITH r AS ({REQUESTS}), rk(role, n) AS (VALUES ('viewer', 1), ('member', 2), ('admin', 3), ('owner', 4)),
    need(action, k) AS (VALUES ('read', 1), ('attest', 2), ('invite', 3), ('settings', 3), ('billing', 4), ('delete_org', 4)),
    h AS (SELECT account_id, org_id, max(n) AS n FROM memberships JOIN rk USING (role) GROUP BY 1, 2),
    g AS (SELECT DISTINCT concat('t_', n_nationkey) AS org_id, CASE WHEN n_regionkey < 3 THEN 'sso' ELSE 'private_ledger' END AS capability FROM nation),
    x AS (SELECT r.account_id, r.org_id, r.action, r.capability, CASE WHEN h.n IS NULL THEN 'not a member' WHEN need.k IS NULL THEN 'unknown action'
      WHEN h.n < need.k THEN 'role too low' WHEN r.capability IS NOT NULL AND g.org_id IS NULL THEN 'not available on this tier' ELSE 'ok' END AS reason
      FROM r LEFT JOIN h USING (account_id, org_id) LEFT JOIN need USING (action) LEFT JOIN g ON g.org_id = r.org_id AND g.capability = r.capability)
    SELECT *, reason = 'ok' AS allowed FROM x""", "memberships")
def _(d):
    tiers = d.nation.select(F.concat(F.lit("t_"), F.col("n_nationkey").cast("string")).alias("org_id"),
                            F.concat(F.lit("tier_"), F.col("n_regionkey").cast("string")).alias("tier"))
    unlocks = d.region.select(F.concat(F.lit("tier_"), F.col("r_regionkey").cast("string")).alias("tier"),
                              F.when(F.col("r_regionkey") < 3, F.lit("sso")).otherwise(F.lit("private_ledger")).alias("capability"))
    return A.role_allows(d.sql(REQUESTS), d.memberships, tiers, unlocks)


@query("L14_outdated_versions", """
    WITH p AS (SELECT *, regexp_full_match(version, 'v?[0-9]+\\.[0-9]+\\.[0-9]+') AS strict,
      list_transform(string_split(ltrim(version, 'v'), '.'), lambda x: TRY_CAST(x AS BIGINT)) AS v FROM versions)
    SELECT p_partkey, CASE WHEN NOT strict THEN 'not comparable' WHEN v < [1, 2, 3] THEN 'outdated' ELSE 'current' END AS state FROM p""", "versions")
def _(d):
    return A.outdated_versions(d.versions, "version", "v1.2.3").select("p_partkey", "state")
