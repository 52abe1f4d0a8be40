"""Who may submit to a ledger, read it, or act in an organisation; and which versions are outdated."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from soundcheck.functions.text import version_parts
from soundcheck.plans.ordered import over_groups, row_number
from soundcheck.plans.sizing import broadcast_if_small

# Each role includes the next. Minimum role per action.
ROLE_RANK = {"viewer": 1, "member": 2, "admin": 3, "owner": 4}
ACTION_ROLE = {"read": "viewer", "attest": "member", "invite": "admin", "settings": "admin", "billing": "owner",
               "delete_org": "owner"}
DEFAULT_CAP = 100


def accept_submissions(subs: DataFrame, accounts: DataFrame, default_cap: int = DEFAULT_CAP, **plan) -> DataFrame:
    """Every submission with its ``status``: 200 accepted, 401 unknown or revoked key, 403 suspended, 429 over
    the monthly cap (UTC calendar month, first come first served; paid accounts have no cap).

    ``subs``: id, key_id, ts. ``accounts``: key_id, tenant_id, revoked, suspended, paid, cap_override.
    """
    judged = subs.join(broadcast_if_small(accounts), "key_id", "left").withColumns({
        "month": F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM"),
        "cap": F.coalesce("cap_override", F.lit(default_cap)),
        "_gate": F.when(F.col("tenant_id").isNull() | F.coalesce("revoked", F.lit(False)), F.lit(401))
        .when(F.coalesce("suspended", F.lit(False)), F.lit(403)).otherwise(F.lit(200))})
    # Only submissions that count against a cap are ranked.
    counted = (F.col("_gate") == 200) & ~F.coalesce("paid", F.lit(False))
    ranked = over_groups(judged.filter(counted), ["tenant_id", "month"], [F.col("ts").asc(), F.col("id").asc()], [row_number("_n")],
                         **plan)
    capped = ranked.withColumn("status", F.when(F.col("_n") > F.col("cap"), F.lit(429)).otherwise(F.lit(200))).drop("_n")
    closed = judged.filter(~counted).withColumn("status", F.col("_gate"))
    cols = ["id", "key_id", "tenant_id", "month", "cap", "paid", "status"]
    return capped.select(*cols).unionByName(closed.select(*cols))


def cap_usage(accepted: DataFrame) -> DataFrame:
    """Per tenant and month: accepted and refused submissions against the cap (null when paid)."""
    return accepted.filter("status IN (200, 429)").groupBy("tenant_id", "month").agg(
        F.count_if(F.col("status") == 200).alias("accepted"), F.count_if(F.col("status") == 429).alias("refused"),
        F.max(F.when(~F.coalesce("paid", F.lit(False)), F.col("cap"))).alias("cap"))


def visible_orgs(principals: DataFrame, orgs: DataFrame, memberships: DataFrame) -> DataFrame:
    """principal, org_id, why: the private ledgers a member may read, directly or through the managing parent.

    ``principals``: account_id. Public ledgers need no row, since anyone may read them. One parent level:
    sibling organisations never see each other.
    """
    mine = principals.select("account_id").distinct().join(memberships.select("account_id", "org_id").distinct(), "account_id")
    private = orgs.filter("ledger_visibility = 'private'")
    direct = mine.join(private.select("org_id"), "org_id").select("account_id", "org_id", F.lit("member").alias("why"))
    managed = mine.withColumnRenamed("org_id", "parent_org_id").join(
        private.select("org_id", "parent_org_id"), "parent_org_id").select(
        "account_id", "org_id", F.lit("managing parent").alias("why"))
    # Direct membership wins where both hold.
    return direct.unionByName(managed).groupBy("account_id", "org_id").agg(F.max("why").alias("why"))


def token_orgs(presented: DataFrame, tokens: DataFrame, as_of_epoch: int, scope: str = "ledger") -> DataFrame:
    """org_id that a presented token opens: digest matches, right scope, neither revoked nor expired.

    ``presented``: token. ``tokens``: id (SHA-256 of the token), org_id, scope, expires_at, revoked_at.
    """
    digests = presented.select(F.sha2(F.col("token").cast("binary"), 256).alias("id")).distinct()
    live = tokens.filter((F.col("scope") == scope) & F.col("revoked_at").isNull()
                         & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of_epoch)))
    return live.join(digests, "id", "left_semi").select("org_id").distinct()


def visible_ledger(ledger: DataFrame, orgs: DataFrame, memberships: DataFrame | None = None,
                   account_id: str | None = None, open_orgs: DataFrame | None = None) -> DataFrame:
    """Entries of public ledgers, plus private ones open to the account or through ``open_orgs`` (token_orgs)."""
    allowed = orgs.filter("ledger_visibility = 'public'").select("org_id")
    if account_id is not None and memberships is not None:
        me = orgs.sparkSession.createDataFrame([(account_id,)], "account_id string")
        allowed = allowed.unionByName(visible_orgs(me, orgs, memberships).select("org_id"))
    if open_orgs is not None:
        allowed = allowed.unionByName(open_orgs.select("org_id"))
    return ledger.join(broadcast_if_small(allowed.distinct()), F.col("tenant_id") == F.col("org_id"), "left_semi")


def role_allows(requests: DataFrame, memberships: DataFrame, org_tiers: DataFrame, tier_capabilities: DataFrame,
                ) -> DataFrame:
    """Every request with ``allowed`` and ``reason``.

    ``requests``: account_id, org_id, action, capability (null for none). ``org_tiers``: org_id, tier.
    ``tier_capabilities``: tier, capability. What a tier unlocks is data, never a name in code.
    """
    rank = F.create_map(*[F.lit(x) for kv in ROLE_RANK.items() for x in kv])
    needed = F.create_map(*[F.lit(x) for a, r in ACTION_ROLE.items() for x in (a, ROLE_RANK[r])])
    held = memberships.groupBy("account_id", "org_id").agg(F.max(F.try_element_at(rank, F.col("role"))).alias("_rank"))
    granted = org_tiers.join(tier_capabilities, "tier").select(
        "org_id", "capability", F.lit(True).alias("_granted")).distinct()
    met = requests.join(held, ["account_id", "org_id"], "left").join(
        broadcast_if_small(granted), ["org_id", "capability"], "left")
    need = F.try_element_at(needed, F.col("action"))
    reason = (
        F.when(F.col("_rank").isNull(), F.lit("not a member"))
        .when(need.isNull(), F.lit("unknown action"))
        .when(F.col("_rank") < need, F.lit("role too low"))
        .when(F.col("capability").isNotNull() & F.col("_granted").isNull(), F.lit("not available on this tier")))
    return met.withColumns({"allowed": reason.isNull(), "reason": F.coalesce(reason, F.lit("ok"))}).select(
        "account_id", "org_id", "action", "capability", "allowed", "reason")


def outdated_versions(df: DataFrame, col: str, latest: str) -> DataFrame:
    """Add ``state``: outdated, current, or not comparable. ``latest`` must be X.Y.Z, a leading v allowed."""
    mine, newest = version_parts(col), version_parts(F.lit(latest))
    return df.withColumn("state", F.when(mine.isNull() | newest.isNull(), F.lit("not comparable"))
                         .when(mine < newest, F.lit("outdated")).otherwise(F.lit("current")))
