"""Split groups must give what a plain window gives, hot keys included."""

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from soundcheck.operators import access, chains, integrity, ledger, monitors
from soundcheck.plans.ordered import lag, last_known, over_groups, prior_max, row_number

DERIVED = lambda: [row_number("rn"), lag("prev", F.col("v")), prior_max("top", F.col("v")), last_known("seen", F.col("v"))]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["hot", "hot", "hot", "a", None]), st.integers(0, 5), st.one_of(st.none(), st.integers(-9, 9))),
                min_size=1, max_size=60))
def test_split_equals_plain(spark, data):
    df = spark.createDataFrame([(k, t, v, i) for i, (k, t, v) in enumerate(data)], "k string, t int, v int, id int")
    order = [F.col("t").desc(), F.col("id").asc()]
    assert rows(over_groups(df, ["k"], order, DERIVED(), rows_per_task=5)) == rows(over_groups(df, ["k"], order, DERIVED()))


def hot(spark, n=4000):
    """One key holds two thirds of the rows; many rows share a time."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 < 2, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("unit"),
        F.col("id").alias("ord"), F.concat(F.lit("b"), F.col("id").cast("string")).alias("label"), F.lit("full").alias("type"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(F.col("id") / 40) * 600).alias("ts"),
        F.when(F.col("id") % 97 == 0, F.lit("pass")).otherwise(F.lit("fail")).alias("verdict"))


def test_chains_of_a_hot_unit(spark):
    b = hot(spark)
    assert rows(chains.chain(b, rows_per_task=300)) == rows(chains.chain(b))
    assert rows(chains.last_good(b, rows_per_task=300)) == rows(chains.last_good(b))
    targets = b.select("unit", F.col("label").alias("target_id"), (F.col("ts") + F.expr("INTERVAL 90 SECOND")).alias("target_ts"))
    assert rows(chains.asof_recovery_point(targets, b, rows_per_task=500)) == rows(chains.asof_recovery_point(targets, b))


def test_overlaps_of_a_hot_room(spark):
    r = hot(spark).select(F.col("unit").alias("room"), F.col("ord").alias("id"), F.col("ts").alias("lo"),
                          (F.col("ts") + F.make_dt_interval(secs=F.col("ord") % 900)).alias("hi"))
    assert rows(integrity.overlaps(r, ["room"], "lo", "hi", "id", rows_per_task=300)) == rows(integrity.overlaps(r, ["room"], "lo", "hi", "id"))


def test_ledger_of_a_hot_tenant(spark):
    reports = hot(spark, 1500).select(F.col("unit").alias("tenant_id"), F.col("label").alias("id"), F.unix_seconds("ts").alias("created_at"),
                                      F.lit("t").alias("target"), "verdict", F.sha2("label", 256).alias("report_sha256"))
    plain = ledger.build_ledger(reports)
    assert rows(ledger.build_ledger(reports, entries_per_round=150, rows_per_task=100)) == rows(plain)
    assert ledger.verify_chain(plain).filter("NOT ok").count() == 0


def test_caps_of_a_hot_tenant(spark):
    subs = hot(spark).select(F.col("ord").alias("id"), F.col("unit").alias("key_id"), "ts")
    accounts = subs.select("key_id").distinct().select(
        "key_id", F.col("key_id").alias("tenant_id"), F.lit(False).alias("revoked"), F.lit(False).alias("suspended"), F.lit(False).alias("paid"),
        F.lit(None).cast("int").alias("cap_override"))
    assert rows(access.accept_submissions(subs, accounts, 900, rows_per_task=300)) == rows(access.accept_submissions(subs, accounts, 900))


def test_damping_follows_the_last_sent(spark):
    at = [0, 100, 899, 900, 1000, 1799, 1800, 5000, 5000]
    d = spark.createDataFrame([(f"d{i}", "x", t) for i, t in enumerate(at)], "id string, destination string, at_s bigint")
    sent = {r["id"] for r in monitors.damp_flaps(d, 900).filter("sent").collect()}
    assert sent == {"d0", "d3", "d6", "d7"}


def test_damping_by_blocks_equals_the_plain_fold(spark):
    import random
    rnd, made, expected = random.Random(11), [], set()
    for d in ("a", "b", None, "hot"):
        at = sorted(rnd.choices(range(-500, 4_000 if d == "hot" else 30_000), k=1500 if d == "hot" else 300))
        free = None
        for i, t in enumerate(at):
            made.append((f"{d}{i:04d}", d, t))
            if free is None or t >= free:
                expected.add(f"{d}{i:04d}")
                free = t + 70
    made += [("none1", "a", None), ("none2", None, None), (None, "quiet", 5), (None, "quiet", 6), ("a9999", "quiet", 2_000_000_000)]
    expected |= {"none1", "none2", "a9999"}
    rows_ = spark.createDataFrame(made, "id string, destination string, at_s bigint").repartition(5)
    for block in (70, 1000, 86400):
        got = monitors.damp_flaps(rows_, 70, block_s=block).collect()
        assert len(got) == len(made)
        assert {r["id"] for r in got if r["sent"] and r["id"]} == expected
        assert sorted(r["at_s"] for r in got if r["sent"] and not r["id"]) == [5]
    assert monitors.damp_flaps(rows_.limit(0), 70).count() == 0 and monitors.damp_flaps(rows_, 0).filter("sent").count() == len(made)


def test_a_tenant_is_chained_batch_by_batch(spark):
    import pyarrow as pa

    entries = pa.RecordBatch.from_pydict({"tenant_id": [None, "a", "a", "b"], "_tail": [None, "t", None, None], "_left": ["1", None, "2", "3"],
                                          "_right": ["x"] * 4})
    cut = lambda size: pa.Table.from_batches(list(ledger._fold(entries.slice(i, size) for i in range(0, 4, size)))).to_pylist()
    assert cut(1) == cut(4) and [r["tenant_id"] for r in cut(4)] == [None, "a", "b"]
    assert [r["prev_hash"] for r in cut(4)] == [ledger.GENESIS, "t", ledger.GENESIS]
    reports = spark.createDataFrame([("t", "a", 1, "x", "pass", "s")], "tenant_id string, id string, created_at bigint, target string, verdict string, report_sha256 string")
    plan = ledger.build_ledger(reports)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan
