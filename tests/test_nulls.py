"""What nulls, damage, foreign tables and commands must not hide."""

import tempfile

from pyspark.sql import functions as F

from soundcheck.functions.jsonpath import json_path
from soundcheck.operators import chains, checks, discovery, ledger, monitors, probes
from soundcheck.operators.registry import Snapshot, check_kinds, register_check_kind
from soundcheck.operators.views import SnapshotSession
from soundcheck.session import materialise
from soundcheck.sources.snapshots import load_chain, load_snapshot


def test_checks_see_their_snapshot_only_and_only_query(spark):
    spark.range(9).createOrReplaceTempView("orders")
    made = checks.checks_table(spark, [
        dict(name="count", sql="SELECT count(*) FROM orders", equals="5"),
        dict(name="schema", sql="SELECT count(*) FROM sales.orders WHERE orders.id >= 0", equals="7"),
        dict(name="inner", sql="WITH x AS (SELECT id FROM orders o WHERE o.id IN (SELECT id FROM sales.orders)) SELECT max(id) FROM x", equals="4"),
        dict(name="command", sql="DROP VIEW orders", equals="1"), dict(name="rows", sql="SELECT id FROM orders", equals="1"),
        dict(name="zero", sql="SELECT 1 DIV (count(*) - 5) FROM orders", equals="1")])
    full = Snapshot({"orders": spark.range(5), "sales.orders": spark.range(7)})
    got = {r["name"]: r for r in checks.run_checks(spark, made, full).collect()}
    assert [got[n]["ok"] for n in ("count", "schema", "inner")] == [True] * 3
    assert got["rows"]["error"] == "expected one row, one column" and "DIVIDE_BY_ZERO" in got["zero"]["error"] and got["command"]["error"]
    assert spark.catalog.tableExists("orders") and not [t for t in spark.catalog.listTables() if t.name.startswith("check_")]
    bare = {r["name"]: r for r in checks.run_checks(spark, made, Snapshot({"other": spark.range(1)})).collect()}
    assert not any(r["ok"] for r in bare.values()) and "no table `orders`" in bare["count"]["error"]
    # Whatever way a name is spelled or shadowed, it is this snapshot's table or an error, also next to databases with such tables.
    spark.sql("CREATE DATABASE IF NOT EXISTS beside")
    spark.range(777).write.mode("overwrite").saveAsTable("beside.orders")
    spark.range(777).write.mode("overwrite").saveAsTable("lines")
    try:
        made = checks.checks_table(spark, [
            dict(name="identifier", sql="SELECT count(*) FROM IDENTIFIER('orders')", equals="5"),
            dict(name="shadowed", sql="SELECT count(*) FROM orders WHERE EXISTS (WITH orders AS (SELECT 1) SELECT * FROM orders)", equals="5"),
            dict(name="literal", sql="SELECT 'FROM sales.orders SubqueryAlias a.b'", equals="FROM sales.orders SubqueryAlias a.b"),
            dict(name="database", sql="SELECT count(*) FROM beside.orders", equals="777"), dict(name="default", sql="SELECT count(*) FROM lines", equals="777"),
            dict(name="nested", sql="SELECT count(*) FROM orders WHERE id IN (SELECT id FROM beside.orders)", equals="5"),
            dict(name="path", sql="SELECT count(*) FROM parquet.`/root/testdata/sf0.001/region.parquet`", equals="5")])
        got = {r["name"]: r for r in checks.run_checks(spark, made, full).collect()}
        assert {n for n, r in got.items() if r["ok"]} == {"identifier", "shadowed", "literal"}, got
        assert all("no table" in got[n]["error"] for n in ("database", "default", "nested", "path"))
        assert checks.run_checks(spark, made, Snapshot({"o": spark.table("beside.orders")})).filter("ok").count() == 2  # literal, and what is its own source
        via = checks.checks_table(spark, [dict(name="via", sql="SELECT count(*) FROM o", equals="777")])
        assert checks.run_checks(spark, via, Snapshot({"o": spark.table("beside.orders")})).first()["ok"]
        assert not checks.run_checks(spark, made.filter("name = 'identifier'"), Snapshot({"other": spark.range(1)})).first()["ok"]
    finally:
        spark.sql("DROP DATABASE beside CASCADE")
        spark.sql("DROP TABLE lines")
    spark.catalog.dropTempView("orders")


def test_one_failing_check_among_many_costs_two_more_scans(spark):
    made = [dict(name=f"n{i}", sql=f"SELECT {'1 DIV (count(*) - 5)' if i == 77 else f'count(*) + {i}'} FROM orders", expect_min=i) for i in range(200)]
    with SnapshotSession(spark, Snapshot({"orders": spark.range(5)})) as own:
        joint = checks._Joint(own.session)
        joint.run([(c["name"], *own.analyse(c["sql"])) for c in made])
        assert joint.runs == 3 and list(joint.errors) == ["n77"] and "DIVIDE_BY_ZERO" in joint.errors["n77"]
        assert joint.got == {f"n{i}": str(i + 5) for i in range(200) if i != 77}
        joint = checks._Joint(own.session)
        joint.settle([("a", "SELECT 1", "int"), ("b", "SELECT 2", "int")], [], ValueError("no place"))
        assert joint.got == {"a": "1", "b": "2"}
    calls = []

    def kind(s, mine, snapshot, as_of):
        rows = mine.collect()
        calls.append(len(rows))
        if any(r["name"] == "n5" for r in rows):
            raise ValueError("bad one")
        return checks.results(mine.withColumns({"ok": F.lit(True), "got": F.lit("1")}))

    if "fragile" not in check_kinds():
        register_check_kind("fragile", kind)
    got = checks.run_checks(spark, checks.checks_table(spark, [dict(name=f"n{i}", kind="fragile") for i in range(32)]), Snapshot()).collect()
    assert [r["name"] for r in got if not r["ok"]] == ["n5"] and len(got) == 32 and len(calls) == 11


def test_times_are_utc_in_any_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        t = spark.sql("SELECT 1 AS id, TIMESTAMP '2024-07-01 00:00:00Z' AS zoned, TIMESTAMP_NTZ '2024-03-10 02:30:00.25' AS gap, TIMESTAMP_NTZ '2024-07-01' AS plain")
        rows = [dict(name=f"{kind}_{c}", max_age_s=60, **({"sql": f"SELECT max({c}) FROM t"} if kind == "sql" else
                     dict(kind="field", table_name="t", filter="id = 1", field=c, order_by="id"))) for kind in ("sql", "field") for c in ("zoned", "plain", "gap")]
        got = {r["name"]: r for r in checks.run_checks(spark, checks.checks_table(spark, rows), Snapshot({"t": t}), "2024-07-01 00:01:00").collect()}
        assert [got[n]["detail"] for n in ("sql_zoned", "sql_plain", "field_zoned", "field_plain")] == ["age 1m0s (max 1m0s)"] * 4
        assert got["field_gap"]["got"] == "2024-03-10T02:30:00.250Z" and got["sql_gap"]["got"] == "2024-03-10 02:30:00.25"
        session = checks.sql_checks(spark, checks.checks_table(spark, [dict(name="s", sql="SELECT TIMESTAMP '2024-07-01 00:00:00Z'", max_age_s=60)]), None, "2024-07-01 00:01:00")
        assert session.first()["detail"] == "age 1m0s (max 1m0s)"
        ages = [discovery.observed_age(t, c, "2024-07-01 00:01:00").first()[0] for c in ("zoned", "plain")]
        assert ages == [60, 60] and discovery.observed_age(t, "gap", "2024-03-10 02:31:00").first()[0] == 60
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_checks_of_scaffold_hold_on_the_snapshot_they_come_from(spark):
    folder = tempfile.mkdtemp(prefix="run-") + "/s"
    spark.range(6).selectExpr("id", "date_add(DATE '2024-01-01', int(id % 3)) AS ts").write.partitionBy("ts").parquet(f"{folder}/events")
    spark.range(4).selectExpr("id", "TIMESTAMP '2024-01-03 00:00:00' AS updated_at").write.parquet(f"{folder}/Odd `Name.parquet")
    snapshot, _, _ = load_snapshot(spark, folder, views=False)
    snapshot.tables["sales.components"] = spark.range(3)
    snapshot.components = ("timescaledb",)
    named = {}
    for flavor in ("postgres", "mysql"):
        made = materialise(discovery.scaffold(spark, snapshot, flavor, as_of="2024-01-04 00:00:00").select(*checks.CHECK_FIELDS), "made")
        again = checks.run_checks(spark, made, snapshot, "2024-01-04 00:00:00").collect()
        named[flavor] = {r["name"] for r in again}
        assert all(r["ok"] for r in again) and len(named[flavor]) == len(again) == made.count(), again
        assert {"server_reachable", "schema_present"} <= named[flavor]
    assert {"events_is_partitioned", "events_chunks", "events_fresh", "timescaledb_loaded", "sales_components_nonempty"} <= named["postgres"]


def test_a_field_that_is_absent_differs_from_a_null(spark):
    docs = Snapshot({"t": spark.sql("SELECT 1 AS id, parse_json('{\"a\": null, \"b\": 2}') AS d")})
    made = checks.checks_table(spark, [dict(name=n, kind="field", table_name="t", filter="id = 1", field=f"d.{n}", order_by="id", equals="null")
                                       for n in ("a", "c")])
    got = {r["name"]: r for r in checks.run_checks(spark, made, docs).collect()}
    assert got["a"]["ok"] and not got["c"]["ok"] and "the row has no" in got["c"]["error"]


def test_a_response_without_status_or_body_fails(spark):
    made = checks.default_checks(checks.checks_table(spark, [dict(name="r", kind="response", url="u", expect_body_contains="x")]))
    rows = spark.createDataFrame([("u", None, "x", 1), ], "url string, status int, body string, captured_at int")
    assert "status" in probes.response_checks(made, rows).first()["error"]
    rows = spark.createDataFrame([("u", 200, None, 1)], "url string, status int, body string, captured_at int")
    assert not probes.response_checks(made, rows).first()["ok"]


def test_nulls_break_a_chain(spark):
    kind = "tenant_id string, seq bigint, prev_hash string, entry_hash string, created_at bigint"
    for rows in ([("t", 1, None, "a", 1)], [("t", 1, ledger.GENESIS, "a", 1), ("t", None, "a", "b", 2)],
                 [("t", 1, ledger.GENESIS, None, 1)], [("t", 1, ledger.GENESIS, "a", None)]):
        assert not ledger.verify_chain(spark.createDataFrame(rows, kind)).first()["ok"]
    assert ledger.verify_chain(spark.createDataFrame([("t", 1, ledger.GENESIS, "a", 1)], kind)).first()["ok"]


def test_reports_older_than_the_tail_are_refused(spark):
    kind = "tenant_id string, id string, created_at bigint, target string, verdict string, report_sha256 string"
    old = materialise(ledger.build_ledger(spark.createDataFrame([("t", "a", 10, "x", "pass", "s"), ("t", "b", 20, "x", "pass", "s")], kind)), "old")
    new, refused = ledger.append_ledger(old, spark.createDataFrame([("t", "c", 15, "x", "pass", "s"), ("t", "d", 20, "x", "pass", "s"), ("u", "e", 1, "x", "pass", "s")], kind))
    assert {r["id"]: r["seq"] for r in new.collect()} == {"d": 3, "e": 1} and [r["id"] for r in refused.collect()] == ["c"]


def test_a_monitor_without_state_alerts(spark):
    rows = spark.createDataFrame([("m", None, True), ("n", "", True), ("o", None, False)], "monitor_id string, alert_state string, overdue boolean")
    assert {r["monitor_id"] for r in monitors.transitions(rows, 5).collect()} == {"m", "n"}


def test_deliveries_without_time_stay(spark):
    rows = spark.createDataFrame([(1, "t", "d", None), (2, "t", "d", 5)], "id int, tenant_id string, destination string, at_s bigint")
    assert {r["id"]: r["allowed"] for r in monitors.rate_limit(rows, n=1).collect()} == {1: True, 2: True}


def test_a_null_subject_is_a_subject(spark):
    rows = spark.createDataFrame([("g", None, 5, 0), ("g", "a", 9, 1), ("g", "b", 1, 2), (None, None, 0, 3)],
                                 "cap_group string, subject string, weight bigint, ord int")
    capped = discovery.cap_candidates(rows, 2).collect()
    assert {r["ord"] for r in capped} == {0, 1, 3} and all(r["truncated"] for r in capped)
    assert discovery.cap_candidates(rows).count() == 4


def test_a_bad_or_missing_expression_is_told_for_every_snapshot(spark):
    rows = spark.createDataFrame([("a", 1), ("b", -1)], "snapshot_id string, price int")
    made = checks.checks_table(spark, [dict(name="ok", sql="count_if(price < 0)", equals="0"), dict(name="bad", sql="nope(price)", equals="0")])
    found = chains.snapshot_results(rows, made).collect()
    assert {(r["snapshot_id"], r["name"]): r["ok"] for r in found} == {("a", "ok"): True, ("b", "ok"): False, ("a", "bad"): False, ("b", "bad"): False}
    assert all(r["error"] for r in found if r["name"] == "bad")
    none = chains.snapshot_verdicts(rows, made.limit(0)).collect()
    assert {r["snapshot_id"]: r["verdict"] for r in none} == {"a": "pass", "b": "pass"}


def test_a_key_with_both_quotes(spark):
    rows = spark.createDataFrame([("{\"it's \\\"a\\\"\": 7}", "it's \"a\""), ("{\"b\": 8}", "b"), ("{\"b\": 8}", "no 'such' \"key\"")], "j string, p string")
    got = rows.select(json_path("j", "p").alias("r")).select("r.*").collect()
    assert [r["value"] for r in got] == ["7", "8", None] and got[2]["error"]


def test_damaged_csv_is_counted(spark):
    folder = tempfile.mkdtemp(prefix="run-") + "/s"
    spark.createDataFrame([("a,b",), ("1,2",), ("3",), ("5,6,7",), ("8,9",)], "value string").coalesce(1).write.text(f"{folder}/t.csv")
    snapshot, load, rows = load_snapshot(spark, folder, views=False)
    assert rows.first()["rows"] == 2 and "2" in load.first()["warnings"]


def test_a_broken_snapshot_is_a_failing_member(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    for label in ("s1", "s3"):
        spark.range(3).write.parquet(f"{folder}/{label}/t.parquet")
    spark.createDataFrame([("not parquet",)], "value string").write.text(f"{folder}/s2/t.parquet")
    tables, loads = load_chain(spark, folder)
    assert {r["snapshot_id"]: r["ok"] for r in loads.collect()} == {"s1": True, "s2": False, "s3": True}
    assert {r["snapshot_id"]: r["count"] for r in tables["t"].groupBy("snapshot_id").count().collect()} == {"s1": 3, "s3": 3}


def test_scaffold_notices_partitions_and_components(spark):
    folder = tempfile.mkdtemp(prefix="run-") + "/s"
    days = spark.range(6).selectExpr("id", "date_add(DATE '2024-01-01', int(id % 3)) AS day")
    days.write.partitionBy("day").parquet(f"{folder}/log")
    snapshot, _, _ = load_snapshot(spark, folder, views=False)
    assert snapshot.partitions == {"log": "day"}
    snapshot.components = ("timescaledb",)
    made = discovery.scaffold(spark, snapshot, as_of="2024-01-04 00:00:00")
    rows = {r["name"]: r for r in made.collect()}
    assert {"log_is_partitioned", "log_chunks", "timescaledb_loaded"} <= set(rows) and rows["log_chunks"]["expect_min"] == 3
    flat = Snapshot({"log": days})
    again = {r["name"]: r["ok"] for r in checks.run_checks(spark, made.select(*checks.CHECK_FIELDS), flat, "2024-01-04 00:00:00").collect()}
    assert not again["log_is_partitioned"] and again["log_chunks"] and not again["timescaledb_loaded"]


def test_a_chain_knows_its_damaged_members(spark, tmp_path):
    for i, label in enumerate(("s1", "s2", "s3", "s 4", "s5")):
        spark.range(i + 3).repartition(2).write.parquet(f"{tmp_path}/c/{label}/t.parquet")
        spark.range(2).write.options(header=True).csv(f"{tmp_path}/c/{label}/u.csv")
    spark.range(5).withColumn("more", F.lit("x")).write.parquet(f"{tmp_path}/c/s6/t.parquet")  # another column, another table less
    spark.range(5).limit(0).coalesce(1).write.mode("append").parquet(f"{tmp_path}/c/s1/t.parquet")  # a file without rows is a good one
    second = sorted((tmp_path / "c/s3/t.parquet").glob("part-*.parquet"))[1]
    second.write_bytes(second.read_bytes()[:-9])  # cut off
    next((tmp_path / "c/s5/u.csv").glob("part-*.csv")).write_text("id\n1\n2,3,4\n")  # ragged
    for sums in (tmp_path / "c/s5/u.csv").glob(".part-*.crc"):
        sums.unlink()
    tables, loads = load_chain(spark, f"{tmp_path}/c")
    told = {r["snapshot_id"]: (r["ok"], r["error"]) for r in loads.collect()}
    assert [label for label, (ok, _) in sorted(told.items()) if ok] == ["s 4", "s1", "s2", "s6"]
    assert second.name in told["s3"][1] and told["s5"][1] == "u: 1 damaged record(s)"
    assert {r["snapshot_id"]: r["count"] for r in tables["t"].groupBy("snapshot_id").count().collect()} == {"s1": 3, "s2": 4, "s 4": 6, "s6": 5}
    assert {r["snapshot_id"]: r["count"] for r in tables["u"].groupBy("snapshot_id").count().collect()} == {"s1": 2, "s2": 2, "s 4": 2}
    assert tables["u"].columns == ["id", "snapshot_id"] and tables["t"].filter("more = 'x'").count() == 5
    members = loads.selectExpr("'u' AS unit", "snapshot_id AS label", "'full' AS type", "timestamp_seconds(ascii(right(snapshot_id, 1))) AS ts",
                               "cast(ascii(right(snapshot_id, 1)) AS bigint) AS ord", "if(ok, 'pass', 'fail') AS verdict")
    walked = chains.last_good(members.filter("label < 's6'")).orderBy("rn").collect()
    assert [(r["label"], r["is_recovery_point"]) for r in walked] == [("s5", False), ("s 4", True)]


def test_every_member_is_checked_as_run_checks_does(spark):
    made = checks.checks_table(spark, [dict(name="s", sql="SELECT sum(id) FROM t", expect_min=3), dict(name="c", kind="count", table_name="t", filter="id > 1", expect_min=1),
                                       dict(name="f", kind="field", table_name="t", filter="id >= 0", field="id", order_by="id", equals="0", severity="advisory"),
                                       dict(name="bad", sql="SELECT count(*) FROM gone", expect_min=0, severity="advisory")])
    members = {f"m{n}": lambda n=n: Snapshot({"t": spark.range(n)}) for n in (1, 3)}

    def broken():
        raise OSError("cut off")

    got = chains.run_every(spark, made, {**members, "broken": broken}, unit_col="label")
    rows = {(r["label"], r["name"]): (r["ok"], r["got"], r["error"]) for r in got.collect()}
    for label, member in members.items():
        assert {r["name"]: (r["ok"], r["got"], r["error"]) for r in checks.run_checks(spark, made, member()).collect()} == {
            n: v for (m, n), v in rows.items() if m == label}
    assert all(not ok and "cut off" in error for (m, _), (ok, _, error) in rows.items() if m == "broken") and len(rows) == 12
    assert {r["label"]: r["verdict"] for r in chains.verdict_of_every(got, "label").collect()} == {"m1": "fail", "m3": "pass", "broken": "fail"}
    assert chains.run_every(spark, made, {}).count() == 0


def test_a_chain_of_partitions_and_one_without_any_good_file(spark, tmp_path):
    spark.range(9).selectExpr("id", "concat('d', id % 3) AS snapshot_id").write.partitionBy("snapshot_id").parquet(f"{tmp_path}/c/t")
    for f in (tmp_path / "c/t/snapshot_id=d1").glob("part-*"):
        f.write_bytes(b"PAR1 not")
    tables, loads = load_chain(spark, f"file://{tmp_path}/c")
    assert {r["snapshot_id"]: r["ok"] for r in loads.collect()} == {"d0": True, "d1": False, "d2": True}
    assert sorted(r["snapshot_id"] for r in tables["t"].collect()) == ["d0"] * 3 + ["d2"] * 3
    for f in (tmp_path / "c/t").glob("*/part-*"):
        f.write_bytes(b"nothing")
    tables, loads = load_chain(spark, f"{tmp_path}/c")
    assert loads.filter("ok").count() == 0 and not tables
