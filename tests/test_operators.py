import os
import tempfile

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from soundcheck.functions import secrets as S
from soundcheck.operators import access, chains, checks as B, discovery as D, ledger as L, monitors as M, redact as R, verdict as V
from soundcheck.operators.expect import evaluate_expectations
from soundcheck.operators.registry import Snapshot, register_check_kind
from soundcheck.sources import files, listings, reports, snapshots

AS_OF = "2024-01-31 00:00:00"


def test_expectation_contract(spark):
    cases = [  # got, expectation, ok, is error
        ("5", dict(expect_min=1), True, False), ("0", dict(expect_min=1), False, False), ("100", dict(expect_max=10), False, False),
        ("5", dict(expect_min=1, expect_max=10), True, False), ("oops", dict(expect_min=1), False, True),
        ("shipped", dict(equals="shipped"), True, False), ("pending", dict(equals="shipped"), False, False),
        ("2024-01-30T23:00:00.000Z", dict(max_age_s=86400), True, False), ("2024-01-28T00:00:00.000Z", dict(max_age_s=86400), False, False),
        ("not-a-time", dict(max_age_s=86400), False, True), ("2030-01-01", dict(max_age_s=1), True, False), ("t", dict(bool=True), True, False),
        ("0", dict(bool=True), False, False), ("maybe", dict(bool=True), False, True), ("x", {}, False, True)]
    defs = B.checks_table(spark, [dict(name=str(i), **e) for i, (_, e, _, _) in enumerate(cases)])
    got = spark.createDataFrame([(f"c{i:04d}", c[0]) for i, c in enumerate(cases)], "check_id string, got string")
    out = evaluate_expectations(defs.join(got, "check_id"), AS_OF).orderBy("ord").collect()
    assert [(r["ok"], r["error"] is not None) for r in out] == [(c[2], c[3]) for c in cases]
    details = {r["name"]: r["detail"] for r in out}
    assert details["1"] == "0 < min 1" and details["2"] == "100 > max 10" and details["3"] == "5 within bounds"
    assert details["6"] == 'want "shipped"' and details["7"] == "age 1h0m0s (max 24h0m0s)"


def test_a_broken_expectation_flips_only_its_row(spark):
    rows = [dict(name=f"n{i}", sql=f"SELECT {i}", equals=str(i)) for i in range(5)]
    run = lambda: [r["ok"] for r in B.run_checks(spark, B.checks_table(spark, rows), Snapshot(), AS_OF).collect()]
    assert run() == [True] * 5
    rows[3]["equals"] = "other"
    assert run() == [True, True, True, False, True]


def test_bad_checks_are_rows(spark):
    t = spark.range(3)
    made = B.checks_table(spark, [
        dict(name="div", sql="SELECT 1 / (count(*) - 3) FROM t", expect_min=1), dict(name="many", sql="SELECT id FROM t", expect_min=1),
        dict(name="two", sql="SELECT 1, 2", expect_min=1), dict(name="none", sql="SELECT id FROM t WHERE id > 9", expect_min=1),
        dict(name="fine", sql="SELECT count(*) FROM t;", equals="3"), dict(name="odd", kind="x"),
        dict(name="files", kind="file_exists", path="p"), dict(name="cast", kind="count", table_name="t", filter="CAST('x' AS INT) = id", expect_min=1),
        dict(name="ok", kind="count", table_name="t", equals="3")])
    out = {r["name"]: r for r in B.run_checks(spark, made, Snapshot({"t": t}), AS_OF).collect()}
    assert [n for n, r in out.items() if r["ok"]] == ["fine", "ok"]
    assert out["many"]["error"] == "expected one row, one column" and out["odd"]["error"] == 'unknown check kind "x"'
    assert out["none"]["error"].startswith("expected a number") and "file inventory" in out["files"]["error"]


def test_kind_registry_refuses(spark):
    for name in ("", "sql"):
        with pytest.raises(ValueError):
            register_check_kind(name, B.sql_checks)
    with pytest.raises(ValueError):
        B.checks_table(spark, [dict(name="x", expect_minimum=1)])


def test_verdict_rule(spark):
    load = spark.createDataFrame([("a", True), ("b", True), ("c", True), ("d", False), ("e", True), ("f", None)], "run_id string, ok boolean")
    results = spark.createDataFrame([("a", False, "advisory"), ("b", False, "required"), ("c", None, ""), ("e", True, None)],
                                    "run_id string, ok boolean, severity string")
    got = {r["run_id"]: r["verdict"] for r in V.verdicts(results, load).collect()}
    assert got == {"a": "pass", "b": "fail", "c": "fail", "d": "fail", "e": "pass", "f": "fail"}


def _reports(spark, n):
    results = spark.range(n).select(
        F.lit("r").alias("run_id"), F.col("id").cast("int").alias("ord"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("name"),
        (F.col("id") != 7).alias("ok"), F.lit("required").alias("severity"), F.lit("1").alias("got"), F.lit("d").alias("detail"),
        F.lit(None).cast("string").alias("error"), F.lit(False).alias("keep_literal"))
    load = spark.createDataFrame([("r", "t", "1", True, "copy", "db", 5, None, None)],
                                 "run_id string, target string, tool_version string, ok boolean, method string, database string, load_ms bigint, "
                                 "warnings string, error string")
    now = F.timestamp_seconds(F.lit(1_700_000_000))
    return V.build_reports(results, load.withColumns({"started_at": now, "finished_at": now}))


def test_a_run_is_one_report_whatever_its_ords(spark):
    rows = _reports(spark, 25).collect()
    assert len(rows) == 1 and rows[0]["verdict"] == "fail" and [c["name"] for c in rows[0]["checks"]] == [f"c{i}" for i in range(25)]
    far = [("r", -1000, "a", True), ("r", 100_000, "b", False), ("r", 1_000_000, "c", True)]
    results = spark.createDataFrame(far, "run_id string, ord int, name string, ok boolean").selectExpr(
        "*", "'required' AS severity", "'1' AS got", "'' AS detail", "CAST(NULL AS string) AS error", "false AS keep_literal")
    load = _reports(spark, 1).select("run_id", "target", "tool_version", "started_at", "finished_at", "load.*").withColumnRenamed("duration_ms", "load_ms")
    report = V.build_reports(results, load).collect()
    assert [(len(r["checks"]), r["part"], r["verdict"]) for r in report] == [(3, 0, "fail")]


def test_reports_are_written_redacted_and_read_strictly(spark):
    path = tempfile.mkdtemp(prefix="run-") + "/reports"
    known = spark.createDataFrame([(0, "TOKEN", "s3cret-value")], "ord int, name string, value string")
    leaky = _reports(spark, 3).withColumn("load", F.col("load").withField("warnings", F.lit("used s3cret-value\nmore")))
    reports.write_reports(leaky, path, known)
    raw = "".join(r["value"] for r in spark.read.text(path).collect())
    assert "s3cret-value" not in raw and "[REDACTED:TOKEN]" in raw
    assert reports.read_reports(spark, path).first()["schema_version"] == 1
    spark.createDataFrame([("{\"schema_version\": \"x\", \"run_id\": 1, ",)], "value string").write.text(path + "-bad")
    with pytest.raises(Exception):
        reports.read_reports(spark, path + "-bad").collect()


SECRETS = [("A", "alpha-secret"), ("B", "alpha-secret-long"), ("C", "REDACTED"), ("D", "ümlaut"), ("E", "]x[R")]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from([v for _, v in SECRETS] + [" ", "\n", "x", "é", "long text " * 40]), max_size=8).map("".join),
                min_size=1, max_size=8))
def test_redaction_properties(spark, texts):
    known = spark.createDataFrame([(i, n, v) for i, (n, v) in enumerate(SECRETS)], "ord int, name string, value string")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")

    def fold(t):
        for name, value in S.longest_first(SECRETS):
            t = t.replace(value, S.marker(name))
        return t
    one = [r["t"] for r in R.scrub(df, ["t"], known).orderBy("i").collect()]
    many = [r["t"] for r in R.scrub(df, ["t"], known, per_pass=2).orderBy("i").collect()]
    assert one == many == [fold(t) for t in texts]


def test_scrub_longest_first(spark):
    known = spark.createDataFrame([(0, "PGPASS", "hunter2-named"), (1, None, "hunter2-named-and-longer"), (2, "SHORT", "abc")],
                                  "ord int, name string, value string")
    df = spark.createDataFrame([("a hunter2-named b hunter2-named-and-longer c abc",)], "t string")
    assert R.scrub(df, ["t"], known).first()["t"] == "a [REDACTED:PGPASS] b [REDACTED] c abc"


def test_equal_values_are_replaced_in_sequence_whatever_the_number(spark):
    known = spark.createDataFrame([(0, "TOKEN", "TOKEN"), (1, "B", "TOKEN")] + [(i, f"n{i}", f"value-{i}") for i in range(2, 40)],
                                  "ord int, name string, value string")
    df = spark.createDataFrame([("x TOKEN y",)], "t string")
    for some in (known, known.where("ord < 2")):
        assert R.scrub(df, ["t"], some).first()["t"] == "x [REDACTED:[REDACTED:B]] y"
    plan = R.scrub(df, ["t"], known)._jdf.queryExecution().toString()
    assert "value-3" not in plan
    assert R.scrub(df, ["t"], known.limit(0)).first()["t"] == "x TOKEN y"


def test_a_long_value_that_ends_in_a_fingerprint_is_not_kept(spark):
    known = spark.createDataFrame([(0, "TOKEN", "s3cret-value")], "ord int, name string, value string")
    text = F.concat(F.repeat(F.lit("x"), 5000), F.lit("[sha256:" + "0" * 64 + "]"))
    r = _reports(spark, 1).withColumn("checks", F.transform("checks", lambda c: c.withField("got", text)))
    assert all(len(c["got"]) < 256 for c in R.redact_reports(r, known).first()["checks"])


def test_redacting_twice_changes_nothing(spark):
    known = spark.createDataFrame([(0, "TOKEN", "s3cret-value"), (1, "LONG", "s3cret-value-2")], "ord int, name string, value string")
    text = F.lit("first s3cret-value line\n" + "more s3cret-value-2 " * 30)
    r = _reports(spark, 4).withColumns({
        "load": F.col("load").withField("warnings", text).withField("error", text),
        "checks": F.transform("checks", lambda c: c.withField("got", text).withField("error", text).withField("keep_literal", c["ord"] == 2))})
    once = R.redact_reports(r, known)
    a, b = once.collect(), R.redact_reports(once, known).collect()
    assert a == b and "s3cret" not in str(a)
    assert a[0]["checks"][0]["got"].startswith("first [REDACTED:TOKEN] line [sha256:") and a[0]["checks"][2]["got"].count("\n") == 1
    assert {x["name"] for x in R.raw_output(r, once).collect()} == {"load warnings", "c0", "c1", "c2", "c3"}
    assert R.raw_output(once, once).count() == 0


def test_payloads_at_any_depth(spark):
    known = spark.createDataFrame([(0, "T", 's3"cret')], "ord int, name string, value string")
    many = known.union(spark.range(30).selectExpr("int(id + 1)", "concat('n', id)", "concat('unused-', id)"))
    df = spark.createDataFrame([(1, 's3"cret', [["k", ['s3"cret', "ok"]]], {"s3": ['s3"cret']}, '{"a":["s3\\"cret",1],"s3":{"b":"Bearer abcd1234"}}')],
                               "i int, t string, n array<struct<k:string,v:array<string>>>, m map<string,array<string>>, j string")
    for some in (known, many):
        row = R.scrub_payload(df, some, ("j",)).first()
        assert row["n"][0]["v"] == ["[REDACTED]", "ok"]
    assert row["t"] == "[REDACTED]" and row["m"] == {"s3": ["[REDACTED]"]}
    assert row["j"] == '{"a":["[REDACTED]",1],"s3":{"b":"Bearer [REDACTED]"}}'


def test_cap_keeps_whole_subjects(spark):
    rows = [("structural", None, None, 0), ("big_min", "table", "big", 100), ("big_fresh", "table", "big", 100), ("mid_min", "table", "mid", 50),
            ("tiny_min", "table", "tiny", 1), ("logs", "dir", "logs", 3), ("mid_twin", "table", "twin", 50)]
    c = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, name string, cap_group string, subject string, weight bigint")
    out = D.cap_candidates(c, 2).collect()
    assert {r["name"] for r in out} == {"structural", "big_min", "big_fresh", "mid_min", "logs"} and out[0]["truncated"]
    assert not D.cap_candidates(c, 9).first()["truncated"]


def test_scaffold_passes_on_its_own_snapshot(spark):
    t = spark.range(10).withColumn("updated_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")))
    snapshot = Snapshot({"a.T 1": t, "empty": t.limit(0)})
    for flavor in ("postgres", "mysql"):
        made = D.scaffold(spark, snapshot, flavor, as_of=AS_OF)
        names = [r["name"] for r in made.collect()]
        assert "server_reachable" in names and any(n.endswith("_fresh") for n in names) and not any(n.startswith("empty") for n in names)


def test_lazy_search_agrees_and_stops(spark):
    b = spark.createDataFrame([("u", i, f"b{i}", "full", 1_700_000_000 + i, "pass" if i in (3, 6) else "fail") for i in range(10)],
                              "unit string, ord bigint, label string, type string, s bigint, verdict string").withColumn("ts", F.timestamp_seconds("s"))
    verdicts = {f"b{i}": ("" if i in (3, 6) else "bad") for i in range(10)}
    for max_try, parallel in ((0, 1), (0, 3), (2, 1)):
        asked = []
        lazy = chains.last_good_search(spark, chains.chain(b), lambda l: asked.append(l) or verdicts[l], max_try, parallel)
        full = chains.last_good(b, max_try)
        key = ["rn", "label", "verdict", "is_recovery_point"]
        assert sorted(map(tuple, lazy.select(key).collect())) == sorted(map(tuple, full.select(key).collect()))
        assert len(asked) <= 6


@pytest.mark.parametrize("field,value,step", [
    ("verdict", "other", "chain hash"), ("created_at", 5, "chain hash"), ("report_raw", "{}", "report hash"), ("signature", "AAAA", "signature"),
    ("key_id", "unknown", "signature"), ("entry_hash", "00" * 32, "chain hash")])
def test_tampering_any_field_is_seen(spark, field, value, step):
    import base64
    from soundcheck.functions import ed25519
    raw = spark.createDataFrame([("t", "a", 1, "x", "pass", '{"k":1}'), ("t", "b", 2, "x", "fail", '{"k":2}')],
                                "tenant_id string, id string, created_at bigint, target string, verdict string, report_raw string")
    raw = raw.withColumn("report_sha256", F.sha2("report_raw", 256))
    ledger = L.build_ledger(raw).join(raw.select("id", "report_raw"), "id").collect()
    seed = b"\7" * 32
    signed = [dict(r.asDict(), key_id="k", signature=base64.b64encode(ed25519.sign(seed, bytes.fromhex(r["entry_hash"]))).decode().rstrip("="))
              for r in ledger]
    keys = spark.createDataFrame([("k", base64.b64encode(ed25519.public_key(seed)).decode())], "key_id string, public_key string")
    whole = spark.createDataFrame(signed, L.CHAINED + ", report_raw string, key_id string, signature string")
    assert whole.count() == L.verify_entries(whole, keys).filter("valid").count() == 2
    assert L.verify_entries(whole).filter("valid").count() == 0  # without keys nothing is shown valid
    bad = whole.withColumn(field, F.when(F.col("id") == "b", F.lit(value)).otherwise(F.col(field)))
    failed = {(r["id"], r["step"]) for r in L.verify_steps(bad, keys).filter("NOT ok").collect()}
    assert ("b", step) in failed and not any(i == "a" for i, _ in failed)


def test_append_continues_and_refuses(spark):
    make = lambda ids: spark.createDataFrame([("t", i, n, "x", "pass", i) for n, i in enumerate(ids)],
                                             "tenant_id string, id string, created_at bigint, target string, verdict string, report_sha256 string")
    first = L.build_ledger(make(["a", "b"]))
    new, refused = L.append_ledger(first, make(["b", "c", "d"]))
    assert [(r["seq"], r["id"]) for r in new.orderBy("seq").collect()] == [(3, "c"), (4, "d")]
    assert [tuple(r) for r in refused.collect()] == [("b", 1)]
    assert L.verify_chain(first.unionByName(new)).first()["ok"]


def test_snapshot_outcomes(spark):
    root = tempfile.mkdtemp(prefix="run-")
    with pytest.raises(snapshots.OperationalError):
        snapshots.load_snapshot(spark, root + "/missing")
    spark.range(3).write.parquet(f"{root}/good.parquet")
    with open(f"{root}/lines.json", "w") as f:
        f.write('{"a": 1}\n{oops\n{"a": 2}\n')
    _, load, counts = snapshots.load_snapshot(spark, root)
    assert load.first()["ok"] and load.first()["warnings"] == "load ignored 1 error(s)"
    assert {r["table"]: r["rows"] for r in counts.collect()} == {"good": 3, "lines": 2}
    with open(f"{root}/torn.parquet", "wb") as f:
        f.write(b"PAR1 torn")
    snapshot, load, _ = snapshots.load_snapshot(spark, root)
    assert not load.first()["ok"] and load.first()["error"].startswith("torn:") and set(snapshot.tables) == {"good", "lines"}


def test_snapshot_folders(spark):
    root = tempfile.mkdtemp(prefix="run-")
    for label, n in (("2024-01-01", 2), ("snapshot_id=2024-01-02", 3)):
        spark.range(n).write.parquet(f"{root}/{label}/t.parquet")
    got = snapshots.load_snapshots(spark, root)["t"].groupBy("snapshot_id").count().collect()
    assert {r["snapshot_id"]: r["count"] for r in got} == {"2024-01-01": 2, "2024-01-02": 3}


def test_inventory_sees_hidden_files(spark):
    root = tempfile.mkdtemp(prefix="run-")
    os.makedirs(f"{root}/.a/_b/c")
    for name in (".top", ".a/_b/x y.txt", ".a/_b/c/deep"):
        with open(f"{root}/{name}", "w") as f:
            f.write(name)
    inv = {r["path"]: r for r in files.file_inventory(spark, root, with_hash=True).collect()}
    assert set(inv) == {".top", ".a", ".a/_b", ".a/_b/x y.txt", ".a/_b/c", ".a/_b/c/deep"}
    import hashlib
    assert inv[".a/_b/x y.txt"]["sha256"] == hashlib.sha256(b".a/_b/x y.txt").hexdigest() and inv[".a"]["is_dir"]
    assert inv[".a/_b/c/deep"]["dir"] == ".a/_b/c" and inv[".top"]["dir"] == "" and inv[".a"]["sha256"] is None
    assert sorted(files.file_inventory(spark, f"file://{root}", with_hash=True).collect()) == sorted(inv.values())


def test_inventory_by_another_scheme_and_with_unreadable_folders(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="run-")
    os.makedirs(f"{root}/a/b c")
    for name in ("top", "a/b c/deep", "a/x"):
        with open(f"{root}/{name}", "w") as f:
            f.write(name)
    mount = os.path.basename(root).replace("_", "")
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{mount}.link./data", f"file:{root}")
    plain = files.file_inventory(spark, root, with_hash=True).drop("mtime").collect()
    there = files.file_inventory(spark, f"viewfs://{mount}/data", with_hash=True)
    wanted = [r if not r["is_dir"] else type(r)(**{**r.asDict(), "size": 0}) for r in plain]
    assert sorted(map(tuple, there.drop("mtime").collect()), key=str) == sorted(map(tuple, wanted), key=str)
    assert there.filter("mtime IS NULL AND NOT is_dir").count() == 0
    import pandas as pd
    told = pd.concat(files._list(iter([pd.DataFrame({"path": [f"{root}/gone", f"{root}/a"]})])))
    assert told["error"].notna().tolist() == [True, False, False]

    def failing(folder):
        if folder.endswith("/a"):
            raise PermissionError(13, "not for you", folder)
        with os.scandir(folder) as it:
            return [(e.path, 1, 1, e.is_dir()) for e in it]

    monkeypatch.setattr(files, "_scan", failing)
    got = {r["path"]: r["error"] for r in files.file_inventory(spark, root).collect()}
    assert set(got) == {"a", "top"} and "not for you" in got["a"] and got["top"] is None


def test_listings(spark):
    df = spark.createDataFrame([(1, 'warn\n[{"time":"2024-01-02T03:04:05.5+02:00","id":"0123456789","short_id":""}] end'), (2, "[]"), (3, "nope")],
                               "id int, out string")
    out = {r["id"]: r for r in listings.parse_restic_snapshots(df, "out").collect()}
    assert set(out) == {1, 3} and out[1]["label"] == "01234567" and out[3]["error"]
    borg = spark.createDataFrame([(1, '{"archives":[{"archive":"old","start":"2024-01-02T03:04:05"}]}'), (2, "{}"), (3, '{"archives":[{"name":"a","time":"x"}]}')],
                                 "id int, out string")
    out = {r["id"]: r for r in listings.parse_borg_archives(borg, "out").collect()}
    assert set(out) == {1, 3} and out[1]["label"] == "old" and "unparseable archive time" in out[3]["error"]


def test_overdue_status(spark):
    m = spark.createDataFrame([("m1", "t", "a"), ("m2", "t", "b"), ("m3", "t", "c")], "monitor_id string, tenant_id string, target string").withColumns({
        "created_at": F.lit(0).cast("bigint"), "interval_s": F.lit(100).cast("bigint"), "grace_s": F.lit(10).cast("bigint"), "alert_state": F.lit("ok")})
    a = spark.createDataFrame([("t", "a", 890), ("t", "b", 889)], "tenant_id string, target string, created_at bigint")
    got = {r["monitor_id"]: (r["status"], r["overdue"]) for r in M.overdue(m, a, 1000).collect()}
    assert got == {"m1": ("ok", False), "m2": ("overdue", True), "m3": ("never", True)}


def test_siblings_never_see_each_other(spark):
    orgs = spark.createDataFrame([("c1", "msp", "private"), ("c2", "msp", "private"), ("x", None, "private"), ("p", None, "public")],
                                 "org_id string, parent_org_id string, ledger_visibility string")
    members = spark.createDataFrame([("anna", "c1", "viewer"), ("max", "msp", "admin")], "account_id string, org_id string, role string")
    ledger = spark.createDataFrame([(o,) for o in ("c1", "c2", "x", "p")], "tenant_id string")
    see = lambda who: {r[0] for r in access.visible_ledger(ledger, orgs, members, who).collect()}
    assert see("anna") == {"c1", "p"} and see("max") == {"c1", "c2", "p"} and see("nobody") == {"p"}
    tokens = spark.createDataFrame([("good", "x", "ledger", None, None), ("old", "c1", "ledger", 5, None), ("off", "c2", "ledger", None, 1)],
                                   "t string, org_id string, scope string, expires_at bigint, revoked_at bigint").withColumn("id", F.sha2("t", 256))
    opened = access.token_orgs(spark.createDataFrame([("good",), ("old",), ("off",)], "token string"), tokens, 10)
    assert {r[0] for r in opened.collect()} == {"x"}


def test_patterns_meet_only_the_files_that_still_fit(spark):
    import random
    import re
    from soundcheck.functions.globs import glob_regex
    from soundcheck.operators import probes
    rnd = random.Random(4)
    part = lambda: "".join(rnd.choices("abé.", k=rnd.randint(1, 4)))
    paths = sorted({"/".join(part() for _ in range(rnd.randint(1, 3))) for _ in range(400)}) + ["a]b", "x[y", "a*b"]
    wild = lambda: "".join(rnd.choice([*"ab.*?", "[ab]", "[!a]", "\\\\*", "é"]) for _ in range(rnd.randint(1, 5)))
    globs = [("/".join(wild() for _ in range(rnd.randint(1, 3))), rnd.choice([None, "path", "find"])) for _ in range(300)]
    globs += [("*", None), ("*", "find"), ("a]b", None), ("x[y", None), ("a\\*b", None), ("*/*", None), ("x[a/b]y", None), ("", None)]
    patterns = spark.createDataFrame([(f"g{i}", g, d) for i, (g, d) in enumerate(globs)], "check_id string, path string, dialect string")
    files_ = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r["check_id"]: r["n"] for r in probes.glob_counts(patterns, files_).collect()}
    for i, (g, d) in enumerate(globs):
        rx = re.compile(glob_regex(g, d or "path").replace("\\z", "\\Z"))
        assert got.get(f"g{i}", 0) == sum(1 for p in paths if rx.match(p)), (g, d)
    # Many patterns below one folder: a file meets those that share its longest literal stretch, not all.
    many = spark.range(3000).selectExpr("concat('c', id) AS check_id", "concat('d/', CASE id % 3 WHEN 0 THEN concat('f', id, '*') WHEN 1 THEN concat('*_', id, '.x') ELSE concat('*k', id, 'k*') END) AS path",
                                        "CAST(NULL AS STRING) AS dialect")
    names = spark.range(3000).selectExpr("concat('d/f', id, 'k', id, 'k_', id, '.x') AS path")
    edges, _ = probes._trie(many)
    shapes = {(e[3], len(e[4])) for e in edges if e[0] == 1}
    assert len(shapes) <= 15
    found = probes.glob_counts(many, names)
    assert found.agg(F.count("n"), F.min("n")).first()[0] == 3000
