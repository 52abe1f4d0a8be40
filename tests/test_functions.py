import datetime as dt

import pytest
from pyspark.sql import functions as F

from soundcheck.functions import ed25519, globs, jsonpath, messages, scalars, secrets, text
from soundcheck.sources.settings import setting_line, split_libraries


def ask(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_numbers(spark):
    good = {"5": 5.0, "-1.5": -1.5, ".5": 0.5, "2.": 2.0, "1e3": 1000.0, "+7": 7.0}
    assert ask(spark, list(good), scalars.parse_num_text) == list(good.values())
    assert ask(spark, ["1d", " 12 ", "", "NaN", "Inf", "0x1", "1e999", "5\n", None], scalars.parse_num_text) == [None] * 9


def test_booleans(spark):
    assert ask(spark, ["t", " TRUE ", "1", "f", "False", "0", "yes", "", None], scalars.parse_bool_text) == [
        True, True, True, False, False, False, None, None, None]


def test_timestamps(spark):
    cases = {
        "2024-01-02": 1704153600, "2024-01-02 03:04:05": 1704164645, "2024-01-02 03:04:05.5": 1704164645,
        "2024-01-02 03:04:05+02": 1704157445, "2024-01-02 03:04:05.25-07": 1704189845, "2024-01-02T03:04:05Z": 1704164645,
        "2024-01-02T03:04:05.123456+01:30": 1704159245,
    }
    assert ask(spark, list(cases), lambda c: F.unix_seconds(scalars.parse_ts_text(c))) == list(cases.values())
    bad = ["2026", "2026-6-1", "12:30:00", "2024-01-02T03:04:05", "2024-01-02 03:04", "2024-02-30", "2024-01-02 03:04:05+02:00", "soon"]
    assert ask(spark, bad, scalars.parse_ts_text) == [None] * len(bad)


def test_timestamps_do_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert ask(spark, ["2024-01-02", "2024-01-02 00:00:00"], lambda c: F.unix_seconds(scalars.parse_ts_text(c))) == [1704153600] * 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_durations(spark):
    cases = {"1h30m": 5400.0, "36h": 129600.0, "90s": 90.0, "1.5h": 5400.0, "-2m": -120.0, "0": 0.0, "250ms": 0.25, "1m1ms": 60.001}
    assert ask(spark, list(cases), scalars.parse_duration_text) == list(cases.values())
    assert ask(spark, ["", "h", "3", "1 h", "1d", "1h-2m"], scalars.parse_duration_text) == [None] * 6
    assert ask(spark, ["12h", "7d", "1w", "0d", "-1d", "1m", "d"], scalars.parse_interval_text) == [43200, 604800, 604800] + [None] * 4


def test_scalar_int(spark):
    assert ask(spark, [" 42 ", "-3", "", None, "4.5", "99999999999999999999"], scalars.scalar_int) == [42, -3, 0, 0, 0, 0]


def test_number_text(spark):
    cases = {0.0: "0", 1.0: "1", -1.5: "-1.5", 999999.0: "999999", 1e6: "1e+06", 1234567.5: "1.2345675e+06", 1e21: "1e+21",
             0.001: "0.001", 0.0005: "0.0005", 0.00051: "0.00051", 1e-5: "1e-05", 1.23e-7: "1.23e-07", -2500000.0: "-2.5e+06"}
    assert ask(spark, list(cases), scalars.number_text, "double") == list(cases.values())


def test_duration_text(spark):
    assert ask(spark, [0.0, 59.6, 60.0, 3600.0, 129600.0, -5.0, -0.2], scalars.duration_text, "double") == [
        "0s", "1m0s", "1m0s", "1h0m0s", "36h0m0s", "-5s", "0s"]


def test_trim_knows_unicode_space(spark):
    assert ask(spark, [" \t a b \n", "", " "], text.trim_space) == ["a b", "", ""]


def test_names(spark):
    assert ask(spark, ["Order Items", "__a--b__", "Ünï", "..."], text.sanitize) == ["order_items", "a__b", "n", ""]
    assert ask(spark, ["..."], lambda c: text.sanitize(c, "entry")) == ["entry"]
    assert ask(spark, ["/srv/repo", "s3:host/x y", "--", "ok-1.2_b"], text.skeleton_file_name) == [
        "srv-repo", "s3-host-x-y", "repository", "ok-1.2_b"]
    assert ask(spark, ["a/.x", "b~", "c.TMP", "d.lock", "e.txt", "dir/", "tmp"], text.is_temp_name) == [
        True, True, True, True, False, True, False]


def test_quoting_survives_odd_names(spark):
    name = "a`b'c"
    spark.range(3).toDF(name).createOrReplaceTempView(text.quote_ident("Weird `Name"))
    got = spark.sql(f"SELECT max({text.quote_ident(name)}), {text.quote_literal(chr(92) + name)} FROM {text.quote_ident('Weird `Name')}").first()
    assert tuple(got) == (2, chr(92) + name)


@pytest.mark.parametrize("n", [1, 4, 5, 6, 7, 8, 9, 12])
def test_truncate_keeps_characters_whole(spark, n):
    samples = ["ab", "äöü", "a€b€c", "x😀y😀", "plain ascii text"]

    def expected(s):
        raw = s.encode()
        return s if len(raw) <= n else raw[:n].decode(errors="ignore") + "…"
    assert ask(spark, samples, lambda c: text.truncate_utf8(c, n)) == [expected(s) for s in samples]


def test_tail(spark):
    assert ask(spark, ["a\nb\n\n", "x" * 5 + "\n" + "y" * 6, "ä" * 10, "zz\n" + "w" * 20], lambda c: text.tail_text(c, 8)) == [
        "a\nb", "…" + "y" * 6, "…" + "ä" * 4, "…" + "w" * 8]


def test_versions(spark):
    assert ask(spark, ["v1.2.3", "0.10.0", "1.2", "1.2.3-dev", "(devel)", "v1.2.3\n"], text.version_parts) == [
        [1, 2, 3], [0, 10, 0], None, None, None, None]


def test_json_path(spark):
    doc = '{"a":{"b":[1.0,{"c":"x"},null,true,2.50,1e300]},"n":12345678901,"o":{"z":1,"y":"q"},"0":"k","s":"{\\"b\\":1}"}'
    cases = {"a.b.0": "1", "a.b.1.c": "x", "a.b.2": "null", "a.b.3": "true", "a.b.4": "2.5", "a.b.5": "1e+300", "n": "12345678901",
             "o": '{"y":"q","z":1}', "0": "k"}
    assert ask(spark, list(cases), lambda p: jsonpath.json_path_text(F.lit(doc), p)) == list(cases.values())
    errors = {"a.x": "no key", "a.b.9": "array ends", "a.b.-1": "array ends", "a.b.q": "an array has no", "n.x": "a scalar has no",
              "a.b.2.x": "a scalar has no", "s.b": "a scalar has no"}
    got = ask(spark, list(errors), lambda p: jsonpath.json_path(F.lit(doc), p)["error"])
    assert all(part in said for part, said in zip(errors.values(), got)), got
    assert ask(spark, ["a"], lambda p: jsonpath.json_path(F.lit("oops"), p)["error"]) == ["the body cannot be parsed as JSON"]


def test_credential_shapes(spark):
    key = "AK" + "IA" + "X" * 16
    hits = [f"restore used key {key} ok", "é" + key, "-----BEGIN OPENSSH " + "PRIVATE KEY-----", "Authorization: BEARER " + "a" * 20,
            "dialing postgres:" + "//app:pass1234@db/x"]
    clean = ["AKIA" + "x" * 16, "a" + key, key + "Z", "bearer short", "postgres:" + "//app:[REDACTED:PGPASS]@db/x", "https://host/path", ""]
    names = lambda c: F.transform(secrets.credential_counts(c), lambda m: m["pattern"])
    assert ask(spark, hits, names) == [["aws-access-key-id"], ["aws-access-key-id"], ["private-key-pem"], ["bearer-token"], ["url-credentials"]]
    assert ask(spark, clean, names) == [[]] * len(clean)


def test_failure_reasons(spark):
    out = "2024 P00 ERROR: [56]: gone\nFatal: no repo\n"
    assert ask(spark, [out], lambda c: messages.failure_reason(c, "pgbackrest")) == ["ERROR: [56]: gone"]
    assert ask(spark, [out, "fine"], lambda c: messages.failure_reason(c, "restic")) == ["Fatal: no repo", ""]
    assert ask(spark, ["\n x\n", "\n"], lambda c: messages.failure_reason(c, "borg", F.lit(2))) == ["x", "exited 2"]


def test_settings(spark):
    lines = ["a = 'x # y' # z", "b=1", "# only", "no separator", "C = 'it''s'", "d = 'open # still", "= x"]
    got = ask(spark, lines, setting_line)
    assert [tuple(r) if r else None for r in got] == [("a", "x # y"), ("b", "1"), None, None, ("c", "it''s"), ("d", "'open # still"), ("", "x")]
    assert ask(spark, ["a, 'b' ,,\"c\", "], split_libraries) == [["a", "b", "c"]]


@pytest.mark.parametrize("pattern,dialect,path,hit", [
    ("d/*", "path", "d/x", True), ("d/*", "path", "d/e/x", False), ("d/*", "find", "d/e/x", True), ("*", "path", ".hidden", True),
    ("a?c", "path", "a/c", False), ("[!a]x", "path", "bx", True), ("[^a]x", "path", "ax", False), ("a.c", "path", "abc", False)])
def test_globs(spark, pattern, dialect, path, hit):
    assert ask(spark, [path], lambda c: c.rlike(globs.glob_regex(pattern, dialect))) == [hit]


def test_ed25519_known_vector():
    # First test vector of RFC 8032, section 7.1: empty message.
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    public = bytes.fromhex("d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a")
    signature = bytes.fromhex("e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b")
    assert ed25519.public_key(seed) == public
    assert ed25519.sign(seed, b"") == signature
    assert ed25519._verify_plain(public, b"", signature)
    assert not ed25519._verify_plain(public, b"x", signature)
    assert not ed25519._verify_plain(public, b"", signature[:-1] + b"\0")


def test_as_of_forms(spark):
    want = dt.datetime(2024, 1, 31)
    for as_of in (want, "2024-01-31 00:00:00", want.replace(tzinfo=dt.timezone.utc)):
        assert spark.range(1).select(F.unix_seconds(scalars.instant(as_of))).first()[0] == 1706659200


def test_ed25519_tables_agree_with_plain_multiples():
    seed = bytes(range(32))
    public = ed25519.public_key(seed)
    assert public == ed25519._pack(ed25519._times(ed25519._secret(seed)[0], ed25519.BASE))
    numbers = [0, 1, 255, 256, ed25519.ORDER - 1, 2**252 + 12345, int.from_bytes(seed, "big") % ed25519.ORDER]
    assert [ed25519._pack(ed25519._base().times(n)) for n in numbers] == [ed25519._pack(ed25519._times(n, ed25519.BASE)) for n in numbers]
    for i in range(3 * ed25519.OFTEN):  # before and after the key has a table
        message = i.to_bytes(4, "little")
        signed = ed25519.sign(seed, message, public)
        assert ed25519._verify_plain(public, message, signed)
        assert not ed25519._verify_plain(public, message + b"x", signed)
        assert not ed25519._verify_plain(public, message, signed[:31] + bytes([signed[31] ^ 128]) + signed[32:])
        assert not ed25519._verify_plain(public, message, signed[:32] + (int.from_bytes(signed[32:], "little") + ed25519.ORDER).to_bytes(32, "little"))
    assert public in ed25519._tables
    identity = (1).to_bytes(32, "little")
    assert ed25519._verify_plain(identity, b"", identity + bytes(32))
    assert not ed25519._verify_plain(identity, b"", (ed25519.P + 1).to_bytes(32, "little") + bytes(32))  # not the canonical encoding


def test_ed25519_is_fast_enough_for_millions():
    import time
    seed = bytes(32)
    public = ed25519.public_key(seed)
    signed = ed25519.sign(seed, b"m", public)
    for _ in range(ed25519.OFTEN):
        ed25519._verify_plain(public, b"m", signed)
    began = time.process_time()
    for _ in range(50):
        ed25519.sign(seed, b"m", public)
        assert ed25519._verify_plain(public, b"m", signed)
    assert time.process_time() - began < 50 * 0.003  # 6 ms and more without tables
