"""Redaction sends a row's texts to Python once, whatever the number of values and of texts."""

import pyarrow as pa

from soundcheck.operators import redact as R

CHECK = "ord int, name string, ok boolean, severity string, got string, detail string, error string, keep_literal boolean"
REPORT = f"run_id string, part int, load struct<warnings:string,error:string>, checks array<struct<{CHECK.replace(' ', ':').replace(',:', ',')}>>"


def _reports(spark):
    check = lambda got: (0, "c", True, "required", got, f"d {got}", None, False)
    return spark.createDataFrame([("a", 0, ("w value-3", None), [check("value-7"), check(None), check("x")]), ("b", 0, None, None),
                                  ("c", 0, (None, "value-5"), [])], REPORT)


def _known(spark, n=60):
    return spark.createDataFrame([(i, f"N{i}", f"value-{i}") for i in range(n)], "ord int, name string, value string")


def _evaluations(df):
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")


def test_many_passes_are_one_evaluation(spark):
    df = spark.createDataFrame([("value-1 value-17 value-59",)], "t string")
    out = R.scrub(df, ["t"], _known(spark), per_pass=4)
    assert out.first()["t"] == "[REDACTED:N1] [REDACTED:N17] [REDACTED:N59]"
    assert _evaluations(out) == 1


def test_a_report_goes_to_python_once(spark):
    out = R.redact_reports(_reports(spark), _known(spark))
    assert _evaluations(out) == 1
    rows = {r["run_id"]: r for r in out.collect()}
    assert [c["got"] for c in rows["a"]["checks"]] == ["[REDACTED:N7]", None, "x"]
    assert rows["a"]["checks"][0]["detail"] == "d [REDACTED:N7]" and rows["a"]["load"]["warnings"].startswith("w [REDACTED:N3] [sha256:")
    assert rows["b"]["checks"] is None and rows["c"]["load"]["error"] == "[REDACTED:N5]" and rows["c"]["checks"] == []
    raw = {(r["run_id"], r["name"], r["raw"]) for r in R.raw_output(_reports(spark), out).collect()}
    assert raw == {("a", "load warnings", "w value-3"), ("a", "c", "value-7")}


def test_a_payload_goes_to_python_once(spark):
    df = spark.createDataFrame([(1, "value-1 Bearer abcd", ["x", None, "value-2"], {"value-3": "value-3"}, '{"value-4":"value-4"}'),
                                (2, None, None, None, None)], "i int, a string, b array<string>, c map<string,string>, j string")
    out = R.scrub_payload(df, _known(spark), ("j",))
    assert _evaluations(out) == 1
    a, b = out.orderBy("i").collect()
    assert tuple(a)[1:] == ("[REDACTED] Bearer [REDACTED]", ["x", None, "[REDACTED]"], {"value-3": "[REDACTED]"}, '{"value-4":"[REDACTED]"}')
    assert tuple(b) == (2, None, None, None, None)


def test_values_are_found_as_by_plain_replacement(monkeypatch):
    monkeypatch.setattr(R, "BYTES_PER_SCAN", 16)
    pairs = [("[L]", "prefix-of-all-long"), ("[M]", "prefix-of-all"), ("[U]", "üüüü"), ("[S]", "abcd"), ("[T]", "cdab")]
    known = R.Known([pairs[:2], pairs[2:4], pairs[4:]])
    texts = [None, "", "prefix-of-al", "l-long", "x prefix-of-all-long prefix-of-all", "abcdab", "é" * 20 + "üüüüü", "ab", "cd", "cdabcd" * 9]

    def fold(s):
        for mark, value in pairs:
            s = s.replace(value, mark)
        return s
    wanted = [None if s is None else fold(s) for s in texts]
    assert known.scrub(pa.array(texts)).to_pylist() == wanted
    assert known.scrub(pa.array(["abcd", *texts, "abcd"]).slice(1, len(texts))).to_pylist() == wanted
    nested = pa.array([[["abcd"], None], None, [], [["x", None]]]).slice(0, 3)
    assert R._every_text(nested, known.scrub).to_pylist() == [[["[S]"], None], None, []]
    maps = pa.array([[("abcd", "abcd")], None, [("k", None)]], pa.map_(pa.string(), pa.string())).slice(0, 3)
    assert R._every_text(maps, known.scrub).to_pylist() == [[("abcd", "[S]")], None, [("k", None)]]
