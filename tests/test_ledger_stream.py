"""Ledger links as a stream: any split and any silence, against the batch answer."""

import pytest

from soundcheck.operators.ledger import GENESIS
from soundcheck.streaming.ledger import newest_links, verify_ledger_stream
from soundcheck.streaming.run import read_files, run_available

DAY = 86400
SCHEMA = "tenant_id string, seq bigint, prev_hash string, entry_hash string, created_at bigint"


def entry(tenant, seq, at, prev=None):
    return tenant, seq, prev or (GENESIS if seq == 1 else f"{tenant}{seq - 1}"), f"{tenant}{seq}", at


FIRST = [entry("silent", 1, 0), entry("silent", 2, DAY), ("null", 1, None, "null1", 0), entry("gap", 1, 0), entry("gap", 3, 2),
         entry("twice", 1, 0), entry("twice", 2, 1), ("nohash", 1, GENESIS, None, 0), ("noseq", None, GENESIS, "x", 0), entry("back", 1, 9)]
SECOND = [entry("silent", 3, 90 * DAY), entry("late", 2, 100 * DAY), entry("late", 3, 100 * DAY), entry("back", 2, 8), entry("bad", 1, 0), entry("bad", 2, 1, "00")]
THIRD = [entry("late", 1, DAY), entry("twice", 1, 0), entry("silent", 4, 91 * DAY)]
WRONG = {("null", 1): "genesis prev_hash is not zero", ("gap", 3): "missing seq before", ("twice", 1): "duplicate seq", ("nohash", 1): "entry without a hash or time",
         ("noseq", None): "entry without a seq", ("back", 2): "created_at runs back", ("bad", 2): "prev_hash does not match"}


@pytest.mark.parametrize("size", [2, 4096])
def test_links_over_batches_and_long_silence(spark, tmp_path, size):
    for i, rows in enumerate((FIRST, SECOND, THIRD)):
        frame = spark.createDataFrame(rows, SCHEMA)
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        links = run_available(verify_ledger_stream(read_files(spark, str(tmp_path / "in"), frame.schema), size), "links",
                              str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        if i == 1:
            seen = {(r.tenant_id, r.seq): r.reason for r in newest_links(links).collect()}
            assert seen["late", 2] == "missing seq before" and seen["late", 3] is None and seen["silent", 3] is None
    found = {(r.tenant_id, r.seq): r.reason for r in newest_links(links).collect()}
    assert set(found) == {(r[0], r[1]) for r in FIRST + SECOND + THIRD}
    assert {k: v for k, v in found.items() if v} == WRONG


def test_small_blocks_share_calls_and_state_rows(spark, tmp_path):
    chain = [entry(t, i, i) for t in ("a", "b") for i in range(1, 601)]
    order = sorted(chain, key=lambda e: (e[1] * 7919 + ord(e[0])) % 1009)
    wrong = {("a", 300): "prev_hash does not match", ("b", 9): "missing seq before"}
    order = [(t, i, "00", h, at) if (t, i) == ("a", 300) else (t, i, p, h, at) for t, i, p, h, at in order if (t, i) != ("b", 8)]
    for i in range(3):
        spark.createDataFrame(order[i::3], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = verify_ledger_stream(read_files(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema, 1), 2)
    query = stream.writeStream.format("memory").queryName("small_blocks").option(
        "checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    found = {(r.tenant_id, r.seq): r.reason for r in newest_links(spark.table("small_blocks")).collect()}
    assert set(found) == {(r[0], r[1]) for r in order} and {k: v for k, v in found.items() if v} == wrong
    # Each tenant has 300 blocks, in one stretch.
    assert [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"]] == [2, 2, 2]
