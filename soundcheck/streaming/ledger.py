"""Ledger links as entries arrive."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from soundcheck.operators.ledger import GENESIS
from soundcheck.streaming.run import use_rocksdb

SEQS_PER_KEY = 4096
SEQS_PER_CALL = 4096
LINKS = "tenant_id string, seq bigint, reason string, revision int"
WAITING, JUDGED, REPEATED = range(3)
FIELDS = ("block", "seq", "placed", "prev_hash", "entry_hash", "created_at", "timed", "tail")
# Of a run: its first and last seq, what its first entry says and whether that is all there, and what its last one says.
LO, HI, PREV, FIRST_AT, COMPLETE, HASH, LAST_AT = range(7)


def _plain(values: pd.Series) -> list:
    """The values of a column, missing texts as None."""
    if values.dtype != object:
        return values.tolist()
    return [v if isinstance(v, (str, bool)) else None for v in values.tolist()]


class Links(StatefulProcessor):
    """Keyed by (tenant, stretch of blocks). State is, for each block, the runs of seqs that are there, with their two ends."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("blocks", "blocks string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        blocks = dict(json.loads(self.state.get()[0])) if self.state.exists() else {}
        # Lists, since there may be millions of small blocks, and a frame's own conversions cost milliseconds each.
        found = [e for pdf in rows for e in zip(*(_plain(pdf[c]) for c in FIELDS))]
        found.sort(key=lambda e: (e[0], e[1], e[4] is not None, e[4] or "", e[5]))
        out = []
        for block, entries in groupby(found, itemgetter(0)):
            blocks[block] = merge(key[0], entries, blocks.get(block, []), out)
        self.state.update((json.dumps(list(blocks.items()), separators=(",", ":")),))
        if out:
            tenants, seqs, reasons, revisions = zip(*out)
            yield pd.DataFrame({"tenant_id": pd.Series(tenants, dtype="object"), "seq": pd.array(seqs, "Int64"),
                                "reason": pd.Series(reasons, dtype="object"), "revision": np.array(revisions, "int32")})

    def close(self) -> None:
        pass


def merge(tenant: str | None, entries: Iterator[tuple], runs: list[list], out: list[tuple]) -> list[list]:
    """The runs of a block with ``entries`` (FIELDS, by seq) in them; ``runs`` and the result are in order. Links go to ``out``."""
    made, at = [], 0
    for _, seq, placed, prev_hash, entry_hash, created_at, timed, tail in entries:
        if not placed:
            out.append((tenant, None, "entry without a seq", JUDGED))
            continue
        while at < len(runs) and runs[at][HI] < seq:
            made.append(runs[at])
            at += 1
        if at < len(runs) and runs[at][LO] <= seq or made and made[-1][HI] >= seq:
            if not tail:
                out.append((tenant, seq, "duplicate seq", REPEATED))
            continue
        time = created_at if timed else None
        one = [seq, seq, prev_hash, time, entry_hash is not None and time is not None, entry_hash, time]
        before = made.pop() if made and made[-1][HI] == seq - 1 else None
        if not tail:
            out.append((tenant, seq, *judge(one, before)))
        if at < len(runs) and runs[at][LO] == seq + 1:
            after = runs[at]
            at += 1
            out.append((tenant, seq + 1, *judge(after, one)))
            one[HI], one[HASH], one[LAST_AT] = after[HI], after[HASH], after[LAST_AT]
        if before:
            one[LO], one[PREV], one[FIRST_AT], one[COMPLETE] = before[LO], before[PREV], before[FIRST_AT], before[COMPLETE]
        made.append(one)
    return made + runs[at:]


def judge(run: list, before: list | None) -> tuple[str | None, int]:
    """What is wrong with the first entry of ``run`` behind the last one of ``before``, and whether that may change."""
    first = run[LO] == 1
    revision = JUDGED if first or before else WAITING
    if not run[COMPLETE]:
        return "entry without a hash or time", revision
    if first:
        return (None if run[PREV] == GENESIS else "genesis prev_hash is not zero"), revision
    if not before:
        return "missing seq before", revision
    if run[PREV] != before[HASH]:
        return "prev_hash does not match", revision
    return ("created_at runs back" if before[LAST_AT] is not None and run[FIRST_AT] < before[LAST_AT] else None), revision


def verify_ledger_stream(entries: DataFrame, seqs_per_key: int = SEQS_PER_KEY) -> DataFrame:
    """tenant_id, seq, reason, revision for every link; reason is null when it holds. ``newest_links`` has one row per link.

    There is no watermark and no age limit, so no entry is too late: one whose predecessor is not there yet
    is ``missing seq before`` (revision 0), and is judged again (1) when that arrives, however long after.
    Every further entry of a seq is a ``duplicate seq`` (2). State is kept for each block of
    ``seqs_per_key`` seqs of a tenant: the ends of each unbroken run, not the entries. The last entry of a block is
    sent to the next one too. A large tenant spreads over all tasks, by stretches of blocks that hold
    ``SEQS_PER_CALL`` seqs: one state row and one call of a batch, however small the blocks. Both stay as they are for a checkpoint.
    """
    use_rocksdb(entries.sparkSession)
    nothing = F.lit(0).cast("bigint")
    block = lambda seq: F.floor(seq / seqs_per_key).cast("bigint")
    rows = entries.select("tenant_id", F.coalesce("seq", nothing).alias("seq"), F.col("seq").isNotNull().alias("placed"),
                          "prev_hash", "entry_hash", F.coalesce("created_at", nothing).alias("created_at"),
                          F.col("created_at").isNotNull().alias("timed"))
    ends_block = F.col("placed") & (F.pmod(F.col("seq") + 1, F.lit(seqs_per_key)) == 0)
    sent = rows.withColumn("tail", F.explode(F.when(ends_block, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    blocks = max(1, SEQS_PER_CALL // seqs_per_key)
    return sent.withColumn("block", block(F.col("seq") + F.col("tail").cast("bigint"))).withColumn(
        "stretch", F.floor(F.col("block") / blocks).cast("bigint")).groupBy("tenant_id", "stretch").transformWithStateInPandas(
        statefulProcessor=Links(), outputStructType=LINKS, outputMode="append", timeMode="none")


def newest_links(links: DataFrame) -> DataFrame:
    """tenant_id, seq and reason: of each link, what is known last."""
    return links.groupBy("tenant_id", "seq").agg(F.max_by("reason", "revision").alias("reason"))
