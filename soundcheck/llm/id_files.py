"""Token ids in compressed binary files.

A file row is a segment: whole documents in order of their id, an index of them, a table of the ids that occur, and blocks
of ids. Every block starts a fresh model and range coder and carries a checksum, as does the table, so any block is read
without the others. The model mixes distributions of three orders: what followed the last two ids and what followed the
last one predict two ids each, and order 0 is how often each id occurs in the segment. Their shares are weights that
adapt to which of them was right, apart for each state of how sure the predictions are. The sum of the shares is one interval
of the range for each id. All of it is arithmetic of integers. Blocks of a segment are coded side by side: one numpy operation makes
the same step in all of them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from soundcheck.llm.packing import Spelling, file_encoder, in_groups
from soundcheck.session import materialise

BLOCK_IDS = 8192  # at most; a small segment has shorter blocks, so that many are coded side by side
LEAST_BLOCK_IDS, BLOCKS = 1024, 512
SEGMENT_IDS = 8_000_000  # a segment ends with the document that reaches this
END_ID = 1
MAGIC = b"IDS2"
COUNTED = 1 << 22  # ids below are counted in an array, others by sorting

# The model. An id is its place among the sorted distinct ids of the segment.
GUESSES = 4  # two of order 2, two of order 1
SLOTS_LOG = 10  # predictions kept for each order and block: two to this
LEVELS = 4  # how sure a prediction is
SHARE_BITS = 10  # the shares of an id's step sum to two to this
WEIGHT_ONE, GUESSED = 1 << 16, (1 << SHARE_BITS) - 24  # at most this share is for predictions
RATE = 5
SETTLED, LEAST, WORD = np.uint64(1 << 48), np.uint64(1 << 40), np.uint64(16)


class Table:
    """Order 0: distinct ids in order, and frequencies, at least one each, that sum to 2 ** ``bits``."""

    def __init__(self, distinct: np.ndarray, freq: np.ndarray):
        ends = np.cumsum(freq, dtype=np.int64)
        self.bits = int(ends[-1]).bit_length() - 1
        self.kind = np.int32 if self.bits + SHARE_BITS < 31 else np.int64  # holds every place of a step
        self.distinct, self.freq, self.start = distinct, freq.astype(self.kind), (ends - freq).astype(self.kind)
        self.find = np.repeat(np.arange(len(distinct), dtype=np.uint32), self.freq)  # which id has each place

    @classmethod
    def count(cls, distinct: np.ndarray, counts: np.ndarray) -> Table:
        total = 1 << max(16, (4 * len(distinct)).bit_length())
        freq = 1 + counts * (total - len(distinct)) // counts.sum()
        freq[counts.argmax()] += total - freq.sum()
        return cls(distinct, freq)

    def pack(self) -> bytes:
        return zlib.compress(np.diff(self.distinct, prepend=0).astype("<u4").tobytes() + self.freq.astype("<u4").tobytes())

    @classmethod
    def unpack(cls, data: bytes) -> Table:
        both = np.frombuffer(zlib.decompress(data), "<u4")
        half = len(both) // 2
        return cls(np.cumsum(both[:half], dtype=np.uint64).astype(np.uint32), both[half:])


def added(shares: np.ndarray) -> np.ndarray:
    """The sum for each block; sums along the first axis would be made 64 bits wide."""
    total = shares[0] + shares[1]
    for more in shares[2:]:
        total += more
    return total


class Model:
    """The state of ``n`` blocks at one step: what is predicted, with which shares. Guesses: two of order 2, then two of order 1."""

    def __init__(self, n: int, table: Table):
        self.n, self.table = n, table
        self.lead = np.zeros(2 * n << SLOTS_LOG, np.uint32)  # order 2, then order 1, of each block: predicted id * LEVELS + how sure
        self.other = np.zeros(2 * n << SLOTS_LOG, np.uint32)  # the runner-up
        self.slots = np.arange(2 * n).reshape(2, n) << SLOTS_LOG
        self.states = np.arange(n) * LEVELS ** 2 + np.arange(GUESSES)[:, None] * (n * LEVELS ** 2)
        two, one = np.divmod(np.arange(LEVELS ** 2), LEVELS)  # the surer a prediction is, the more it begins with
        begin = np.stack([1 + 2 * two, np.ones_like(two), 1 + one, np.ones_like(two)]) * (WEIGHT_ONE // 16)
        self.weights = np.repeat(begin[:, None], n, axis=1).astype(np.int32).reshape(-1)
        self.seen = np.zeros((2, n), np.uint32)  # hash of the last two ids, and the last id

    def predict(self, n: int) -> None:
        """For the first ``n`` blocks, which are those that have ids left."""
        self.at = self.slots[:, :n] + ((self.seen[:, :n] * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOTS_LOG))
        self.leads, self.others = self.lead.take(self.at), self.other.take(self.at)
        sure = self.leads & np.uint32(LEVELS - 1)
        self.guesses = np.empty((GUESSES, n), np.uint32)
        self.guesses[::2], self.guesses[1::2] = self.leads >> np.uint32(2), self.others
        self.state = self.states[:, :n] + (sure[0] * np.uint32(LEVELS) + sure[1])
        self.held = self.weights.take(self.state)
        self.shares = ((self.held * np.int32(GUESSED - GUESSES) >> 16) + 1).astype(self.table.kind, copy=False)
        self.plain = (1 << SHARE_BITS) - added(self.shares)

    def interval(self, ids: np.ndarray, equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of each id in the sum of all shares; ``equal``: which guesses are the id."""
        bits = self.table.bits
        below, same = added(self.shares * (self.guesses < ids)), added(self.shares * equal)
        return self.plain * self.table.start.take(ids) + (below << bits), self.plain * self.table.freq.take(ids) + (same << bits)

    def lookup(self, place: np.ndarray) -> np.ndarray:
        """The id whose interval holds each place: a guess, or what order 0 has there without the guesses that end before."""
        bits, g = self.table.bits, self.guesses
        below, same = self.shares.copy(), self.shares.copy()
        below[:] = 0
        for k in range(1, GUESSES):  # guess j against guess j + k
            less, equal = g[:-k] < g[k:], g[:-k] == g[k:]
            below[k:] += self.shares[:-k] * less
            below[:-k] += self.shares[k:] * ~(less | equal)
            same[k:] += self.shares[:-k] * equal
            same[:-k] += self.shares[k:] * equal
        start = self.plain * self.table.start.take(g) + (below << bits)
        end = start + self.plain * self.table.freq.take(g) + (same << bits)
        past = end <= place
        ahead = added(self.shares * past)
        holds = (start <= place) & ~past
        at = np.minimum((place - (ahead << bits)) // self.plain, len(self.table.find) - 1)
        found = self.table.find.take(np.maximum(at, 0))
        for k in range(GUESSES):
            np.copyto(found, g[k], where=holds[k])
        return found

    def update(self, ids: np.ndarray, size: np.ndarray, equal: np.ndarray) -> None:
        n = len(ids)
        right = np.zeros((GUESSES, n), np.int32)
        hits = np.flatnonzero(equal)  # the part of each in what happened
        part = (self.shares.reshape(-1).take(hits).astype(np.int64) << (self.table.bits + 16)) // size.take(hits % n)
        right.reshape(-1)[hits] = np.minimum(part, WEIGHT_ONE - 1)
        right -= self.held
        right >>= RATE
        right += self.held
        self.weights[self.state] = right
        hit, sure, four = equal[::2], self.leads & np.uint32(LEVELS - 1), np.uint32(LEVELS)
        keep = sure > 1
        self.lead[self.at] = np.where(hit, self.leads + (sure < LEVELS - 1), np.where(keep, self.leads - np.uint32(1), ids * four))
        self.other[self.at] = np.where(hit, self.others, np.where(keep, ids, self.guesses[::2]))
        self.seen[0, :n] = (self.seen[1, :n] * np.uint32(0x85EBCA6B)) ^ (ids + np.uint32(0x27D4EB2F))
        self.seen[1, :n] = ids


class Coder:
    """Carry-less range coders of 64 bits, one for each block, that move words of 16 bits."""

    def __init__(self, n: int):
        self.low, self.range = np.zeros(n, np.uint64), np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)

    def narrow(self, n: int, start: np.ndarray, size: np.ndarray, bits: int) -> None:
        """To an interval of a sum of 2 ** bits."""
        width = self.range[:n] >> np.uint64(bits)
        self.low[:n] += width * start.astype(np.uint64)
        self.range[:n] = width * size.astype(np.uint64)

    def renew(self, n: int) -> None:
        """Words that can't change any more go out or come in until the ranges are wide again."""
        low, width = self.low[:n], self.range[:n]
        settled = (low ^ (low + width)) < SETTLED
        rows = np.flatnonzero(settled | (width < LEAST))
        while len(rows):
            lo, wi = low.take(rows), width.take(rows)
            stuck = (lo ^ (lo + wi)) >= SETTLED
            if stuck.any():
                wi = np.where(stuck, (np.uint64(0) - lo) & (LEAST - np.uint64(1)), wi)
            self.move(rows, lo)
            low[rows] = lo = lo << WORD
            width[rows] = wi = wi << WORD
            rows = rows[((lo ^ (lo + wi)) < SETTLED) | (wi < LEAST)]


class Encoder(Coder):
    def __init__(self, n: int, ids_each: int):
        super().__init__(n)
        self.out, self.used, self.room = np.zeros(n * (4 * ids_each + 8), "<u2"), np.zeros(n, np.int64), 4 * ids_each + 8

    def move(self, rows: np.ndarray, low: np.ndarray) -> None:
        self.out[rows * self.room + self.used.take(rows)] = low >> np.uint64(48)
        self.used[rows] += 1

    def finish(self) -> list[bytes]:
        for _ in range(4):
            self.move(np.arange(len(self.low)), self.low)
            self.low <<= WORD
        return [self.out[i * self.room:i * self.room + n].tobytes() for i, n in enumerate(self.used)]


class Decoder(Coder):
    def __init__(self, coded: list[bytes]):
        super().__init__(len(coded))
        self.room = max(map(len, coded)) // 2 + 8
        self.data = np.zeros(len(coded) * self.room, "<u2")
        for i, c in enumerate(coded):
            self.data[i * self.room:i * self.room + len(c) // 2] = np.frombuffer(c, "<u2")
        self.code, self.used = np.zeros(len(coded), np.uint64), np.zeros(len(coded), np.int64)
        for _ in range(4):
            self.move(np.arange(len(coded)), self.low)

    def move(self, rows: np.ndarray, low: np.ndarray) -> None:
        self.code[rows] = (self.code.take(rows) << WORD) | self.data.take(rows * self.room + self.used.take(rows))
        self.used[rows] += 1

    def place(self, n: int, bits: int) -> np.ndarray:
        at = (self.code[:n] - self.low[:n]) // (self.range[:n] >> np.uint64(bits))
        return np.minimum(at, np.uint64((1 << bits) - 1)).astype(np.int64)


def encode_blocks(ids: np.ndarray, block_ids: int | None = None) -> bytes:
    """One segment: MAGIC, counts and the table with its checksum, for each block its ids, bytes and checksum, then the coded bytes.

    Any unsigned 32-bit ids; none give a segment without blocks.
    """
    block_ids = block_ids or max(LEAST_BLOCK_IDS, min(BLOCK_IDS, len(ids) // BLOCKS))
    n = -(-len(ids) // block_ids)
    if not n:
        return MAGIC + struct.pack("<IIII", 0, block_ids, 0, 0)
    if ids.max() < COUNTED:
        counts = np.bincount(ids).astype(np.int64, copy=False)
        places, distinct = (np.cumsum(counts > 0) - 1).astype(np.uint32).take(ids), np.flatnonzero(counts)
        table = Table.count(distinct, counts[distinct])
    else:
        distinct, places, counts = np.unique(ids, return_inverse=True, return_counts=True)
        table = Table.count(distinct, counts)
    packed, bits = table.pack(), table.bits + SHARE_BITS
    grid = np.zeros(n * block_ids, np.uint32)
    grid[:len(ids)] = places
    steps = np.ascontiguousarray(grid.reshape(n, block_ids).T)
    short = len(ids) - (n - 1) * block_ids  # ids of the last block
    model, coder = Model(n, table), Encoder(n, block_ids)
    for t in range(block_ids if n > 1 else short):
        live = n if t < short else n - 1
        now = steps[t, :live]
        model.predict(live)
        equal = model.guesses == now
        start, size = model.interval(now, equal)
        coder.narrow(live, start, size, bits)
        coder.renew(live)
        model.update(now, size, equal)
    coded = coder.finish()
    index = b"".join(struct.pack("<III", block_ids if i < n - 1 else short, len(c), zlib.crc32(c)) for i, c in enumerate(coded))
    return MAGIC + struct.pack("<IIII", n, block_ids, len(packed), zlib.crc32(packed)) + packed + index + b"".join(coded)


def decode_blocks(data: bytes) -> np.ndarray:
    """The ids of a segment; a damaged one is a ValueError."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment of ids")
    n, block_ids, size, crc = struct.unpack_from("<IIII", data, 4)
    if not n:
        return np.zeros(0, np.uint32)
    packed, at = data[20:20 + size], 20 + size
    if zlib.crc32(packed) != crc:
        raise ValueError("the table of ids is damaged")
    index = [struct.unpack_from("<III", data, at + 12 * i) for i in range(n)]
    coded, at = [], at + 12 * n
    for i, (_, size, crc) in enumerate(index):
        coded.append(data[at:at + size])
        at += size
        if zlib.crc32(coded[-1]) != crc:
            raise ValueError(f"block {i} is damaged")
    short, table = index[-1][0], Table.unpack(packed)
    bits = table.bits + SHARE_BITS
    model, coder = Model(n, table), Decoder(coded)
    out = np.zeros((block_ids, n), np.uint32)
    for t in range(block_ids if n > 1 else short):
        live = n if t < short else n - 1
        model.predict(live)
        now = model.lookup(coder.place(live, bits).astype(table.kind, copy=False))
        equal = model.guesses == now
        start, size = model.interval(now, equal)
        coder.narrow(live, start, size, bits)
        coder.renew(live)
        model.update(now, size, equal)
        out[t, :live] = table.distinct.take(now)
    return out.T.reshape(-1)[:(n - 1) * block_ids + short]


def write_ids(docs: DataFrame, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files and return them: part, segment, doc_ids, lengths, n_ids, payload.

    Documents are in ascending id order over (part, segment) and inside each segment, null ids first,
    ties by text. Null texts are empty: only ``end_id``. Repeated rows are written as often as they
    occur. An empty table gives no segments. Only the two named columns are read.
    """
    ordered = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(
        F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    from pyspark.sql.pandas.types import to_arrow_type
    id_type = to_arrow_type(docs.schema[id_col].dataType)
    schema = f"part int, segment int, doc_ids array<{docs.schema[id_col].dataType.simpleString()}>, lengths array<bigint>, " \
             "n_ids long, payload binary"
    load = file_encoder(tokenizer)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling, part, segment = Spelling(load, end_id), TaskContext.get().partitionId(), 0
        held, lengths, owners = [], [], []

        def flush():
            ids = np.concatenate(held)
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([owners], pa.list_(id_type)),
                pa.array([lengths], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()),
                pa.array([encode_blocks(ids)], pa.binary())], names=["part", "segment", "doc_ids", "lengths", "n_ids", "payload"])

        size = 0
        for rows in in_groups(batches):
            ids, sizes = spelling.texts(rows.column(1))
            at = 0
            for doc, n in zip(rows.column(0).to_pylist(), sizes.tolist()):
                held.append(ids[at:at + n])
                lengths.append(n)
                owners.append(doc)
                at, size = at + n, size + n
                if size >= SEGMENT_IDS:
                    yield flush()
                    held, lengths, owners, size, segment = [], [], [], 0, segment + 1
        if owners:
            yield flush()

    return materialise(ordered.mapInArrow(make, schema), "id-files")


def read_ids(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32[, ids] from the files."""
    id_type = files.schema["doc_ids"].dataType.elementType
    before = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row for each part
    offsets = parts.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    places = files.select("part", "segment", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("inside")).join(
        offsets, "part").select("part", "segment", (F.col("base") + F.col("inside")).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_blocks(row["payload"]).astype("<u4")
                lengths = np.array(row["lengths"], np.int64)
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                blobs = [ids[s:s + n].tobytes() for s, n in zip(starts, lengths)]
                columns = [pa.array(row["doc_ids"], arrow_type), pa.array(starts + row["start"], pa.int64()), pa.array(lengths, pa.int64()),
                           pa.array([zlib.crc32(b) for b in blobs], pa.int64())] + [pa.array(blobs, pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    from pyspark.sql.pandas.types import to_arrow_type
    arrow_type = to_arrow_type(id_type)
    return files.join(places, ["part", "segment"]).select("start", "doc_ids", "lengths", "payload").mapInArrow(
        read, f"doc_id {id_type.simpleString()}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
