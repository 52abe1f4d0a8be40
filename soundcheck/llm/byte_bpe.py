"""Byte-level BPE encoding and decoding by tree reduction.

A text is cut into pre-tokens, which never merge with each other. A pre-token is encoded as a tree:
halves are encoded by themselves and joined where they meet. Joining re-encodes a window of tokens
around the border and widens it until its first token is the left half's and its last the right
half's: two valid encodings that share a token are one valid encoding, so nothing outside the window
can change. Decoding concatenates up the tree.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from soundcheck.llm.text import chunks, remember

LEAF = 8  # bytes that are merged directly
MERGED = 300_000  # merges of few bytes that a task remembers
TEXTS_AT_ONCE = 128
NO_RANK = 1 << 40


class ByteBpe:
    """Ranks of a vocabulary file: one base64 token and its rank per line."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.merged: dict[bytes, list[int]] = {}  # of leaves and of windows of two tokens

    def merge(self, data: bytes) -> list[int]:
        """Lowest rank first, leftmost on a tie: the direct form, for few bytes."""
        ranks, none = self.ranks, NO_RANK
        if (whole := ranks.get(data)) is not None:
            return [whole]
        parts = [data[i:i + 1] for i in range(len(data))]
        pairs = [ranks.get(data[i:i + 2], none) for i in range(len(data) - 1)]
        while pairs and (low := min(pairs)) < none:
            i = pairs.index(low)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        return [ranks[p] for p in parts]

    def encode_piece(self, data: bytes) -> list[int]:
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        if len(data) <= LEAF:
            return self.remembered(data)
        half = len(data) // 2
        return self.join(self.encode_piece(data[:half]), self.encode_piece(data[half:]))

    def remembered(self, data: bytes) -> list[int]:
        if (found := self.merged.get(data)) is None:
            if len(self.merged) >= MERGED:
                self.merged.clear()
            found = self.merged[data] = self.merge(data)
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        i = j = 1
        window = self.remembered(self.tokens[left[-1]] + self.tokens[right[0]])
        if window[0] == left[-1] and window[-1] == right[0]:
            return left[:-1] + window + right[1:]
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.merge(b"".join(map(self.tokens.__getitem__, left[-i:] + right[:j])))
            left_holds = i == len(left) or window[0] == left[-i]
            right_holds = j == len(right) or window[-1] == right[j - 1]
            if left_holds and right_holds:
                return left[:-i] + window + right[j:]
            i, j = i if left_holds else 2 * i, j if right_holds else 2 * j

    def encode(self, text: str) -> list[int]:
        if text[1:].isalpha() and text[0] == " ":  # one match: a blank and letters
            return self.encode_piece(text.encode())
        ids: list[int] = []
        for piece in self.pattern.findall(text):
            ids += self.encode_piece(piece.encode())
        return ids

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 4096:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def encoder(path: str, pattern: str):
    """A column function text -> ids (array of int); null counts as empty."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe, known = ByteBpe(path, pattern), {}

        def fresh(parts: list[str]) -> list[bytes]:
            return [array("i", bpe.encode(p)).tobytes() for p in parts]

        for texts in batches:
            blobs = []
            for i in range(0, len(texts), TEXTS_AT_ONCE):
                cut = [chunks(t or "") for t in texts[i:i + TEXTS_AT_ONCE].to_pylist()]
                remember(cut, fresh, known)
                blobs += [b"".join(map(known.__getitem__, parts)) for parts in cut]
            ends = np.cumsum([0, *[len(b) // 4 for b in blobs]], dtype="int32")
            yield pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(blobs), "i"))

    return encode


def decoder(path: str, pattern: str):
    """A column function ids -> bytes; null gives null, an unknown id is an error."""

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = ByteBpe(path, pattern)
        for rows in batches:
            ids, ends, known = rows.values.to_numpy(), rows.offsets.to_numpy(), rows.is_valid().to_pylist()
            yield pa.array([bpe.decode(ids[a:b].tolist()) if k else None for a, b, k in zip(ends, ends[1:], known)], pa.binary())

    return decode


def encode_texts(docs: DataFrame, path: str, pattern: str, text_col: str = "text",
                 keep: list[str] | None = None) -> DataFrame:
    """One row per input row: ``row`` (struct of the columns in ``keep``, by default all, so names never clash) and ``ids``.

    Null and empty texts have no ids. Texts of any length are encoded whole; equal texts and repeated
    rows give equal ids; an empty table gives no rows.
    """
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"),
                       encoder(path, pattern)(F.col(text_col)).alias("ids"))


def decode_ids(ids: Column, path: str, pattern: str) -> Column:
    return decoder(path, pattern)(ids)
