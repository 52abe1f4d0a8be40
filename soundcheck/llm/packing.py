"""Best-fit packing planned over a histogram of lengths.

Only the number of pieces of each length decides how they can be packed, and there are no more lengths
than tokens in a sequence. So best-fit decreasing runs over counts and plans slots: ranks from .. to of
a length go to sequences from .. on, at one offset. Pieces then take the slots of their rank within
their length. Neither texts nor ids are shuffled.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from soundcheck.llm.text import AT_ONCE, REMEMBERED, chunks
from soundcheck.session import in_small_batches, materialise

CAPACITY = 1024
TEXTS_AT_ONCE, BYTES_AT_ONCE = 128, 2 << 20  # texts are encoded some MB at a time, so that most of their words are looked up once
END_ID = 2
WORD_END, CHUNK_END = "\x01", "\x02"  # not among the characters of LATIN
# Characters on which all libraries agree: no two forms of a letter, no special case of lower-casing.
LATIN = re.compile(r"[\t\n\r -~\u00c0-\u012f\u0131-\u017e\u0180-\u01c3\u01cd-\u024f]*").fullmatch
# Words of them, each after one blank.
BLANK_WORDS = re.compile(r"(?: [!-~\u00c0-\u012f\u0131-\u017e\u0180-\u01c3\u01cd-\u024f]+)*").fullmatch
# How the two kinds of files cut words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LOWER_WORDS = {"normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
               "split": {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}}


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, past the last rank, sequence of the first rank, offset): by best fit, or by first fit where that needs fewer sequences."""
    return min(best_fit(histogram, capacity), first_fit(histogram, capacity), key=lambda slots: max((s + b - a for _, a, b, s, _ in slots), default=0))


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Longest pieces first; each goes to the fullest sequence that still holds it. Sequences with equal
    free space are one group, so the work depends on the lengths that occur, not on the pieces.
    """
    free: dict[int, list[tuple[int, int]]] = {r: [] for r in range(capacity + 1)}  # free space -> (first sequence, how many)
    slots, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            space = next((r for r in range(length, capacity + 1) if free[r]), None)
            if space is None:
                opened = max(1, left // (capacity // length))
                free[capacity].append((sequences, opened))
                sequences += opened
                continue
            first, n = free[space].pop()
            used = min(n, left)
            slots.append((length, rank, rank + used, first, capacity - space))
            if used < n:
                free[space].append((first + used, n - used))
            free[space - length].append((first, used))
            rank, left = rank + used, left - used
    return slots


def first_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Longest pieces first; each goes to the first sequence that still holds it. Neighbours with equal free space are one run."""
    runs: list[tuple[int, int, int]] = []  # first sequence, how many, free space
    slots, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left, after = 0, histogram[length], []
        runs.append((sequences, -(-left // (capacity // length)), capacity))
        for first, n, space in runs:
            each = space // length
            while n and each and left:
                used, each = (min(n, left // each), each) if left >= each else (1, left)
                for k in range(each):
                    slots.append((length, rank, rank + used, first, capacity - space + k * length))
                    rank += used
                after.append((first, used, space - each * length))
                first, n, left = first + used, n - used, left - used * each
            if n and space < capacity:
                after.append((first, n, space))
        runs = after
        sequences = max((first + n for first, n, _ in runs), default=0)
    return slots


def cut(n: int, capacity: int = CAPACITY) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: full ones, but for the first."""
    start, first = 0, n % capacity or min(n, capacity)
    while start < n:
        yield start, first
        start, first = start + first, capacity


def file_encoder(path: str) -> Callable[[], tuple[Callable[[str], list[str]], Callable[[list[str]], list[bytes]]]]:
    """Makes, on an executor, two functions for a tokenizer file: one cuts a text into chunks, one encodes them to little-endian unsigned 32-bit ids.

    Joined, the ids are those of the library for the whole text without special tokens added. Strings of added tokens that
    stand in a text are those tokens, as in the library, and chunks of their own.

    The library takes some microseconds for every byte. Where the file is a byte-level BPE whose merges are in the order of
    their ids, a chunk of plain Latin characters is merged by those ranks instead (``by_ranks``), with the same ids;
    any other chunk goes to the library.
    """

    def load():
        import json
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        fast, added = by_ranks(content), content.get("added_tokens") or []
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in added):
            raise ValueError("added tokens that depend on what stands around them are not supported")
        names = {a["content"] for a in added}
        between = re.compile("(" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + ")").split if names else lambda text: [text]

        def cut_text(text: str) -> list[str]:
            return [c for part in between(text) for c in ([part] if part in names else chunks(part))]

        def encode(parts: list[str]) -> list[bytes]:
            plain = [] if not fast else parts if LATIN("".join(parts)) and names.isdisjoint(parts) else [p for p in parts if LATIN(p) and p not in names]
            found = dict(zip(plain, fast(plain)))
            if len(plain) == len(parts):
                return [found[p] for p in parts]
            rest = [p for p in parts if p not in found]
            found.update(zip(rest, (np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(rest, add_special_tokens=False))))
            return [found[p] for p in parts]

        cut_text.names = names
        return cut_text, encode

    return load


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in files of byte-level BPE: itself where it is printable, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


def by_ranks(file: dict) -> Callable[[list[str]], list[bytes]] | None:
    """The encoder of lists of plain Latin chunks for the two kinds of files it is sure of, else None.

    A token's id is its rank: merging the pair with the smallest id of the joined token, again and again, is what the
    list of merges says. A word's end is a byte that no such chunk has; it joins the last byte first, as those tokens
    come before all other merges. Chunks are merged in one call for all of them: where each is a word after a blank, its first
    token is the one that begins with a blank; where words have an end, another such byte stands between chunks.
    """
    import regex
    import tiktoken
    model, before, pre = file["model"], file.get("normalizer"), file.get("pre_tokenizer") or {}
    suffix, letters = model.get("end_of_word_suffix") or "", byte_letters()
    merged = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    plain = model["type"] == "BPE" and not (model.get("dropout") or model.get("unk_token") or model.get("continuing_subword_prefix")
                                            or model.get("byte_fallback") or model.get("ignore_merges"))
    ids = [model["vocab"].get(a + b, -1) for a, b in merged]
    if not plain or ids != list(range(len(model["vocab"]) - len(merged), len(model["vocab"]))) or len(model["vocab"]) - len(merged) != (512 if suffix else 256):
        return None
    ranks = {}
    for token, i in model["vocab"].items():
        ended = bool(suffix) and token.endswith(suffix)
        spelt = bytes(letters[c] for c in (token[:-len(suffix)] if ended else token))
        if not (suffix and (WORD_END.encode() in spelt or CHUNK_END.encode() in spelt)):
            ranks[spelt + (WORD_END.encode() if ended else b"")] = i
    if not suffix and before is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        words = WORDS.removesuffix(r"|\s+(?!\S)|\s+")
    elif suffix and before == LOWER_WORDS["normalizer"] and [p | {"behavior": 0} if p["type"] == "Split" else p["type"] for p in pre.get("pretokenizers", ())] == [
            LOWER_WORDS["split"] | {"behavior": 0}, "ByteLevel"]:
        words = f"[^{WORD_END}]*{WORD_END}"
        between = len(model["vocab"])
        ranks |= {WORD_END.encode(): between + 1, (CHUNK_END + WORD_END).encode(): between}  # a byte by itself must have a rank; it never stays alone
    else:
        return None
    encoding = tiktoken.Encoding("ranks", pat_str=words, mergeable_ranks=ranks, special_tokens={})
    merge, piece = encoding.encode_to_numpy, encoding._encode_single_piece
    cut = regex.compile(f"{CHUNK_END}|" + LOWER_WORDS["split"]["pattern"]["Regex"].replace(r"[^\s", rf"[^\s{CHUNK_END}") if suffix else WORDS).findall
    blank = np.zeros(len(model["vocab"]), bool)
    blank[[i for token, i in ranks.items() if token.startswith(b" ") and not suffix]] = True

    def after_blanks(chunks: list[str]) -> list[bytes]:
        text = "".join(chunks)
        if text.count(" ") == [c[:1] for c in chunks].count(" ") == len(chunks) and BLANK_WORDS(text):
            ids = merge(text)
            return divided(ids, np.append(np.flatnonzero(blank[ids])[1:], len(ids)))
        plain = [c for c in chunks if BLANK_WORDS(c) and c.count(" ") == 1]
        found = dict(zip(plain, after_blanks(plain))) if plain else {}
        return [found[c] if c in found else array("I", [i for word in cut(c) for i in piece(word.encode())]).tobytes() for c in chunks]

    def lowered(chunks: list[str]) -> list[bytes]:
        text = WORD_END.join(cut("".join([c + CHUNK_END for c in chunks]).lower()))
        ids = merge(text + WORD_END)
        ends = np.flatnonzero(ids == between)
        return divided(ids[ids != between], ends - np.arange(len(ends)))

    def divided(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        data, ends = ids.astype("<u4").tobytes(), (4 * ends).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def encode(chunks: list[str]) -> list[bytes]:
        return (lowered if suffix else after_blanks)(chunks) if chunks else []

    return encode


class Spelling:
    """What a task remembers of encoded chunks: the ids of all of them, end to end, and a number for each that tells where they are."""

    def __init__(self, load, end_id: int):
        self.cut_text, self.encode = load()
        self.spanning = [n for n in self.cut_text.names if " " in n]
        self.end_id = end_id
        self.forget()

    def forget(self) -> None:
        self.chunks: dict[str, int] = {}
        self.after_blank: dict[str, int] = {}  # words after one blank; -1: the text must be cut as a whole
        self.ids, self.used = np.array([self.end_id] * AT_ONCE, np.uint32), 1  # number 0 is the end of a text
        self.starts, self.sizes, self.known = np.zeros(AT_ONCE, np.int64), np.ones(AT_ONCE, np.int32), 1

    def add(self, known: dict[str, int], keys: list[str], chunks: list[str]) -> None:
        for i in range(0, len(chunks), AT_ONCE):
            found = self.encode(chunks[i:i + AT_ONCE])
            ids, sizes = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
            known.update(zip(keys[i:i + AT_ONCE], range(self.known, self.known + len(found))))
            self.ids = self.longer(self.ids, self.used + len(ids))
            self.starts, self.sizes = (self.longer(x, self.known + len(found)) for x in (self.starts, self.sizes))
            self.ids[self.used:self.used + len(ids)] = ids
            self.sizes[self.known:self.known + len(found)] = sizes
            self.starts[self.known:self.known + len(found)] = self.used + np.cumsum(sizes) - sizes
            self.used, self.known = self.used + len(ids), self.known + len(found)

    @staticmethod
    def longer(values: np.ndarray, n: int) -> np.ndarray:
        return values if n <= len(values) else np.concatenate([values, np.zeros(max(n, 2 * len(values)) - len(values), values.dtype)])

    def of_chunks(self, chunks: list[str]) -> list[int]:
        new = list({c for c in chunks if c not in self.chunks})
        self.add(self.chunks, new, new)
        return list(map(self.chunks.__getitem__, chunks))

    def of_words(self, words: list[str]) -> list[int]:
        """Of distinct words after one blank each."""
        numbers = list(map(self.after_blank.get, words))
        new = [w for w, n in zip(words, numbers) if n is None]
        if not new:
            return numbers
        whole = [" " + w for w in new]
        if self.cut_text("x" + "".join(whole)) != ["x", *whole]:
            good = [w for w, c in zip(new, whole) if self.cut_text("x" + c) == ["x", c]]
            self.after_blank.update(dict.fromkeys(new, -1))
            new, whole = good, [" " + w for w in good]
        self.add(self.after_blank, new, whole)
        return list(map(self.after_blank.__getitem__, words))

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: none) and their ends, end to end, and how many each text has."""
        if len(self.chunks) + len(self.after_blank) > REMEMBERED:
            self.forget()
        texts = texts.fill_null("")
        parts = pc.split_pattern(texts, " ")
        at = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
        words = parts.flatten().dictionary_encode()
        codes, words = words.indices.to_numpy(), words.dictionary.to_numpy(zero_copy_only=False)
        first = np.zeros(len(codes), bool)
        first[at[:-1]] = True
        after = np.zeros(len(words), bool)
        after[codes[~first]] = True
        of_word = np.zeros(len(words), np.int32)
        of_word[after] = self.of_words(words[after].tolist())
        numbers, begin = of_word[codes], words[codes[first]].tolist()
        numbers[first] = self.of_chunks(begin)
        whole = np.zeros(len(texts), bool)
        whole[np.searchsorted(at, np.flatnonzero(numbers < 0), "right") - 1] = True
        for name in self.cut_text.names:
            if name in self.spanning or any(name in b for b in begin):
                whole |= pc.match_substring(texts, name).to_numpy(zero_copy_only=False)
        if whole.any():
            rows = [numbers[a:b] for a, b in zip(at[:-1], at[1:])]
            for i in np.flatnonzero(whole).tolist():
                rows[i] = np.array(self.of_chunks(self.cut_text(texts[i].as_py())), np.int64)
            numbers, at = np.concatenate(rows), np.cumsum([0, *map(len, rows)])
        numbers = np.insert(numbers, at[1:], 0)
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes, dtype=np.int64)
        narrow = np.int32 if self.used + ends[-1] < 1 << 31 else np.int64
        place = np.repeat((self.starts[numbers] - (ends - sizes)).astype(narrow), sizes)
        place += np.arange(ends[-1], dtype=narrow)
        return self.ids[place], np.diff(ends[at[1:] + np.arange(len(texts))], prepend=0)


def in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about BYTES_AT_ONCE, or of TEXTS_AT_ONCE longer ones."""
    held, size = [], 0
    for batch in batches:
        for i in range(0, batch.num_rows, TEXTS_AT_ONCE):
            held.append(batch.slice(i, TEXTS_AT_ONCE))
            size += held[-1].nbytes
            if size >= BYTES_AT_ONCE:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def pieces(docs: DataFrame, load, end_id: int, capacity: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32[, ids] and where it was made: block (task) and nth of its length there."""
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, " \
             "block int, nth long" + ", ids binary" * with_ids

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling, seen, block = Spelling(load, end_id), Counter(), TaskContext.get().partitionId()
        for part in in_groups(batches):
            ids, lengths = spelling.texts(part.column(1))
            ids, at, rows = memoryview(ids.astype("<u4", copy=False)).cast("B"), 0, []
            for doc, n in zip(part.column(0).to_pylist(), lengths.tolist()):
                for k, (start, length) in enumerate(cut(n, capacity)):
                    own = ids[4 * (at + start):4 * (at + start + length)]
                    rows.append((doc, k, start, length, zlib.crc32(own), block, seen[length]) + ((bytes(own),) if with_ids else ()))
                    seen[length] += 1
                at += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    frame = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "block", "nth"] + ["ids"] * with_ids
    from pyspark.sql.pandas.types import to_arrow_type
    types = [to_arrow_type(docs.schema[id_col].dataType), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    return frame.mapInArrow(make, schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids] for every piece of every row of ``docs``.

    A document is the ids of its text (null: none) and ``end_id``; beyond ``capacity`` it is cut, and
    only its first piece may be shorter. Repeated rows are packed as often as they occur. Which of
    several equally long pieces takes which slot follows the order of tasks. An empty table gives no
    rows. Only the two named columns are read.
    """
    made = materialise(pieces(in_small_batches(docs), file_encoder(tokenizer), end_id, capacity, id_col, text_col, with_ids), "pieces")
    counts = made.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    slots = docs.sparkSession.createDataFrame(plan(histogram, capacity),
                                              "length long, first long, past long, sequence long, offset long")
    placed = made.join(bases, ["length", "block"]).withColumn("rank", F.col("base") + F.col("nth"))
    # The plan grows with the capacity, not with the data: every slot empties a group or ends a length.
    return placed.join(F.broadcast(slots), "length").where("rank >= first AND rank < past").select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"),
        "offset", *["ids"] * with_ids)
