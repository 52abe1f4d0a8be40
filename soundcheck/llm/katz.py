"""A Katz backoff language model over word pairs, and the score of every text under it.

P(w | h) is the Good-Turing discounted share of w among what followed h, or, where w never followed h,
the backoff weight of h times P(w); P(w) is the smoothed share of w itself. The weight of h spreads
exactly what its discounts left over, so every history's probabilities add up to one over the learned
words and one unknown word.

Texts are cut into chunks of a few million tokens. A chunk sends each part of the vocabulary its
distinct words, and each part of the pairs its distinct pairs, once, with their counts in training
texts; the part adds the counts of all chunks and answers. Counts and weights thus stay in tables
divided by hash, of which a chunk gets what it asked for. Pairs are divided by their history; a history
with a large share of all tokens is divided by its followers too, and its few sums are added up apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from soundcheck.llm.text import MIX
from soundcheck.session import materialise

TOKENS_PER_CHUNK = 2_000_000
TEXTS_AT_ONCE = 512
DISCOUNTED = 5  # counts up to this are discounted
RESERVE = 0.5  # of a count, kept by every history for words that never followed it
HOT = 4  # a history with more than 1 / (HOT * parts) of all tokens is divided
END = xxhash.xxh3_64_intdigest(b" ")  # no word holds a blank
START = -1  # the history of a first token


def learned_from(id_col: str = "doc_id", folds: int = 5) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds != 1


def squeeze(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def expand(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def mixed(a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    a = a.astype(np.uint64) * MIX
    a ^= a >> np.uint64(32)
    if b is not None:
        a = (a + b.astype(np.uint64)) * MIX
        a ^= a >> np.uint64(29)
    return a


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words of some texts and of the end, which of them each token is, and where each text's tokens end."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    at = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
    pieces = parts.flatten().dictionary_encode()
    words = pieces.dictionary.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_numpy(zero_copy_only=False).tolist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    codes = np.insert(pieces.indices.to_numpy().astype(np.int64), at[1:], len(words))
    at = at + np.arange(len(at))
    empty = [i for i, w in enumerate(words) if not w]  # before and after blanks at the ends of a text
    if empty:
        left = codes != empty[0]
        codes, at = codes[left], np.concatenate([[0], np.cumsum(left)])[at]
    return np.append(hashes, np.uint64(END)), codes, at[1:]


def by_part(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of their part, and where each part begins among them."""
    order = np.argsort(part.astype(np.uint16 if parts <= 1 << 16 else np.int64), kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(part.astype(np.int64), minlength=parts))])


def cut_into_chunks(docs: DataFrame, tokens_per_chunk: int) -> DataFrame:
    """chunk, doc_ids, learned, lengths, words (distinct hashes, sorted), tokens (places in words)."""
    from pyspark.sql.pandas.types import to_arrow_type
    id_name = docs.schema["doc_id"].dataType.simpleString()
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, held, hashes, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush():
            every, codes = np.concatenate(hashes), np.concatenate([h[2] for h in held])
            used = np.zeros(len(every), bool)
            used[codes] = True
            words, place = np.unique(every[used], return_inverse=True)
            at = np.zeros(len(every), np.uint32)
            at[used] = place
            columns = [[(task << 32) + n], [[h[0] for h in held]], [[h[1] for h in held]], [[len(h[2]) for h in held]],
                       [squeeze(words)], [squeeze(at[codes])]]
            types = [pa.int64(), pa.list_(id_type), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                              names=["chunk", "doc_ids", "learned", "lengths", "words", "tokens"])

        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(i, TEXTS_AT_ONCE)
                own, codes, ends = hashed_words(part.column(2))
                hashes.append(own)
                base, start = sum(map(len, hashes[:-1])), 0
                for doc, learned, end in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), ends.tolist()):
                    held.append((doc, learned, codes[start:end] + base))
                    size, start = size + end - start, end
                    if size >= tokens_per_chunk:
                        yield flush()
                        held, hashes, base, size, n = [], [own], 0, 0, n + 1
        if held:
            yield flush()

    return docs.select("doc_id", "learned", "text").mapInArrow(
        make, f"chunk long, doc_ids array<{id_name}>, learned array<boolean>, lengths array<long>, words binary, tokens binary")


def in_training(row: dict) -> np.ndarray:
    return np.repeat(np.array(row["learned"], bool), np.array(row["lengths"], np.int64))


def ask_words(parts: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, tokens = expand(row["words"], np.uint64), expand(row["tokens"], np.uint32)
                counts = np.bincount(tokens[in_training(row)], minlength=len(words)).astype(np.int64)
                order, begin = by_part(words % np.uint64(parts), parts)
                out = [(p, row["chunk"], squeeze(words[order[a:b]]), squeeze(counts[order[a:b]]))
                       for p, (a, b) in enumerate(zip(begin.tolist(), begin[1:].tolist())) if a < b]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                                                 names=["part", "chunk", "words", "counts"])
    return ask


def answer_words(parts: int, total: int):
    """For each asking chunk: numbers of its words (frequent ones are small) and their counts. Also this part's sums (chunk null)."""

    def answer(table: pa.Table) -> pa.Table:
        rows, part = table.to_pylist(), table["part"][0].as_py()
        asked = [expand(r["words"], np.uint64) for r in rows]
        words, place = np.unique(np.concatenate(asked), return_inverse=True)
        counts = np.zeros(len(words), np.int64)
        np.add.at(counts, place, np.concatenate([expand(r["counts"], np.int64) for r in rows]))
        numbers = np.empty(len(words), np.int64)
        numbers[np.argsort(-counts, kind="stable")] = np.arange(len(words)) * parts + part
        ends = np.cumsum([len(a) for a in asked])[:-1]
        own = [(r["chunk"], squeeze(numbers[p]), squeeze(counts[p])) for r, p in zip(rows, np.split(place, ends))]
        most = np.flatnonzero(counts * HOT * parts > total)  # fewer than HOT * parts words, all parts together
        own.append((None, squeeze(numbers[most]), squeeze(counts[most])))
        return pa.table({"chunk": pa.array([o[0] for o in own], pa.int64()), "part": pa.array([part] * len(own), pa.int32()),
                         "numbers": pa.array([o[1] for o in own], pa.binary()), "counts": pa.array([o[2] for o in own], pa.binary()),
                         "distinct": pa.array([int((counts > 0).sum())] * len(own), pa.int64())})
    return answer


def chunk_pairs(row: dict, words: list[dict], parts: int, hot: np.ndarray):
    """The distinct pairs of a chunk and who answers them.

    Returns the tokens' word places, word counts, the tokens in order of their pairs, where each pair begins among them, and
    for each pair: history (number, count), word place, word number, part.
    """
    hashes, tokens = expand(row["words"], np.uint64), expand(row["tokens"], np.uint32).astype(np.int64)
    numbers, counts = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64)
    order, begin = by_part(hashes % np.uint64(parts), parts)
    for w in words:
        own = order[begin[w["part"]]:begin[w["part"] + 1]]
        numbers[own], counts[own] = expand(w["numbers"], np.int64), expand(w["counts"], np.int64)
    width = len(hashes) + 1
    keys = np.empty(len(tokens), np.int64)
    keys[0], keys[1:] = 0, tokens[:-1] + 1
    keys[np.cumsum([0, *row["lengths"][:-1]])] = 0  # 0: the start
    keys *= width
    keys += tokens
    bits = len(tokens).bit_length()
    if width * width < 1 << (63 - bits):  # values sort faster than places
        keys <<= bits
        keys |= np.arange(len(tokens))
        keys.sort()
        order = keys & ((1 << bits) - 1)
        keys >>= bits
    else:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    h, w = np.divmod(keys[first], width)
    h -= 1
    h_number = np.where(h < 0, START, numbers[h])
    spread = np.isin(h_number, hot)
    to = np.where(spread, mixed(h_number, numbers[w]), mixed(h_number)) % np.uint64(parts)
    return tokens, counts, order, first, h_number, np.where(h < 0, -1, counts[h]), w, numbers[w], to


def ask_pairs(parts: int, hot: np.ndarray):
    def ask(chunk: pa.Table, words: pa.Table) -> pa.Table:
        out = []
        for row in chunk.to_pylist():
            _, counts, order, first, h, _, w, number, to = chunk_pairs(row, words.to_pylist(), parts, hot)
            trained = np.add.reduceat(in_training(row)[order].astype(np.uint32), first)
            order, begin = by_part(to, parts)
            for p, (a, b) in enumerate(zip(begin.tolist(), begin[1:].tolist())):
                if a < b:
                    own = order[a:b]
                    out.append((p, row["chunk"], squeeze(h[own]), squeeze(number[own]), squeeze(trained[own].astype(np.uint32)),
                                squeeze(counts[w[own]])))
        names = ["part", "chunk", "h", "w", "trained", "count"]
        types = [pa.int32(), pa.int64()] + [pa.binary()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names) if out else pa.table(
            {n: pa.array([], t) for n, t in zip(names, types)})
    return ask


def answer_pairs(hot: np.ndarray, total: int, distinct: int):
    """For each asking chunk: the counts of its pairs, and the sums of histories of which it has an unseen pair.

    Sums of a history: how many of its pairs occur 1 .. DISCOUNTED times, and the share P(w) of all that followed it.
    The row without a chunk holds this part's counts of counts, and its sums of divided histories.
    """

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        h, w, trained, count = (np.concatenate([expand(r[c], t) for r in rows]) for c, t in
                                (("h", np.int64), ("w", np.int64), ("trained", np.uint32), ("count", np.int64)))
        width = int(w.max()) + 1
        order = np.argsort((h + 1) * width + w) if (int(h.max()) + 2) * width < 1 << 63 else np.lexsort((w, h))
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(h[order]) != 0) | (np.diff(w[order]) != 0)]))
        sums = np.add.reduceat(trained[order].astype(np.int64), starts)
        each = np.empty(len(h), np.int64)
        each[order] = np.repeat(sums, np.diff(np.append(starts, len(h))))
        seen = sums > 0
        pair_h, pair_share = h[order][starts][seen], smoothed(count[order][starts][seen], total, distinct)
        histories, place = np.unique(pair_h, return_inverse=True)
        low = np.zeros((len(histories), DISCOUNTED), np.int64)
        few = sums[seen] <= DISCOUNTED
        np.add.at(low, (place[few], sums[seen][few] - 1), 1)
        share = np.bincount(place, pair_share, len(histories))
        ends = np.cumsum([len(expand(r["trained"], np.uint32)) for r in rows])[:-1]
        own = []
        for r, hs, cs in zip(rows, np.split(h, ends), np.split(each, ends)):
            wanted = np.intersect1d(hs[cs == 0], histories)
            at = np.searchsorted(histories, wanted)
            own.append((r["chunk"], squeeze(cs), squeeze(wanted), squeeze(low[at]), squeeze(share[at])))
        divided = np.flatnonzero(np.isin(histories, hot))
        own.append((None, squeeze(np.bincount(np.minimum(sums, DISCOUNTED + 2), minlength=DISCOUNTED + 3)), squeeze(histories[divided]),
                    squeeze(low[divided]), squeeze(share[divided])))
        part = table["part"][0].as_py()
        return pa.table({"chunk": pa.array([o[0] for o in own], pa.int64()), "part": pa.array([part] * len(own), pa.int32()),
                         **{n: pa.array([o[i + 1] for o in own], pa.binary()) for i, n in enumerate(("counts", "h", "low", "share"))}})
    return answer


def smoothed(counts: np.ndarray, total: int, distinct: int) -> np.ndarray:
    """P(w): the learned words and one unknown word add up to one."""
    return (counts + 0.5) / (total + 0.5 * (distinct + 1))


def discounts(times: np.ndarray) -> np.ndarray:
    """Katz's factors for counts 0 .. DISCOUNTED + 1 (from there on 1), where ``times[r]`` pairs occur r times.

    Where the counts of counts give no factor between 0 and 1, half a count is taken off instead.
    """
    out = np.ones(DISCOUNTED + 2)
    k = DISCOUNTED
    common = (k + 1) * times[k + 1] / times[1] if times[1] else 1.0
    for r in range(1, k + 1):
        good = (r + 1) * times[r + 1] / (r * times[r]) if times[r] else 0.0
        d = (good - common) / (1 - common) if common < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def score_chunks(parts: int, hot: np.ndarray, hot_low: np.ndarray, hot_share: np.ndarray, d: np.ndarray, total: int, distinct: int,
                 texts: int, id_type):
    left_off = np.arange(1, DISCOUNTED + 1) * (1 - d[1:DISCOUNTED + 1])

    def score(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        rows = answers.to_pylist()
        words, pairs = [r for r in rows if r["numbers"] is not None], [r for r in rows if r["numbers"] is None]
        out = []
        for row in chunk.to_pylist():
            tokens, counts, order, first, h, h_count, w, _, to = chunk_pairs(row, words, parts, hot)
            h_count = np.where(h == START, texts, h_count)
            times = np.zeros(len(h), np.int64)
            asked, begin = by_part(to, parts)
            for a in pairs:
                times[asked[begin[a["part"]]:begin[a["part"] + 1]]] = expand(a["pair_counts"], np.int64)
            unseen = np.flatnonzero(times == 0)
            low, share, own = np.zeros((len(unseen), DISCOUNTED), np.int64), np.zeros(len(unseen)), h[unseen]
            # A history that is not divided has one part; the sums of the others replace what several parts sent.
            wanted = np.concatenate([expand(a["h"], np.int64) for a in pairs])
            for known, known_low, known_share in (
                    (wanted, np.concatenate([expand(a["low"], np.int64).reshape(-1, DISCOUNTED) for a in pairs]),
                     np.concatenate([expand(a["share"], np.float64) for a in pairs])), (hot, hot_low, hot_share)):
                if len(known) and len(own):
                    sort = np.argsort(known)
                    at = np.minimum(np.searchsorted(known, own, sorter=sort), len(known) - 1)
                    fill = known[sort[at]] == own
                    low[fill], share[fill] = known_low[sort[at[fill]]], known_share[sort[at[fill]]]
            word = np.log10(smoothed(counts, total, distinct))
            logs = np.log10(d[np.minimum(times, DISCOUNTED + 1)] * np.maximum(times, 1) / (h_count + RESERVE))
            weight = np.log10((RESERVE + low @ left_off) / (h_count[unseen] + RESERVE) / (1 - share))
            logs[unseen] = np.where(h_count[unseen] > 0, weight, 0.0) + word[w[unseen]]
            each = np.empty(len(tokens))
            each[order] = np.repeat(logs, np.diff(first, append=len(tokens)))
            starts = np.cumsum([0, *row["lengths"][:-1]])
            out.append(pa.table({
                "doc_id": pa.array(row["doc_ids"], id_type), "held_out": pa.array(~np.array(row["learned"], bool)),
                "n_tokens": pa.array(row["lengths"], pa.int64()),
                "n_known": pa.array(np.add.reduceat((counts[tokens] > 0).astype(np.int64), starts)),
                "train_tokens": pa.array([total] * len(starts), pa.int64()),
                "base_score": pa.array(np.add.reduceat(word[tokens], starts)),
                "score": pa.array(np.add.reduceat(each, starts))}))
        return pa.concat_tables(out)
    return score


def score_texts(docs: DataFrame, learned: Column, id_col: str = "doc_id", text_col: str = "text",
                tokens_per_chunk: int = TOKENS_PER_CHUNK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    ``learned`` says which rows are learned from (null: not); all are scored. Tokens are the words,
    A-Z lower-cased, then one end; null and empty texts are one end. n_known counts tokens that
    occur in learned texts, base_score adds log10 P(w), score log10 P(w | h). Repeated rows count as
    often as they occur. Without anything learned, all is unknown. An empty table gives no rows.
    Only the named columns are read.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(learned, F.lit(False)).alias("learned"), F.col(text_col).alias("text"))
    chunks = materialise(cut_into_chunks(docs, tokens_per_chunk), "chunks")
    tokens = F.aggregate(F.zip_with("learned", "lengths", lambda x, n: F.when(x, n).otherwise(0)), F.lit(0).cast("long"), lambda a, b: a + b)
    sums = chunks.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(F.filter("learned", lambda x: x))).alias("texts"), F.sum(tokens).alias("tokens")).first()
    parts, texts, total = max(1, sums["n"]), sums["texts"] or 0, sums["tokens"] or 0

    words = materialise(chunks.mapInArrow(ask_words(parts), "part int, chunk long, words binary, counts binary").groupBy("part").applyInArrow(
        answer_words(parts, total), "chunk long, part int, numbers binary, counts binary, distinct long"), "words")
    distinct, frequent = 0, [np.array([START])]
    for r in words.where("chunk IS NULL").toLocalIterator():  # one row for each part
        distinct += r["distinct"]
        frequent.append(expand(r["numbers"], np.int64))
    hot = np.sort(np.concatenate(frequent))

    answered = words.where("chunk IS NOT NULL").drop("distinct")
    asked = chunks.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(
        ask_pairs(parts, hot), "part int, chunk long, h binary, w binary, trained binary, count binary")
    pairs = materialise(asked.groupBy("part").applyInArrow(
        answer_pairs(hot, total, distinct), "chunk long, part int, counts binary, h binary, low binary, share binary"), "pairs")
    times, hot_low, hot_share = np.zeros(DISCOUNTED + 3, np.int64), np.zeros((len(hot), DISCOUNTED), np.int64), np.zeros(len(hot))
    for r in pairs.where("chunk IS NULL").toLocalIterator():  # one row for each part
        times += expand(r["counts"], np.int64)
        at = np.searchsorted(hot, expand(r["h"], np.int64))
        hot_low[at] += expand(r["low"], np.int64).reshape(-1, DISCOUNTED)
        hot_share[at] += expand(r["share"], np.float64)

    every = answered.select("chunk", "part", "numbers", "counts", *[F.lit(None).cast("binary").alias(c) for c in ("pair_counts", "h", "low", "share")]).union(
        pairs.where("chunk IS NOT NULL").select("chunk", "part", *[F.lit(None).cast("binary").alias(c) for c in ("numbers", "counts")],
                                                F.col("counts").alias("pair_counts"), "h", "low", "share"))
    id_type = docs.schema["doc_id"].dataType
    return chunks.groupBy("chunk").cogroup(every.groupBy("chunk")).applyInArrow(
        score_chunks(parts, hot, hot_low, hot_share, discounts(times), total, distinct, texts, to_arrow_type(id_type)),
        f"doc_id {id_type.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
