"""Operators of the training-data subpackage against plain forms, on small and awkward inputs."""

import math
import os
import random
import struct
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as vocabularies
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

from soundcheck.llm import (byte_bpe, chat, id_files, katz, language, near_text, near_vectors, packing, quality,  # noqa: E402
                            text as cutting, token_counts)
from soundcheck.llm.components import components, forest  # noqa: E402
from soundcheck.llm.queries import QUERIES  # noqa: E402
from soundcheck.session import BATCH_BYTES, BATCH_LIMIT, READ_LIMIT, READ_ROWS  # noqa: E402

RANKS, FILE, WORDS = (vocabularies.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json"))
ENCODERS = {p: packing.file_encoder(p)() for p in (FILE, WORDS)}
LIBRARIES = {p: Tokenizer.from_file(p) for p in (FILE, WORDS)}
LONG = " ".join(f"w{i % 700}x{i % 31}" for i in range(20_000))
AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog, twice as high as before.", "en", "a"), (2, None, None, None), (3, "", "en", "a"),
    (4, " \n\t ", None, "a"), (5, LONG, "en", "b"), (6, "a" * 5000, "xx", "b"), (7, "two\nlines \n\n  and   blanks\x1c\x85", "en", "b"),
    (8, "Der schnelle braune Fuchs springt über den faulen Hund und noch weiter.", "de", None),
    (9, "the quick brown FOX jumps over the lazy dog, twice as high as before.", "en", "a"), (9, "the quick brown FOX jumps over the lazy dog, twice as high as before.", "en", "a"),
    (None, "no id here, but the text is one that counts all the same today", "en", "a"), (11, "<|endoftext|> ends 123 !!", "en", "a"), (12, "one", "en", "a")]
CLASHING = ["row", "ids", "class", "n_tokens", "kept", "score", "length", "chunk", "host", "component", "part", "u", "vec_id", "sig", "lang_pred"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string")
    return rows.withColumns({c: F.lit("mine") for c in CLASHING}).repartition(3)


def none_left(df):
    return df.limit(0)


def ids_of(tokenizer, text):
    return LIBRARIES[tokenizer].encode(text or "", add_special_tokens=False).ids


# Byte-level BPE

BPE = byte_bpe.ByteBpe(RANKS, vocabularies.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=BPE.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("ab the-= \n\t\x1c\x85　'sé日"), st.characters(exclude_categories=["Cs"])), max_size=200), st.sampled_from([2, 5, 24]))
def test_tree_of_any_leaf_size_equals_the_library(text, leaf):
    before, byte_bpe.LEAF = byte_bpe.LEAF, leaf
    try:
        expected = LIBRARY.encode_ordinary(text)
        assert BPE.encode(text) == expected
        assert [i for c in cutting.chunks(text) for i in BPE.encode(c)] == expected
        assert BPE.decode(expected) == text.encode()
    finally:
        byte_bpe.LEAF = before


def test_the_tree_joins_on_the_given_table(folder, monkeypatch):
    import pyarrow.parquet as pq
    texts = [t for t in pq.read_table(f"{folder}/documents.parquet", columns=["text"]).column(0).to_pylist()[:40] if t]
    joins, join = [], BPE.join
    monkeypatch.setattr(BPE, "join", lambda a, b: joins.append(1) or join(a, b))
    for text in texts:
        assert BPE.encode(text) == LIBRARY.encode_ordinary(text)
    assert len(joins) > len(texts)


def test_remembered_merges_stay_few(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MERGED", 3)
    own = byte_bpe.ByteBpe(RANKS, vocabularies.PATTERN)
    for text in ("qzxjvkwpyyhh" * 20, "unlikelyhoodnesses aàéb" * 9):
        assert own.encode(text) == LIBRARY.encode_ordinary(text) and len(own.merged) <= 3


def test_encode_texts(spark, docs):
    rows = byte_bpe.encode_texts(docs, RANKS, vocabularies.PATTERN).select("row.text", "row.ids", "ids").collect()
    assert len(rows) == len(AWKWARD)
    for text, mine, ids in rows:
        assert (mine, list(ids)) == ("mine", LIBRARY.encode_ordinary(text or ""))
    back = byte_bpe.encode_texts(docs, RANKS, vocabularies.PATTERN).select(
        "row.text", byte_bpe.decode_ids(F.col("ids"), RANKS, vocabularies.PATTERN).alias("b")).collect()
    assert all(bytes(r.b) == (r.text or "").encode() for r in back)
    assert byte_bpe.encode_texts(none_left(docs), RANKS, vocabularies.PATTERN).count() == 0


# Token counts

def best_spelling(word, scores):
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            s = scores.get(word[start:end])
            if s is not None and (best[start][0] + s, -best[start][1] - 1) > (best[end][0], -best[end][1]):
                best[end] = (best[start][0] + s, best[start][1] + 1)
    return best[-1][1]


def test_token_counts(docs):
    trie = token_counts.UnigramTrie(RANKS, vocabularies.PATTERN)
    words = [b"the", b"there", b"therefore", b" the", b"xqzzy", b"", "日本".encode(), b"a" * 90]
    assert [trie.count(w) for w in words] == [best_spelling(w, trie.scores) for w in words]
    for text, pre, n in token_counts.count_tokens(docs, RANKS, vocabularies.PATTERN).select("row.text", "n_pretokens", "n_tokens").collect():
        pieces = trie.pattern.findall(text or "")
        if len(text or "") < 1000:
            assert (pre, n) == (len(pieces), sum(best_spelling(p.encode(), trie.scores) for p in pieces))
    assert token_counts.count_tokens(none_left(docs), RANKS, vocabularies.PATTERN).count() == 0


def test_long_pretokens_take_no_trie():
    import resource
    import time
    trie = token_counts.UnigramTrie(RANKS, vocabularies.PATTERN)
    rnd = random.Random(8)
    for word in (b"a" * 700, "日本語".encode() * 80, bytes(rnd.choices(b"thesandio", k=900)), rnd.randbytes(300)):
        assert trie.count_long(word) == trie.count(word) == best_spelling(word, trie.scores)
    nodes, before, start = trie.nodes, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    word = "".join(rnd.choices("abcdefghijklmnop", k=10_000_000)).encode()
    assert 0 < trie.count(word) <= len(word) and trie.nodes == nodes
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000 and time.time() - start < 240


def test_a_trie_begun_anew_counts_the_same():
    a, b = (token_counts.UnigramTrie(RANKS, vocabularies.PATTERN) for _ in range(2))
    words = [random.Random(i).randbytes(12) for i in range(50)]
    expected = [a.count(w) for w in words]
    before, token_counts.MAX_NODES = token_counts.MAX_NODES, 20
    try:
        assert [b.count(w) for w in words] == expected and b.nodes < 40
    finally:
        token_counts.MAX_NODES = before


# Tokenizer files

@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abcdeionst TH'éÀßſŁđžǅ\n\t.,-<|>_`~ĳ0123µª日"), st.characters(exclude_categories=["Cs"])), max_size=60), st.sampled_from([FILE, WORDS]))
def test_merging_by_ranks_equals_the_library(text, path):
    want = ids_of(path, text)
    cut_text, encode = ENCODERS[path]
    assert [i for c in cut_text(text) for i in np.frombuffer(encode([c])[0], "<u4").tolist()] == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", " ", "  ", "\n", "word", "É", "日本", " x"]), max_size=12).map("".join),
       st.sampled_from([FILE, WORDS]))
def test_strings_of_special_tokens_are_those_tokens(text, path):
    want = LIBRARIES[path].encode(text, add_special_tokens=False).ids
    cut_text, encode = ENCODERS[path]
    assert [i for c in cut_text(text) for i in np.frombuffer(encode([c])[0], "<u4").tolist()] == want


ODD = st.text(st.one_of(st.sampled_from("abcdeionst TH'éÀßſŁđžǅ\n\t.,-<|>_`~ĳ0123µª日\x01\x02\x1c\xa0"), st.characters(exclude_categories=["Cs"])), max_size=60)
SPELLINGS = {p: packing.Spelling(packing.file_encoder(p), 7) for p in (FILE, WORDS)}


def test_blanks_at_the_ends_of_chunks_are_not_those_of_the_next():
    for path in (FILE, WORDS):
        for chunks in ([" x ", "it's"], ["it's", " x "], [" x", " y "], [" ", "x"], ["", " x", " y"]):
            assert [np.frombuffer(b, "<u4").tolist() for b in ENCODERS[path][1](chunks)] == [ids_of(path, c) for c in chunks]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), ODD, st.lists(st.sampled_from(["<|endoftext|>", "<|", "|>", " ", "  ", "\n", "word", "Word.", "it's", "日本", " x", "x "]), max_size=12).map("".join)),
                min_size=1, max_size=6), st.sampled_from([FILE, WORDS]), st.integers(0, 2))
def test_texts_spelt_together_equal_the_library(texts, path, skip):
    for spelling in (SPELLINGS[path], packing.Spelling(lambda: ENCODERS[path], 7)):
        ids, sizes = spelling.texts(pa.array([None] * skip + texts, pa.string()).slice(skip))
        assert np.split(ids, np.cumsum(sizes))[-1].size == 0 and [x.tolist() for x in np.split(ids, np.cumsum(sizes))[:-1]] == [ids_of(path, t) + [7] for t in texts]


@pytest.mark.parametrize("path", [FILE, WORDS])
def test_a_word_is_looked_up_and_encoded_once_for_many_texts(path):
    cut_text, encode = ENCODERS[path]
    asked, cuts = [], []

    def own_cut(text):
        cuts.append(len(text))
        return cut_text(text)

    own_cut.names = cut_text.names
    spelling = packing.Spelling(lambda: (own_cut, lambda parts: asked.extend(parts) or encode(parts)), 7)
    texts = ["Some words " * 50 + f"and number {i}." for i in range(300)]
    for _ in range(2):
        ids, _ = spelling.texts(pa.array(texts))
    assert ids.tolist() == [i for t in texts for i in ids_of(path, t) + [7]]
    assert len(asked) == len(set(asked)) < 310 and sum(cuts) < sum(map(len, texts)) // 20
    before = packing.REMEMBERED
    try:
        packing.REMEMBERED = 100
        assert spelling.texts(pa.array(texts))[0].tolist() == ids.tolist() and spelling.texts(pa.array(["a b"]))[0].tolist() == ids_of(path, "a b") + [7]
        assert len(spelling.after_blank) == 1
    finally:
        packing.REMEMBERED = before


def test_texts_are_encoded_some_megabytes_at_a_time():
    rows = pa.record_batch([pa.array(range(9000)), pa.array(["x" * 2000] * 9000)], names=["doc_id", "text"])
    groups = list(packing.in_groups(iter([rows.slice(0, 700), rows.slice(700)])))
    assert [i for g in groups for i in g.column(0).to_pylist()] == list(range(9000)) and len(groups) < 11
    assert max(g.nbytes for g in groups) < 1.2 * packing.BYTES_AT_ONCE and list(packing.in_groups(iter([]))) == []


def test_other_tokenizer_files_are_left_to_the_library():
    import json
    with open(FILE) as file:
        own = json.load(file)
    for change in ({"normalizer": {"type": "NFD"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": own["model"] | {"byte_fallback": True}},
                   {"model": own["model"] | {"merges": own["model"]["merges"][::-1]}}, {"model": own["model"] | {"end_of_word_suffix": "</w>"}}):
        assert packing.by_ranks(own | change) is None
    assert packing.by_ranks(own)


# Packing

@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan_places_every_piece_once_and_needs_no_more_than_first_fit(histogram):
    slots = packing.plan(histogram, 64)
    held = defaultdict(list)
    for length in histogram:
        ranks = sorted((a, b) for n, a, b, _, _ in slots if n == length)
        assert ranks[0][0] == 0 and ranks[-1][1] == histogram[length]
        assert all(x[1] == y[0] for x, y in zip(ranks, ranks[1:]))
    for length, first, past, sequence, offset in slots:
        for k in range(past - first):
            held[sequence + k].append((offset, length))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    free = []
    for length in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        k = next((i for i, f in enumerate(free) if f >= length), None)
        if k is None:
            free.append(64 - length)
        else:
            free[k] -= length
    assert len(held) <= len(free)


def test_plan_takes_first_fit_where_best_fit_needs_more():
    histogram = {1: 1, 5: 1, 25: 2, 40: 2, 2: 1, 7: 19, 8: 6}
    used = [len({s + k for _, a, b, s, _ in how(histogram, 64) for k in range(b - a)}) for how in (packing.best_fit, packing.first_fit, packing.plan)]
    assert used == [6, 5, 5]


def test_pack(docs):
    rows = packing.pack(docs, FILE, with_ids=True).collect()
    expected = Counter(tuple(ids_of(FILE, t) + [2]) for _, t, *_ in AWKWARD)
    sequences, texts = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = struct.unpack(f"<{r.length}I", r.ids)
        assert r.length <= 1024 and (r.piece == 0 or r.length == 1024) and zlib.crc32(r.ids) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length))
        texts[r.doc_id].append((r.piece, r.start, ids))
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))] and sum(n for _, n in pieces) <= 1024
    assert len(sequences) <= -(-sum(len(k) * n for k, n in expected.items()) // 1024) + 1
    for doc, text, *_ in AWKWARD:
        if doc not in (9,):
            joined = [i for _, _, ids in sorted(texts[doc]) for i in ids]
            assert joined == ids_of(FILE, text) + [2]
    assert len(texts[9]) == 2
    assert packing.pack(none_left(docs), FILE).count() == 0


# Token-id files

@pytest.mark.parametrize("ids", [[], [0], [2**32 - 1, 0, 5, 2**32 - 1], list(range(3000)), [7, 8, 9] * 900, [2**31 + i % 50 for i in range(2000)],
                                 list(np.random.default_rng(3).zipf(1.2, 4000) % 49408)])
def test_blocks_come_back(ids):
    ids = np.array(ids, np.uint32)
    data = id_files.encode_blocks(ids, 256)
    assert (id_files.decode_blocks(data) == ids).all()
    if len(ids) == 2700:
        assert len(data) < len(ids) // 4  # predictions by what followed before
    if len(ids):
        with pytest.raises(ValueError, match="block .* is damaged"):
            id_files.decode_blocks(data[:-1] + bytes([data[-1] ^ 1]))
        with pytest.raises(ValueError, match="table of ids is damaged"):
            id_files.decode_blocks(data[:22] + bytes([data[22] ^ 1]) + data[23:])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 6), st.integers(0, 2**32 - 1)), max_size=300), st.integers(1, 70))
def test_any_ids_come_back(ids, block):
    ids = np.array(ids, np.uint32)
    assert (id_files.decode_blocks(id_files.encode_blocks(ids, block)) == ids).all()


def test_shares_of_a_step_cover_the_range_once():
    """Every place of the sum belongs to one id: the intervals of all ids follow each other without gaps."""
    rng = np.random.default_rng(5)
    table = id_files.Table.count(np.arange(6), np.array([1, 50, 3, 9, 9, 2]))
    model, every = id_files.Model(1, table), np.arange(6, dtype=np.uint32)
    for x in rng.integers(0, 6, 200, dtype=np.uint32):
        model.predict(1)
        both = [model.interval(np.array([i]), model.guesses == i) for i in every]
        starts, sizes = np.array([a[0] for a, _ in both]), np.array([b[0] for _, b in both])
        assert starts[0] == 0 and (starts[1:] == (starts + sizes)[:-1]).all()
        assert starts[-1] + sizes[-1] == 1 << table.bits + id_files.SHARE_BITS and (sizes > 0).all()
        for i in every:
            for place in (starts[i], starts[i] + sizes[i] // 2, starts[i] + sizes[i] - 1):
                assert model.lookup(np.array([place]))[0] == i
        now = np.array([x])
        model.update(now, sizes[x:x + 1], model.guesses == now)


@pytest.mark.parametrize("distinct, kind", [(3000, np.int32), (200_000, np.int32), (400_000, np.int64)])
def test_a_step_is_as_narrow_as_its_places_allow(distinct, kind):
    ids = np.random.default_rng(6).permutation(np.repeat(np.arange(distinct, dtype=np.uint32) * 9, 2))
    places, counts = np.unique(ids, return_counts=True)
    model = id_files.Model(40, id_files.Table.count(places, counts))
    model.predict(40)
    start, size = model.interval(np.arange(40, dtype=np.uint32), model.guesses == np.arange(40, dtype=np.uint32))
    assert model.shares.dtype == start.dtype == size.dtype == kind
    assert (model.table.start + model.table.freq).max() << id_files.SHARE_BITS == 1 << model.table.bits + id_files.SHARE_BITS
    few = ids[:6000]
    assert (id_files.decode_blocks(id_files.encode_blocks(ids, 9000)) == ids).all() and (id_files.decode_blocks(id_files.encode_blocks(few, 70)) == few).all()


def test_mixing_is_shorter_than_order_0_alone(folder):
    import pyarrow.parquet as pq
    texts = [t for t in pq.read_table(f"{folder}/documents.parquet", columns=["text"]).column(0).to_pylist() if t]
    ids = np.concatenate([np.frombuffer(b, "<u4") for t in texts for b in ENCODERS[WORDS][1](cutting.chunks(t))])
    counts = np.unique(ids, return_counts=True)[1] / len(ids)
    assert 8 * len(id_files.encode_blocks(ids)) < len(ids) * -(counts * np.log2(counts)).sum()


def test_files_come_back(docs, monkeypatch):
    monkeypatch.setattr(id_files, "SEGMENT_IDS", 20)
    files = id_files.write_ids(docs, WORDS)
    rows = id_files.read_ids(files, with_ids=True).orderBy("start").collect()
    by_id = sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in rows] == [r[0] for r in by_id]
    at = 0
    for r, (_, text, *_) in zip(rows, by_id):
        ids = np.array(ids_of(WORDS, text) + [1], "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (at, len(ids) // 4, zlib.crc32(ids), ids)
        at += len(ids) // 4
    assert files.count() > 3 and id_files.read_ids(id_files.write_ids(none_left(docs), WORDS)).count() == 0


# Quality rules

def plain_measure(text):
    words = [w for w in (text or "").encode().split()]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab \n\t#é|"), max_size=120))
def test_measures(text):
    assert quality.measure(text) == plain_measure(text)


def test_judge(spark, docs):
    rows = quality.judge(docs).select("row.doc_id", "row.text", "row.kept", "n_words", "n_repeat_words", "base_failed", "host_rejected", F.col("kept").alias("k")).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        m = plain_measure(r.text)
        assert r["n_words"] == m[0] and r["base_failed"] == (m[0] < 10 or 100 * m[4] > 20 * m[0]) and r[2] == "mine"
        assert r["k"] == (not r["base_failed"] and not r["host_rejected"])
    assert quality.judge(none_left(docs)).count() == 0


def test_a_bad_host_is_rejected_and_a_small_one_is_not(spark):
    good = " ".join(f"word{i}" for i in range(30))
    rows = [("big", "x")] * 300 + [("big", good)] * 20 + [("fine", good)] * 500 + [("small", "x")] + [(f"h{i}", good) for i in range(40)] + [("small", good)]
    judged = quality.judge(spark.createDataFrame(rows, "source string, text string")).where("NOT base_failed").groupBy("row.source").agg(F.min("kept").alias("k")).collect()
    verdict = {r["source"]: r["k"] for r in judged}
    assert not verdict["big"] and verdict["fine"] and verdict["small"]


def test_prior_without_spread_shrinks_to_the_mean():
    mean, weight = quality.beta_prior(100, 10, 10, 10 * 1.0 / 10)
    assert mean == 0.1 and weight > 1e5
    assert quality.beta_prior(0, 0, 0, 0.0) == (0.0, 1.0)


# Language

def test_language_of_held_out_documents(spark, folder):
    found = QUERIES["op4_language_id"](spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id")
    row = found.where("held_out AND accepted AND n_chars > 100").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert row.n > 100 and row.a > 0.99


def test_language_of_awkward_texts(docs):
    model = language.learn(docs)
    assert set(model) == {"en", "de", "xx"} and model == language.learn(docs.repartition(7))
    rows = language.identify(docs, model).select("row.doc_id", "row.lang_pred", F.col("lang_pred").alias("p"), "score", "accepted").collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(AWKWARD) and all(r[1] == "mine" and 0 <= r.score <= 1 for r in rows)
    assert [by[k].p for k in (2, 3, 4)] == ["und"] * 3 and by[8].p == "de" and by[6].p == "xx"
    assert not by[2].accepted
    assert language.learn(none_left(docs)) == {} and language.identify(none_left(docs), model).count() == 0
    assert {r.lang_pred for r in language.identify(docs, {}).collect()} == {"und"}


@pytest.mark.parametrize("learned", [["en"], ["en", "fr"], ["de", "en", "es", "fr"]])
def test_texts_without_one_language_are_rejected_at_any_length(spark, folder, learned):
    documents = spark.read.parquet(f"{folder}/documents.parquet").where("text IS NOT NULL AND n_chars > 200")
    model = language.learn(documents.where(~language.held_out()).where(F.col("lang").isin(learned)))
    draw, own = random.Random(3), documents.where(language.held_out()).select("lang", "text").collect()
    words = {k: [w for r in own if r.lang == k for w in r.text.split()] for k in ("de", "en", "es", "fr")}
    letters = lambda n: " ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 9))) for _ in range(n))
    hexes = lambda n: " ".join(f"{draw.getrandbits(32):08x}" for _ in range(n))

    def mixed(n):
        starts = {k: draw.randrange(len(words[k]) - n) for k in draw.sample(sorted(words), 2)}
        return " ".join(w for k, i in starts.items() for w in words[k][i:i + n // 2])

    texts = [(kind.__name__ if kind is mixed else "random", kind(n)) for kind in (letters, hexes, mixed) for n in (100, 500, 2000) for _ in range(40)]
    texts += [("cyrillic", "\u0448\u0438\u0440\u043e\u043a\u0430\u044f \u0440\u0435\u043a\u0430 " * n) for n in (1, 40, 900)]
    texts += [("own" if r.lang in learned else "foreign", r.text) for r in own]
    rows = language.identify(spark.createDataFrame(texts, "kind string, text string").repartition(4), model, keep=["kind"])
    share = {r.kind: r.a for r in rows.groupBy("row.kind").agg(F.avg(F.col("accepted").cast("int")).alias("a")).collect()}
    assert share["own"] > 0.97 and share["cyrillic"] == 0 and share["random"] <= 0.01 and share["mixed"] <= 0.05
    assert share.get("foreign", 0) <= 0.02
    tie = language.identify(spark.createDataFrame([(texts[0][1],)], "text string"), {"a": b"x", "b": b"x"}, min_score=0.0).first()
    assert tie.lang_pred == "a" and not tie.accepted


# Language model

def test_scores_equal_the_plain_model_for_any_chunks(spark, folder):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 3000")
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows, given_, vocabulary, pairs = brute.katz([(zlib.crc32(str(i).encode()) % 5 != 1, t) for i, t in texts], katz.RESERVE, katz.DISCOUNTED,
                                                 lambda n: katz.discounts(np.array(n)))
    for tokens in (4000, 10 ** 6):
        got = {r.doc_id: r for r in katz.score_texts(docs.repartition(3), katz.learned_from(), tokens_per_chunk=tokens).collect()}
        for (i, _), row in zip(texts, rows):
            r = got[i]
            assert (r.n_tokens, r.n_known, r.train_tokens) == row[:3] and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1)
            assert r.base_score == pytest.approx(row[3], rel=1e-9) and r.score == pytest.approx(row[4], rel=1e-9)
    for h in list(pairs)[:20]:
        assert sum(given_(w, h) for w in vocabulary + [b"never seen"]) == pytest.approx(1, abs=1e-9)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aAbÀé日 \t\n\x0b\x0c\r\x1c\x85\xa0"), max_size=15)), min_size=1, max_size=6), st.integers(0, 2))
def test_words_hashed_together_are_those_of_each_text(texts, skip):
    hashes, codes, ends = katz.hashed_words(pa.array([None] * skip + texts, pa.string()).slice(skip))
    got = [hashes[x].tolist() for x in np.split(codes, ends)]
    assert got == [cutting.word_hashes(t).tolist() + [katz.END] for t in texts] + [[]]


@pytest.mark.parametrize("parts", [1, 7, 70_000])
def test_pairs_of_a_chunk_are_found_by_one_sort(parts, monkeypatch):
    """No token is searched for among the pairs, and no part takes a pass over all words: both were most of the work."""
    rnd = np.random.default_rng(4)
    hashes, lengths = np.unique(rnd.integers(0, 2**63, 400, dtype=np.uint64)), [3000, 1, 999]
    tokens = rnd.integers(0, len(hashes), sum(lengths)).astype(np.uint32)
    part, words = hashes % np.uint64(parts), []
    for p in np.unique(part):
        own = np.flatnonzero(part == p)
        words.append({"part": int(p), "numbers": katz.squeeze(own * parts), "counts": katz.squeeze(own + 5)})
    row = {"words": katz.squeeze(hashes), "tokens": katz.squeeze(tokens), "lengths": lengths, "learned": [True, False, True], "chunk": 0}
    with monkeypatch.context() as m:
        m.setattr(np, "searchsorted", None)
        got, counts, order, first, h, h_count, w, number, to = katz.chunk_pairs(row, words, parts, np.array([katz.START, 3 * parts]))
    starts = {0, 3000, 3001}
    want = [(katz.START if i in starts else int(tokens[i - 1]) * parts, int(tokens[i]) * parts) for i in range(len(tokens))]
    pairs = list(zip(h.tolist(), number.tolist()))
    assert got.tolist() == tokens.tolist() and len(pairs) == len(set(pairs))
    each = np.empty(len(tokens), np.int64)
    each[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(tokens)))
    assert [pairs[i] for i in each] == want
    assert counts.tolist() == list(range(5, len(hashes) + 5)) and (number == w * parts).all() and ((h < 0) == (h_count == -1)).all()
    assert all(len(set(to[h == x].tolist())) == 1 for x in set(h.tolist()) - {katz.START, 3 * parts}) and to.max() < parts


def test_scores_of_awkward_texts(docs):
    rows = katz.score_texts(docs, F.lit(True)).collect()
    assert len(rows) == len(AWKWARD) and sum(r.n_tokens for r in rows) == rows[0].train_tokens
    assert all(r.n_known == r.n_tokens and r.score <= 0 and not r.held_out for r in rows)
    nothing = katz.score_texts(docs, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score == r.base_score == 0 for r in nothing)
    assert katz.score_texts(none_left(docs), F.lit(True)).count() == 0


# Components

def test_components(spark):
    r = random.Random(4)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(0, k) for k in range(1000, 1200)] + [(5, 5), (6, 7), (6, 7)]
    frame = spark.createDataFrame(links + [(None, 3)], "a long, b long").repartition(9)
    got = {x.node: x.component for x in components(frame).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: c for n, c in brute.components(nodes, links).items()}
    assert components(none_left(frame)).count() == 0
    assert list(forest(np.arange(5), np.array([[3, 4], [4, 1]]))) == [0, 1, 2, 1, 1]


# Near-duplicate texts

def sets_of(rows, size):
    out = []
    for i, t in rows:
        w = brute.words(t)
        out.append((i, {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()))
    return out


def plain_near(rows, size, percent):
    sets = sets_of(rows, size)
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1:] if x and y and 100 * len(x & y) >= percent * len(x | y)]
    return brute.components({i for i, _ in sets}, links)


@pytest.mark.parametrize("size,percent,block", [(3, 85, 512), (5, 80, 3)])
def test_near_duplicates_of_chained_families(spark, monkeypatch, size, percent, block):
    monkeypatch.setattr(near_text, "MEMBERS_PER_BLOCK", block)
    r, rows = random.Random(size), []
    for family in range(12):
        words = [f"f{family}w{r.randrange(60)}" for _ in range(80)]
        for _ in range(14):
            for _ in range(r.choice((0, 1, 1, 2, 6))):
                words[r.randrange(len(words))] = f"n{r.randrange(10 ** 6)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + k, f"Shared words that stand in many short texts {k}") for k in range(30)]
    got = near_text.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), size, percent).collect()
    expected = plain_near(rows, size, percent)
    assert {x.doc_id: x.component_id for x in got} == expected and all(x.kept == (x.doc_id == x.component_id) for x in got)
    assert 20 < len(set(expected.values())) < len(rows)


def test_wide_columns_of_lists_join_when_blocks_are_known(spark, monkeypatch):
    numbered, plain = [], near_text.over_groups
    monkeypatch.setattr(near_text, "over_groups", lambda df, *rest: numbered.append(df.columns) or plain(df, *rest))
    rows = [(i, " ".join(f"w{(i * 7 + k) % 90}" for k in range(40))) for i in range(40)]
    near_text.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).count()
    assert len(numbered) == 1 and not {"sig", "rare", "posted"} & set(numbered[0])


def test_signatures_before_texts_without_words_keep_their_length(spark):
    rows = [(1, "a b c d"), (2, None), (3, " "), (4, "e f g"), (5, "")]
    signed = near_text.signatures(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 3, 32).collect()
    assert {r.doc_id: r.sig and len(r.sig) for r in signed} == {1: 32, 2: None, 3: None, 4: 32, 5: None}


def test_signatures_and_their_exploded_keys_are_never_broadcast(spark, tmp_path):
    # Spark takes an array for one element, and a row for as many rows as an explode makes of it.
    rows = [(i, 9, [(i + c) % 50 if c % 2 else i for c in range(32)]) for i in range(300)]
    spark.createDataFrame(rows, "class long, n_shingles long, sig array<int>").write.parquet(str(tmp_path / "classes"))
    classes = spark.read.parquet(str(tmp_path / "classes"))
    pairs = spark.createDataFrame([(0, 50), (0, 1)], "a long, b long")
    for joined, some in ((near_text.postings(classes, 32, 9), 300), (near_text.agreeing(pairs, classes, 9), 1)):
        assert joined.select(joined.columns[0]).distinct().count() >= some
        joined.collect()
        assert "BroadcastExchange" not in joined._jdf.queryExecution().executedPlan().toString()


def test_near_duplicates_of_awkward_texts(docs):
    rows = near_text.near_duplicates(docs, 3, 85).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(AWKWARD) and by[9].component_id == 1 and not by[9].kept and by[1].kept
    assert [(by[k].n_shingles, by[k].component_id, by[k].kept) for k in (2, 3, 4)] == [(0, k, True) for k in (2, 3, 4)]
    assert by[12].n_shingles == 1 and by[None].kept and by[None].component_id is None
    assert near_text.near_duplicates(none_left(docs)).count() == 0


def test_matches_needed_lose_one_in_a_billion():
    for k, s in ((32, 0.85), (32, 0.8), (16, 0.5)):
        t = near_text.least_matches(k, s)
        below = sum(math.comb(k, i) * s ** i * (1 - s) ** (k - i) for i in range(t))
        assert t == 1 or below <= near_text.LOST


# Near-duplicate vectors

def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "LEAST_SHARDS", 3)
    monkeypatch.setattr(near_vectors, "QUERIES_PER_TASK", 300)
    g = np.random.default_rng(8)
    base = g.normal(size=(400, 24))
    group = base[0] + 0.05 * g.normal(size=(150, 24))
    chain = [base[1]]
    for _ in range(20):
        chain.append(chain[-1] + 0.22 * g.normal(size=24))
    x = np.concatenate([base, group, chain, base[5:8], base[9:10] * 1e200]).astype(np.float64)
    rows = [(i, v.tolist(), "mine") for i, v in enumerate(x)]
    odd = [(9000, None), (9001, [0.0] * 24), (9002, [float("nan")] * 24), (9003, [None] + [1.0] * 23), (9004, [float("inf")] * 24), (9005, []),
           (9006, [1.0, 2.0]), (9007, [2.0, 4.0]), (None, x[0].tolist())]
    frame = spark.createDataFrame(rows + [(i, v, "mine") for i, v in odd], "vec_id long, embedding array<double>, class string").repartition(3)
    got = {r.vec_id: r for r in near_vectors.near_vectors(frame).collect()}
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    expected = brute.components(range(len(x)), list(zip(*np.nonzero(near))))
    assert {i: got[i].n_links for i in range(len(x))} == {i: int(n) for i, n in enumerate(near.sum(axis=1))}
    assert {i: got[i].component_id for i in range(len(x))} == expected
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in range(9000, 9006))
    assert got[9007].component_id == 9006 and got[9006].n_links == 1
    assert got[None].n_links == 0 and got[None].component_id is None and got[None].kept
    assert near_vectors.near_vectors(none_left(frame)).count() == 0


def test_graphs_travel_as_narrow_rows_once_for_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "LEAST_SHARDS", 2)
    monkeypatch.setattr(near_vectors, "QUERIES_PER_TASK", 50)
    monkeypatch.setattr(near_vectors, "LEAST_TASKS", 2)
    written, plain = {}, near_vectors.materialise
    monkeypatch.setattr(near_vectors, "materialise", lambda df, label: written.setdefault(label, plain(df, label)))
    g = np.random.default_rng(4)
    x = g.normal(size=(300, 8)).astype(np.float32)
    x[200:] = x[:100] * 2 + 1e-4
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.component_id for r in near_vectors.near_vectors(frame).collect()}
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float64)
    assert got == brute.components(range(300), list(zip(*np.nonzero(unit @ unit.T >= 0.95))))
    # A row for each node, of one vector in its own precision and a few links: never a shard in one value.
    assert written["index"].count() == 300 and written["index"].schema["vector"].dataType.simpleString() == "array<float>"
    assert written["index"].selectExpr("max(size(links))", "max(size(vector))").first()[0] <= 3 * near_vectors.NEIGHBOURS


def test_blocks_of_queries_stream_past_a_graph_however_batches_are_cut(spark):
    g = np.random.default_rng(5)
    x = g.normal(size=(40, 6))
    nodes = pa.table({"dim": pa.array([6] * 40, pa.int32()), "shard": pa.array([0] * 20 + [1] * 20, pa.int32()), "class": pa.array(range(40), pa.int64()),
                      "copies": pa.array([2] * 40, pa.int64()), "vector": pa.array(list(x))})
    told = []
    for cut in (1, 7, 100):
        index = pa.Table.from_batches(list(near_vectors.build_index(iter(nodes.to_batches(max_chunksize=cut)))))
        assert index.column_names[-2:] == ["node", "links"] and index["node"].to_pylist() == [*range(20)] * 2
        rows = []
        for shard, part in ((0, index.slice(0, 20)), (1, index.slice(20, 20)), (2, index.slice(0, 0))):  # no graph for shard 2
            for block, some in ((-1, part), (0, nodes.slice(0, 25)), (3, nodes.slice(25, 15))):
                rows += [dict(r, shard=shard, slice=0, block=block) for r in some.to_pylist()]
        names = ["dim", "shard", "slice", "block", "class", "copies", "vector", "node", "links"]
        sorted_rows = pa.Table.from_pylist([{k: r.get(k) for k in names} for r in rows], pa.schema(
            [(n, index.schema.field(n).type if n in index.column_names else pa.int32()) for n in names]))
        out = pa.Table.from_batches(list(near_vectors.search_index(0.999)(iter(sorted_rows.to_batches(max_chunksize=cut)))))
        told.append(sorted(r for r in zip(*(c.to_pylist() for c in out.columns)) if r[2]))
    assert told[0] == told[1] == told[2] == [(i, i, 2) for i in range(40)]


# Chat formatting

def test_chats(spark):
    turns = [("user", "hi"), ("assistant", "hello"), ("user", None), ("assistant", "")]
    rows = [(1, k, *t) for k, t in enumerate(turns[:2])] + [(2, k, *t) for k, t in enumerate(turns)] + [(3, k, *t) for k, t in enumerate(turns)]
    rows += [(4, 0, "user", "hi"), (5, 0, "user", "hi"), (5, 1, "assistant", "else"), (6, 0, "user", ""), (7, 0, "user", None), (8, 0, None, "hi"),
             (9, 1, "user", "tie"), (9, 1, "user", "tie"), (10, None, "user", "first"), (10, 0, "user", "then"), (None, 0, "user", "no one")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("mine")).withColumn("h1", F.lit(0))
    for size in (512, 1):
        got = chat.format_chats(frame.repartition(5), turns_per_part=size).orderBy("conv_id", "part").collect()
        texts, copies = defaultdict(str), {}
        for r in got:
            texts[r.conv_id] += r.rendered
            copies[r.conv_id] = (r.n_turns, r.copies)
        assert set(texts) == {2, 5, 6, 7, 8, 9, 10}
        assert copies[2] == (4, 2) and copies[9] == (2, 1)
        assert texts[2] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
        assert texts[10].index("first") < texts[10].index("then") and texts[8].startswith("<|im_start|>user\nhi")
    assert chat.format_chats(none_left(frame)).count() == 0


def test_chats_run_no_python(spark, folder):
    plan = chat.format_chats(spark.read.parquet(f"{folder}/conversations.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("operate", [
    quality.judge, lambda docs: language.identify(docs, language.Model({"en": b"some words of it"}, 0.1)),
    near_text.near_duplicates, lambda docs: packing.pack(docs, FILE)], ids=["judge", "identify", "near_duplicates", "pack"])
def test_whole_texts_reach_python_in_small_batches(spark, operate):
    for limit in (BATCH_LIMIT, READ_LIMIT):
        spark.conf.unset(limit)
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 400).alias("text"), F.lit("a").alias("source"))
    operate(docs)

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "bytes"])

    found = docs.mapInArrow(held, "n long, bytes long").collect()
    assert sum(r["n"] for r in found) == 3000 and max(r["bytes"] for r in found) < 1.1 * BATCH_BYTES
    assert spark.conf.get(READ_LIMIT) == str(READ_ROWS)
    spark.conf.set(BATCH_LIMIT, "1m")
    operate(docs)
    assert spark.conf.get(BATCH_LIMIT) == "1m"  # who uses the session decides
    spark.conf.unset(BATCH_LIMIT)


# Pipeline

def test_pipeline_equals_its_plain_form(spark):
    import corpus_pipeline
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = docs.collect()
    measured = {r.doc_id: plain_measure(r.text) for r in rows}
    failed = {i: m[0] < 10 or 100 * m[4] > 20 * m[0] for i, m in measured.items()}
    hosts = defaultdict(list)
    for r in rows:
        hosts[r.source].append(failed[r.doc_id])
    mean, weight = quality.beta_prior(len(rows), sum(failed.values()), len(hosts), sum(sum(h) ** 2 / len(h) for h in hosts.values()))
    bad = {h for h, f in hosts.items() if (sum(f) + mean * weight) / (len(f) + weight) > quality.MAX_HOST_RATE}
    left = [r for r in rows if not failed[r.doc_id] and r.source not in bad]
    assert sorted(r.doc_id for r in corpus_pipeline.good_documents(spark, docs, folder).collect()) == sorted(r.doc_id for r in left)

    good = spark.createDataFrame(left, docs.schema)
    known = corpus_pipeline.known_language(spark, good, folder)
    assert known.columns == docs.columns and known.count() >= 0.98 * len(left)
    texts = [(r.doc_id, r.text) for r in known.collect()]
    heads = plain_near(texts, 5, 80)
    kept = sorted(i for i, c in heads.items() if i == c)
    one = corpus_pipeline.one_of_each(spark, known, folder)
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == kept

    lengths = Counter()
    for r in corpus_pipeline.run(spark, folder).collect():
        lengths[r.doc_id] += r.length
    assert lengths == {i: len(ids_of(FILE, t)) + 1 for i, t in texts if i in set(kept)}


def test_pipeline_of_awkward_rows(spark, docs):
    import corpus_pipeline
    one = corpus_pipeline.one_of_each(spark, docs, "")
    ids = [r.doc_id for r in one.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5, 6, 7, 8, 11, 12] and None in ids and one.columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none_left(docs), "").count() == 0


def test_most_rows_of_the_pipeline_meet_no_verdict_in_a_shuffle(spark):
    import corpus_pipeline
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(50)] + [(99, " ".join(f"w3x{k}" for k in range(30)))]
    one = corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
    stay, *_ = one._jdf.queryExecution().optimizedPlan().toString().split("\n+- ")[0].split("\n:- ")[1:]
    assert stay.count("Join ") == 1 and "broadcast" in stay
    assert sorted(r.doc_id for r in one.collect()) == list(range(50))


def test_pipeline_keeps_one_row_per_group_of_repeated_and_null_ids(spark):
    import corpus_pipeline
    words = [[f"{t}{i}" for i in range(60)] for t in "abcd"]
    a, b, c, d = (" ".join(w) for w in words)
    near = [" ".join([*words[0][:-1], f"other{i}"]) for i in range(3)]
    rows = [(3, a), (5, near[0]), (5, near[0]), (5, b), (9, near[1]), (2, c), (2, c + " x"), (2, c), (None, d), (None, d), (None, near[2]), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, docs, "").collect())
    of_two = [kept.pop((2, t), 0) for t in (c, c + " x")]
    assert sum(of_two) == 1 and kept == {(3, a): 1, (5, b): 1, (None, d): 1, (None, None): 2}
