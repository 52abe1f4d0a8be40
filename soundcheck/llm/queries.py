"""Registered queries: each operator of this subpackage over its whole table, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op4_language_id")
def language_id(spark, folder):
    from soundcheck.llm.language import held_out, identify, learn
    docs = table(spark, folder, "documents")
    model = learn(docs.where(~held_out()))
    return identify(docs, model, keep=["doc_id"]).select("row.doc_id", held_out("row.doc_id").alias("held_out"), "lang_pred", "score", "accepted")


MEASURED_SQL = r"""
d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i:i + 4]) AS times
            FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 3, 1))) AS i FROM d)),
repeats AS (SELECT rid, count(DISTINCT i + k) AS n FROM windows, range(0, 5) r(k) WHERE times > 1 GROUP BY rid),
lines AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
measured AS (SELECT rid, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words
    FROM d JOIN lines USING (rid) LEFT JOIN repeats USING (rid)),
based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS f FROM based WHERE source IS NOT NULL GROUP BY source),
sums AS (SELECT sum(n) AS nn, sum(f) AS k, count(*) AS h, sum(f * f / n) AS q, sum(f) / sum(n) AS m FROM hosts),
rho AS (SELECT m, CASE WHEN m > 0 AND m < 1 AND nn > h THEN ((q - k * k / nn) / (m * (1 - m)) - h) / (nn - h) ELSE 0 END AS r FROM sums),
prior AS (SELECT m, 1 / least(greatest(r, 1e-6), 1 - 1e-6) - 1 AS w FROM rho),
verdicts AS (SELECT source, (f + m * w) / (n + w) > 0.5 AS host_rejected FROM hosts, prior)
"""


@query("op5_quality_rules", f"""WITH {MEASURED_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       coalesce(host_rejected, false) AS host_rejected, NOT base_failed AND NOT coalesce(host_rejected, false) AS kept
FROM based LEFT JOIN verdicts USING (source)""")
def quality_rules(spark, folder):
    from soundcheck.llm.quality import judge
    judged = judge(table(spark, folder, "documents"), keep=["doc_id"])
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "host_rejected", "kept")


@query("op8_chat_formatting", """
WITH convs AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns
               FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
     distinct_convs AS (SELECT turns, len(turns) AS n, min(conv_id) AS conv_id, count(*) AS copies FROM convs GROUP BY turns),
     maximal AS (SELECT * FROM distinct_convs a WHERE NOT EXISTS (
                 SELECT 1 FROM distinct_convs b WHERE b.n > a.n AND b.turns[1:a.n] = a.turns)),
     parts AS (SELECT *, unnest(range(0, (n - 1) // 512 + 1)) AS part FROM maximal)
SELECT conv_id, CAST(part AS BIGINT) AS part, CAST(n AS BIGINT) AS n_turns, CAST(copies AS BIGINT) AS copies,
       list_aggregate(list_transform(turns[part * 512 + 1:(part + 1) * 512], lambda x: concat('<|im_start|>', coalesce(x['role'], 'user'),
           chr(10), coalesce(x['text'], ''), '<|im_end|>', chr(10))), 'string_agg', '') AS rendered
FROM parts""")
def chat_formatting(spark, folder):
    from soundcheck.llm.chat import format_chats
    return format_chats(table(spark, folder, "conversations"))


@query("op2_byte_bpe")
def byte_bpe(spark, folder):
    import public_tokenizers as vocabularies
    from soundcheck.llm.byte_bpe import decode_ids, encode_texts
    path, pattern = vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN
    encoded = encode_texts(table(spark, folder, "documents"), path, pattern, keep=["doc_id"])
    return encoded.select(
        "row.doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(decode_ids(F.col("ids"), path, pattern), 256).alias("decoded_sha256"))


@query("op6_best_fit_packing")
def best_fit_packing(spark, folder):
    import public_tokenizers as vocabularies
    from soundcheck.llm.packing import pack
    return pack(table(spark, folder, "documents"), vocabularies.path("byte_bpe_50k.json"))


@query("op7_token_counts")
def token_counts(spark, folder):
    import public_tokenizers as vocabularies
    from soundcheck.llm.token_counts import count_tokens
    counted = count_tokens(table(spark, folder, "documents"), vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN,
                           keep=["doc_id"])
    return counted.select("row.doc_id", "n_pretokens", "n_tokens")


@query("op10_token_id_files")
def token_id_files(spark, folder):
    import public_tokenizers as vocabularies
    from soundcheck.llm.id_files import read_ids, write_ids
    return read_ids(write_ids(table(spark, folder, "documents"), vocabularies.path("word_bpe_49k.json")))


@query("op9_minhash_near_dedup", r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [ws]
                ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i:i + 2]) END) AS shingle FROM words),
counts AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b USING (shingle)
           WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN counts a ON a.doc_id = x JOIN counts b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
reach AS (SELECT doc_id AS node, doc_id AS origin FROM documents UNION SELECT y, origin FROM reach JOIN links ON node = x)
SELECT doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(origin) AS component_id, doc_id = min(origin) AS kept
FROM documents LEFT JOIN counts USING (doc_id) JOIN reach ON node = doc_id GROUP BY doc_id""")
def minhash_near_dedup(spark, folder):
    from soundcheck.llm.near_text import near_duplicates
    return near_duplicates(table(spark, folder, "documents"), size=3, percent=85)


@query("op1_hnsw_near_dedup", """
WITH RECURSIVE usable AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
          WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT vec_id AS node, vec_id AS origin FROM embeddings UNION SELECT y, origin FROM reach JOIN links ON node = x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_links, min(origin) AS component_id, vec_id = min(origin) AS kept
FROM embeddings JOIN reach ON node = vec_id LEFT JOIN counts ON x = vec_id GROUP BY vec_id""")
def hnsw_near_dedup(spark, folder):
    from soundcheck.llm.near_vectors import near_vectors
    return near_vectors(table(spark, folder, "embeddings"))


@query("op3_katz_scores")
def katz_scores(spark, folder):
    from soundcheck.llm.katz import learned_from, score_texts
    return score_texts(table(spark, folder, "documents"), learned_from())


@query("op13_periodic_runs")
def periodic_runs(spark, folder):
    from soundcheck.llm.periodic import collapse_runs

    def planted(doc_id, words: list[bytes]) -> list[bytes]:
        """The texts of the task: every tenth document, by a checksum of its id, repeats from some word on."""
        import zlib
        h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
        if h % 10 or not n:
            return words
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]

    found = collapse_runs(table(spark, folder, "documents"), keep=["doc_id"], key_col="doc_id", prepare=planted)
    strongest = F.expr("""aggregate(runs, CAST(NULL AS STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>), (best, r) ->
        CASE WHEN best IS NULL OR r.length * best.period > best.length * r.period THEN r ELSE best END)""")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    return found.select("row.doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), strongest.alias("best"),
                        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_words", "n_runs", "best.*", F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256")


@query("op11_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
sized AS (SELECT page_id, t, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, sha256(t) AS payload_digest FROM p),
firsts AS (SELECT t, min(page_id) AS first FROM sized WHERE payload_bytes >= 100 GROUP BY t)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM sized LEFT JOIN firsts USING (t)""")
def warc(spark, folder):
    from soundcheck.llm.warc import read_warc, resolve, write_warc
    found = resolve(read_warc(spark, write_warc(table(spark, folder, "pages"))))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEARCH_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')"


@query("op12_ranked_search", f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {SEARCH_TERMS} AS ts FROM documents),
sizes AS (SELECT rid, doc_id, CAST(len(ts) AS BIGINT) AS n, ts FROM d WHERE len(ts) > 0),
corpus AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM sizes),
q AS (SELECT DISTINCT qid, item_id, unnest(ts) AS t FROM (SELECT row_number() OVER () AS qid, item_id, {SEARCH_TERMS} AS ts FROM benchmark)),
tfs AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(ts) AS t FROM sizes) WHERE t IN (SELECT t FROM q) GROUP BY rid, t),
ws AS (SELECT t, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM tfs GROUP BY t), corpus),
scored AS (SELECT qid, item_id, rid, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll)))) AS score
           FROM tfs JOIN q USING (t) JOIN ws USING (t) JOIN sizes USING (rid), corpus GROUP BY qid, item_id, rid),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) AS place
           FROM scored JOIN sizes USING (rid) WHERE score > 0)
SELECT item_id, CAST(place AS INT) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE place <= 10""")
def ranked_search(spark, folder):
    from soundcheck.llm.ranked import rank
    return rank(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
