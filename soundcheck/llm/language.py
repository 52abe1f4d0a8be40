"""Language identification by compression.

For every language a raw-content zstandard dictionary is cut from a bounded sample of labelled
training texts. A text is encoded block by block with each dictionary and with none; the language whose
dictionary gives the fewest bytes wins. Its margin is what the next best encoding, or the one without
a dictionary, is longer, as a share of the best, so that it does not grow with the text. A margin
under the bar, which is fitted to the training texts, is a rejection.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from soundcheck.session import in_small_batches

#: The sample that is learned from: at most so many distinct texts per language, so many bytes of each.
TEXTS_PER_LANGUAGE = 96
BYTES_PER_TEXT = 1024
BLOCK = 4096  # bytes encoded at a time, so that the dictionary matters as much at the end of a long text
LEVEL = 9
MIN_SCORE = 0.5  # the score of a margin at the bar

#: A text has up to so many blocks even if it is short, each of so many bytes at least, so that mixtures show.
PARTS = 4
BYTES_PER_PART = 64
MIXED = 0.25  # a text of which this share is clearly another language's is never accepted

#: The bar lies between the margins of texts without a language and those of texts not learned from.
FOLDS = 3
LEAST_TEXTS = 12  # a language with fewer is not measured
LOST = 0.01  # so many of the texts with a language may lie under the bar
DEFAULT_BAR = 0.08


NOT_LETTERS = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    """Lower-case letters with single blanks between runs, so that layout and case do not count."""
    return NOT_LETTERS.sub(" ", text.lower())


def held_out(id_col: str = "doc_id", folds: int = 3) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 1


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", texts: int = TEXTS_PER_LANGUAGE,
          bytes_per_text: int = BYTES_PER_TEXT) -> dict[str, bytes]:
    """Language -> dictionary content, from the sample with the smallest text hashes.

    The rows that reach the driver are bounded by the parameters and the number of languages. Rows
    with a null language or without a letter are not learned from; equal texts count once. No rows
    give an empty model. Text hashes are thinned by each language's count before the ranking, so
    that no language is sorted as a whole. The model carries the bar that these texts give (``fit_bar``).
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"),
        F.xxhash64(F.col(text_col)).alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    # One row in every `keep` still leaves four times the sample, unless most texts are copies: then all are ranked.
    for spare in (4, 0):
        step = F.coalesce(*[F.when(F.col("lang") == k, F.lit(max(1, n // (spare * texts)) if spare else 1))
                            for k, n in counts.items()]) if counts else F.lit(1)
        thin = rows.where(F.pmod("h", step) == 0).groupBy("lang", "h").agg(F.min("text").alias("text"))
        ranked = thin.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(
            F.col("k") <= texts).select("lang", "k", F.substring("text", 1, bytes_per_text).alias("text")).collect()
        found = {k: sorted((r["k"], r["text"]) for r in ranked if r["lang"] == k) for k in counts}
        if all(len(found[k]) >= min(texts, n) // 2 for k, n in counts.items()):
            break
    samples = {k: [plain(t).encode()[:bytes_per_text] for _, t in v] for k, v in sorted(found.items()) if v}
    return Model({k: b" ".join(v) for k, v in samples.items()}, fit_bar(samples))


class Model(dict):
    """Language -> dictionary content, and the bar for margins."""

    def __init__(self, contents: dict[str, bytes], bar: float):
        super().__init__(contents)
        self.bar = bar


def encoders(contents: list[bytes]) -> list[zstandard.ZstdCompressor]:
    """One for each content, and last the one without a dictionary."""
    made = []
    for content in contents:
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=False,
                                             write_content_size=False, write_dict_id=False))
    return [*made, zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)]


def sizes(made: list[zstandard.ZstdCompressor], data: bytes) -> list[list[int]]:
    """For each block of ``data``, the bytes that each encoder needs."""
    n = max(-(-len(data) // BLOCK), min(PARTS, len(data) // BYTES_PER_PART), 1)
    step = max(1, -(-len(data) // n))
    return [[len(e.compress(data[i:i + step])) for e in made] for i in range(0, max(1, len(data)), step)]


def margin(found: list[list[int]], bar: float) -> tuple[int, float]:
    """The language with the smallest encoding (the first by name on a tie) and how far the others are behind.

    Languages are in order of their names. Blocks that another language encodes better by more than
    the bar count against the winner, and by half those that the winner's dictionary does not shorten by
    as much, down to a margin of 0 at a share of ``MIXED``.
    """
    totals = [sum(column) for column in zip(*found)]
    best = min(range(len(totals) - 1), key=lambda i: totals[i])
    behind = min(s for i, s in enumerate(totals) if i != best) / totals[best] - 1
    others = sum(b[-1] * (1 if b[best] > (1 + bar) * min(b[:-1]) else 0.5 * (b[-1] < (1 + bar) * b[best])) for b in found) / totals[-1]
    return best, max(0.0, behind) * max(0.0, 1 - others / MIXED)


def fit_bar(samples: dict[str, list[bytes]]) -> float:
    """The bar from the training texts of each language.

    Each fold's texts are measured with dictionaries from the other folds. What has no language is the
    same texts with every letter replaced by a random one, and with every other word taken from a text of
    another language (one of random letters, if there is no other). The bar is halfway between the highest of these margins and the one that ``LOST`` of
    the others are under, or the latter if it is lower.
    """
    usable = {k: v for k, v in samples.items() if len(v) >= LEAST_TEXTS}
    draw = random.Random(0)
    right, noise = [], []
    for fold in range(FOLDS if usable else 0):
        made = encoders([b" ".join(t for i, t in enumerate(v) if i % FOLDS != fold or k not in usable) for k, v in samples.items()])
        languages = list(samples)
        for k, v in usable.items():
            for text in v[fold::FOLDS]:
                best, lead = margin(sizes(made, text), DEFAULT_BAR)
                right.append(lead if languages[best] == k else 0.0)
                drawn = bytes(32 if c == 32 else draw.randrange(97, 123) for c in text)
                other = draw.choice(samples[draw.choice([x for x in languages if x != k])]) if len(languages) > 1 else drawn
                woven = b" ".join(w for pair in zip(text.split()[::2], other.split()[1::2]) for w in pair)
                noise += [margin(sizes(made, x), DEFAULT_BAR)[1] for x in (drawn, woven)]
    if not right:
        return DEFAULT_BAR
    least = sorted(x for x in right if x > 0)
    if not least:
        return DEFAULT_BAR
    low = least[int(LOST * len(least))]
    return min(low, (low + max(noise)) / 2)


def predictor(model: dict[str, bytes]):
    """A column function text -> struct(lang_pred, score); ``und`` and 0 without letters or without a model.

    The score is margin / (margin + bar): 0 on a tie, ``MIN_SCORE`` at the bar.
    """
    languages = sorted(model)
    contents = [model[k] for k in languages]
    bar = getattr(model, "bar", DEFAULT_BAR)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        made = encoders(contents)

        def one(text: str | None) -> tuple[str, float]:
            if not (text and languages and any(map(str.isalpha, text))):
                return "und", 0.0
            best, lead = margin(sizes(made, plain(text).encode()), bar)
            return languages[best], lead / (lead + bar)

        for texts in batches:
            yield pd.DataFrame([one(t) for t in texts], columns=["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: dict[str, bytes], text_col: str = "text", keep: list[str] | None = None,
             min_score: float = MIN_SCORE) -> DataFrame:
    """One row per input row: ``row`` (struct of the columns in ``keep``, by default all), lang_pred, score, accepted.

    Null, empty and letterless texts are ``und`` with score 0 and never accepted; so is every text
    when the model is empty. Ties go to the language that is first by name and are never accepted.
    Texts of any length are encoded whole. An empty table gives no rows.
    """
    found = in_small_batches(docs).select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"),
                        predictor(model)(F.col(text_col)).alias("found"))
    return found.select("row", "found.*").withColumn("accepted", (F.col("score") > 0) & (F.col("score") >= min_score))
