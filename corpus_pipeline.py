"""From raw documents to packed training sequences: quality rules, language, near-duplicates, packing.

``STAGES`` lists the steps; each takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from functools import reduce

import public_tokenizers as vocabularies
from pyspark.sql import DataFrame, SparkSession, functions as F

from soundcheck.llm import language, near_text, packing, quality
from soundcheck.plans.sizing import may_be_among
from soundcheck.session import materialise


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host is not rejected."""
    return quality.judge(docs).where("kept").select("row.*")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart; learned from the labels that these documents carry."""
    return language.identify(docs, language.learn(docs)).where("accepted").select("row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five-word shingles, similarity 0.8), that with the smallest id.

    Rows are told apart by id and text, so repeated ids are judged text by text. Among equal ids the smallest
    hash of the text stays, and a null id only if the group has no other. Texts without a word are in no group:
    of those that repeat an id and a text one stays, and all whose id is null. Most rows are the only one of their key
    and stay; they are told by a map of the other keys, so only the rest meets the verdicts in a shuffle.
    """
    key = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.unhex(F.md5(F.col("text"))))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), key.alias("_key"), F.col("text").alias("_text"))
    near = near_text.near_duplicates(keyed, size=5, percent=80, id_col="_key", text_col="_text")
    judged = materialise(near.groupBy(F.col("doc_id").alias("_judged")).agg(
        F.count(F.lit(1)).alias("_all"), F.count_if("kept").alias("_rows"), F.max("n_shingles").alias("_shingles")).where("_all > 1 OR _rows = 0"), "judged")
    marked = may_be_among(keyed, "_key", judged.select("_judged"))
    found = marked.where("_maybe").join(judged, F.col("_key") == F.col("_judged"), "left").where("_rows IS NULL OR _rows > 0")
    single = F.col("_rows").isNull() | (F.col("_rows") == 1) | ((F.col("_shingles") == 0) & F.col("_row.doc_id").isNull())
    return reduce(DataFrame.union, [rows.select("_row.*") for rows in (
        marked.where("NOT _maybe"), found.where(single), found.where(~single).dropDuplicates(["_key"]))])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabularies.path("byte_bpe_50k.json"))


STAGES = [("quality rules", good_documents), ("language ID", known_language), ("MinHash near-dedup", one_of_each),
          ("best-fit packing", packed)]

#: Compression and subword ids have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return reduce(lambda rows, stage: materialise(stage[1](spark, rows, sf_dir), "pipeline"), STAGES, docs)
