"""Quality rules with host verdicts.

Each text is measured once. Rule failures are then counted per host, every host's failure rate is
shrunk towards the corpus rate with a beta prior that is itself estimated from all hosts, and the
verdict of a host goes back to its documents. Counting is combined map-side, so a host that holds a
third of all documents is one row per task in the shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from soundcheck.session import in_small_batches, materialise

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"  # [\x20\x09-\x0D], as bytes.split() takes them
WINDOW = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20
MAX_HOST_RATE = 0.5


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """The counts of one text: words, code points in words, symbols, repeated lines, words in repeated windows."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return (len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that stand in a window found at least twice, each counted once."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    hashes = ids[:n].copy()
    for i in range(1, window):
        hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[i:n + i]
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + window, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def measures(text: Column) -> Column:
    names = [c.split()[0] for c in MEASURES.split(", ")]

    @F.pandas_udf(MEASURES)
    def each(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t) for t in texts], columns=names, dtype="int64")

    return each(text)


def host_rates(hosts: DataFrame) -> DataFrame:
    """Shrunk failure rates of ``hosts`` (host, n, failed): adds ``rate``.

    The prior is fitted by moments. With K failures in N documents of H hosts, the mean is K/N; the
    share rho of variance between hosts follows from sum(n * (k/n - K/N)^2), whose expectation is
    m(1-m)(H + (N-H) rho). The beta prior then weighs 1/rho - 1 documents. Without any spread
    between hosts (or with one host) every rate is shrunk to the corpus rate.
    """
    sums = hosts.agg(F.sum("n").alias("N"), F.sum("failed").alias("K"), F.count(F.lit(1)).alias("H"),
                     F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("Q")).first()  # four numbers
    mean, weight = beta_prior(sums["N"] or 0, sums["K"] or 0, sums["H"], sums["Q"] or 0.0)
    return hosts.withColumn("rate", (F.col("failed") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight)))


def beta_prior(n: int, failed: int, hosts: int, squares: float) -> tuple[float, float]:
    """(mean, weight in documents) of the prior; ``squares`` is the sum of failed * failed / n over the hosts."""
    if not n:
        return 0.0, 1.0
    mean, rho = failed / n, 0.0
    if 0 < mean < 1 and n > hosts:
        rho = ((squares - failed * failed / n) / (mean * (1 - mean)) - hosts) / (n - hosts)
    return mean, 1 / min(max(rho, 1e-6), 1 - 1e-6) - 1


def judge(docs: DataFrame, text_col: str = "text", host_col: str = "source", keep: list[str] | None = None,
          max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per input row: ``row`` (struct of the columns in ``keep``, by default all), the measures, base_failed, host_rejected, kept.

    A null text is an empty one: no words, so it fails the base rules. An empty table gives no rows.
    Rows without a host are judged on their own text alone. Repeated rows count as often as they
    occur. The columns of ``docs`` stay inside ``row``, so their names never clash.
    """
    measured = materialise(in_small_batches(docs).select(
        F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), F.col(host_col).cast("string").alias("host"),
        measures(F.col(text_col)).alias("m")).select("row", "host", "m.*"), "quality")
    judged = measured.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                                 | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))
    hosts = judged.where("host IS NOT NULL").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("base_failed").alias("failed"))
    verdicts = host_rates(hosts).select("host", (F.col("rate") > max_host_rate).alias("host_rejected"))
    return (judged.join(verdicts, "host", "left")
            .withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
            .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")).drop("host"))
