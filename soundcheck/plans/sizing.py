"""Broadcasts are hinted only after counting the side, and only up to a fixed number of rows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, functions as F

from soundcheck.session import materialise

BROADCAST_ROWS = 100_000
MAP_BITS = 24  # of the map that `may_be_among` broadcasts: 2 ** 18 rows at most


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads no more than one row beyond that."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when the counted side is small; otherwise leave a shuffle join to AQE."""
    return F.broadcast(df) if fits(df, max_rows) else df


def never_broadcast(df: DataFrame) -> DataFrame:
    """``df``, hinted so that a join with it sorts and merges two shuffled sides, whatever sizes Spark assumes for them.

    Spark takes a written table for as large as its files, takes the share of the columns that are read, with an array
    for one element, and leaves that as it is when an explode makes many rows of each. A table that is ten or a
    hundred times as large in memory is then sent to the driver.
    """
    return df.hint("merge")


def may_be_among(df: DataFrame, key: str, keys: DataFrame, name: str = "_maybe") -> DataFrame:
    """``df`` with the column ``name``: true for every row whose ``key`` is among ``keys`` (one column), and for few others.

    Only a map of bits goes to the tasks, of one size whatever the number of keys, so wide rows that an exact join would
    drop, or need not see, are not shuffled for it. A null key hashes like any other.
    """
    def place(hashed: Column) -> tuple[Column, Column]:
        at = hashed.bitwiseAND(F.lit((1 << MAP_BITS) - 1).cast("long"))
        return F.shiftright(at, 6), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63).cast("long")).cast("int"))

    word, bit = place(F.xxhash64(keys.columns[0]))
    bits = keys.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    word, bit = place(F.xxhash64(key))
    return df.withColumn("_at", word).join(F.broadcast(bits), F.col("_at") == F.col("_word"), "left").withColumn(
        name, F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_at", "_word", "_bits")


def hold(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Compute a table that is used several times once: on the driver while it is small, else written."""
    spark = df.sparkSession
    rows = df.limit(max_rows + 1).repartition(1).collect()
    if len(rows) <= max_rows:
        return spark.createDataFrame(rows, df.schema)
    return materialise(df, "held")


def batches(df: DataFrame, size: int, ordered: bool = False) -> Iterator[list[Row]]:
    """Stream a table of *definitions* to the driver, ``size`` rows at a time.

    One partition means one job; ``ordered`` keeps the partitions of a sorted table instead, and reads
    them only as far as asked.
    """
    batch: list[Row] = []
    for row in (df if ordered else df.repartition(1)).toLocalIterator():
        batch.append(row)
        if len(batch) == size:
            yield batch
            batch = []
    if batch:
        yield batch
