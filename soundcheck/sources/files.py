"""Inventory of a file tree: mounted, in an object store, or on any file system that Spark reads."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from soundcheck.session import materialise

LISTED = "path string, size bigint, mtime_us bigint, is_dir boolean, error string"
LIST_BATCH = 10_000
CHUNK_BYTES = 8 << 20
WHOLE_BYTES = 1 << 30  # Spark's reader hands a file over as one value, so longer ones are not hashed that way
STORES = ("s3", "gs", "gcs", "abfs", "abfss")  # schemes that tasks open by themselves


def _scan(folder: str) -> Iterator[tuple]:
    """(path, size, time, is folder) of what lies in a mounted folder; links are told as they are."""
    with os.scandir(folder) as it:
        for e in it:
            stat = e.stat(follow_symlinks=False)
            yield e.path, stat.st_size, stat.st_mtime_ns // 1000, e.is_dir(follow_symlinks=False)


def _select(folder: str) -> Iterator[tuple]:
    """The same of a folder in a store."""
    from pyarrow import fs
    store, path = fs.FileSystem.from_uri(folder)
    scheme = urlparse(folder).scheme
    for e in store.get_file_info(fs.FileSelector(path)):
        yield f"{scheme}://{e.path}", e.size or 0, (e.mtime_ns or 0) // 1000, e.type == fs.FileType.Directory


def _list(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["path", "size", "mtime_us", "is_dir", "error"]
    for pdf in it:
        for folder in pdf["path"]:
            rows = []
            try:
                for entry in (_select if "://" in folder else _scan)(folder):
                    rows.append((*entry, None))
                    if len(rows) == LIST_BATCH:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            except OSError as error:  # the folder is told once more, with what is wrong; its entries so far stay
                rows.append((folder, 0, 0, None, str(error)))
            if rows:
                yield pd.DataFrame(rows, columns=columns)


@F.pandas_udf(T.StructType([T.StructField("sha256", T.StringType()), T.StructField("error", T.StringType())]))
def _hashed(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    import hashlib

    def digest(path):
        if path is None:
            return None, None
        h = hashlib.sha256()
        try:
            if "://" in path:
                from pyarrow import fs
                store, where = fs.FileSystem.from_uri(path)
                source = store.open_input_stream(where)
            else:
                source = open(path, "rb")
            with source as f:
                while chunk := f.read(CHUNK_BYTES):
                    h.update(chunk)
        except OSError as error:
            return None, str(error)
        return h.hexdigest(), None

    for paths in it:
        yield pd.DataFrame([digest(p) for p in paths], columns=["sha256", "error"], dtype=object)


def file_inventory(spark: SparkSession, root: str, with_hash: bool = False) -> DataFrame:
    """path (relative), dir, name, size, mtime, is_dir, sha256, error of everything below ``root``.

    A plain path or ``file:`` URI is a mounted tree and a URI of ``STORES`` a tree in a store: folders are listed
    in tasks, level by level, and files hashed in chunks, so neither a large folder nor a large file has to
    fit in memory; hidden names count. A URI of any other scheme is listed and read by Spark itself, which leaves out names
    that begin with a dot or an underscore and takes files up to ``WHOLE_BYTES`` whole. A folder that cannot be listed and a
    file that cannot be read have an ``error``; only a missing root raises.
    """
    parsed = urlparse(root)
    if parsed.scheme == "file":
        root = unquote(parsed.path)
    elif "://" in root and parsed.scheme not in STORES:
        return _by_spark(spark, root.rstrip("/"), with_hash)
    if "://" not in root and not os.path.isdir(root):
        raise NotADirectoryError(root)
    root = root.rstrip("/") or "/"
    frontier, levels = spark.createDataFrame([(root,)], "path string"), []
    while True:
        level = materialise(frontier.repartition("path").mapInPandas(_list, LISTED), "inventory")
        levels.append(level.filter("error IS NULL OR is_dir IS NULL"))
        frontier = level.filter("is_dir").select("path")
        if frontier.isEmpty():
            break
    listed = reduce(DataFrame.unionByName, levels)
    broken = listed.filter("is_dir IS NULL").select(F.col("path").alias("_p"), F.col("error").alias("_error"))
    found = listed.filter("is_dir IS NOT NULL").drop("error").join(broken, F.col("path") == F.col("_p"), "left")
    found = found.drop("_p").unionByName(broken.filter(F.col("_p") == root).select(  # nothing else tells of the root
        F.col("_p").alias("path"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime_us"), F.lit(True).alias("is_dir"), "_error"))
    if with_hash:
        found = found.repartition("path").withColumn("_h", _hashed(F.when(~F.col("is_dir"), F.col("path"))))
        found = found.withColumns({"sha256": F.col("_h.sha256"), "error": F.coalesce("_error", "_h.error")})
    else:
        found = found.withColumns({"sha256": F.lit(None).cast("string"), "error": F.col("_error")})
    return _shown(found.withColumn("mtime", F.timestamp_micros("mtime_us")), root)


def _shown(found: DataFrame, root: str) -> DataFrame:
    relative = F.expr(f"substr(path, {len(root) + 2 if root != '/' else 2})")
    return found.withColumn("path", relative).select("path", _parent("path"), F.substring_index("path", "/", -1).alias("name"), "size", "mtime",
                                                     "is_dir", "sha256", "error")


def _parent(path: str) -> Column:
    return F.when(F.contains(F.col(path), F.lit("/")), F.regexp_replace(path, "/[^/]*\\z", "")).otherwise(F.lit("")).alias("dir")


def _by_spark(spark: SparkSession, root: str, with_hash: bool) -> DataFrame:
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, ignoreCorruptFiles=True).load(root)
    short = F.col("length") <= WHOLE_BYTES
    held = materialise(files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.lit(False).alias("is_dir"),
                                    F.when(short, F.sha2("content", 256)).alias("sha256") if with_hash else F.lit(None).cast("string").alias("sha256"),
                                    F.when(~short, F.lit("too large to be read whole")).alias("error") if with_hash else F.lit(None).cast("string").alias("error")),
                       "inventory")
    below = F.slice(F.split(F.expr(f"substr(path, {len(root) + 2})"), "/"), 1, F.size(F.split(F.expr(f"substr(path, {len(root) + 2})"), "/")) - 1)
    folders = held.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(below)), lambda i: F.array_join(F.slice(below, 1, i), "/"))).alias("p")).filter(
        "p <> ''").distinct().select(F.concat(F.lit(root + "/"), "p").alias("path"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("timestamp").alias("mtime"),
                                     F.lit(True).alias("is_dir"), F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("string").alias("error"))
    return _shown(held.unionByName(folders), root)
