"""Snapshots: folders of tables, loaded so that checks can run against them."""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from soundcheck.functions.text import quote_ident
from soundcheck.operators.registry import Snapshot
from soundcheck.plans.sizing import broadcast_if_small
from soundcheck.schemas import LOAD

FORMATS = ("parquet", "csv", "json", "orc")
CORRUPT = "_corrupt_record"
OPEN_TOGETHER = 8
EMPTY_BYTES = 16 << 20  # a columnar file without rows is smaller


class OperationalError(RuntimeError):
    """The snapshot could not even be tried: a bad argument or a missing root. Not a verdict."""


def list_folder(spark: SparkSession, folder: str) -> list[tuple[str, str, bool]]:
    """(name, path, is_dir) of the visible entries of a folder on any file system Spark reads."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
        raise OperationalError(f"snapshot root not found: {folder}")
    entries = [(s.getPath().getName(), s.getPath().toString(), s.isDirectory()) for s in fs.listStatus(path)]
    return sorted(e for e in entries if not e[0].startswith((".", "_")))


def find_tables(spark: SparkSession, folder: str) -> dict[str, tuple[str, str]]:
    """name -> (format, path): files and folders with a known suffix; a bare folder counts as parquet."""
    found = {}
    for name, path, is_dir in list_folder(spark, folder):
        stem, _, suffix = name.rpartition(".")
        if suffix in FORMATS and stem:
            found[stem] = (suffix, path)
        elif is_dir:
            found[name] = ("parquet", path)
    return found


def read_table(spark: SparkSession, fmt: str, path: str | list[str]) -> DataFrame:
    if fmt == "csv":
        kinds = spark.read.options(header=True, inferSchema=True).csv(path).schema
        if CORRUPT not in kinds.names:  # only a declared column gets the damaged records
            kinds = kinds.add(CORRUPT, "string")
        return spark.read.schema(kinds).options(header=True, columnNameOfCorruptRecord=CORRUPT).csv(path)
    if fmt == "json":
        return spark.read.option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return spark.read.format(fmt).load(path)


def partition_column(spark: SparkSession, df: DataFrame, path: str) -> str | None:
    """The time column by which a folder of ``column=value`` folders is stored in parts."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    try:
        keys = {n.partition("=")[0] for n, _, is_dir in list_folder(spark, path) if is_dir and "=" in n}
    except OperationalError:  # a single file
        return None
    return next((k for k in sorted(keys) if isinstance(kinds.get(k), (T.DateType, T.TimestampType, T.TimestampNTZType))), None)


def load_snapshot(spark: SparkSession, folder: str, name: str | None = None, views: bool = True,
                  ) -> tuple[Snapshot, DataFrame, DataFrame]:
    """(snapshot, load result, rows per table).

    Every table is opened and counted, which reads all footers, so a damaged table shows here: it makes
    the load fail, which is a verdict. A missing root is an ``OperationalError``. Dropped records of text
    formats are a warning.
    """
    started = time.monotonic()
    found = find_tables(spark, folder)

    def open_table(table: str) -> tuple[DataFrame, int, int] | str:
        try:
            df = read_table(spark, *found[table])
            if CORRUPT not in df.columns:
                df.limit(1).collect()
                return df, df.count(), 0
            others = [F.count(F.col(f"`{c}`")) for c in df.columns if c != CORRUPT]
            seen = df.agg(F.count_if(F.col(CORRUPT).isNotNull()), F.count(F.lit(1)), *others).first()
            return df.filter(F.col(CORRUPT).isNull()).drop(CORRUPT), seen[1] - seen[0], seen[0]
        except Exception as error:  # noqa: BLE001 - an unreadable table is a failing load
            return f"{table}: {str(error).strip()}"

    with ThreadPoolExecutor(OPEN_TOGETHER) as pool:  # tables are counted side by side
        opened = dict(zip(found, pool.map(open_table, found)))
    errors = [o for o in opened.values() if isinstance(o, str)]
    good = {t: o for t, o in opened.items() if not isinstance(o, str)}
    tables, counts = {t: o[0] for t, o in good.items()}, [(t, o[1]) for t, o in good.items()]
    dropped = sum(o[2] for o in good.values())
    if views:
        for table, df in tables.items():
            df.createOrReplaceTempView(f"`{table}`")
    if not tables and not errors:
        raise OperationalError(f"no tables in {folder}")
    millis = int((time.monotonic() - started) * 1000)
    warning = f"load ignored {dropped} error(s)" if dropped else None
    load = spark.createDataFrame([(not errors, "files", folder, millis, warning, "; ".join(errors) or None)], LOAD)
    parts = {t: c for t in tables if (c := partition_column(spark, tables[t], found[t][1]))}
    return (Snapshot(tables, name=name or folder.rstrip("/").rpartition("/")[2], partitions=parts), load,
            spark.createDataFrame(counts, "table string, rows bigint"))


def load_snapshots(spark: SparkSession, root: str, unit_col: str = "snapshot_id") -> dict[str, DataFrame]:
    """The readable snapshots of a chain: every table of any of them with its label in ``unit_col`` (see ``load_chain``)."""
    return load_chain(spark, root, unit_col)[0]


def load_chain(spark: SparkSession, root: str, unit_col: str = "snapshot_id") -> tuple[dict[str, DataFrame], DataFrame]:
    """A folder of dated snapshots as one chain: (tables with the label in ``unit_col``, loads).

    Either ``root/<label>/<table>.<format>``, where ``key=value`` folder names give the value, or
    ``root/<table>/<unit_col>=<label>/``. Each table is one scan over all members, which takes a row's
    label from the path of its file; a column that a member lacks is null there. The footer of every file is
    read, in tasks, and every record of text formats. A snapshot with a file or record that cannot be read is
    a failing member: its row in ``loads`` (``unit_col``, ok, error) says why, and none of its rows are in
    the tables. (Damage inside a data page shows only when the page is read.)
    """
    found: dict[tuple[str, str], dict[str, tuple[str, str]]] = {}  # (table, format) -> label -> (path, labelled folder)
    labels: dict[str, list[str]] = {}  # label -> what is wrong
    for name, path, is_dir in list_folder(spark, root):
        if not is_dir:
            continue
        labelled = [(n.partition("=")[2], where) for n, where, _ in list_folder(spark, path) if n.startswith(f"{unit_col}=")]
        for label, where in labelled:
            labels.setdefault(label, [])
            found.setdefault((name, "parquet"), {})[label] = where, where
        if not labelled:
            label = name.partition("=")[2] or name
            labels.setdefault(label, [])
            for table, (fmt, where) in find_tables(spark, path).items():
                found.setdefault((table, fmt), {})[label] = where, path
    if not found:
        raise OperationalError(f"no snapshots in {root}")

    def open_table(key: tuple[str, str]) -> tuple[DataFrame | None, list[tuple[str, str]]]:
        members = found[key]
        try:
            if key[1] in ("parquet", "orc"):
                return _columnar(spark, key[1], members, unit_col)
            if key[1] == "json":
                return _records(read_table(spark, "json", [path for path, _ in members.values()]), spark, members, unit_col)
        except Exception:  # noqa: BLE001 - then the members are opened one by one, and those that fail are told
            pass
        return _side_by_side(spark, key[1], members, unit_col)

    with ThreadPoolExecutor(OPEN_TOGETHER) as pool:
        opened = dict(zip(found, pool.map(open_table, found)))
    for (table, _), (_, wrong) in opened.items():
        for label, why in wrong:
            labels[label].append(f"{table}: {why}")
    good = [label for label, why in labels.items() if not why]
    parts: dict[str, list[DataFrame]] = {}
    for (table, _), (df, _) in opened.items():
        if df is not None:
            parts.setdefault(table, []).append(df.filter(F.col(unit_col).isin(good)))
    loads = spark.createDataFrame([(label, not why, "; ".join(why) or None) for label, why in labels.items()],
                                  f"{unit_col} string, ok boolean, error string")
    return {t: reduce(_merge, dfs) for t, dfs in parts.items()}, loads


def _merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def _reason(error: Exception) -> str:
    """The innermost cause that Spark gives, without the trace."""
    lines = str(error).strip().splitlines() or [type(error).__name__]
    return next((line.partition(": ")[2] for line in reversed(lines) if line.startswith("Caused by: ")), lines[0])


def _plain(uri: str) -> str:
    """One spelling of a file's place: ``file:///x`` and ``file:/x`` are the same."""
    return re.sub(r"\A([A-Za-z][A-Za-z0-9+.-]*):/+", r"\1:/", uri)


def _folders(spark: SparkSession, members: dict[str, tuple[str, str]]) -> tuple[dict[str, str], int]:
    """(folder as a plain URI -> label, path segments of each: all are equally deep)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folders = {_plain(path(folder).toUri().toString()): label for label, (_, folder) in members.items()}
    return folders, len(next(iter(folders)).split("/"))


def _labelled(spark: SparkSession, df: DataFrame, members: dict[str, tuple[str, str]], unit_col: str) -> DataFrame:
    """The columns of ``df`` with the label whose folder the row's file lies in. There are as many labels as members."""
    folders, depth = _folders(spark, members)
    kept = [F.col(quote_ident(c)) for c in df.columns if c != unit_col]
    place = F.regexp_replace("_metadata.file_path", r"\A([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")
    names = spark.createDataFrame(list(folders.items()), f"_folder string, {quote_ident(unit_col)} string")
    return df.select(*kept, F.substring_index(place, "/", depth).alias("_folder")).join(broadcast_if_small(names), "_folder").select(*kept, unit_col)


def _columnar(spark: SparkSession, fmt: str, members: dict[str, tuple[str, str]], unit_col: str) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """(one scan over all members, [(label, what is wrong with a file of it)])."""

    def kinds(path: str) -> T.StructType | str:
        try:
            return spark.read.format(fmt).option("ignoreCorruptFiles", True).load(path).schema
        except Exception as error:  # noqa: BLE001 - a member without a readable schema is a failing one
            return _reason(error)

    with ThreadPoolExecutor(OPEN_TOGETHER) as pool:
        schemas = dict(zip(members, pool.map(lambda at: kinds(at[0]), members.values())))
    wrong = [(label, kind) for label, kind in schemas.items() if isinstance(kind, str)]
    members = {label: at for label, at in members.items() if not isinstance(schemas[label], str)}
    if not members:
        return None, wrong
    fields: dict[str, T.StructField] = {}
    for label in members:
        for field in schemas[label].fields:
            if fields.setdefault(field.name, field).dataType != field.dataType:
                raise ValueError(f"{field.name} has several types")  # then Spark's own coercion decides, member by member
    paths = [path for path, _ in members.values()]
    rows = spark.read.format(fmt).schema(T.StructType(list(fields.values()))).option("ignoreCorruptFiles", True).load(paths)
    seen = rows.groupBy(F.col("_metadata.file_path").alias("place")).agg(F.count(F.lit(1)).alias("n"))  # from footers, a task for every few files
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select(
        F.col("_metadata.file_path").alias("place"), "path")  # names only; contents are not read
    silent = {r["place"]: r["path"] for r in files.join(seen, "place", "left_anti").collect()}  # files without rows: empty or damaged ones
    if silent:
        held = spark.read.format("binaryFile").option("ignoreCorruptFiles", True).load(list(silent.values())).select(
            F.col("_metadata.file_path").alias("place"), F.when(F.col("length") <= EMPTY_BYTES, F.col("content")).alias("content"))
        told = {r["place"]: r["error"] for r in held.mapInArrow(_footers(fmt), "place string, error string").collect()}
        folders, depth = _folders(spark, members)
        for place in sorted(silent):
            if (why := told.get(place, "cannot be read")) is not None:
                wrong.append((folders["/".join(_plain(place).split("/")[:depth])], f"{place.rpartition('/')[2]}: {why}"))
    return _labelled(spark, rows, members, unit_col), wrong


def _footers(fmt: str):
    """Whether files without rows have a footer all the same. A file too large to hold none but a footer has content that is lost."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = []
            for content in batch.column(1):
                try:
                    if not content.is_valid:
                        raise ValueError("no readable footer")
                    if fmt == "orc":
                        from pyarrow import orc
                        orc.ORCFile(pa.BufferReader(content.as_buffer()))
                    else:
                        from pyarrow import parquet
                        parquet.ParquetFile(pa.BufferReader(content.as_buffer()))
                    errors.append(None)
                except Exception as error:  # noqa: BLE001 - whatever is wrong with it is the answer
                    errors.append(str(error).strip().splitlines()[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(errors, pa.string())], names=["place", "error"])

    return check


def _records(rows: DataFrame, spark: SparkSession, members: dict[str, tuple[str, str]], unit_col: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Text formats: every record is parsed whole, and damaged ones are told by label."""
    placed = _labelled(spark, rows, members, unit_col)
    if CORRUPT not in rows.columns:
        return placed, []
    used = [F.count(F.col(quote_ident(c))).alias(f"_n{i}") for i, c in enumerate(rows.columns)]  # so that no column is left unparsed
    bad = placed.groupBy(unit_col).agg(F.count(F.col(CORRUPT)).alias("bad"), *used).where("bad > 0")
    return placed.drop(CORRUPT), [(r[unit_col], f"{r['bad']} damaged record(s)") for r in bad.orderBy(unit_col).collect()]  # one row per member


def _side_by_side(spark: SparkSession, fmt: str, members: dict[str, tuple[str, str]], unit_col: str) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """Members that are read each for itself: CSV files have their own headers, and some members cannot be read together."""

    def one(member: tuple[str, tuple[str, str]]) -> tuple[DataFrame | None, list[tuple[str, str]]]:
        try:
            if fmt in ("parquet", "orc"):
                return _columnar(spark, fmt, dict([member]), unit_col)
            return _records(read_table(spark, fmt, member[1][0]), spark, dict([member]), unit_col)
        except Exception as error:  # noqa: BLE001 - a member that cannot be read is a failing one
            return None, [(member[0], _reason(error))]

    with ThreadPoolExecutor(OPEN_TOGETHER) as pool:
        opened = list(pool.map(one, members.items()))
    tables = [df for df, _ in opened if df is not None]
    return reduce(_merge, tables) if tables else None, [w for _, wrong in opened for w in wrong]
