"""Session helpers: a local session for tests and the shared folder for written intermediates."""

from __future__ import annotations

import logging
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: For whole texts: bytes that are handed to Python at a time, and rows that are read from Parquet at a time.
BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20
READ_LIMIT, READ_ROWS = "spark.sql.parquet.columnarReaderBatchSize", 512


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench rely on."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("soundcheck")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    logging.getLogger("SQLQueryContextLogger").setLevel(logging.CRITICAL)  # failing checks are results here
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediates, which every executor must be able to read.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall back to a
    temporary folder: on a cluster such a folder would be lost with its machine.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if conf_dir:
        return conf_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="soundcheck-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, for operators on whole texts: from now on its session handles few of them at a time, unless it was set otherwise.

    A task holds a batch several times, while it is read, sent and turned into strings, and executors and their Python
    workers keep that memory for the stages that follow. With Spark's own limits, 64 MB and 4096 rows, that is most of
    what an executor has. Rows are the same whatever the limits.
    """
    conf = df.sparkSession.conf
    for key, value in ((BATCH_LIMIT, f"{BATCH_BYTES}b"), (READ_LIMIT, str(READ_ROWS))):
        if key not in conf.getAll:
            conf.set(key, value)
    return df


def materialise(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: values are fixed, lineage ends here."""
    path = shared_path(df.sparkSession, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
