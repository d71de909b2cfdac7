"""Session helpers: a default local session and the shared scratch folder."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, shuffle_partitions: int | None = None, memory: str = "12g") -> SparkSession:
    """A local[N] session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("loomtally")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only where it is unset and the session runs on one
    machine (tests) a temporary folder is chosen and set on the context."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="loomtally-")
    spark.sparkContext.setCheckpointDir(made)
    return "file://" + os.path.abspath(made)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the JVM ends."""
    path = f"{shared_dir(spark)}/loomtally/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(jvm_path)
    return path


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Jobs within hand at most `rows` rows to Python at a time (no more than the session has set)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if rows is not None:
        spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release_memory() -> None:
    """Hand memory that a worker has freed back to the system: workers live on for other tasks and
    stages, and the allocators keep what large arrays have left."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def durable(df: DataFrame, name: str = "step", batch_rows: int | None = None, group_bytes: int | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back.
    Lost executors then cost a re-read and not a recomputation of what is above.
    batch_rows: rows handed to Python at a time, where they are wide. group_bytes: bytes of a row
    group, looked at behind every row and not behind 100, where rows hold megabytes: a writer
    holds a row group, and a reader unpacks one."""
    path, writer = scratch_path(df.sparkSession, name), df.write
    if group_bytes is not None:
        writer = writer.option("parquet.block.size", group_bytes).option("parquet.page.size.row.check.min", 1)
    with batches_of(df.sparkSession, batch_rows):
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
