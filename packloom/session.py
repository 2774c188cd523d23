"""Session settings the library relies on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # One unbroken base64 text per value, as a data URL needs it.
    "spark.sql.chunkBase64String.enabled": "false",
    # Arrow batches are cut by size as well as by rows, since single texts may be large.
    "spark.sql.execution.arrow.maxBytesPerBatch": "64MB",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


_SHIPPED = "_packloom_shipped"


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once per Spark context."""
    context = spark.sparkContext
    if getattr(context, _SHIPPED, False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="packloom-code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    setattr(context, _SHIPPED, True)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session somebody else built, and send the package to its workers."""
    ship(spark)
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and benches on one machine; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("packloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("PACKLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and staged tables.

    The cluster names it in ``spark.checkpoint.dir``; a local folder is made only on a
    local master where that is unset, as in tests. On a cluster each executor would write
    to its own disk there, so a missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="packloom-"))
    return context.getCheckpointDir().rstrip("/")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new, unused folder name below the shared folder."""
    return f"{checkpoint_dir(spark)}/packloom-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table below the shared folder and read it back: cuts lineage, computes once."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give every core rows before heavy per-row work on a table of few files.

    A file with one row group is one task however many cores idle. Tables with at least
    as many files as cores pass through, so large inputs are never moved for this.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df._jdf.inputFiles()) < cores else df


@contextmanager
def fixed_splits(spark: SparkSession) -> Iterator[None]:
    """Inside, files are split as they are now however many cores come or go, so each read of a file gives its rows the same positions."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    if before is None:
        spark.conf.set(name, spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)


def child_folders(spark: SparkSession, folder: str) -> list[str]:
    """Names of a folder's direct children on any Hadoop file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [status.getPath().getName() for status in fs.listStatus(path)] if fs.exists(path) else []


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder this library wrote, on any Hadoop file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def first_characters(spark: SparkSession, path: str) -> dict[str, bytes]:
    """First byte that is no blank (or byte-order mark) of each data file of a file, folder or pattern."""
    conf = spark._jsc.hadoopConfiguration()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    codecs = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    found = {}
    waiting = list(fs.globStatus(target) or [])
    while waiting:
        status = waiting.pop()
        file = status.getPath()
        if status.isDirectory():
            waiting += [s for s in fs.listStatus(file) if s.getPath().getName()[0] not in "_."]
            continue
        stream, codec = fs.open(file), codecs.getCodec(file)
        stream = codec.createInputStream(stream) if codec else stream
        try:
            first = b""
            while not first and (part := bytes(stream.readNBytes(1024))):
                first = part.lstrip(b"\xef\xbb\xbf \t\r\n")[:1]
        finally:
            stream.close()
        found[file.toString()] = first
    return found
