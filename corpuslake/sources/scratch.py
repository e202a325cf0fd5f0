"""Small files and folders on whatever file system Spark uses."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; a local session may go without, a cluster may not."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="corpuslake-")
    return f"{root.rstrip('/')}/corpuslake/{name}-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def modified_ms(spark: SparkSession, path: str) -> int | None:
    fs, where = _fs(spark, path)
    return fs.getFileStatus(where).getModificationTime() if fs.exists(where) else None


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if it is not there."""
    fs, where = _fs(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file so that readers see the old text or the new, nothing between."""
    fs, where = _fs(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs.mkdirs(where.getParent())
    stream = fs.create(part, True)
    try:
        spark._jvm.org.apache.commons.io.IOUtils.write(text, stream, "UTF-8")
    finally:
        stream.close()
    if not fs.rename(part, where):  # some file systems refuse to replace
        fs.delete(where, False)
        if not fs.rename(part, where):
            raise OSError(f"cannot publish {path}")
