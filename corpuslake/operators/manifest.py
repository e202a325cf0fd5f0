"""File manifests: fingerprints, summaries and deltas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import EXTENSIONS


def select_files(files: DataFrame, extensions: Sequence[str] = EXTENSIONS, relative: str = "path") -> DataFrame:
    """Files that a scan keeps: nothing hidden on the way, extension in the list."""
    return files.where(~T.hidden(F.col(relative)) & T.extension(F.col("path")).isin(list(extensions)))


def fingerprint(files: DataFrame, content: str = "content") -> DataFrame:
    """path, size, mtime and sha256 of files with their ``content``."""
    raw = F.col(content).cast("binary")
    return files.select("path", F.octet_length(raw).cast("long").alias("size"), "mtime", F.sha2(raw, 256).alias("sha256"))


def summarize(files: DataFrame) -> DataFrame:
    """file_count and total_bytes of a scan, as one row."""
    return files.agg(F.count("*").alias("file_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"))


def _last(manifest: DataFrame) -> DataFrame:
    """One row a path; of several the one that sorts last by hash stands."""
    return manifest.groupBy("path").agg(F.max("sha256").alias("sha256"))


def diff(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(path, change): added, changed or removed, by one full outer join on path."""
    now, then = _last(current), _last(previous).withColumnRenamed("sha256", "before")
    both = now.withColumn("_now", F.lit(True)).join(then.withColumn("_then", F.lit(True)), "path", "full_outer")
    change = (
        F.when(F.col("_then").isNull(), "added").when(F.col("_now").isNull(), "removed")
        .when(~F.col("sha256").eqNullSafe(F.col("before")), "changed")
    )
    return both.select("path", change.alias("change")).where("change is not null")


def to_process(delta: DataFrame) -> DataFrame:
    """(path, file_seq): added files by path, then changed ones by path.

    ``file_seq`` sorts in the order of processing; nothing has to number all files in one place."""
    seq = F.concat(F.when(F.col("change") == "added", "0:").otherwise("1:"), "path")
    return delta.where(F.col("change").isin("added", "changed")).select("path", seq.alias("file_seq"))
