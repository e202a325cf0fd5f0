"""Monitored folders: resolution and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import EXTENSIONS

_SUMS = ("files_scanned", "files_added", "files_changed", "files_removed", "chunks_created", "chunks_skipped", "chunks_updated")


def resolve(monitors: DataFrame, legacy_path: str | None) -> DataFrame:
    """``monitors`` (path, extensions, label) and, unless one has its path, the legacy folder."""
    if not legacy_path:
        return monitors
    legacy = monitors.sparkSession.range(1).select(
        F.lit(legacy_path).alias("path"), F.array(*map(F.lit, EXTENSIONS)).alias("extensions"), F.lit("legacy").alias("label"))
    return monitors.select("path", "extensions", "label").unionByName(legacy.join(monitors.select("path"), "path", "left_anti"))


def roll_up(runs: DataFrame) -> DataFrame:
    """Sums over successful runs and the count of all runs."""
    ok = lambda c: F.coalesce(F.sum(F.when(F.col("success"), F.col(c))), F.lit(0)).alias(c)
    return runs.agg(F.count("*").alias("monitors_processed"), *[ok(c) for c in _SUMS])


def status(monitors: DataFrame, files: DataFrame) -> DataFrame:
    """total_monitors, and files (path) below each monitor's folder with its own extensions.

    A file meets the folders above it by an equi join on folder names, not by comparing every pair."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    placed = files.where(~T.hidden(F.col("path"))).select("path", T.extension(F.col("path")).alias("ext"), F.explode(above).alias("folder"))
    hits = placed.join(monitors.select(F.col("path").alias("folder"), "extensions"), "folder").where(F.array_contains("extensions", F.col("ext")))
    one = hits.select(F.lit(0).alias("m"), F.lit(1).alias("f")).unionByName(monitors.select(F.lit(1).alias("m"), F.lit(0).alias("f")))
    return one.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("total_monitors"), F.coalesce(F.sum("f"), F.lit(0)).alias("total_files"))
