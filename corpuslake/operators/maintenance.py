"""Health, orphans and quality of the chunk store."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import Maintaining
from .retrieval import live

_DEFAULT = Maintaining()
_ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def iso(column) -> F.Column:
    return F.date_format(column, _ISO)


def source_files(entries: DataFrame) -> DataFrame:
    """Distinct source files of live chunks."""
    return live(entries).select(F.col("context.source_file").alias("source_file")).where("source_file is not null").distinct()


def live_count(entries: DataFrame) -> DataFrame:
    return live(entries).agg(F.count("*").alias("live_chunks"))


def count_by_status(entries: DataFrame) -> DataFrame:
    return live(entries).groupBy("status").agg(F.count("*").alias("n"))


def store_health(entries: DataFrame, stale_threshold: float = _DEFAULT.stale_threshold) -> DataFrame:
    """One row over live chunks: null confidence counts as 0, null access counts as never; zeros when there are none."""
    confidence, accessed = F.coalesce("confidence", F.lit(0.0)), F.coalesce("access_count", F.lit(0))
    flag = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    number = lambda c: F.coalesce(c, F.lit(0.0))
    return live(entries).agg(
        F.count("*").alias("total_chunks"),
        number(F.round(F.avg(F.col("embedding").isNotNull().cast("double")), 4)).alias("embedding_coverage"),
        number(F.avg(confidence)).alias("avg_confidence"), number(F.min(confidence)).alias("confidence_min"), number(F.max(confidence)).alias("confidence_max"),
        flag(confidence < stale_threshold).alias("stale_count"), flag(accessed == 0).alias("never_accessed"),
        F.count_distinct("context.source_file").alias("unique_source_files"),
        iso(F.min("created_at")).alias("oldest_chunk"), iso(F.max("created_at")).alias("newest_chunk"),
    )


def orphans(entries: DataFrame, manifest: DataFrame) -> DataFrame:
    """Source files of live chunks that the manifest (path) does not have."""
    return source_files(entries).join(manifest.select(F.col("path").alias("source_file")), "source_file", "left_anti")


def sync_counts(entries: DataFrame, manifest: DataFrame, scan: DataFrame) -> DataFrame:
    """orphan_count and missing_count, as one row."""
    missing = scan.select("path").join(source_files(entries).withColumnRenamed("source_file", "path"), "path", "left_anti")
    tagged = orphans(entries, manifest).select(F.lit(1).alias("o"), F.lit(0).alias("m")).unionByName(missing.select(F.lit(0).alias("o"), F.lit(1).alias("m")))
    return tagged.agg(F.coalesce(F.sum("o"), F.lit(0)).alias("orphan_count"), F.coalesce(F.sum("m"), F.lit(0)).alias("missing_count"))


def archive(entries: DataFrame, files: DataFrame, now: datetime) -> DataFrame:
    """All ``entries``, with live chunks of ``files`` (source_file) archived as of ``now``; others are untouched."""
    gone = files.select(F.col("source_file").alias("_file")).distinct().withColumn("_gone", F.lit(True))
    joined = entries.join(gone, F.col("context.source_file") == F.col("_file"), "left")
    hit = F.col("_gone") & F.array_contains("tags", "document_chunk") & (F.col("status") != "archived")
    hit = F.coalesce(hit, F.lit(False))
    columns = {"status": F.when(hit, "archived").otherwise(F.col("status")), "updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at"))}
    return joined.select(*[columns.get(c, F.col(c)).alias(c) for c in entries.columns])


def hot_chunks(entries: DataFrame, limit: int = _DEFAULT.quality_report_limit) -> DataFrame:
    """Most accessed live chunks; ties by id."""
    return live(entries).where("access_count > 0").orderBy(F.desc("access_count"), "id").limit(limit).select(
        "id", "access_count", "confidence", F.col("context.source_file").alias("source_file"))


def cold_chunks(entries: DataFrame, as_of: datetime, days: int = _DEFAULT.cold_chunk_days, limit: int = _DEFAULT.quality_report_limit) -> DataFrame:
    """Oldest live chunks, never accessed and older than ``days`` before ``as_of``; ties by id."""
    old = F.col("created_at") < F.lit(as_of - timedelta(days=days))
    return live(entries).where((F.col("access_count") == 0) & old).orderBy("created_at", "id").limit(limit).select(
        "id", "confidence", iso("created_at").alias("created_at"), F.col("context.source_file").alias("source_file"))


def low_confidence(entries: DataFrame, threshold: float = _DEFAULT.stale_threshold, limit: int = _DEFAULT.quality_report_limit) -> DataFrame:
    """Least confident live chunks below ``threshold``; null confidence is not below anything; ties by id."""
    return live(entries).where(F.col("confidence") < threshold).orderBy("confidence", "id").limit(limit).select(
        "id", "confidence", "access_count", F.col("context.source_file").alias("source_file"))


def query_count(access_log: DataFrame) -> DataFrame:
    return access_log.where(F.col("action") == "query").agg(F.count("*").alias("total_queries"))


def quality_summary(entries: DataFrame, access_log: DataFrame, threshold: float = _DEFAULT.stale_threshold) -> DataFrame:
    """One row; here, unlike in ``store_health``, nulls count as neither unaccessed nor unsure."""
    zero = F.lit(0).cast("long")
    chunks = live(entries).agg(
        zero.alias("q"), F.count_if(F.col("access_count") == 0).alias("a"), F.count_if(F.col("confidence") < threshold).alias("c"))
    queries = query_count(access_log).select(F.col("total_queries").alias("q"), zero.alias("a"), zero.alias("c"))
    return chunks.unionByName(queries).agg(
        F.sum("q").alias("total_queries"), F.lit(None).cast("double").alias("avg_retrieval_score"),
        F.sum("a").alias("chunks_never_accessed"), F.sum("c").alias("chunks_below_threshold"))
