"""Queries over the chunk store: maintenance and retrieval."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import maintenance as M
from ..operators import retrieval as R
from . import fixtures as X

S = SparkSession
_NOW = datetime(2024, 3, 1)


def live_chunks(spark: S, sf: str) -> DataFrame:
    return R.live(X.entries(spark, sf)).select("id", "status", "confidence")


def live_count(spark: S, sf: str) -> DataFrame:
    return M.live_count(X.entries(spark, sf))


def count_by_status(spark: S, sf: str) -> DataFrame:
    return M.count_by_status(X.entries(spark, sf))


def source_files(spark: S, sf: str) -> DataFrame:
    return M.source_files(X.entries(spark, sf))


def health_store(spark: S, sf: str) -> DataFrame:
    got = M.store_health(X.entries(spark, sf))
    return got.withColumns({c: F.round(c, 9) for c in ("embedding_coverage", "avg_confidence")})


def health_local(spark: S, sf: str) -> DataFrame:
    """The scan's summary, whether the manifest before has files, and the scan's last change as the time of ingest."""
    from ..operators import manifest

    files = X.files(spark, sf)
    scanned = manifest.fingerprint(manifest.select_files(files))
    before = X.previous_files(spark, sf, files).agg((F.count("*") > 0).alias("manifest_exists"))
    last = scanned.agg(M.iso(F.max("mtime")).alias("last_ingest"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(manifest.summarize(scanned)).join(one(before), "_one").join(one(last), "_one").select(
        F.lit("/corpus").alias("corpus_path"), "file_count", "total_bytes", "manifest_exists", "last_ingest")


def hot_chunks(spark: S, sf: str) -> DataFrame:
    return M.hot_chunks(X.entries(spark, sf))


def cold_chunks(spark: S, sf: str) -> DataFrame:
    return M.cold_chunks(X.entries(spark, sf), X.AS_OF)


def low_confidence(spark: S, sf: str) -> DataFrame:
    return M.low_confidence(X.entries(spark, sf))


def query_count(spark: S, sf: str) -> DataFrame:
    return M.query_count(X.access_log(spark, sf))


def quality_summary(spark: S, sf: str) -> DataFrame:
    return M.quality_summary(X.entries(spark, sf), X.access_log(spark, sf))


def quality_report(spark: S, sf: str) -> DataFrame:
    """The report in one table: its three lists, each in order, and the figures of its summary."""
    e = X.entries(spark, sf)

    def listed(name: str, df: DataFrame, *order) -> DataFrame:
        place = F.row_number().over(Window.orderBy(*order, "id")).alias("rank")  # ten rows
        return df.select(F.lit(name).alias("section"), place, "id", "source_file", F.lit(None).cast("double").alias("value"))

    summary = M.quality_summary(e, X.access_log(spark, sf))
    figures = ("total_queries", "avg_retrieval_score", "chunks_never_accessed", "chunks_below_threshold")
    stack = summary.select(F.explode(F.array(*[F.struct(F.lit(f"summary.{n}").alias("section"), F.col(n).cast("double").alias("value")) for n in figures])).alias("x"))
    none = lambda kind: F.lit(None).cast(kind)
    return (
        listed("hot", M.hot_chunks(e), F.desc("access_count")).unionByName(listed("cold", M.cold_chunks(e, X.AS_OF), "created_at"))
        .unionByName(listed("low", M.low_confidence(e), "confidence"))
        .unionByName(stack.select("x.section", none("int").alias("rank"), none("long").alias("id"), none("string").alias("source_file"), "x.value"))
    )


def detect_orphans(spark: S, sf: str) -> DataFrame:
    return M.orphans(X.entries(spark, sf), X.manifest_sources(spark, sf, 2, "/corpus/extra.md"))


def sync_stats(spark: S, sf: str) -> DataFrame:
    manifest, scan = X.manifest_sources(spark, sf, 2, "/corpus/extra.md"), X.manifest_sources(spark, sf, 3, "/corpus/new.md")
    return M.sync_counts(X.entries(spark, sf), manifest, scan)


def archive_orphans(spark: S, sf: str) -> DataFrame:
    e = X.entries(spark, sf)
    after = M.archive(e, M.orphans(e, X.manifest_sources(spark, sf, 2, "/corpus/extra.md")), _NOW)
    return after.select("id", "status", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


def _hits(spark: S, sf: str, k: int) -> DataFrame:
    hits = R.top_k(X.entries(spark, sf), X.query_vector(spark, sf), k)
    return hits.withColumns({"source_file": F.col("context.source_file"), "chunk_index": F.col("context.chunk_index")})


def retrieve_topk(spark: S, sf: str) -> DataFrame:
    return _hits(spark, sf, 5).select("rank", "id", F.round("distance", 6).alias("distance"))


def _windows(spark: S, sf: str) -> DataFrame:
    return R.neighbors(_hits(spark, sf, 10), X.entries(spark, sf), 1)


def neighbors(spark: S, sf: str) -> DataFrame:
    return _windows(spark, sf).select("hit_rank", "id", "source_file", "chunk_index", F.round("distance", 6).alias("distance"))


def neighbors_merged(spark: S, sf: str) -> DataFrame:
    return R.merge_neighbors(_windows(spark, sf)).select("hit_rank", "id", "source_file", "chunk_index")


def format_source(spark: S, sf: str) -> DataFrame:
    rows = _hits(spark, sf, 10).withColumn("heading", F.lit("own"))
    return R.format_source(rows).select(F.md5("content").alias("content_md5"), "source_file", "heading", "chunk_index", F.round("distance", 6).alias("distance"))


def retrieval_score(spark: S, sf: str) -> DataFrame:
    """Over two results, one with distances and one with scores alone."""
    rows = _hits(spark, sf, 10).select(F.when(F.col("rank") % 3 != 0, F.col("distance")).alias("distance"), F.col("confidence").alias("score"))
    return R.average_score(rows)


def retrieval_metadata(spark: S, sf: str) -> DataFrame:
    got = R.result_metadata(_hits(spark, sf, 10))
    return got.withColumns({"distance_min": F.round("distance_min", 6), "distance_max": F.round("distance_max", 6), "source_files": F.array_join("source_files", "|")})


def retrieval_statuses(spark: S, sf: str) -> DataFrame:
    return R.status_counts(_hits(spark, sf, 10))


def context_normalize(spark: S, sf: str) -> DataFrame:
    """Event properties as contexts, some of them blank or broken."""
    i = F.col("event_id")
    good = F.format_string('{"source_file":"/f/%s.md","chunk_index":%s}', (i % 50).cast("string"), (i % 9).cast("string"))
    text = F.when(i % 5 == 0, "  ").when(i % 7 == 0, "{broken").otherwise(good)
    got = X.table(spark, sf, "events").select("event_id", R.normalize_context(text).alias("c"))
    return got.select("event_id", "c.source_file", "c.chunk_index")


def context_resolve(spark: S, sf: str) -> DataFrame:
    """Rows whose context has gaps, filled from the store by id and then from the row."""
    e = X.entries(spark, sf)
    gap = F.col("id") % 4
    context = F.struct(
        F.when(gap != 0, F.lit("/own.md")).alias("source_file"), F.when(gap != 1, F.lit(7)).alias("chunk_index"), F.when(gap == 2, F.lit("own")).alias("heading"))
    rows = e.select(F.when(F.col("id") % 9 != 0, F.col("id")).alias("id"), F.col("id").alias("n"), context.alias("context"), F.lit("/top.md").alias("source_file"), F.lit(99).alias("chunk_index"), F.lit("top").alias("heading"))
    return R.resolve_context(rows, e).select("n", "source_file", "chunk_index", "heading")


def zero_embedding(spark: S, sf: str) -> DataFrame:
    vector = F.when(F.col("id") % 5 == 0, F.array_repeat(F.lit(0.0).cast("float"), 4)).when(F.col("id") % 5 == 1, F.array().cast("array<float>")).otherwise(F.col("embedding"))
    return X.entries(spark, sf).select("id", T.zero_embedding(vector).alias("zero"))


def synthesis_prompt(spark: S, sf: str) -> DataFrame:
    top = _hits(spark, sf, 5)
    made = R.joined_contents(top).unionByName(R.joined_contents(top.where("rank > 99")))
    return made.select(F.md5(R.synthesis_prompt(F.lit("what is it?"), F.col("context"))).alias("prompt_md5"))


def feedback_event(spark: S, sf: str) -> DataFrame:
    asked = X.table(spark, sf, "conversations").where("role = 'user'").select(
        F.col("text").alias("question"), F.concat_ws(",", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_ids"),
        (F.col("turn") / 10.0).cast("double").alias("retrieval_score"), (F.col("conv_id") % 2 == 0).alias("synthesized"), F.lit(None).cast("int").alias("rating"))
    return R.feedback_events(asked)


def stream_ingest(spark: S, sf: str) -> DataFrame:
    """Files that arrive in a queue, ingested in micro-batches; the store's chunks by file kind."""
    from ..streaming.ingest import replay_queue

    return replay_queue(spark, X.files(spark, sf).select("path", "content"))


QUERIES = {f.__name__: f for f in (
    live_chunks, live_count, count_by_status, source_files, health_store, health_local, hot_chunks, cold_chunks, low_confidence, query_count,
    quality_summary, quality_report, detect_orphans, sync_stats, archive_orphans, retrieve_topk, neighbors, neighbors_merged, format_source,
    retrieval_score, retrieval_metadata, retrieval_statuses, context_normalize, context_resolve, zero_embedding, synthesis_prompt, feedback_event,
    stream_ingest,
)}
