"""Continuous ingest: a queue of files, a folder watcher, scheduled maintenance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators import chunking, enrich, parsing
from ..sources import scratch
from ..sources.store import ChunkStore


def subscribe(messages: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Run ``handle`` on every micro-batch of a stream of messages (path, ...).

    The checkpoint makes each message arrive at least once; dedup by content hash
    makes a repeat harmless."""
    writer = messages.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def scheduled(spark: SparkSession, run: Callable[[], object], seconds: int, checkpoint: str) -> StreamingQuery:
    """Call ``run`` on the driver every ``seconds``, as the batches of a clock stream."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = clock.writeStream.foreachBatch(lambda _rows, _n: (run(), None)[1])
    return writer.trigger(processingTime=f"{seconds} seconds").option("checkpointLocation", checkpoint).start()


def ingest_batch(store: ChunkStore) -> Callable[[DataFrame, int], None]:
    """Handler of a queue of files (path, content): parse, chunk, dedup, append."""

    def handle(batch: DataFrame, _number: int) -> None:
        made = chunking.chunk(parsing.sections_only(parsing.parse(batch.select("path", "content"))))
        fresh = enrich.seen_earlier(enrich.mark_existing(made.withColumn("file_seq", F.col("source_file")), store.entries()))
        store.append(enrich.entry_payload(fresh.where("not exists")))

    return handle


def replay_queue(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Put ``files`` (path, content) in a queue folder, drain it by a stream, count the store's chunks by extension."""
    queue, store = scratch.scratch_path(spark, "queue"), ChunkStore(spark, scratch.scratch_path(spark, "store"))
    files.write.parquet(queue)
    messages = spark.readStream.schema("path string, content string").parquet(queue)
    subscribe(messages, ingest_batch(store), scratch.scratch_path(spark, "progress"), available_now=True).awaitTermination()
    kind = T.extension(F.col("context.source_file"))
    return store.entries().groupBy(kind.alias("extension")).agg(F.count("*").alias("chunks"), F.count_distinct("content_hash").alias("hashes"))
