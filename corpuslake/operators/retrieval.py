"""Retrieval: vector top-k, neighbours, sources and the summary of a result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import CHUNK_TAG

_JSON_CONTEXT = "source_file string, heading string, section_path array<string>, chunk_index int, token_count int, retired boolean"


#: Columns of an entry that a neighbour's row has besides its place and content.
CARRIED = ("content_type", "confidence", "tags", "source_agent", "knowledge_domain", "status")


def cosine_distance(vector: Column, query: Sequence[float]) -> Column:
    """1 - cosine, in doubles; null for null, empty, zero or unequally long vectors."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.transform(vector, lambda x: x.cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(v, q, lambda a, b: a * b))
    norm = F.sqrt(total(F.transform(v, lambda x: x * x)))
    size = F.lit(sum(float(x) ** 2 for x in query) ** 0.5)
    return F.when((F.size(vector) == len(query)) & (norm > 0) & (size > 0), 1 - dot / (norm * size))


def live(entries: DataFrame) -> DataFrame:
    """Live chunks: tagged as such and not archived. A null status, or null tags, is not live."""
    return entries.where(F.array_contains("tags", CHUNK_TAG) & (F.col("status") != "archived"))


def top_k(entries: DataFrame, query: Sequence[float], k: int = 5, tags: Sequence[str] = (CHUNK_TAG,)) -> DataFrame:
    """The ``k`` entries with all ``tags`` nearest to ``query``, with distance and rank; ties by id.

    Keeps k rows in every task and merges those, so no shuffle grows with the store."""
    picked = entries
    for tag in tags:
        picked = picked.where(F.array_contains("tags", tag))
    near = picked.withColumn("distance", cosine_distance(F.col("embedding"), query)).where("distance is not null")
    best = near.orderBy("distance", "id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("distance", "id")))


def normalize_context(context: Column) -> Column:
    """Context as a struct, from JSON text; blank or broken text gives a struct of nulls."""
    nulls = F.from_json(F.lit("{}"), _JSON_CONTEXT)
    return F.coalesce(F.when(T.strip(context) != "", F.from_json(context, _JSON_CONTEXT)), nulls)


def resolve_context(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """``rows`` with source_file, chunk_index and heading of their context.

    Where a context lacks source_file or chunk_index and the row has an id, the
    store's context overlays it; what is still missing comes from the row's own
    top-level columns. Only rows with a gap take part in the join."""
    names = ("source_file", "chunk_index", "heading")
    gap = (F.col("context.source_file").isNull() | F.col("context.chunk_index").isNull()) & F.col("id").isNotNull()
    stored = entries.select(F.col("id").alias("_id"), F.lit(True).alias("_found"), *[F.col(f"context.{n}").alias(f"_s_{n}") for n in names])
    joined = rows.withColumn("_gap", F.when(gap, F.col("id"))).join(stored, F.col("_gap") == F.col("_id"), "left")
    top = lambda n: F.col(n) if n in rows.columns else F.lit(None)
    return joined.select(
        *[c for c in rows.columns if c not in names],
        *[F.coalesce(F.when(F.col("_found"), F.col(f"_s_{n}")), F.col(f"context.{n}"), top(n)).alias(n) for n in names],
    )


def dedupe_key(id_: Column, hash_: Column, source_file: Column, chunk_index: Column, content: Column) -> Column:
    """Names a retrieved chunk: its id, else its hash, else its place and content."""
    return F.coalesce(
        F.concat(F.lit("i:"), id_.cast("string")), F.concat(F.lit("h:"), hash_),
        F.concat_ws("|", F.lit("p"), F.coalesce(source_file, F.lit("")), F.coalesce(chunk_index.cast("string"), F.lit("")), F.coalesce(content, F.lit(""))),
    )


def neighbors(hits: DataFrame, entries: DataFrame, radius: int = 1) -> DataFrame:
    """Every hit's window: chunks of its file within ``radius``, and the hit itself if it is not among them.

    ``hits``: rank, id, content, content_hash, distance, source_file, chunk_index, and of ``CARRIED`` what they have.
    Returns hit_rank, id, content, content_hash, source_file, chunk_index, heading, distance and ``CARRIED``.
    A stored row takes the hit's place and has no distance. Windows span sections
    and include archived chunks. Hits are few (top-k), so Spark broadcasts them
    when their size allows and shuffles both sides by file when not.
    """
    place = ("source_file", "chunk_index", "heading")
    stored = entries.where(F.col("content_type") == CHUNK_TAG).select(
        "id", "content", "content_hash", *CARRIED, *[F.col(f"context.{n}").alias(n) for n in place]
    )
    asked = hits.where("source_file is not null and chunk_index is not null").select(
        F.col("rank").alias("hit_rank"), F.col("source_file").alias("_file"), F.col("chunk_index").alias("_at")
    )
    near = F.col("chunk_index").between(F.col("_at") - radius, F.col("_at") + radius)
    window = stored.join(asked, (F.col("source_file") == F.col("_file")) & near).select(
        "hit_rank", "id", "content", "content_hash", *place, *CARRIED, F.lit(None).cast("double").alias("distance")
    )
    key = dedupe_key(F.col("id"), F.col("content_hash"), F.col("source_file"), F.col("chunk_index"), F.col("content"))
    kinds = {f.name: f.dataType for f in stored.schema}
    given = lambda n: F.col(n) if n in hits.columns else F.lit(None).cast(kinds[n]).alias(n)
    own = hits.select(F.col("rank").alias("hit_rank"), "id", "content", "content_hash", *map(given, place), *map(given, CARRIED), "distance").withColumn("_key", key)
    alone = own.join(window.select("hit_rank", key.alias("_key")), ["hit_rank", "_key"], "left_anti").drop("_key")
    return window.unionByName(alone)


def merge_neighbors(windows: DataFrame) -> DataFrame:
    """Each chunk once, as it first arrives (hit_rank, chunk_index, id)."""
    key = dedupe_key(F.col("id"), F.col("content_hash"), F.col("source_file"), F.col("chunk_index"), F.col("content"))
    first = Window.partitionBy("_key").orderBy("hit_rank", F.coalesce("chunk_index", F.lit(0)), "id")
    return windows.withColumn("_key", key).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_key", "_n")


def format_source(rows: DataFrame) -> DataFrame:
    """content, source_file, heading, chunk_index and distance, from the context first, then the row."""
    own = lambda n: F.coalesce(F.col(f"context.{n}"), F.col(n)) if n in rows.columns else F.col(f"context.{n}")
    score = [F.col(c) for c in ("distance", "score") if c in rows.columns] or [F.lit(None).cast("double")]
    return rows.select("content", *[own(n).alias(n) for n in ("source_file", "heading", "chunk_index")], F.coalesce(*score).alias("distance"))


def average_score(rows: DataFrame) -> DataFrame:
    """Mean of distance, or of score where there is none, rounded to 4 places; null without any."""
    score = F.coalesce("distance", "score") if "score" in rows.columns else F.col("distance")
    return rows.agg(F.round(F.avg(score), 4).alias("retrieval_score"))


def result_metadata(rows: DataFrame) -> DataFrame:
    """One row that sums a result up. ``rows``: rank, confidence, distance, score, source_file, embedding, status."""
    score = F.coalesce("distance", "score") if "score" in rows.columns else F.col("distance")
    first = F.sort_array(F.collect_list(F.when(F.col("source_file").isNotNull(), F.struct("rank", "source_file"))))
    return rows.agg(
        F.round(F.avg(score), 4).alias("retrieval_score"), F.count("*").alias("chunk_count"), F.round(F.avg("confidence"), 4).alias("confidence_avg"),
        F.min("confidence").alias("confidence_min"), F.max("confidence").alias("confidence_max"),
        F.min("distance").alias("distance_min"), F.max("distance").alias("distance_max"),
        F.array_distinct(F.transform(first, lambda x: x["source_file"])).alias("source_files"),
        F.count_distinct("source_file").alias("source_file_count"),
        F.coalesce(F.bool_and(~T.zero_embedding(F.col("embedding"))), F.lit(True)).alias("all_embedded"),
    )


def status_counts(rows: DataFrame) -> DataFrame:
    """Rows of each status, null included."""
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def synthesis_prompt(question: Column, context: Column) -> Column:
    """The prompt for an answer; the bare question if there is no context."""
    asked = F.concat(
        F.lit("You are a helpful assistant. Use the context below to answer the question.\n\nContext:\n"), context,
        F.lit("\n\nQuestion: "), question, F.lit("\n\nAnswer:"),
    )
    return F.when(F.coalesce(context, F.lit("")) == "", question).otherwise(asked)


def joined_contents(rows: DataFrame) -> DataFrame:
    """Contents of a result in order of rank, joined as a prompt's context."""
    parts = F.sort_array(F.collect_list(F.struct("rank", F.coalesce("content", F.lit("")).alias("content"))))
    return rows.agg(F.array_join(F.transform(parts, lambda p: p["content"]), "\n\n---\n\n").alias("context"))


def feedback_events(feedback: DataFrame) -> DataFrame:
    """Feedback rows: question_hash instead of the question, the rest as given."""
    rest = [c for c in feedback.columns if c != "question"]
    return feedback.select(T.question_hash(F.col("question")).alias("question_hash"), *rest)
