"""Between chunks and the store: relevance filter, existence, embeddings, outcomes, payloads."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CHUNK_TAG

#: (text, prompt) -> (relevant, confidence), or the text alone if it takes one argument; an exception keeps the chunk.
Classifier = Callable[..., "tuple[bool, float | None]"]
#: texts -> a vector or None for each.
Embedder = Callable[[Sequence[str]], "Sequence[Sequence[float] | None]"]


def verdict(relevant: Column, confidence: Column, threshold: float, failed: Column | None = None) -> Column:
    """Whether a judged chunk is kept: relevant, and confident enough; failures are kept."""
    kept = F.coalesce(relevant, F.lit(False)) & (F.coalesce(confidence, F.lit(0.0)) >= threshold)
    return kept if failed is None else F.coalesce(failed, F.lit(False)) | kept


def _asked(classifier: Classifier, prompt: str) -> Callable[[str], "tuple[bool, float | None]"]:
    """The classifier with its prompt; one that has a single parameter judges the text alone."""
    try:
        known = inspect.signature(classifier).parameters.values()
    except (TypeError, ValueError):
        return lambda text: classifier(text, prompt)
    takes = sum(p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD) for p in known)
    if takes >= 2 or any(p.kind == p.VAR_POSITIONAL for p in known):
        return lambda text: classifier(text, prompt)
    return classifier


def filter_chunks(chunks: DataFrame, classifier: Classifier | None, prompt: str | None, threshold: float = 0.5, enabled: bool = True) -> DataFrame:
    """Chunks that the classifier keeps, asked with ``prompt``; each distinct text is judged once.

    ``content_hash`` is no name for a text here: it reads case and white space alike, which a classifier need not.
    All pass if filtering is off, the prompt is blank, or there is no classifier."""
    if not enabled or classifier is None or not (prompt or "").strip():
        return chunks

    def run(frames):
        judge = _asked(classifier, prompt)
        for frame in frames:
            rows = []
            for key, text in zip(frame["_key"], frame["content"]):
                try:
                    relevant, confidence = judge(text)
                    rows.append((key, relevant is True and float(confidence or 0.0) >= threshold))
                except Exception:  # fail open
                    rows.append((key, True))
            yield type(frame)(rows, columns=["_key", "_keep"])

    named = chunks.withColumn("_key", F.coalesce(F.sha2("content", 256), F.lit("")))
    each = named.groupBy("_key").agg(F.min("content").alias("content"))
    judged = each.mapInPandas(run, "_key string, _keep boolean")
    return named.join(judged.where("_keep").select("_key"), "_key", "left_semi").select(*chunks.columns)


def mark_existing(chunks: DataFrame, entries: DataFrame, force: bool = False) -> DataFrame:
    """``chunks`` with ``exists``: whether the store holds the hash (never, when forced)."""
    if force:
        return chunks.withColumn("exists", F.lit(False))
    known = entries.where("content_hash is not null").select("content_hash").distinct().withColumn("exists", F.lit(True))
    return chunks.join(known, "content_hash", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def attach_embeddings(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """``chunks`` with ``embedding`` of their hash. Of several vectors (content_hash, ord, embedding) the last stands."""
    last = vectors.where("embedding is not null").groupBy("content_hash").agg(F.max_by("embedding", "ord").alias("embedding"))
    return chunks.join(last, "content_hash", "left")


def embed(chunks: DataFrame, embedder: Embedder | None, batch: int = 64) -> DataFrame:
    """``chunks`` (with exists) with ``embedding``: each new hash embedded once.

    Where a batch fails, its texts are embedded one by one, and those that fail then have null."""
    if embedder is None:
        return chunks.withColumn("embedding", F.lit(None).cast("array<float>"))

    def attempt(texts):
        """A vector or None for each text; None if the call fails or gives another number of them."""
        try:
            vectors = list(embedder(texts))
            return vectors if len(vectors) == len(texts) else None
        except Exception:  # chunks are written without vectors
            return None

    def run(frames):
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                texts = part["content"].tolist()
                vectors = attempt(texts)
                if vectors is None:
                    vectors = [None if (one := attempt([t]) if len(texts) > 1 else None) is None else one[0] for t in texts]
                vectors = [list(map(float, v)) if v is not None and len(v) else None for v in vectors]
                yield type(frame)({"content_hash": part["content_hash"].tolist(), "embedding": vectors})

    fresh = chunks.where("not exists").groupBy("content_hash").agg(F.min("content").alias("content"))
    made = fresh.mapInPandas(run, "content_hash string, embedding array<float>")
    return chunks.join(made, "content_hash", "left")


def outcome(dry_run: Column, has_store: Column, exists: Column, force: Column, written: Column) -> Column:
    """What becomes of a chunk, in this order. ``written``: the store said success, in so many words."""
    return (
        F.when(dry_run, "created").when(~has_store, "created").when(exists & ~force, "skipped")
        .when(~F.coalesce(written, F.lit(False)), "skipped").when(force, "updated").otherwise("created")
    )


def seen_earlier(chunks: DataFrame) -> DataFrame:
    """``chunks`` (file_seq, content_hash) with ``exists`` also true where an earlier file of the run has the hash.

    The least file of a hash is one aggregation, combined before the shuffle."""
    first = chunks.groupBy("content_hash").agg(F.min("file_seq").alias("_first"))
    return chunks.join(first, "content_hash").withColumn("exists", F.col("exists") | (F.col("_first") < F.col("file_seq"))).drop("_first")


def ingest_counts(outcomes: DataFrame, filtered_out: DataFrame | None = None) -> DataFrame:
    """One row of chunks_created, chunks_skipped (filtered out ones too) and chunks_updated."""
    every = outcomes.select("outcome")
    if filtered_out is not None:
        every = every.unionByName(filtered_out.select(F.lit("skipped").alias("outcome")))
    count = lambda what: F.coalesce(F.sum((F.col("outcome") == what).cast("long")), F.lit(0))
    return every.agg(*[count(w).alias(f"chunks_{w}") for w in ("created", "skipped", "updated")])


def entry_payload(chunks: DataFrame) -> DataFrame:
    """Rows for the store: content, type, hash, tags and context of each chunk."""
    tags = F.array_distinct(F.array_compact(F.array("source_file", "heading", F.lit(CHUNK_TAG))))
    context = F.struct("source_file", "heading", "section_path", "chunk_index", "token_count", F.lit(None).cast("boolean").alias("retired"))
    vector = F.col("embedding") if "embedding" in chunks.columns else F.lit(None).cast("array<float>")
    return chunks.select("content", F.lit(CHUNK_TAG).alias("content_type"), "content_hash", tags.alias("tags"), context.alias("context"), vector.alias("embedding"))


def tombstones(removed: DataFrame) -> DataFrame:
    """Rows for the store that say a file (path) is gone. They count as live chunks until archived."""
    null = lambda kind: F.lit(None).cast(kind)
    context = F.struct(
        F.col("path").alias("source_file"), null("string").alias("heading"), null("array<string>").alias("section_path"),
        null("int").alias("chunk_index"), null("int").alias("token_count"), F.lit(True).alias("retired"),
    )
    return removed.select(
        F.concat(F.lit("Retired document: "), "path").alias("content"), F.lit("observation").alias("content_type"), null("string").alias("content_hash"),
        F.array_distinct(F.array("path", F.lit("retired"), F.lit(CHUNK_TAG))).alias("tags"), context.alias("context"), null("array<float>").alias("embedding"),
    )


