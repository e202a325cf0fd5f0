"""Queries over files, sections, chunks, manifests and ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, enrich, manifest, monitors, parsing
from ..operators import retrieval as R
from . import fixtures as X

S = SparkSession


def _joined(column: str, by: str = ">") -> F.Column:
    return F.array_join(column, by)


def _scanned(spark: S, sf: str) -> DataFrame:
    return manifest.select_files(X.files(spark, sf))


def _printed(manifest_rows: DataFrame) -> DataFrame:
    return manifest_rows.select("path", "size", F.date_format("mtime", "yyyy-MM-dd HH:mm:ss").alias("mtime"), "sha256")


def scan_files(spark: S, sf: str) -> DataFrame:
    return _scanned(spark, sf).select("path")


def scan_hidden(spark: S, sf: str) -> DataFrame:
    return X.files(spark, sf).select("path", T.hidden(F.col("path")).alias("hidden"))


def file_fingerprint(spark: S, sf: str) -> DataFrame:
    return _printed(manifest.fingerprint(_scanned(spark, sf)))


def scan_summary(spark: S, sf: str) -> DataFrame:
    return manifest.summarize(manifest.fingerprint(_scanned(spark, sf)))


def manifest_key(spark: S, sf: str) -> DataFrame:
    return X.monitors(spark, sf).select("path", T.manifest_key(F.col("path")).alias("key"))


def manifest_diff(spark: S, sf: str) -> DataFrame:
    now = X.files(spark, sf)
    return manifest.diff(manifest.fingerprint(now), X.previous_files(spark, sf, now))


def to_process(spark: S, sf: str) -> DataFrame:
    return manifest.to_process(manifest_diff(spark, sf))


def heading_level(spark: S, sf: str) -> DataFrame:
    lines = X.markdown(spark, sf).select("path", F.posexplode(F.split("content", "\n", -1)).alias("pos", "line"))
    return lines.groupBy("path").agg(*[F.count_if(T.heading_level(F.concat("line", F.lit("\n"))) == d).alias(f"h{d}") for d in range(1, 7)])


def section_path(spark: S, sf: str) -> DataFrame:
    lines = parsing.markdown_headings(X.markdown(spark, sf))
    return lines.select("path", "pos", "level", F.md5("title").alias("title_md5"), F.md5(_joined("section_path")).alias("path_md5"))


def _sections(df: DataFrame) -> DataFrame:
    return df.select("source_file", "section_ord", F.md5("heading").alias("heading_md5"), F.size("section_path").alias("depth"),
                     F.md5(_joined("section_path")).alias("path_md5"), F.length("content").alias("n_chars"), F.md5("content").alias("content_md5"))


def md_sections(spark: S, sf: str) -> DataFrame:
    return _sections(parsing.parse_markdown(X.markdown(spark, sf)))


def parse_markdown(spark: S, sf: str) -> DataFrame:
    return _sections(parsing.parse_markdown(X.files(spark, sf).where(T.extension(F.col("path")) == ".md")))


def parse_text(spark: S, sf: str) -> DataFrame:
    return _sections(parsing.parse_text(X.text_files(spark, sf)))


def parse_dispatch(spark: S, sf: str) -> DataFrame:
    got = parsing.parse(X.files(spark, sf).select("path", "content"))
    return got.select("source_file", "error", F.md5("content").alias("content_md5"), F.col("heading"))


def paragraphs(spark: S, sf: str) -> DataFrame:
    made = X.markdown(spark, sf).select("path", F.posexplode(chunking.paragraphs(F.col("content"))).alias("pos", "p"))
    return made.groupBy("path").agg(F.count("*").alias("n"), F.max(F.length("p")).alias("longest"), F.sum(F.length("p")).alias("chars"))


def chunk_hard_split(spark: S, sf: str) -> DataFrame:
    made = X.table(spark, sf, "documents").select("doc_id", F.posexplode(chunking.hard_split(F.col("text"), 2048)).alias("i", "part"))
    return made.select("doc_id", "i", F.md5("part").alias("part_md5"))


def _chunks(df: DataFrame) -> DataFrame:
    return df.select("source_file", "section_ord", "chunk_index", "token_count", F.length("content").alias("n_chars"), "content_hash", F.md5("content").alias("content_md5"))


def chunk_pack(spark: S, sf: str) -> DataFrame:
    return _chunks(X.chunks(spark, sf, 64))


def chunks(spark: S, sf: str) -> DataFrame:
    return _chunks(X.chunks(spark, sf))


def token_count(spark: S, sf: str) -> DataFrame:
    return X.table(spark, sf, "documents").select("doc_id", T.token_count(F.col("text")).alias("tokens"))


def content_hash(spark: S, sf: str) -> DataFrame:
    return X.table(spark, sf, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


def question_hash(spark: S, sf: str) -> DataFrame:
    return X.table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", T.question_hash(F.col("text")).alias("question_hash"))


def content_source(spark: S, sf: str) -> DataFrame:
    """Direct content: each assistant turn is a section of its own, chunked and counted."""
    rows = X.table(spark, sf, "conversations").where("role = 'assistant'")
    name = F.concat(F.lit("content://chat/"), F.uuid())
    sections = rows.select(name.alias("source_file"), F.lit(0).alias("section_ord"), F.lit("chat").alias("heading"), F.array(F.lit("chat")).alias("section_path"), F.col("text").alias("content"))
    return chunking.chunk(sections, 64).groupBy("heading").agg(F.count("*").alias("chunks"))


def entry_payload(spark: S, sf: str) -> DataFrame:
    made = enrich.entry_payload(X.chunks(spark, sf))
    return made.select("content_type", "content_hash", F.md5(_joined("tags", "|")).alias("tags_md5"), F.size("tags").alias("n_tags"), "context.source_file", "context.chunk_index", "context.token_count")


def retire_tombstones(spark: S, sf: str) -> DataFrame:
    gone = manifest_diff(spark, sf).where("change = 'removed'")
    return enrich.tombstones(gone).select("content", "content_type", _joined("tags", "|").alias("tags"), "context.source_file", "context.retired")


def _numbered(spark: S, sf: str) -> DataFrame:
    """Chunks of whole documents, with the order of their files and the store's knowledge of them."""
    made = chunking.chunk(X.plain_sections(spark, sf))
    store = R.live(X.entries(spark, sf)).select("content_hash")
    return enrich.seen_earlier(enrich.mark_existing(made.withColumn("file_seq", F.col("source_file")), store))


def exists_map(spark: S, sf: str) -> DataFrame:
    made = chunking.chunk(X.plain_sections(spark, sf))
    store = R.live(X.entries(spark, sf)).select("content_hash")
    return enrich.mark_existing(made, store).select("source_file", "chunk_index", "content_hash", "exists")


def embed_attach(spark: S, sf: str) -> DataFrame:
    vectors = X.entries(spark, sf).select("content_hash", F.col("id").alias("ord"), "embedding")
    made = chunking.chunk(X.plain_sections(spark, sf))
    got = enrich.attach_embeddings(made, vectors)
    return got.select("source_file", "chunk_index", F.round(F.element_at(F.col("embedding"), 1).cast("double"), 6).alias("first_component"))


def filter_chunks(spark: S, sf: str) -> DataFrame:
    """A classifier that SQL can express: relevant by length, as confident as its hash's first digit."""
    def judge(text: str) -> tuple[bool, float]:
        return len(text) % 2 == 0, (len(text) % 10) / 10

    made = chunking.chunk(X.plain_sections(spark, sf))
    kept = enrich.filter_chunks(made, judge, "keep what matters", 0.4)
    return kept.select("source_file", "chunk_index", F.length("content").alias("n_chars"))


def ingest_outcome(spark: S, sf: str) -> DataFrame:
    cases = X.ingest_cases(spark)
    made = enrich.outcome(F.col("dry_run"), F.col("has_store"), F.col("exists"), F.col("force"), F.col("answer") == "ok")
    return cases.select("*", made.alias("outcome"))


def ingest_summary(spark: S, sf: str) -> DataFrame:
    no, yes = F.lit(False), F.lit(True)
    made = _numbered(spark, sf).withColumn("outcome", enrich.outcome(no, yes, F.col("exists"), no, yes))
    return enrich.ingest_counts(made)


def corpus_stats(spark: S, sf: str) -> DataFrame:
    files = _scanned(spark, sf)
    made = chunking.chunk(parsing.sections_only(parsing.parse(files.select("path", "content"))))
    zero = F.lit(0).cast("long")
    sizes = files.select(F.lit(1).cast("long").alias("f"), zero.alias("c"), F.octet_length("content").cast("long").alias("b"))
    counted = made.select(zero.alias("f"), F.lit(1).cast("long").alias("c"), zero.alias("b"))
    return sizes.unionByName(counted).agg(F.sum("f").alias("file_count"), F.sum("c").alias("estimated_chunks"), F.sum("b").alias("total_bytes"))


def monitor_resolve(spark: S, sf: str) -> DataFrame:
    got = monitors.resolve(X.monitors(spark, sf), "/corpus/legacy").unionByName(monitors.resolve(X.monitors(spark, sf), "/corpus/src0"))
    return got.select("path", _joined("extensions", ",").alias("extensions"), "label")


def monitor_rollup(spark: S, sf: str) -> DataFrame:
    """Runs by source: failed when the source's number is divisible by five."""
    number = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    runs = X.table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n")).select(
        (number % 5 != 0).alias("success"), F.col("n").alias("files_scanned"), (F.col("n") % 7).alias("files_added"), (F.col("n") % 5).alias("files_changed"),
        (F.col("n") % 3).alias("files_removed"), (F.col("n") * 2).alias("chunks_created"), (F.col("n") % 11).alias("chunks_skipped"), F.lit(0).cast("long").alias("chunks_updated"))
    return monitors.roll_up(runs)


def monitor_status(spark: S, sf: str) -> DataFrame:
    return monitors.status(X.monitors(spark, sf), X.files(spark, sf))


QUERIES = {f.__name__: f for f in (
    scan_files, scan_hidden, file_fingerprint, scan_summary, manifest_key, manifest_diff, to_process, heading_level, section_path, md_sections,
    parse_markdown, parse_text, parse_dispatch, paragraphs, chunk_hard_split, chunk_pack, chunks, token_count, content_hash, question_hash,
    content_source, entry_payload, retire_tombstones, exists_map, embed_attach, filter_chunks, ingest_outcome, ingest_summary, corpus_stats,
    monitor_resolve, monitor_rollup, monitor_status,
)}
