"""Relations of the corpus model, derived from the driver's tables; the same as ``oracle.VIEWS``."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, parsing

AS_OF = datetime(2024, 2, 1)
QUERY_VECTOR_ID = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _start(unit: str):
    return F.expr(f"timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, {'cast(doc_id as int), 0' if unit == 'hours' else '0, cast(doc_id as int)'}, 0)")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, mtime and content of one file per document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    ext = F.when(F.col("doc_id") % 8 < 4, ".md").when(F.col("doc_id") % 8 < 6, ".txt").when(F.col("doc_id") % 8 == 6, ".MD").otherwise(".rb")
    dot = F.when(F.col("doc_id") % 29 == 0, ".").otherwise("")
    path = F.concat(F.lit("/corpus/"), "source", F.lit("/"), dot, F.col("doc_id").cast("string"), ext)
    return d.select("doc_id", path.alias("path"), _start("minutes").alias("mtime"), F.col("text").alias("content"))


def previous_files(spark: SparkSession, sf_dir: str, current: DataFrame) -> DataFrame:
    """(path, sha256) of a manifest before: some files missing, some with another hash, some gone since."""
    old = current.where("doc_id % 10 != 0").select("path", F.when(F.col("doc_id") % 10 == 1, F.lit("0")).otherwise(F.sha2(F.col("content").cast("binary"), 256)).alias("sha256"))
    gone = current.where("doc_id % 50 = 2").select(F.concat(F.lit("/corpus/gone/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.lit("1").alias("sha256"))
    return old.unionByName(gone)


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files (path, content) whose text has headings and paragraphs."""
    d = files(spark, sf_dir)
    lines = F.transform(
        F.split("content", "\n", -1),
        lambda line, n: F.when((F.col("doc_id") + n) % 5 == 0, F.concat(F.repeat(F.lit("#"), (1 + (F.col("doc_id") + n) % 4).cast("int")), F.lit(" "), line)).otherwise(line),
    )
    return d.select("doc_id", F.concat(F.lit("/md/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.array_join(lines, "\n\n").alias("content"))


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where(T.extension(F.col("path")) == ".txt").select("doc_id", "path", "content")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.parse_markdown(markdown(spark, sf_dir)).unionByName(parsing.parse_text(text_files(spark, sf_dir)))


def chunks(spark: SparkSession, sf_dir: str, max_tokens: int = 512) -> DataFrame:
    return chunking.chunk(sections(spark, sf_dir), max_tokens)


def plain_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One section per document: its whole text, stripped."""
    d = files(spark, sf_dir)
    return parsing.parse_text(d.select("path", "content"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk store, one row per document; every vector and every user's events are some entry's."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    seen = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("seen"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    users = table(spark, sf_dir, "events").agg(F.max("user_id") + 1).first()[0]
    stored = table(spark, sf_dir, "embeddings").agg(F.max("vec_id") + 1).first()[0]
    j = d.join(seen, F.col("doc_id") % users == F.col("user_id"), "left").join(vectors, F.col("doc_id") % stored == F.col("vec_id"), "left")
    i = F.col("doc_id")
    file = F.when(i % 43 != 0, F.concat(F.lit("/corpus/"), "source", F.lit(".md")))
    heading = F.concat(F.lit("h"), (i % 7).cast("string"))
    tags = F.when(i % 41 == 0, None).when(i % 13 == 0, F.array_compact(F.array(file, heading))).otherwise(F.array_compact(F.array(file, heading, F.lit("document_chunk"))))
    index = F.when(i % 11 == 0, 0).otherwise(F.floor(i / 20)).cast("int")
    context = F.struct(file.alias("source_file"), heading.alias("heading"), F.array(heading).alias("section_path"), index.alias("chunk_index"),
                       F.ceil(F.length("text") / 4).cast("int").alias("token_count"), F.lit(None).cast("boolean").alias("retired"))
    return j.select(
        i.alias("id"), F.col("text").alias("content"), F.when(i % 37 == 0, "observation").otherwise("document_chunk").alias("content_type"),
        T.content_hash(F.col("text")).alias("content_hash"), F.when(i % 17 != 0, (i % 100) / F.lit(100.0)).alias("confidence"), tags.alias("tags"),
        F.when(i % 10 == 0, "archived").when(i % 10 == 1, None).when(i % 10 < 5, "candidate").otherwise("confirmed").alias("status"),
        F.when(i % 19 != 0, F.coalesce("seen", F.lit(0))).alias("access_count"), F.when(i % 7 != 0, F.col("embedding")).alias("embedding"),
        F.lit("agent").alias("source_agent"), F.lit("docs").alias("knowledge_domain"), context.alias("context"),
        _start("hours").alias("created_at"), _start("hours").alias("updated_at"),
    )


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "query").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select(kind.alias("action"))


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """One stored vector, as the question's."""
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == QUERY_VECTOR_ID).select("embedding").first()[0])


def manifest_sources(spark: SparkSession, sf_dir: str, modulus: int, extra: str) -> DataFrame:
    """(path) of sources whose number is divisible by ``modulus``, and one more."""
    s = table(spark, sf_dir, "documents").select("source").distinct()
    some = s.where(F.regexp_extract("source", "([0-9]+)$", 1).cast("int") % modulus == 0)
    return some.select(F.concat(F.lit("/corpus/"), "source", F.lit(".md")).alias("path")).unionByName(spark.range(1).select(F.lit(extra).alias("path")))


def monitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("source").distinct()
    return s.select(F.concat(F.lit("/corpus/"), "source").alias("path"), F.array(F.lit(".md"), F.lit(".txt")).alias("extensions"), F.col("source").alias("label"))


def ingest_cases(spark: SparkSession) -> DataFrame:
    """Every combination of what decides a chunk's outcome: 16 flags by 5 answers of the store."""
    answers = F.array(*[F.lit(a) for a in ("ok", "failed", "no_success_key", "null", "exception")])
    flags = {n: (F.shiftright("id", b) % 2 == 1) for b, n in enumerate(("dry_run", "has_store", "exists", "force"))}
    return spark.range(16).select(*[c.alias(n) for n, c in flags.items()], F.explode(answers).alias("answer"))
