"""From raw documents to packed training sequences, in five stages.

Each stage reads what the one before it wrote. The first four return the columns
of ``documents``; the last returns packed pieces. Null ids, null or empty texts,
very long texts, ties and repeated rows pass through as each stage says; an empty
table passes all stages as one; extra columns, whatever their names, go. Stages begin
with a heap that holds nothing of the stage before (``storage.trim``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm.bwt_dedup import remove_repeats
from corpuslake.llm.decontam import find_leaks
from corpuslake.llm.langid import predict, train
from corpuslake.llm.ngram_join import link_components
from corpuslake.llm.packing import pack
from corpuslake.llm.storage import cut, trim

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document is rejected when its text has no letter or its best language is less likely than this.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letter (null and empty texts too), or no language likelier than the rest.

    Repeated rows are judged alike; with no labelled row nothing is known, and all go. Texts of any length are scored whole."""
    trim(spark)
    trees = train(docs.select("doc_id", "lang", "text"))
    return predict(docs, trees).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component of near copies the document with the smallest id.

    A null id is larger than every number. Rows that tie have one id: of different texts the one with the smaller
    hash stays, of equal texts any. Texts without words are copies of nothing, and all stay. Texts of any length are
    compared whole.

    A row is told from others by its id and a hash of its text, which any scan gives alike, so no number has to hold
    from job to job and no copy of the texts is kept. Equal rows become one in their own task, before the shuffle."""
    trim(spark)
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    docs = docs.select(*COLUMNS).withColumns({"d": F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), "tag": F.xxhash64("text")})
    found = link_components(docs, id_col="d", tag_col="tag")
    least = F.min(F.struct(F.col("doc_id").alias("d"), "tag")).alias("least")
    kept = cut(found.where("component is not null").groupBy("component").agg(least).select("least.*"), "kept", found)
    rest = [c for c in COLUMNS if c != "doc_id"]
    each = docs.where(~wordless).groupBy("d", "tag").agg(F.first(F.struct("doc_id", *rest)).alias("row"))
    # The kept ids are as many as the documents, so texts meet them by a shuffle at every size.
    copied = each.join(kept.hint("shuffle_merge"), ["d", "tag"], "left_semi").select("row.*")
    return copied.unionByName(docs.where(wordless).select("doc_id", *rest)).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that a document with a smaller id has; n_chars follows.

    A null id is larger than every number; rows of one id are not smaller than each other, so repeated rows all stay
    as they are. Null texts stay null; a text may end up empty; texts of any length are read whole."""
    trim(spark)
    out = remove_repeats(docs.select(*COLUMNS), as_text=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    size = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumns({"text": text, "n_chars": size}).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item.

    Null and empty texts are clean, repeated rows are judged alike, texts of any length are read whole; an empty
    benchmark drops nothing."""
    trim(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_leaks(docs.select(*COLUMNS), benchmark).where("not contaminated").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left: null and empty texts as their end id, repeated rows each by itself, texts of any length whole."""
    trim(spark)
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontaminate", decontaminate),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name, docs)
    return docs


#: The tokenizer and the language model are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None
