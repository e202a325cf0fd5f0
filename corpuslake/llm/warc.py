"""Content-addressed WARC archive.

Payload bytes are stored once each, in ``payloads`` under a SHA-256 digest; the
exact head of every record (WARC header lines and, for responses, the HTTP
head) is stored in ``records``. Whole records come back from a join of the two.

Null text is an empty payload; a null id is kept, and can be a response, but
orders before every number. Rows that repeat an id are records of their own; of
such ties one is the response and the others revisit it. An empty table gives
an archive without records. Extra columns are ignored. A record whose payload is
lost or altered is an error when it is read, never a missing row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import cut, discard, fresh_path, write_table

#: Payloads shorter than this are never written as revisits.
REVISIT_MIN_BYTES = 1000
#: Fixed so that an archive of the same rows has the same bytes.
WARC_DATE = "2024-01-01T00:00:00Z"
_EOL = "\r\n"


@dataclass(frozen=True)
class Archive:
    """Where the two tables of an archive lie."""

    path: str

    @property
    def payloads(self) -> str:
        return f"{self.path}/payloads"

    @property
    def records(self) -> str:
        return f"{self.path}/records"


def _head() -> F.Column:
    """The exact head of a record as text, from its columns."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_EOL))
    sha1 = F.concat(F.lit("sha1:"), F.col("sha1"))
    record_id = lambda seq: F.concat(F.lit("<urn:corpuslake:record:"), seq.cast("string"), F.lit(">"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: "),
        F.col("n_bytes").cast("string"),
        F.lit(_EOL * 2),
    )
    revisit = F.col("kind") == "revisit"
    block = F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes") + F.octet_length(http))
    return F.concat(
        F.lit(f"WARC/1.1{_EOL}"),
        line("WARC-Type", F.col("kind")),
        line("WARC-Record-ID", record_id(F.col("seq"))),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]", "")),
        line("WARC-Date", F.lit(WARC_DATE)),
        line("WARC-Payload-Digest", sha1),
        F.when(
            revisit,
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("WARC-Refers-To", record_id(F.col("owner_seq"))),
                line("X-Refers-To-Id", F.coalesce(F.col("owner_id").cast("string"), F.lit(""))),
            ),
        ).otherwise(line("Content-Type", F.lit("application/http; msgtype=response"))),
        line("X-Id", F.coalesce(F.col("id").cast("string"), F.lit(""))),
        line("Content-Length", block.cast("string")),
        F.lit(_EOL),
        F.when(revisit, F.lit("")).otherwise(http),
    )


def write_archive(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html",
    revisit_min_bytes: int = REVISIT_MIN_BYTES,
) -> Archive:
    """Write one record per row of ``pages`` and each distinct payload once.

    Who owns a payload is settled on digests alone: one aggregation that is
    combined before the shuffle, so a payload with a third of all rows is a few
    rows there, as it is where payloads are stored.
    """
    archive, spark = Archive(path), pages.sparkSession
    payload = F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # Rows are numbered once, in a table: every later step sees the same numbers.
    size = F.octet_length("payload").cast("long")
    slim = rows.select("id", "url", F.monotonically_increasing_id().alias("seq"), size.alias("n_bytes"), "digest", F.sha1("payload").alias("sha1"))
    slim = cut(slim, "rows")
    owners = (
        slim.groupBy("digest")
        .agg(F.max(F.struct(F.coalesce("id", F.lit(-(2**63))).alias("o"), "seq", "id")).alias("owner"))
        .select(F.reverse("digest").alias("rd"), F.col("owner.id").alias("owner_id"), F.col("owner.seq").alias("owner_seq"))
    )
    heads = slim.withColumn("rd", F.reverse("digest")).join(owners, "rd").drop("rd")
    kind = F.when((F.col("n_bytes") >= revisit_min_bytes) & (F.col("seq") != F.col("owner_seq")), "revisit").otherwise("response")
    write_table(heads.withColumn("kind", kind).select("seq", "digest", _head().alias("head")), archive.records)
    # Payloads of a digest are all the same: each task keeps one before the shuffle.
    write_table(rows.groupBy("digest").agg(F.first("payload").alias("payload")), archive.payloads)
    discard(slim)
    return archive


def read_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """Every record, whole: seq, head (text), digest, payload, payload_digest (SHA-1) and ``record``, its exact bytes.

    A revisit's ``record`` is its head alone; its payload is that of the record it refers to.
    Payloads are checked against their digests once each, before records meet them."""
    wrong = lambda *what: F.raise_error(F.concat(*what)).cast("string")
    checked = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("digest")).otherwise(wrong(F.lit("payload does not match digest "), F.col("digest")))
    stored = spark.read.parquet(archive.payloads).select(F.reverse(checked).alias("rd"), "payload", F.sha1("payload").alias("payload_digest"))
    records = spark.read.parquet(archive.records).withColumn("rd", F.reverse("digest")).join(stored, "rd", "left").drop("rd")
    there = F.when(F.col("payload").isNotNull(), F.col("payload_digest")).otherwise(wrong(F.lit("payload is lost: "), F.col("digest")))
    tail = F.encode(F.lit(_EOL * 2), "utf-8")
    body = F.when(_field("WARC-Type") == "revisit", F.encode(F.lit(""), "utf-8")).otherwise(F.col("payload"))
    return records.withColumns({"payload_digest": there, "record": F.concat(F.encode("head", "utf-8"), body, tail)})


def _field(name: str) -> F.Column:
    return F.regexp_extract("head", f"\\r\\n{name}: ([^\\r]*)\\r\\n", 1)


def read_index(spark: SparkSession, archive: Archive) -> DataFrame:
    """Per record: id, payload_bytes, payload_digest, record_type, refers_to.

    Read back from whole records: a digest that is not the payload's, or a record that
    is not as long as it says, is an error.
    """
    number = lambda name: F.when(_field(name) != "", _field(name).cast("long"))
    whole = F.octet_length("record") == F.octet_length(F.encode(F.substring_index("head", _EOL * 2, 1), "utf-8")) + number("Content-Length") + 8
    same = _field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("payload_digest"))
    return read_records(spark, archive).select(
        number("X-Id").alias("id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(same & whole, F.col("payload_digest"))
        .otherwise(F.raise_error(F.lit("a record's digest or length differs from its payload's")).cast("string"))
        .alias("payload_digest"),
        _field("WARC-Type").alias("record_type"),
        number("X-Refers-To-Id").alias("refers_to"),
    )


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: archive all of ``pages``, then read the archive back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archive = write_archive(pages, fresh_path(spark, "warc"))
    return read_index(spark, archive).withColumnRenamed("id", "page_id")


OP1_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, encode(coalesce(html, '')) AS raw FROM pages
), d AS (
  SELECT page_id, octet_length(raw)::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
         max(page_id) OVER (PARTITION BY html) AS owner FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> owner THEN owner END AS refers_to
FROM d
"""
