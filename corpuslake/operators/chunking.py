"""Chunks of sections: greedy packing of paragraphs under a character budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..settings import Chunking

_DEFAULT = Chunking()


def paragraphs(content: Column) -> Column:
    """Paragraphs between blank lines; runs of line ends count once, empty ones do not count."""
    return F.filter(F.split(content, "\\n\\n+", -1), lambda p: p != "")


def hard_split(text: Column, most: int) -> Column:
    """Slices of ``most`` characters."""
    last = F.ceil(F.length(text) / F.lit(most)).cast("int") - 1
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substring(text, i * most + 1, F.lit(most)))).otherwise(F.array().cast("array<string>"))


def packed_ranges(lengths: str, most: int) -> Column:
    """Ranges (f, t, h) of paragraphs, by their lengths: one fold, whose state is an open range.

    A paragraph joins the open range if it fits with the two line ends between; else
    the range closes, and a paragraph that is too long by itself is hard (h)."""
    empty = "cast(array() as array<struct<f:int,t:int,h:boolean>>)"
    closed = "IF(s.f > 0, array_append(s.out, struct(s.f AS f, s.i AS t, false AS h)), s.out)"
    return F.expr(f"""
      aggregate({lengths}, struct(0 AS f, 0 AS n, 0 AS i, {empty} AS out), (s, n) ->
        CASE WHEN IF(s.f = 0, n, s.n + 2 + n) <= {most}
             THEN struct(IF(s.f = 0, s.i + 1, s.f) AS f, IF(s.f = 0, n, s.n + 2 + n) AS n, s.i + 1 AS i, s.out AS out)
             WHEN n > {most}
             THEN struct(0 AS f, 0 AS n, s.i + 1 AS i, array_append({closed}, struct(s.i + 1 AS f, s.i + 1 AS t, true AS h)) AS out)
             ELSE struct(s.i + 1 AS f, n AS n, s.i + 1 AS i, {closed} AS out) END,
        s -> {closed})
    """)


def chunk(sections: DataFrame, max_tokens: int | None = None, overlap_tokens: int | None = None,
          hash_fn: Callable[[Column], Column] = T.content_hash) -> DataFrame:
    """Chunks of sections (source_file, section_ord, heading, section_path, content).

    ``chunk_index`` counts within a section, so it does not name a chunk of a file.
    ``overlap_tokens`` is accepted and changes nothing. No shuffle: a section's
    chunks are made from its own row.
    """
    del overlap_tokens
    most = (max_tokens or _DEFAULT.max_tokens) * T.CHARS_PER_TOKEN
    with_parts = sections.withColumn("_p", paragraphs(F.col("content"))).withColumn("_n", F.transform("_p", lambda p: F.length(p)))
    ranged = with_parts.withColumn("_r", packed_ranges("_n", most))
    texts = F.flatten(F.transform("_r", lambda r: F.when(
        r["h"], hard_split(F.element_at("_p", r["f"]), most)
    ).otherwise(F.array(F.array_join(F.slice(F.col("_p"), r["f"], r["t"] - r["f"] + 1), "\n\n")))))
    out = ranged.select("source_file", "section_ord", "heading", "section_path", F.posexplode(texts).alias("chunk_index", "content"))
    return out.withColumns({"token_count": T.token_count(F.col("content")), "content_hash": hash_fn(F.col("content"))})
