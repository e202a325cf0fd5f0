"""Scalar expressions over text: all built in, none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is stripped from both ends of a text.
BLANKS = " \t\n\x0b\f\r\x00"
CHARS_PER_TOKEN = 4


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def content_hash(text: Column) -> Column:
    """MD5 of the text, stripped, in lower case, with white space collapsed."""
    return F.md5(F.regexp_replace(F.lower(strip(F.coalesce(text, F.lit("")))), r"[ \t\n\x0B\f\r]+", " "))


def token_count(text: Column) -> Column:
    return F.ceil(F.length(text) / F.lit(CHARS_PER_TOKEN)).cast("int")


def question_hash(question: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(question, F.lit("")), 256), 1, 16)


manifest_key = question_hash


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; empty for names without one, or that only start with a dot."""
    return F.lower(F.regexp_extract(basename(path), r"^\.*[^.].*(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    """File name without its last extension."""
    name = basename(path)
    return F.regexp_replace(name, r"^(\.*[^.].*)\.[^.]+$", "$1")


def heading_level(line: Column) -> Column:
    """1 to 6 for a heading line, else 0."""
    return F.length(F.regexp_extract(line, r"^(#{1,6})[ \t\n\x0B\f\r]", 1))


def heading_title(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(line, r"^#+[ \t\n\x0B\f\r]*", ""), r"(\r\n|\n|\r)\z", "")


def zero_embedding(vector: Column) -> Column:
    """No vector, an empty one, or all zeros."""
    return vector.isNull() | ~F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def hidden(relative: Column) -> Column:
    """Whether any part of a path, from the scan root's own name down, starts with a dot."""
    return relative.rlike(r"(^|/)\.")
