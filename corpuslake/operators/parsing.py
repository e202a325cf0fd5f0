"""Sections of Markdown and text files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

def _outlined(files: DataFrame) -> DataFrame:
    """``files`` (path, content) with lines (with their line ends) and heads, one struct for each heading
    line: pos, level, title and the titles on the stack from there on.

    All of a file lies in its own row, so nothing is shuffled: a fold over the headings keeps
    one title for each depth, and a heading clears what is deeper."""
    lines = files.select("path", F.coalesce("content", F.lit("")).alias("content")).withColumn(
        "lines", F.filter(F.split("content", "(?<=\\n)", -1), lambda x: x != ""))
    found = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("pos"), T.heading_level(x).alias("level"), x.alias("line"))), lambda h: h["level"] > 0)
    lines = lines.select("path", "content", "lines", F.transform(found, lambda h: F.struct(h["pos"].alias("pos"), h["level"].alias("level"), T.heading_title(h["line"]).alias("title"))).alias("found"))
    stack = ", ".join(f"if(h.level = {d}, h.title, if(h.level < {d}, null, s.t{d})) AS t{d}" for d in range(1, 7))
    empty = ", ".join(f"cast(null AS string) AS t{d}" for d in range(1, 7))
    kind = "array<struct<" + ",".join(f"t{d}:string" for d in range(1, 7)) + ">>"
    folded = f"""
      aggregate(found, struct({empty}, cast(array() AS {kind}) AS out),
        (s, h) -> named_struct({", ".join(f"'t{d}', if(h.level = {d}, h.title, if(h.level < {d}, null, s.t{d}))" for d in range(1, 7))},
          'out', array_append(s.out, struct({stack}))),
        s -> s.out)"""
    lines = lines.withColumn("stacks", F.expr(folded))
    heads = F.transform("found", lambda h, i: F.struct(
        h["pos"].alias("pos"), h["level"].alias("level"), h["title"].alias("title"),
        F.array_compact(F.array(*[F.get(F.col("stacks"), i)[f"t{d}"] for d in range(1, 7)])).alias("path")))
    return lines.select("path", "content", "lines", heads.alias("heads"))


def markdown_headings(files: DataFrame) -> DataFrame:
    """path, pos (of the line), level, title and section_path of every heading of files (path, content)."""
    return _outlined(files).select("path", F.explode("heads").alias("h")).select("path", "h.pos", "h.level", "h.title", F.col("h.path").alias("section_path"))


def parse_markdown(files: DataFrame) -> DataFrame:
    """Sections (source_file, section_ord, heading, section_path, content) of files (path, content).

    Sections without content are left out; a file without any has one, of its whole text.
    A file's sections are made of its own row, in one pass."""
    outlined = _outlined(files).withColumn("stem", T.stem(F.col("path")))
    last = F.size("heads")
    head = lambda j: F.get(F.col("heads"), j - 1)

    def section(j):
        start = F.when(j > 0, head(j)["pos"] + 1).otherwise(0)
        end = F.coalesce(F.get(F.col("heads"), j)["pos"], F.size("lines"))
        return F.struct(
            j.cast("int").alias("section_ord"), F.when(j > 0, head(j)["title"]).otherwise(F.col("stem")).alias("heading"),
            F.coalesce(F.when(j > 0, head(j)["path"]), F.array().cast("array<string>")).alias("section_path"),
            T.strip(F.array_join(F.slice(F.col("lines"), start + 1, end - start), "")).alias("content"))

    whole = F.array(F.struct(F.lit(0).alias("section_ord"), F.col("stem").alias("heading"), F.array().cast("array<string>").alias("section_path"), T.strip(F.col("content")).alias("content")))
    made = outlined.select("path", "content", "stem", F.filter(F.transform(F.sequence(F.lit(0), last), section), lambda x: x["content"] != "").alias("made"))
    some = F.when(F.size("made") > 0, F.col("made")).otherwise(whole)
    return made.select(F.col("path").alias("source_file"), F.explode(some).alias("x")).select("source_file", "x.*")


def parse_text(files: DataFrame) -> DataFrame:
    """One section for each file."""
    return files.select(
        F.col("path").alias("source_file"), F.lit(0).alias("section_ord"), T.stem(F.col("path")).alias("heading"),
        F.array().cast("array<string>").alias("section_path"), T.strip(F.coalesce("content", F.lit(""))).alias("content"),
    )


Extractor = Callable[[str, bytes], "str | None"]


def extract_binary(files: DataFrame, extractor: Extractor | None = None) -> DataFrame:
    """Sections of binary files (path, raw) by an injected extractor; failures are error rows."""
    made = "source_file string, section_ord int, heading string, section_path array<string>, content string, error string, detail string"
    named = files.select("path", F.col("raw"), T.stem(F.col("path")).alias("heading"))
    if extractor is None:
        return named.select(F.col("path").alias("source_file"), *_error("unsupported format"))

    def run(frames):
        for frame in frames:
            rows = []
            for path, raw, heading in zip(frame["path"], frame["raw"], frame["heading"]):
                try:
                    got = extractor(path, bytes(raw) if raw is not None else b"")
                    if isinstance(got, str):
                        rows.append((path, 0, heading, [], got.strip(T.BLANKS), None, None))
                    else:
                        rows.append((path, 0, None, None, None, "extraction_failed", repr(got)))
                except Exception as error:  # a file's failure is its own row
                    rows.append((path, 0, None, None, None, "extraction_failed", str(error)))
            yield type(frame)(rows, columns=["source_file", "section_ord", "heading", "section_path", "content", "error", "detail"])

    return named.mapInPandas(run, made)


def _error(message: str) -> list:
    return [
        F.lit(0).alias("section_ord"), F.lit(None).cast("string").alias("heading"), F.lit(None).cast("array<string>").alias("section_path"),
        F.lit(None).cast("string").alias("content"), F.lit(message).alias("error"), F.lit(None).cast("string").alias("detail"),
    ]


def parse(files: DataFrame, extractor: Extractor | None = None) -> DataFrame:
    """Sections and error rows of files (path, content[, raw]), by extension."""
    kind = T.extension(F.col("path"))
    fine = [F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("detail")]
    raw = F.col("raw") if "raw" in files.columns else F.col("content").cast("binary")
    return (
        parse_markdown(files.where(kind == ".md")).select("*", *fine)
        .unionByName(parse_text(files.where(kind == ".txt")).select("*", *fine))
        .unionByName(extract_binary(files.where(kind.isin(".pdf", ".docx")).select("path", raw.alias("raw")), extractor))
        .unionByName(files.where(~kind.isin(".md", ".txt", ".pdf", ".docx")).select(F.col("path").alias("source_file"), *_error("unsupported format")))
    )


def sections_only(parsed: DataFrame) -> DataFrame:
    """Sections of files whose first section is not an error."""
    return parsed.where(F.col("error").isNull()).drop("error", "detail")


