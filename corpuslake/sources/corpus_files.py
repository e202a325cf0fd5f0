"""Corpus folders as a Spark data source.

The driver lists names (stat calls only); executors read and hash the bytes, so
folders must be on a file system that all of them mount.
"""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import EXTENSIONS, FILE

#: Files of one partition: up to so many bytes or files.
PART_BYTES, PART_FILES = 64_000_000, 2_000


def walk(root: str, extensions: Sequence[str] = EXTENSIONS) -> Iterator[tuple[str, int, float]]:
    """(path, size, mtime) of regular files below ``root``, sorted by path.

    Names that start with a dot are skipped, the root's own included; so are other
    extensions, and whatever cannot be read. A root that is a file gives that file."""
    if os.path.basename(root.rstrip("/") or root).startswith("."):
        return
    try:
        info = os.stat(root)
        if stat.S_ISDIR(info.st_mode):
            for name in sorted(os.listdir(root)):
                yield from walk(os.path.join(root, name), extensions)
        elif stat.S_ISREG(info.st_mode) and os.path.splitext(root)[1].lower() in extensions:
            yield root, info.st_size, info.st_mtime
    except OSError:
        return


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.extensions = tuple(options.get("extensions", ",".join(EXTENSIONS)).split(","))
        self.with_content = options.get("content", "false").lower() == "true"

    def partitions(self) -> list[_Files]:
        parts: list[list[str]] = []
        size = PART_BYTES
        for path, n, _ in walk(self.root, self.extensions):
            if size >= PART_BYTES or len(parts[-1]) >= PART_FILES:
                parts.append([])
                size = 0
            parts[-1].append(path)
            size += n
        return [_Files(p) for p in parts] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                mtime = datetime.fromtimestamp(os.stat(path).st_mtime, timezone.utc)
                with open(path, "rb") as file:
                    raw = file.read()
            except OSError:  # gone, or not ours to read
                continue
            row = (path, len(raw), mtime, hashlib.sha256(raw).hexdigest())
            yield (*row, raw) if self.with_content else row


class CorpusFiles(DataSource):
    """``spark.read.format("corpus_files").load(folder)``; options ``extensions`` and ``content``."""

    @classmethod
    def name(cls) -> str:
        return "corpus_files"

    def schema(self) -> str:
        return FILE + (", raw binary" if self.options.get("content", "false").lower() == "true" else "")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def scan(spark: SparkSession, root: str, extensions: Sequence[str] = EXTENSIONS, content: bool = False) -> DataFrame:
    """path, size, mtime and sha256 of a folder's files, and their bytes if asked for."""
    spark.dataSource.register(CorpusFiles)
    reader = spark.read.format("corpus_files").option("extensions", ",".join(extensions)).option("content", str(content).lower())
    return reader.load(root)


def read_contents(paths: DataFrame) -> DataFrame:
    """``paths`` (path and other columns) with raw and content; files that are gone have null bytes."""
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in paths.schema]

    def run(frames):
        for frame in frames:
            raws, texts = [], []
            for path in frame["path"]:
                try:
                    with open(path, "rb") as file:
                        raw = file.read()
                except OSError:
                    raw = None
                raws.append(raw)
                texts.append(None if raw is None else raw.decode("utf-8", "replace"))
            yield frame.assign(raw=raws, content=texts)

    return paths.mapInPandas(run, ", ".join([*kept, "raw binary", "content string"]))
