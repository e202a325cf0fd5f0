"""Manifests kept between runs: one snapshot folder per corpus, and a pointer to the current one."""

from __future__ import annotations

import hashlib
import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MANIFEST
from . import scratch


class ManifestStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = os.path.expanduser(folder).rstrip("/") if folder.startswith("~") else folder.rstrip("/")

    def path(self, corpus_path: str) -> str:
        """Where a corpus' pointer lies. The name comes from the path as given: ``/a`` is not ``/a/``."""
        return f"{self.folder}/{hashlib.sha256(corpus_path.encode()).hexdigest()[:16]}.manifest.json"

    def load(self, corpus_path: str) -> DataFrame:
        """The last manifest; empty when there is none or it cannot be read."""
        empty = self.spark.createDataFrame([], MANIFEST)
        try:
            text = scratch.read_text(self.spark, self.path(corpus_path))
            found = json.loads(text)["snapshot"] if text else None
            return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/{found}") if found else empty
        except Exception:  # corrupt: start anew
            return empty

    def save(self, corpus_path: str, manifest: DataFrame) -> bool:
        """Write a snapshot, then point to it at once; False if either fails."""
        pointer = self.path(corpus_path)
        name = f"{os.path.basename(pointer).split('.')[0]}/{uuid.uuid4().hex}"
        try:
            manifest.select("path", "size", F.col("mtime").cast("string").alias("mtime"), "sha256").write.parquet(f"{self.folder}/{name}")
            scratch.write_text(self.spark, pointer, json.dumps({"snapshot": name}))
            return True
        except Exception:
            return False

    def delete(self, corpus_path: str) -> None:
        scratch.delete(self.spark, self.path(corpus_path))

    def saved_at_ms(self, corpus_path: str) -> int | None:
        return scratch.modified_ms(self.spark, self.path(corpus_path))


class MonitorStore:
    """The registered monitors, one small file that every engine of an installation reads anew."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.file = f"{ManifestStore(spark, folder).folder}/monitors.json"

    def load(self) -> list[dict]:
        """The monitors; none if the file is not there or cannot be read."""
        try:
            text = scratch.read_text(self.spark, self.file)
            return json.loads(text) if text else []
        except Exception:  # corrupt: start anew
            return []

    def save(self, monitors: list[dict]) -> None:
        scratch.write_text(self.spark, self.file, json.dumps(monitors))
