"""The chunk store: immutable Parquet segments and a pointer that lists the current ones.

An append writes one new segment. A change to rows writes the changed table as
a new segment and drops the old ones from the list. Readers see one list or the
other. A crash between the two leaves an unlisted segment, which does no harm.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import maintenance
from ..schemas import ENTRY
from . import scratch


class ChunkStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._pointer = f"{self.path}/segments.json"

    def _state(self) -> dict:
        text = scratch.read_text(self.spark, self._pointer)
        return json.loads(text) if text else {"segments": [], "next_id": 0}

    def _publish(self, segments: list[str], next_id: int) -> None:
        scratch.write_text(self.spark, self._pointer, json.dumps({"segments": segments, "next_id": next_id}))

    def entries(self) -> DataFrame:
        segments = self._state()["segments"]
        reader = self.spark.read.schema(ENTRY)
        return reader.parquet(*[f"{self.path}/{s}" for s in segments]) if segments else self.spark.createDataFrame([], ENTRY)

    def append(self, payload: DataFrame, status: str = "confirmed", confidence: float | None = 0.5) -> int:
        """Add rows of ``entry_payload`` or ``tombstones``; returns how many were written."""
        state, name = self._state(), f"segment-{uuid.uuid4().hex}"
        now = F.lit(datetime.now(timezone.utc))
        rows = payload.withColumn("id", F.monotonically_increasing_id() + state["next_id"])
        given = {
            "confidence": F.lit(confidence), "status": F.lit(status), "access_count": F.lit(0), "source_agent": F.lit(None),
            "knowledge_domain": F.lit(None), "created_at": now, "updated_at": now,
        }
        want = self.spark.createDataFrame([], ENTRY).schema
        columns = [(F.col(f.name) if f.name in rows.columns else given[f.name]).cast(f.dataType).alias(f.name) for f in want]
        rows.select(*columns).write.parquet(f"{self.path}/{name}")
        written = self.spark.read.schema(ENTRY).parquet(f"{self.path}/{name}").agg(F.count("*"), F.max("id")).first()
        if written[0]:
            self._publish([*state["segments"], name], written[1] + 1)
        return written[0]

    def archive(self, files: DataFrame) -> int:
        """Archive live chunks of ``files`` (source_file); returns how many rows changed."""
        state, before = self._state(), self.entries()
        name = f"segment-{uuid.uuid4().hex}"
        stamp = datetime.now(timezone.utc).replace(tzinfo=None)
        after = maintenance.archive(before, files, stamp)
        after.write.parquet(f"{self.path}/{name}")
        was = before.where("status = 'archived'").count()
        now = self.spark.read.schema(ENTRY).parquet(f"{self.path}/{name}").where("status = 'archived'").count()
        self._publish([name], state["next_id"])
        return now - was


class EventLog:
    """Append-only rows of one schema."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        found = scratch.exists(self.spark, self.path)
        return self.spark.read.schema(self.schema).parquet(self.path) if found else self.spark.createDataFrame([], self.schema)
