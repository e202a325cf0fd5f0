"""The public face: one object with every call. Calls return dicts and do not raise."""

from __future__ import annotations

import functools
import os
import time
from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import chunking, enrich, maintenance, manifest, parsing, retrieval
from .schemas import ENTRY, EXTENSIONS, FEEDBACK
from .settings import Settings
from .sources import corpus_files
from .sources.manifest_store import ManifestStore, MonitorStore
from .sources.store import ChunkStore, EventLog

_COUNTS = ("files_scanned", "files_added", "files_changed", "files_removed", "chunks_created", "chunks_skipped", "chunks_updated")


def _guarded(call):
    """A failure becomes an answer that says so."""

    @functools.wraps(call)
    def run(*args, **kwargs):
        try:
            return call(*args, **kwargs)
        except Exception as error:
            return {"success": False, "error": str(error)}

    return run


class Engine:
    """``store_path`` None means no store: ingest counts chunks as created, queries find nothing.

    ``embedder``: texts -> vectors; ``classifier``: (text, prompt) -> (relevant, confidence);
    ``extractor``: (path, bytes) -> text; ``synthesizer``: prompt -> answer; ``hash_fn``:
    column of content -> column of its hash. Manifests and monitors lie in the settings'
    ``manifest_dir``, else beside the store, else in the user's home."""

    def __init__(self, spark: SparkSession, settings: Settings | None = None, store_path: str | None = None, embedder: enrich.Embedder | None = None,
                 classifier: enrich.Classifier | None = None, extractor: parsing.Extractor | None = None, synthesizer: Callable[[str], str] | None = None,
                 hash_fn: Callable[[Column], Column] = T.content_hash):
        self.spark, self.settings = spark, settings or Settings()
        self.store = ChunkStore(spark, store_path) if store_path else None
        self.feedback = EventLog(spark, f"{store_path}/feedback", FEEDBACK) if store_path else None
        self.access_log = EventLog(spark, f"{store_path}/access_log", "action string") if store_path else None
        home = self.settings.manifest_dir or (f"{store_path.rstrip('/')}/manifests" if store_path else "~/.corpuslake/manifests")
        self.manifests, self.monitors = ManifestStore(spark, home), MonitorStore(spark, home)
        self.embedder, self.classifier, self.extractor, self.synthesizer = embedder, classifier, extractor, synthesizer
        self.hash_fn = hash_fn

    # ------------------------------------------------------------ ingest

    @_guarded
    def scan_corpus(self, path: str, extensions: Sequence[str] = EXTENSIONS) -> dict:
        found = list(corpus_files.walk(path, tuple(extensions)))
        return {"success": True, "path": path, "file_count": len(found), "total_bytes": sum(n for _, n, _ in found), "files": [p for p, _, _ in found]}

    @_guarded
    def ingest_corpus(self, path: str | None = None, monitors: Sequence[dict] | None = None, dry_run: bool = False, force: bool = False, filter: bool = True) -> dict:
        if monitors:
            runs = [self._guarded_path(m["path"], dry_run, force, filter) for m in monitors]
            sums = {c: sum(r.get(c, 0) for r in runs if r["success"]) for c in _COUNTS}
            return {"success": True, "monitors_processed": len(runs), **sums}
        if path is None:
            return {"success": False, "error": "path is required when monitors is not provided"}
        return self._guarded_path(path, dry_run, force, filter)

    @_guarded
    def _guarded_path(self, path: str, dry_run: bool, force: bool, filter: bool) -> dict:
        current = corpus_files.scan(self.spark, path).persist()
        try:
            previous = self.spark.createDataFrame([], "path string, sha256 string") if force else self.manifests.load(path)
            delta = manifest.diff(current, previous).persist()
            changes = {r["change"]: r["count"] for r in delta.groupBy("change").count().collect()}
            counts = self._process(manifest.to_process(delta), dry_run, force, filter)
            if not dry_run:
                if self.store and changes.get("removed"):
                    self.store.append(enrich.tombstones(delta.where("change = 'removed'")), confidence=None)
                if not self.manifests.save(path, current):
                    raise OSError("manifest was not saved")
            delta.unpersist()
            files = {"files_scanned": current.count(), **{f"files_{c}": changes.get(c, 0) for c in ("added", "changed", "removed")}}
            return {"success": True, **files, **counts}
        finally:
            current.unpersist()

    def _process(self, paths: DataFrame, dry_run: bool, force: bool, filter: bool) -> dict:
        """Parse, chunk, filter, dedup, embed and store the files of ``paths`` (path, file_seq)."""
        files = corpus_files.read_contents(paths).where("raw is not null")  # files may go meanwhile
        return self._ingest_files(files, paths, dry_run, force, filter)

    def _ingest_files(self, files: DataFrame, paths: DataFrame, dry_run: bool, force: bool, filter: bool) -> dict:
        parsed = parsing.sections_only(parsing.parse(files.select("path", "content", "raw"), self.extractor))
        made = chunking.chunk(parsed, self.settings.chunker.max_tokens, hash_fn=self.hash_fn).join(paths.select(F.col("path").alias("source_file"), "file_seq"), "source_file").persist()
        settings = self.settings.ingest
        kept = enrich.filter_chunks(made, self.classifier, settings.filter_prompt, settings.filter_threshold, filter).persist()
        total, passed = made.count(), kept.count()
        counts = {"chunks_created": 0, "chunks_skipped": total - passed, "chunks_updated": 0}
        if dry_run or self.store is None:
            counts["chunks_created"] = passed
        else:
            marked = enrich.mark_existing(kept, self.store.entries(), force)
            fresh = marked if force else enrich.seen_earlier(marked).where("not exists")
            written = self.store.append(enrich.entry_payload(enrich.embed(fresh, self.embedder)))
            counts["chunks_updated" if force else "chunks_created"] = written
            counts["chunks_skipped"] += passed - written
        made.unpersist()
        kept.unpersist()
        return counts

    @_guarded
    def ingest_file(self, file_path: str, force: bool = False, filter: bool = True) -> dict:
        if not os.path.isfile(file_path):
            raise FileNotFoundError(f"No such file: {file_path}")
        one = self.spark.createDataFrame([(file_path, "0:")], "path string, file_seq string")
        return {"success": True, "file": file_path, **self._process(one, False, force, filter)}

    def ingest_content(self, content: str, source_type: str = "text", metadata: dict | None = None) -> dict:
        """Chunks a text that has no file; the metadata is echoed, not stored."""
        said = {"source_type": source_type, "metadata": metadata or {}}
        try:
            name = F.concat(F.lit(f"content://{source_type}/"), F.uuid())
            section = self.spark.createDataFrame([(content, 0)], "content string, section_ord int").select(
                name.alias("source_file"), "section_ord", F.lit(source_type).alias("heading"), F.array(F.lit(source_type)).alias("section_path"), "content")
            made = chunking.chunk(section, self.settings.chunker.max_tokens, hash_fn=self.hash_fn)
            settings = self.settings.ingest
            kept = enrich.filter_chunks(made, self.classifier, settings.filter_prompt, settings.filter_threshold).persist()
            count = kept.count()
            if self.store is not None:
                fresh = enrich.mark_existing(kept, self.store.entries()).where("not exists")
                self.store.append(enrich.entry_payload(enrich.embed(fresh, self.embedder)))
            return {"status": "ingested", "chunks": count, **said}
        except Exception as error:
            return {"status": "failed", "error": str(error), **said}

    # ------------------------------------------------------------ query

    _RESULT = ("rank", "id", "content", "content_hash", "source_file", "heading", "chunk_index", *retrieval.CARRIED, "embedding", "distance", "context")

    def _retrieve(self, question: str, top_k: int | None, expand: bool, radius: int | None) -> DataFrame:
        """Retrieved chunks by rank: at most the windows of ``top_k`` hits, kept in memory."""
        entries = self._entries()
        names = ("source_file", "chunk_index", "heading")
        vector = list(self.embedder([question]))[0] if self.store is not None and self.embedder is not None else []
        hits = retrieval.top_k(entries, vector, top_k or self.settings.query.top_k)
        hits = retrieval.resolve_context(hits.withColumn("context", F.struct(*[F.col(f"context.{n}").alias(n) for n in names])), entries)
        radius = self.settings.query.neighbor_radius if radius is None else int(radius)
        if expand and radius > 0:
            merged = retrieval.merge_neighbors(retrieval.neighbors(hits, entries, radius))
            place = Window.orderBy("hit_rank", "chunk_index", "id")  # at most top_k windows
            hits = merged.withColumns({"rank": F.row_number().over(place), "embedding": F.lit(None).cast("array<float>"), "context": F.struct(*names)})
        return hits.select(*self._RESULT).persist()

    @staticmethod
    def _metadata(rows: DataFrame) -> dict:
        got = retrieval.result_metadata(rows).first().asDict()
        ends = lambda n: None if (low := got.pop(f"{n}_min")) is None else [low, got.pop(f"{n}_max")]
        got |= {"confidence_range": ends("confidence"), "distance_range": ends("distance"), "statuses": {r["status"]: r["n"] for r in retrieval.status_counts(rows).collect()}}
        return {n: v for n, v in got.items() if not n.endswith(("_min", "_max"))}

    @staticmethod
    def _sources(rows: DataFrame) -> list[dict]:
        return [r.asDict() for r in retrieval.format_source(rows.orderBy("rank")).collect()]

    @_guarded
    def retrieve(self, question: str, top_k: int | None = None, expand_neighbors: bool = False, neighbor_radius: int | None = None) -> dict:
        rows = self._retrieve(question, top_k, expand_neighbors, neighbor_radius)
        try:
            return {"success": True, "sources": self._sources(rows), "metadata": self._metadata(rows)}
        finally:
            rows.unpersist()

    @_guarded
    def query(self, question: str, top_k: int | None = None, synthesize: bool = True, expand_neighbors: bool = False, neighbor_radius: int | None = None) -> dict:
        started = time.monotonic()
        rows = self._retrieve(question, top_k, expand_neighbors, neighbor_radius)
        try:
            answer, synthesized = None, synthesize and self.synthesizer is not None
            if synthesized:
                prompt = retrieval.joined_contents(rows).select(retrieval.synthesis_prompt(F.lit(question), F.col("context"))).first()[0]
                try:
                    answer = self.synthesizer(prompt)
                except Exception:  # an answer is optional
                    answer = None
            sources = self._sources(rows)
            metadata = self._metadata(rows) | {"latency_ms": round((time.monotonic() - started) * 1000)}
            if sources:
                ids = [r["id"] for r in rows.where("id is not null").orderBy("rank").select("id").collect()]
                self.record_feedback(question, ids, metadata["retrieval_score"] or 0.0, synthesized)
            return {"success": True, "answer": answer, "sources": sources, "metadata": metadata}
        finally:
            rows.unpersist()

    @_guarded
    def record_feedback(self, question: str, chunk_ids: Sequence[int], retrieval_score: float, synthesized: bool = True, rating: int | None = None) -> dict:
        row = self.spark.createDataFrame([(question, list(chunk_ids), retrieval_score, synthesized, rating)], FEEDBACK.replace("question_hash", "question", 1))
        events = retrieval.feedback_events(row)
        if self.feedback is not None:
            self.feedback.append(events)
        return {"success": True, "question_hash": events.first()["question_hash"], "rating": rating}

    # ------------------------------------------------------------ corpus and maintenance

    def manifest_path(self, path: str) -> str:
        return self.manifests.path(path)

    @_guarded
    def corpus_stats(self, path: str, extensions: Sequence[str] = EXTENSIONS) -> dict:
        if not os.path.exists(path):
            return {"success": False, "error": "path does not exist"}
        scanned = self.scan_corpus(path, extensions)
        files = corpus_files.scan(self.spark, path, extensions, content=True).withColumn("content", F.col("raw").cast("string"))
        made = chunking.chunk(parsing.sections_only(parsing.parse(files.select("path", "content", "raw"), self.extractor)), self.settings.chunker.max_tokens)
        return {"success": True, "path": path, "file_count": scanned["file_count"], "estimated_chunks": made.count(), "total_bytes": scanned["total_bytes"]}

    def _entries(self) -> DataFrame:
        return self.store.entries() if self.store is not None else self.spark.createDataFrame([], ENTRY)

    @_guarded
    def detect_orphans(self, path: str) -> dict:
        entries, known = self._entries(), self.manifests.load(path).select("path").distinct()
        files = [r[0] for r in maintenance.orphans(entries, known).orderBy("source_file").toLocalIterator()]
        return {
            "success": True, "orphan_count": len(files), "orphan_files": files,
            "total_chunks": maintenance.live_count(entries).first()[0], "total_manifest_files": known.count(),
        }

    @_guarded
    def cleanup_orphans(self, path: str, dry_run: bool = True) -> dict:
        found = self.detect_orphans(path)
        if not found["success"]:
            return found
        if not found["orphan_count"]:
            return found | {"archived": 0, "files_cleaned": 0, "dry_run": dry_run}
        if dry_run:
            return found | {"archived": found["orphan_count"], "files_cleaned": found["orphan_count"], "dry_run": True}
        known = self.manifests.load(path).select("path").distinct()
        archived = self.store.archive(maintenance.orphans(self._entries(), known)) if self.store else 0
        return {"success": True, "archived": archived, "files_cleaned": found["orphan_count"], "dry_run": False}

    @_guarded
    def reindex(self, path: str) -> dict:
        self.manifests.delete(path)
        return self.ingest_corpus(path, force=True)

    @_guarded
    def health(self, path: str | None = None) -> dict:
        path = path or self.settings.corpus_path
        if not path:
            return {"success": False, "error": "corpus_path is required"}
        scanned, saved, entries = self.scan_corpus(path), self.manifests.saved_at_ms(path), self._entries()
        stats = maintenance.store_health(entries, self.settings.maintenance.stale_threshold).first().asDict()
        stats["confidence_range"] = [stats.pop("confidence_min"), stats.pop("confidence_max")]
        stats["by_status"] = {r["status"]: r["n"] for r in maintenance.count_by_status(entries).collect()}
        files = self.spark.createDataFrame([(p,) for p in scanned["files"]], "path string")
        iso = datetime.fromtimestamp(saved / 1000, timezone.utc).isoformat() if saved else None
        local = {"corpus_path": path, "file_count": scanned["file_count"], "total_bytes": scanned["total_bytes"], "manifest_exists": saved is not None, "last_ingest": iso}
        sync = maintenance.sync_counts(entries, self.manifests.load(path).select("path").distinct(), files).first().asDict()
        return {"success": True, "local": local, "store": stats, "sync": sync}

    @_guarded
    def quality_report(self, limit: int | None = None, as_of: datetime | None = None) -> dict:
        s, entries = self.settings.maintenance, self._entries()
        limit, as_of = limit or s.quality_report_limit, as_of or datetime.now(timezone.utc).replace(tzinfo=None)
        rows = lambda df: [r.asDict() for r in df.collect()]
        log = self.access_log.read() if self.access_log is not None else self.spark.createDataFrame([], "action string")
        return {
            "success": True, "hot_chunks": rows(maintenance.hot_chunks(entries, limit)), "cold_chunks": rows(maintenance.cold_chunks(entries, as_of, s.cold_chunk_days, limit)),
            "low_confidence": rows(maintenance.low_confidence(entries, s.stale_threshold, limit)), "poor_retrieval": [],
            "summary": maintenance.quality_summary(entries, log, s.stale_threshold).first().asDict(),
        }

    # ------------------------------------------------------------ monitors

    def resolve_monitors(self) -> list[dict]:
        """Registered monitors, read anew, and the legacy folder unless one has its path."""
        legacy = self.settings.corpus_path
        found = self.monitors.load()
        if legacy and all(m["path"] != legacy for m in found):
            found.append({"path": legacy, "extensions": list(EXTENSIONS), "label": "legacy"})
        return found

    @_guarded
    def add_monitor(self, path: str, extensions: Sequence[str] | None = None, label: str | None = None) -> dict:
        full = os.path.abspath(os.path.expanduser(path))
        if not os.path.isdir(full):
            return {"success": False, "error": f"Path {full} does not exist or is not a directory"}
        known = self.monitors.load()
        if any(m["path"] == full for m in known):
            return {"success": False, "error": f"Path {full} is already registered"}
        added = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        made = {"path": full, "extensions": list(extensions or (".md", ".txt")), "label": label or os.path.basename(full), "added_at": added}
        self.monitors.save([*known, made])
        return {"success": True, "monitor": made}

    @_guarded
    def remove_monitor(self, identifier: str) -> dict:
        known = self.monitors.load()
        for m in known:
            if identifier in (m["path"], m["label"]):
                self.monitors.save([x for x in known if x is not m])
                return {"success": True, "removed": m}
        return {"success": False, "error": f"Monitor '{identifier}' not found"}

    def list_monitors(self) -> dict:
        return {"success": True, "monitors": self.resolve_monitors()}

    @_guarded
    def monitor_status(self) -> dict:
        monitors = self.resolve_monitors()
        return {"success": True, "total_monitors": len(monitors), "total_files": sum(sum(1 for _ in corpus_files.walk(m["path"], tuple(m["extensions"]))) for m in monitors)}

    # ------------------------------------------------------------ continuous

    def watch(self, checkpoint: str):
        """Ingest all monitors every ``watcher_seconds``; None when there are none."""
        from .streaming.ingest import scheduled

        if not self.resolve_monitors():
            return None
        return scheduled(self.spark, lambda: self.ingest_corpus(monitors=self.resolve_monitors()), self.settings.schedules.watcher_seconds, checkpoint)

    def maintain(self, checkpoint: str):
        """Check health every ``maintenance_seconds``, of the corpus or else the first monitor; None without either."""
        from .streaming.ingest import scheduled

        path = self.settings.corpus_path or next((m["path"] for m in self.resolve_monitors()), None)
        return scheduled(self.spark, lambda: self.health(path), self.settings.schedules.maintenance_seconds, checkpoint) if path else None

    def consume(self, messages: DataFrame, checkpoint: str, available_now: bool = False):
        """Ingest the files that a stream of messages (path[, content]) names, with this engine's hooks."""
        from .streaming.ingest import subscribe

        def handle(batch: DataFrame, _number: int) -> None:
            seen = batch.where("path is not null").withColumn("file_seq", F.concat(F.lit("0:"), "path"))
            if "content" in batch.columns:  # of several messages for a path any one stands
                given = seen.where("content is not null").groupBy("path", "file_seq").agg(F.first("content").alias("content"))
                self._ingest_files(given.withColumn("raw", F.col("content").cast("binary")), given, False, False, True)
                seen = seen.where("content is null")
            self._process(seen.select("path", "file_seq").distinct(), False, False, True)

        return subscribe(messages, handle, checkpoint, available_now)

    def on_reload(self, messages: DataFrame, checkpoint: str, changed: Callable[[list[dict]], None], available_now: bool = False):
        """Call ``changed`` with the monitors, read anew, for every batch of reload messages.

        A running ``watch`` needs no message: it reads the monitors at every tick."""
        from .streaming.ingest import subscribe

        def handle(batch: DataFrame, _number: int) -> None:
            if batch.limit(1).count():
                changed(self.resolve_monitors())

        return subscribe(messages, handle, checkpoint, available_now)
