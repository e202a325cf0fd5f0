"""The public calls over real folders."""

import os

import pytest
from pyspark.sql import functions as F

from corpuslake.engine import Engine
from corpuslake.operators import enrich, maintenance, parsing, retrieval
from corpuslake.schemas import ENTRY
from corpuslake.settings import Ingesting, Settings
from corpuslake.sources import corpus_files


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "corpus"
    (root / "deep").mkdir(parents=True)
    (root / ".git").mkdir()
    (root / "one.md").write_text("# A\naaaa\n## B\nbbbb\n# Empty\n")
    (root / "two.TXT").write_text("cccc " * 10)
    (root / "deep" / "_draft.md").write_text("dddd")
    (root / "deep" / "bad.pdf").write_bytes(b"%PDF")
    (root / ".hidden.md").write_text("x")
    (root / ".git" / "c.md").write_text("x")
    (root / "skip.rb").write_text("x")
    return root


@pytest.fixture
def engine(spark, tmp_path):
    def embed(texts):
        return [[float(t.count(c)) + 0.01 for c in "abcd"] for t in texts]

    settings = Settings(manifest_dir=str(tmp_path / "manifests"))
    return Engine(spark, settings, str(tmp_path / "store"), embedder=embed)


def test_scan(spark, corpus):
    names = [os.path.relpath(p, corpus) for p, _, _ in corpus_files.walk(str(corpus))]
    assert names == ["deep/_draft.md", "deep/bad.pdf", "one.md", "two.TXT"]
    assert {r.path for r in corpus_files.scan(spark, str(corpus)).collect()} == {str(corpus / n) for n in names}
    assert list(corpus_files.walk(str(corpus / ".git"))) == [] and list(corpus_files.walk(str(corpus / "none"))) == []
    assert [p for p, _, _ in corpus_files.walk(str(corpus / "one.md"))] == [str(corpus / "one.md")]


def test_ingest_delta_and_retire(engine, corpus):
    path = str(corpus)
    dry = engine.ingest_corpus(path, dry_run=True)
    assert dry["success"] and dry["chunks_created"] == 4 and engine.manifests.saved_at_ms(path) is None
    first = engine.ingest_corpus(path)
    assert (first["files_scanned"], first["files_added"], first["chunks_created"]) == (4, 4, 4)
    again = engine.ingest_corpus(path)
    assert (again["files_added"], again["files_changed"], again["chunks_created"], again["chunks_skipped"]) == (0, 0, 0, 0)
    (corpus / "one.md").write_text("# A\naaaa\n## B\nnew\n")
    os.remove(corpus / "two.TXT")
    third = engine.ingest_corpus(path)
    assert (third["files_changed"], third["files_removed"], third["chunks_created"], third["chunks_skipped"]) == (1, 1, 1, 1)
    forced = engine.ingest_corpus(path, force=True)
    assert (forced["files_added"], forced["files_removed"], forced["chunks_updated"]) == (3, 0, 3)
    found = engine.detect_orphans(path)
    assert found["orphan_files"] == [str(corpus / "two.TXT")]
    assert engine.cleanup_orphans(path)["archived"] == 1
    done = engine.cleanup_orphans(path, dry_run=False)
    assert (done["archived"], done["files_cleaned"]) == (2, 1)
    assert engine.detect_orphans(path)["orphan_count"] == 0


def test_query_and_feedback(engine, corpus):
    engine.ingest_corpus(str(corpus))
    got = engine.query("bbbb", top_k=2)
    assert got["sources"][0]["content"] == "bbbb" and got["metadata"]["chunk_count"] == 2 and got["answer"] is None
    assert got["metadata"]["all_embedded"] and "latency_ms" in got["metadata"]
    wide = engine.retrieve("bbbb", top_k=1, expand_neighbors=True)
    assert {s["content"] for s in wide["sources"]} == {"aaaa", "bbbb"} and wide["metadata"]["retrieval_score"] is None
    assert engine.feedback.read().count() == 1
    assert engine.record_feedback("same", [1], 0.5)["question_hash"] == "0967115f2813a354"


def test_health_quality_and_monitors(engine, corpus):
    engine.ingest_corpus(str(corpus))
    health = engine.health(str(corpus))
    assert health["local"]["manifest_exists"] and health["store"]["total_chunks"] == 4 and health["sync"]["missing_count"] == 1
    assert engine.quality_report()["summary"]["chunks_never_accessed"] == 4
    assert engine.add_monitor(str(corpus))["success"] and not engine.add_monitor(str(corpus))["success"]
    assert not engine.add_monitor(str(corpus / "none"))["success"]
    assert engine.monitor_status() == {"success": True, "total_monitors": 1, "total_files": 3}
    runs = engine.ingest_corpus(monitors=[*engine.resolve_monitors(), {"path": str(corpus / "none")}])
    assert runs["monitors_processed"] == 2 and runs["files_scanned"] == 4
    assert engine.remove_monitor("corpus")["success"] and not engine.remove_monitor("corpus")["success"]
    assert engine.corpus_stats(str(corpus))["estimated_chunks"] == 4
    assert engine.ingest_corpus()["success"] is False and engine.health()["success"] is False
    assert engine.reindex(str(corpus))["chunks_updated"] == 4
    assert engine.ingest_content("some text", "note", {"k": 1}) == {"status": "ingested", "chunks": 1, "source_type": "note", "metadata": {"k": 1}}


def test_filter_fails_open(spark, tmp_path, corpus):
    def judge(text):
        if text == "bbbb":
            raise ValueError("no")
        return text == "aaaa", 0.9

    settings = Settings(ingest=Ingesting(filter_prompt="p"), manifest_dir=str(tmp_path / "m"))
    got = Engine(spark, settings, str(tmp_path / "s"), classifier=judge).ingest_corpus(str(corpus))
    assert (got["chunks_created"], got["chunks_skipped"]) == (2, 2)


def test_corrupt_manifest_is_empty(engine, corpus):
    engine.ingest_corpus(str(corpus))
    with open(engine.manifest_path(str(corpus)), "w") as f:
        f.write("{broken")
    assert engine.manifests.load(str(corpus)).count() == 0


def test_nulls_in_maintenance(spark):
    schema = ", ".join(f"{n} {t}" for n, t in (("id", "long"), ("tags", "array<string>"), ("status", "string"), ("confidence", "double"), ("access_count", "long")))
    tag = ["document_chunk"]
    rows = [(1, tag, "ok", None, None), (2, tag, None, 0.1, 0), (3, None, "ok", 0.1, 0), (4, tag, "ok", 0.2, 0), (5, tag, "archived", 0.1, 0), (6, tag, "ok", 0.9, 3)]
    given = spark.createDataFrame(rows, schema)
    want = spark.createDataFrame([], ENTRY)
    entries = want.unionByName(given, allowMissingColumns=True)
    assert [r.id for r in retrieval.live(entries).orderBy("id").collect()] == [1, 4, 6]
    health = maintenance.store_health(entries).first()
    assert (health.total_chunks, health.stale_count, health.never_accessed, health.embedding_coverage) == (3, 2, 2, 0.0)
    quality = maintenance.quality_summary(entries, spark.createDataFrame([("query",), ("x",)], "action string")).first()
    assert (quality.total_queries, quality.chunks_never_accessed, quality.chunks_below_threshold) == (1, 1, 1)
    empty = maintenance.store_health(want).first()
    assert (empty.total_chunks, empty.avg_confidence, empty.oldest_chunk) == (0, 0.0, None)
    meta = retrieval.result_metadata(spark.createDataFrame([], "rank int, confidence double, distance double, score double, source_file string, embedding array<float>, status string")).first()
    assert meta.all_embedded is True and meta.retrieval_score is None


def test_embedding_failures_leave_nulls(spark):
    chunks = spark.createDataFrame([("h1", "a", False), ("h2", "b", False), ("h3", "c", True)], "content_hash string, content string, exists boolean")

    def broken(texts):
        if "b" in texts:
            raise RuntimeError("down")
        return [[1.0]] * len(texts)

    got = {r.content_hash: r.embedding for r in enrich.embed(chunks, broken, batch=1).collect()}
    assert got == {"h1": [1.0], "h2": None, "h3": None}


def test_watcher_runs_on_a_clock(spark, tmp_path):
    from corpuslake.streaming.ingest import scheduled

    calls = []
    query = scheduled(spark, lambda: calls.append(1), 1, str(tmp_path / "c"))
    for _ in range(100):
        if calls:
            break
        query.awaitTermination(1)
    query.stop()
    assert calls


def test_retrieval_goes_through_the_operators(spark, tmp_path, corpus):
    asked = []

    def embed(texts):
        return [[float(t.count(c)) + 0.01 for c in "abcd"] for t in texts]

    made = Engine(spark, None, str(tmp_path / "store"), embedder=embed, synthesizer=lambda p: asked.append(p) or "said", hash_fn=lambda c: F.sha2(c, 256))
    assert made.ingest_corpus(str(corpus))["success"] and made.manifests.folder == str(tmp_path / "store" / "manifests")
    assert {len(r[0]) for r in made.store.entries().select("content_hash").collect()} == {64}
    got = made.query("bbbb", top_k=1, expand_neighbors=True)
    assert got["answer"] == "said" and asked[0].startswith("You are a helpful assistant.") and "\n\n---\n\n" in asked[0]
    assert {s["heading"] for s in got["sources"]} == {"A", "B"} and got["metadata"]["statuses"] == {"confirmed": 2}
    assert got["metadata"]["confidence_range"] == [0.5, 0.5] and got["metadata"]["distance_range"] is None and got["metadata"]["source_file_count"] == 1
    rows = retrieval.neighbors(retrieval.resolve_context(retrieval.top_k(made.store.entries(), embed(["bbbb"])[0], 1), made.store.entries()), made.store.entries())
    assert {(r.content_type, tuple(r.tags)[-1], r.status) for r in rows.collect()} == {("document_chunk", "document_chunk", "confirmed")}
    assert Engine(spark).retrieve("x")["sources"] == []


def test_prompt_and_single_embeddings(spark):
    chunks = spark.createDataFrame([(f"h{i}", c, False) for i, c in enumerate("abc")], "content_hash string, content string, exists boolean")
    kept = enrich.filter_chunks(chunks, lambda text, prompt: (text in prompt, 1.0), "a and c", 0.5)
    assert sorted(r.content for r in kept.collect()) == ["a", "c"]

    def picky(texts):
        if "b" in texts:
            raise RuntimeError("down")
        return [[1.0]] * len(texts)

    assert {r.content: r.embedding for r in enrich.embed(chunks, picky).collect()} == {"a": [1.0], "b": None, "c": [1.0]}


def test_texts_of_one_hash_are_judged_each_by_itself(spark):
    rows = [("h", "a  b"), ("h", "A b"), ("h", "a b"), ("h", "a  b"), ("h", None)]
    chunks = spark.createDataFrame(rows, "content_hash string, content string")
    kept = enrich.filter_chunks(chunks, lambda text: (len(text) == 4, 1.0), "even", 0.5)
    assert kept.columns == chunks.columns and sorted(r.content or "" for r in kept.collect()) == ["", "a  b", "a  b"]


def test_queue_of_paths_and_reload(spark, tmp_path, engine, corpus):
    queue = str(tmp_path / "queue")
    rows = [(str(corpus / "one.md"), None), (str(corpus / "gone.md"), None), ("/sent/note.txt", "sent text"), (str(corpus / "one.md"), None)]
    spark.createDataFrame(rows, "path string, content string").write.parquet(queue)
    stream = spark.readStream.schema("path string, content string").parquet(queue)
    engine.consume(stream, str(tmp_path / "c1"), available_now=True).awaitTermination()
    assert sorted(r.content for r in engine.store.entries().collect()) == ["aaaa", "bbbb", "sent text"]
    assert all(r.embedding for r in engine.store.entries().collect())
    seen = []
    other = Engine(spark, engine.settings)
    assert other.add_monitor(str(corpus), label="x")["success"] and [m["label"] for m in engine.resolve_monitors()] == ["x"]
    engine.on_reload(spark.readStream.schema("path string, content string").parquet(queue), str(tmp_path / "c2"), seen.append, available_now=True).awaitTermination()
    assert [m["label"] for m in seen[0]] == ["x"]


def test_markdown_is_parsed_without_a_shuffle(spark):
    files = spark.createDataFrame([("/a.md", "# T\nx\n## U\ny"), ("/b.md", None)], "path string, content string")
    made = parsing.parse_markdown(files)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.heading, r.content, list(r.section_path)) for r in made.collect()) == [("T", "x", ["T"]), ("U", "y", ["T", "U"]), ("b", "", [])]
