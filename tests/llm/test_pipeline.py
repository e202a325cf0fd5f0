"""The pipeline's stages on planted cases, and the registry."""

import os
import random
from types import SimpleNamespace

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline as P
from corpuslake.llm import storage

SF = "/root/testdata/sf0.001"


def prose(draw, words):
    vocab = ["the", "and", "of", "thing", "with", "that", "from", "have", "this", "some", "other", "people", "about", "water", "house", "light", "green", "stone", "river", "night"]
    return " ".join(draw.choice(vocab) + draw.choice(["", "s", "ing", "ed", "ly"]) for _ in range(words))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    draw = random.Random(8)
    passage, leak = prose(draw, 60), prose(draw, 40)
    near = prose(draw, 200).split()
    rows = [(i, prose(draw, 120), "en", "s", 0) for i in range(20)]
    rows += [(20, None, "en", "s", 0), (21, "", None, "s", 0), (22, " 12 34 !", "en", None, 0), (None, prose(draw, 50), "en", "s", 0)]
    rows += [(30, " ".join(near), "en", "s", 0), (31, " ".join(near[:-1] + ["changed"]), "en", "s", 0), (30, " ".join(near), "en", "s", 0)]
    rows += [(40, prose(draw, 100) + " " + passage, "en", "s", 0), (41, passage + " " + prose(draw, 100), "en", "s", 0), (50, prose(draw, 80) + " " + leak.upper(), "en", "s", 0)]
    where = str(tmp_path_factory.mktemp("sf"))
    docs = [(i, t, la, s, len(t or "")) for i, t, la, s, _ in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, passage


def test_stages(spark, sf_dir):
    where, passage = sf_dir
    docs = spark.read.parquet(f"{where}/documents.parquet")
    seen = [docs]
    for name, stage in P.STAGES:
        seen.append(P.cut(stage(spark, seen[-1], where), name))
    assert all(tuple(d.columns) == P.COLUMNS for d in seen[1:-1])
    ids = lambda d: sorted((-1 if r[0] is None else r[0]) for r in d.select("doc_id").collect())
    clean = list(range(20))
    assert ids(seen[1]) == [-1, *clean, 30, 30, 31, 40, 41, 50]
    assert ids(seen[2]) == [-1, *clean, 30, 40, 41, 50]
    texts = {r.doc_id: (r.text, r.n_chars) for r in seen[3].collect()}
    assert passage in texts[40][0] and passage not in texts[41][0] and texts[41][1] == len(texts[41][0])
    assert ids(seen[4]) == [-1, *clean, 30, 40, 41]
    assert set(ids(seen[5])) == {-1, *clean, 30, 40, 41}
    assert P.run(spark, where).count() == seen[5].count()


def test_empty_documents(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir[0]}/documents.parquet")
    for _, stage in P.STAGES:
        assert stage(spark, docs.where("false"), sf_dir[0]).count() == 0


def test_stages_take_odd_tables(spark, sf_dir, tmp_path):
    """Nulls everywhere, very long texts, ties, repeated rows, columns with clashing names, and an empty benchmark."""
    draw = random.Random(3)
    long = prose(draw, 60_000)
    rows = [(1, long, "en", None, None), (1, long, None, "s", 1), (None, None, None, None, None), (None, None, None, None, None), (2, "", "en", "s", 0), (3, prose(draw, 30), "en", "s", 9), (4, "déjà vu " * 40, "fr", "s", 9)]
    clash = ("_row", "version", "k", "_known", "kept", "contaminated", "coverage", "component_id", "lang_pred", "ids")
    docs = spark.createDataFrame([(*r, *range(len(clash))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in clash))
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {name: stage(spark, docs, str(tmp_path)).collect() for name, stage in P.STAGES}
    ids = {name: sorted((-1 if r.doc_id is None else r.doc_id) for r in got) for name, got in out.items()}
    assert set(ids["language_id"]) <= {1, 3, 4} and {1, 3} <= set(ids["language_id"])
    assert ids["near_duplicates"] == [-1, -1, 1, 2, 3, 4]
    assert ids["repeated_passages"] == ids["decontaminate"] == [-1, -1, 1, 1, 2, 3, 4]
    assert {(r.doc_id, r.text) for r in out["repeated_passages"]} >= {(1, long), (None, None), (2, "")}
    assert sorted(set(ids["packing"])) == [-1, 1, 2, 3, 4]


def test_names():
    names = __spark_entry__.queries()
    assert [n for k in range(1, 11) for n in names if n.startswith(f"op{k}_")] and "pipeline" in names
    assert sum(n.startswith("op") for n in names) == 10


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.oracle_sql() if n.startswith("op")))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = __spark_entry__.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    row = lambda names, v: tuple("null" if v[names.index(c)] is None else repr(v[names.index(c)]) for c in sorted(names))
    assert sorted(row(got.columns, tuple(r)) for r in got.collect()) == sorted(row(columns, r) for r in want.fetchall())


def test_executors_are_told_to_collect_garbage(spark, monkeypatch):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    storage.collect_garbage(spark)
    assert full() > before
    told = []
    monkeypatch.setattr(storage, "collect_garbage", told.append)
    storage.trim(spark)
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(master="local-cluster[3,2,3000]"))
    monkeypatch.setitem(storage._TRIMMED, "at", -1e9)
    storage.trim(cluster)
    storage.trim(cluster)
    assert told == [cluster]
