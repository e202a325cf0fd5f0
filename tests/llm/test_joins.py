"""N-gram join, components and passage dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslake.llm import bwt_dedup, components, ngram_join
from corpuslake.llm.components import connected_components

LAST = 2**63 - 1


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute_components(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    parent = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(parent, i)] = find(parent, j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(parent, i)] = min(doc, least.get(find(parent, i), LAST))
    return sorted((LAST if d is None else d, len(s), least.get(find(parent, i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def near_copies():
    draw = random.Random(3)
    vocab = [f"w{i}é" for i in range(3000)]
    rows = [(0, None), (1, ""), (2, " \n "), (None, "a b c"), (5, "A b  c"), (6, "a b c"), (6, "a b c"), (None, None)]
    for _ in range(5):
        base = [draw.choice(vocab) for _ in range(draw.choice([6, 12, 40, 120]))]
        for _ in range(draw.choice([3, 30, 50])):
            x = list(base)
            for _ in range(draw.randrange(0, 4)):
                x[draw.randrange(len(x))] = draw.choice(vocab)
            if draw.random() < 0.3:
                x = x[: max(3, len(x) - draw.randrange(0, 9))]
            rows.append((len(rows), " ".join(x).replace("w", "W" if draw.random() < 0.2 else "w")))
    passage = [draw.choice(vocab) for _ in range(60)]
    for _ in range(40):
        extra = [draw.choice(vocab) for _ in range(draw.randrange(1, 40))]
        rows.append((len(rows), " ".join(passage[: draw.randrange(20, 60)] + extra)))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("common,patience,fragment", [(2, 8, 500), (2, 10**9, 10**7), (ngram_join.COMMON, 8, 10**7)])
def test_components_match_brute_force(spark, monkeypatch, common, patience, fragment):
    monkeypatch.setattr(ngram_join, "FRAGMENT_BYTES", fragment)
    monkeypatch.setattr(ngram_join, "PAIRS_PER_POSTING", patience)
    rows = near_copies()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, part int").repartition(5)
    got = sorted((LAST if r[0] is None else r[0], r[1], r[2]) for r in ngram_join.link_components(df, common=common).collect())
    assert got == brute_components(rows)


def test_join_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.link_components(empty).collect() == []
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.link_components(only).collect())) == [(1, 0, 1), (2, 0, 2)]


@pytest.mark.parametrize("held,few", [(3, 0), (500_000, 0), (500_000, 200_000)])
def test_connected_components(spark, monkeypatch, held, few):
    monkeypatch.setattr(components, "HELD_EDGES", held)
    draw = random.Random(5)
    edges = [(f"n{draw.randrange(60):02}", f"n{draw.randrange(60):02}") for _ in range(35)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(40)] + [("n00", None), ("x", "x")]
    df = spark.createDataFrame(edges, "a string, b string")
    nodes = sorted({n for a, b in edges if a and b and a != b for n in (a, b)})
    parent = {n: n for n in nodes}
    for a, b in edges:
        if a and b and a != b:
            parent[find(parent, max(find(parent, a), find(parent, b)))] = min(find(parent, a), find(parent, b))
    got = {r.node: r.label for r in connected_components(df.repartition(6), few=few).collect()}
    assert got == {n: find(parent, n) for n in nodes}
    assert connected_components(df.where("false")).count() == 0


def brute_repeats(rows):
    least = {}
    for doc, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - 49):
            w = raw[i : i + 50]
            least[w] = min(LAST if doc is None else doc, least.get(w, 2**63))
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        mask = [0] * len(raw)
        for i in range(len(raw) - 49):
            if least[raw[i : i + 50]] < (LAST if doc is None else doc):
                mask[i : i + 50] = [1] * 50
        kept = bytes(x for x, m in zip(raw, mask) if not m)
        spans = sum(1 for i, m in enumerate(mask) if m and (not i or not mask[i - 1]))
        out.append((LAST if doc is None else doc, len(raw), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("size", [10**7, 2_000])
def test_repeats_match_brute_force(spark, monkeypatch, size):
    draw = random.Random(5)
    vocab = ["the", "of", "and", "thé", "er", "tion", "abra", "x" * 7, "\n"]
    prose = lambda n: " ".join(draw.choice(vocab) for _ in range(n))
    passages = [prose(draw.randrange(8, 60)) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "a" * 49), (3, "a" * 50), (4, "a" * 200), (None, "a" * 120), (5, "ab" * 100), (6, "ba" * 60), (6, "ba" * 70), (7, "long " * 30_000)]
    for n in range(8, 60):
        text = prose(draw.randrange(0, 40)) + "".join(draw.choice(passages) + prose(draw.randrange(0, 5)) for _ in range(draw.randrange(0, 3)))
        rows.append((n, text if draw.random() < 0.8 else draw.choice(rows[:9])[1]))
    rows += rows[20:24]
    draw.shuffle(rows)
    df = spark.createDataFrame([(*r, b"z", 1, 2, 3, 4) for r in rows], "doc_id long, text string, kept binary, version long, k int, _known int, part int").repartition(5)
    monkeypatch.setattr(bwt_dedup, "RANGE_BYTES", size)
    out = bwt_dedup.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert sorted((LAST if r[0] is None else r[0], *r[1:]) for r in out.collect()) == brute_repeats(rows)


def test_repeats_in_an_empty_table(spark):
    assert bwt_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_kept_text_has_whole_characters(spark):
    shared = "é" * 40
    df = spark.createDataFrame([(1, "ab" + shared), (2, "é" + "x" + shared + "y")], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in bwt_dedup.remove_repeats(df, as_text=True).collect()}
    assert got == {1: "ab" + shared, 2: "éxy"}


def test_merge_is_a_sort(spark):
    import numpy as np

    draw = np.random.default_rng(1)
    shards = []
    for _ in range(4):
        lengths = draw.integers(50, 90, 5)
        shards.append((draw.integers(97, 100, lengths.sum()).astype(np.uint8), lengths))
    orders = [bwt_dedup.shard_order(d, n) for d, n in shards]
    shard, block = bwt_dedup.merge_shards([bwt_dedup.pairs_before(d, n)[1][o] for (d, n), o in zip(shards, orders)])
    used, found = [0] * 4, []
    for s in shard:
        data, lengths = shards[s]
        place = orders[s][used[s]]
        used[s] += 1
        end = np.cumsum(lengths)
        k = np.searchsorted(end, place, "right")
        ring = data[end[k] - lengths[k] : end[k]]
        found.append(bytes(np.roll(ring, -(place - end[k] + lengths[k]))[:50]))
    assert found == sorted(found)
    assert [a != b for a, b in zip(found, found[1:])] == [a != b for a, b in zip(block, block[1:])]


def test_segments_that_share_an_anchor_only_are_not_compared():
    """One of 50 bytes is repeated in another setting; a shared anchor-sized string alone asks for no comparison."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    noise = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8))
    passage, gram = noise(bwt_dedup.LENGTH), noise(bwt_dedup.ANCHOR + bwt_dedup.LEFT - 1)

    def marked(a, b):
        s = bwt_dedup.Segments([a, b])
        count = np.bincount(s.text, minlength=2).astype("<u4")
        low = (s.anchor & np.uint64(0xFFFFFFFF)).astype("<u4") ^ (s.anchor >> np.uint64(32)).astype("<u4")
        given = {"docs": np.array([1, 2], "<i8"), "versions": np.array([1, 2], "<i8"), "counts": count, "anchors": low, "names": s.name, "lefts": s.left, "rights": s.right}
        table = pa.table({"part": pa.array([0], pa.int32())} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in given.items()})
        got = bwt_dedup._judge_names(table, 1)
        return [np.frombuffer(x, np.uint8).max() for x in got.column("data").to_pylist() if x]

    assert marked(noise(60) + passage + noise(60), noise(70) + passage + noise(50)) == [2]
    for _ in range(20):
        assert marked(noise(60) + gram + noise(60), noise(70) + gram + noise(50)) == []
