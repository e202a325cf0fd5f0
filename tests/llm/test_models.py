"""Language ID, URL filters, top-k search and decontamination."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpuslake.llm import decontam, langid, topk, urls

WORDS = {"en": "the and of that with this from have".split(), "fr": "les des une dans pour été avec où".split(), "de": "der und ist nicht für über ein mit".split()}


def labelled(spark, n=60, seed=1):
    draw = random.Random(seed)
    rows = [(i, lang := draw.choice(list(WORDS)), " ".join(draw.choice(WORDS[lang]) for _ in range(draw.randint(3, 40)))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, lang string, text string"), rows


class PlainPPM:
    """One language's tree, walked byte by byte."""

    def __init__(self, texts, size):
        self.counts = [defaultdict(Counter) for _ in range(langid.ORDER + 1)]
        for t in texts:
            raw = b"\n" * langid.ORDER + t
            for i in range(langid.ORDER, len(raw)):
                for o in range(langid.ORDER + 1):
                    self.counts[o][raw[i - o : i]][raw[i]] += 1
        top = self.counts[langid.ORDER]
        self.counts[langid.ORDER] = {c: n for c, n in top.items() if sum(n.values()) >= langid.KEEP}

    def chance(self, context, byte):
        order = next(o for o in range(langid.ORDER, -1, -1) if context[langid.ORDER - o :] in self.counts[o])
        gone, p = set(), 1.0
        for o in range(order, -1, -1):
            own = {b: n for b, n in self.counts[o][context[langid.ORDER - o :]].items() if b not in gone}
            n, q = sum(own.values()), len(own)
            if byte in own:
                return p * own[byte] / (n + q)
            if n:
                p *= q / (n + q)
            gone |= set(own)
        return p / (256 - len(gone))

    def bits(self, text):
        raw = b"\n" * langid.ORDER + text
        return sum(-math.log2(self.chance(raw[i - langid.ORDER : i], raw[i])) for i in range(langid.ORDER, len(raw)))


def test_code_lengths_match_a_plain_tree(spark):
    df, rows = labelled(spark)
    trees = langid.train(df, train_rows=10**6)
    tests = [b"", b"the", "où été".encode(), b"zz\x00qq!", "über the Ω".encode(), b"x", b"with this from des une"]
    got = trees.bits(tests)
    for j, lang in enumerate(trees.langs):
        plain = PlainPPM([t.encode() for _, own, t in rows if own == lang], 256)
        assert np.allclose(got[:, j], [plain.bits(t) for t in tests], rtol=1e-4, atol=1e-3), lang


def test_prediction(spark):
    df, _ = labelled(spark)
    trees = langid.train(df)
    rows = [(1, "the and of that", "fr", "x"), (2, "les des une", None, "y"), (3, None, "en", "z"), (4, " 12 ?!", "en", "z"), (5, "", None, None), (None, "der und ist", None, None), (6, "the " * 100_000, None, None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string"), trees).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "en", 2: "fr", 3: "und", 4: "und", 5: "und", None: "de", 6: "en"}
    assert all(0 <= s <= 1 for _, s in got.values())
    none = langid.train(df.where("false"))
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}
    assert langid.predict(df.where("false"), trees).count() == 0


def test_held_out_accuracy(spark):
    df, rows = labelled(spark, 400, 2)
    got = langid.predict(df.where(langid.held_out()), langid.train(df.where(~langid.held_out()))).collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    if rest is None:
        return "", "", None, None
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
    tail = rest[end:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_urls_against_brute_force(spark):
    draw = random.Random(4)
    hosts = ["a.example.com", "EXAMPLE.net", "example.net", "xexample.net", "b.org", "org", "c.net:80", "u@d.com", "", "é.com"]
    paths = ["", "/", "/en/x", "/de/", "/fr/1", "/en", "//de/"]
    made = [None, "", "nohost", "mailto:x", "http:/a.net/"] + [f"{draw.choice(['http', 'HTTPS', ''])}://{draw.choice(hosts)}{draw.choice(paths)}{draw.choice(['', '?q=://z', '#f', '?a#b'])}" for _ in range(300)]
    good = [u for u in made if u and "://" in u and brute_url(u)[0]]
    links = [(draw.choice(good), draw.choice(good)) for _ in range(40)] + [(None, good[0]), ("bad", good[1])]

    def node(u):
        host, path, *_ = brute_url(u)
        q = u.split("://", 1)[1].split("#")[0]
        return host + (path or "/") + (q[q.index("?") :] if "?" in q else "")

    parent = {node(u): node(u) for u in good}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    linked = set()
    for a, b in links:
        if a in good and b in good and node(a) != node(b):
            linked |= {node(a), node(b)}
            parent[find(node(a))] = find(node(b))
    bad = {find(n) for n in linked if brute_url("http://" + n)[3] == "block"}
    pages = spark.createDataFrame([(i, u, "v") for i, u in enumerate(made)], "page_id long, url string, verdict string")
    for r in urls.judge(pages, spark.createDataFrame(links, "src string, dst string")).collect():
        host, path, rule, verdict = brute_url(made[r.page_id])
        if verdict is None:
            alias = made[r.page_id] in good and node(made[r.page_id]) in linked and find(node(made[r.page_id])) in bad
            verdict = "block" if alias else "allow"
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict), made[r.page_id]


def test_links_in_comments_and_scripts_are_none():
    page = """<!-- <link rel=canonical href=/a> --><script>var x = '<link rel="canonical" href="/b">';</script><style><link rel=canonical href=/s></style>
    <template><meta http-equiv=refresh content="0;url=/t"></template><link rel=canonical href=/c href=/z><textarea><link rel=canonical href=/d></textarea><!-- never closed <link rel=canonical href=/e>"""
    assert list(urls.declared_links("http://x.org/", page)) == ["http://x.org/c"]


def test_url_query_with_links(spark, tmp_path):
    """The query over pages that declare links: blocks reach aliases, allowed ones stay."""
    canonical = lambda to: f'<html><head><link rel="canonical" href="{to}"></head></html>'
    rows = [(1, "http://good.io/a", canonical("http://bad.net/x")), (2, "http://good.io/b", "<!-- " + canonical("http://bad.net/x") + " -->"), (3, "http://example.net/en/q", canonical("http://bad.net/x")),
            (4, "https://good.io/a#f", None), (5, None, None), (6, "http://c.io/1", canonical("/2")), (7, "http://c.io/2", '<meta http-equiv=refresh content="0;url=http://good.io/a">'), (7, "http://c.io/2", ""), (8, "http://d.io/", "x" * 400_000)]
    spark.createDataFrame([(*r, "k", "o") for r in rows], "page_id long, url string, html string, k string, own string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.page_id, r.rule, r.verdict) for r in urls.op7_urls(spark, str(tmp_path)).collect())
    assert got == [(1, None, "block"), (2, None, "allow"), (3, "example.net/en/", "allow"), (4, None, "block"), (5, None, "allow"), (6, None, "block"), (7, None, "block"), (7, None, "block"), (8, None, "allow")]
    clash = spark.createDataFrame([("http://a.net/", 1, 2, 3, 4, "p")], "url string, k int, own int, spread int, _0 int, path string")
    none = spark.createDataFrame([], "src string, dst string")
    assert tuple(urls.judge(clash, none).first()) == ("http://a.net/", 1, 2, 3, 4, "a.net", "/", "net/", "block")
    assert urls.judge(clash.where("false"), none).count() == 0


def test_links_of_pages(spark):
    html = '<link rel="canonical" href="../b?x=1&amp;y=2"><META http-equiv=Refresh content="3; URL=\'//q.net/z\'"><link rel=stylesheet href=s>'
    pages = spark.createDataFrame([("http://a.com/d/e", html), ("http://b.com", None), (None, html), ("http://c.com", "<p>canonical</p>")], "url string, html string")
    assert sorted(map(tuple, urls.links_of_pages(pages).collect())) == [("http://a.com/d/e", "http://a.com/b?x=1&y=2"), ("http://a.com/d/e", "http://q.net/z")]


@pytest.mark.parametrize("shard,block", [(7, 3), (4096, 1024)])
def test_topk_matches_brute_force(spark, shard, block):
    draw = np.random.default_rng(3)
    rows = [(i, [float(x) for x in draw.normal(size=8)], "c") for i in range(120)] + [(i, [0.5] * 8, "c") for i in range(120, 200)]
    rows += [(300, None, "c"), (350, [1.0, None] + [0.0] * 6, "c"), (400, [float("nan")] * 8, "c"), (450, [float("inf")] * 8, "c"), (500, [], "c"), (None, [1.0] * 8, "c"), (100, [9.0] * 8, "c"), (150, [0.0] * 8, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    q = topk.quantise(df)
    got = {}
    for r in topk.search(q, q.where("id % 50 = 0"), 5, shard, block).collect():
        got.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in rows[:200] + rows[-2:]]
    for qid in (0, 50):
        v = next(v for i, v in whole if i == qid)
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != qid)[:5]
        assert sorted(got[qid]) == [(k + 1, s, i) for k, (s, i) in enumerate(best)]
    assert set(got) == {0, 50, 100, 150}
    assert topk.search(q.where("false"), q.where("false")).count() == 0
    other = topk.quantise(spark.createDataFrame([(i, [float(i)] * n) for i, n in ((0, 8), (1, 3), (2, 3), (50, 3), (3, 8))], "vec_id long, embedding array<double>"))
    met = {(r.query_id, r.vec_id) for r in topk.search(other, other.where("id % 50 = 0"), 5, shard, block).collect()}
    assert met == {(0, 3), (50, 1), (50, 2)}
    few = q.where("id in (0, 1, 2)")
    assert topk.search(few, few.where("id = 0")).count() == 2


@pytest.mark.parametrize("size", [1e3, 1e7, 1e9, 1e17, 1e30])
def test_topk_of_large_components_is_exact(spark, size):
    draw = np.random.default_rng(8)
    rows = [(i, [float(x) for x in draw.normal(size=6) * size]) for i in range(60)]
    q = topk.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    hold = lambda x: max(-(2**63), min(2**63 - 1, x))
    whole = {i: [hold(math.floor(256 * x)) for x in v] for i, v in rows}
    got = {}
    for r in topk.search(q, q.where("id % 20 = 0"), 5, 13, 2, 16).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for i in (0, 20, 40):
        best = sorted((-hold(sum(a * b for a, b in zip(whole[i], w))), j) for j, w in whole.items() if j != i)[:5]
        assert sorted(got[i]) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]


BENCH = [(1, "The quick brown fox jumps over the lazy dog while seven wizards make toxic brew. Later on, the tired fox sleeps under an old oak tree."), (2, "too short"), (3, None), (None, "alpha beta gamma delta epsilon zeta"), (5, "one two three four five six seven eight nine ten")]


def test_leaks(spark):
    a, b = BENCH[0][1].split(". ")
    rows = [
        (1, "Intro words here. " + BENCH[0][1].upper() + " And an end.", [1]), (2, f"{b} filler in between, {a}!", [1]), (3, "quick brown fox jumps over nothing at all", []),
        (4, None, []), (5, "", []), (6, "one two three four five -- and six seven eight nine ten", [5]), (7, "one two three four", []), (None, BENCH[4][1], [5]),
        (8, "too short", []), (9, "alpha beta gamma delta epsilon zeta", []), (10, "x " * 50_000 + BENCH[4][1], [5]), (11, "one two three four five " * 3, [5]),
    ]
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows], "doc_id long, text string, coverage int")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r.leaked_items, r.coverage) for r in decontam.find_leaks(docs, bench).collect()}
    for i, _, leaked in rows:
        assert got[i][:2] == (bool(leaked), leaked), i
    assert got[1][2] == 1.0 and got[11][2] == 0.5
    assert decontam.find_leaks(docs, bench.where("false")).where("contaminated").count() == 0
    assert decontam.find_leaks(docs.where("false"), bench).count() == 0


def test_small_benchmark_blocks_give_the_same(spark, monkeypatch):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    docs = spark.createDataFrame([(1, BENCH[0][1] + BENCH[4][1])], "doc_id long, text string")
    monkeypatch.setattr(decontam, "ITEMS_BYTES", 1)
    assert decontam.find_leaks(docs, bench).first().leaked_items == [1, 5]


def test_large_benchmarks_are_joined(spark, monkeypatch):
    draw = random.Random(9)
    prose = lambda n: " ".join(draw.choice("a b c dd ee ff gg hh ii jj kk ll mm nn oo pp".split()) for _ in range(n))
    items = [(i if i % 7 else None, prose(draw.randrange(3, 30))) for i in range(40)] + [(3, "a " * 30), (50, None)]
    texts = [prose(draw.randrange(0, 60)) + " " + draw.choice(items)[1][: draw.randrange(10, 99)] for _ in range(30) if (items := items[:41])] + [None, "", "a " * 200]
    rows = [(i, t, "c") for i, t in enumerate(texts)] + [(None, texts[0], "c"), (1, texts[1], "c")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string, k string"), spark.createDataFrame(items, "item_id long, text string")
    told = lambda: sorted((str(r.doc_id), str(r.text), r.k, r.contaminated, round(r.coverage, 9), r.leaked_items) for r in decontam.find_leaks(docs, bench).collect())
    small = told()
    monkeypatch.setattr(decontam, "ITEMS_BYTES", 1)
    assert told() == small and any(r[3] for r in small)
    assert decontam.find_leaks(docs.where("false"), bench).count() == 0


def test_repetitive_texts_take_linear_time():
    import time

    items = decontam.Items([(1, "x " * 800), (2, "y " * 10)])
    decontam.coverages(["warm up"], items)
    for n in (4_000, 40_000):
        began = time.perf_counter()
        assert decontam.coverages(["x " * n], items) == [[(0, 1.0)]]
        assert time.perf_counter() - began < 0.1 * n / 4000


def test_leaks_query_against_brute_force(spark, tmp_path):
    """Every word sequence of an item against every document, tiled by definition."""
    draw = random.Random(12)
    word = lambda: draw.choice("red green blue one two three four".split())
    items = [(i, " ".join(word() for _ in range(draw.randint(5, 14)))) for i in range(8)]
    rows = [(i, " ".join([word() for _ in range(draw.randint(0, 12))] + items[draw.randrange(8)][1].upper().split()[: draw.randint(0, 14)])) for i in range(40)] + [(40, None), (41, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: (r.contaminated, r.coverage, r.leaked_items) for r in decontam.op10_decontam(spark, str(tmp_path)).collect()}
    for doc, text in rows:
        covered = {i: sum(k for _, _, k in plain_tiles(item.split(), (text or "").lower().split(), 5)) / len(item.split()) for i, item in items}
        leaked = sorted(i for i, c in covered.items() if c >= 0.5)
        assert got[doc][0] == bool(leaked) and got[doc][2] == leaked and abs(got[doc][1] - max(covered.values())) < 1e-12


def plain_tiles(a, b, least):
    """Greedy string tiling by its definition."""
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and free_a[i + k] and free_b[j + k]:
                    k += 1
                if k > best[2]:
                    best = (i, j, k)
        i, j, k = best
        if k < least:
            return out
        out.append(best)
        free_a[i : i + k] = [False] * k
        free_b[j : j + k] = [False] * k


def test_tiling_matches_its_definition():
    draw = random.Random(6)
    for _ in range(150):
        a = np.array([draw.randrange(3) for _ in range(draw.randint(5, 25))])
        b = np.array([draw.randrange(3) for _ in range(draw.randint(5, 40))])
        pairs = [(i, j) for i in range(len(a) - 2) for j in range(len(b) - 2) if (a[i : i + 3] == b[j : j + 3]).all()]
        assert decontam.tile(a, b, pairs, 3) == plain_tiles(a.tolist(), b.tolist(), 3)
        assert decontam.tile_passes(a, b, 3) == plain_tiles(a.tolist(), b.tolist(), 3)
