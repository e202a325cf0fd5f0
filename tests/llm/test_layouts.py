"""Main text of hand-written pages of other layouts, and the query against a search of all labellings."""

import itertools

import pytest

from corpuslake.llm import html_crf
from corpuslake.llm.html_blocks import leaf_blocks

LINKS = "<a href=/a>Home</a><br><a href=/b>News</a>"
PAGES = [
    (f"<table><tr><td>{LINKS}</td><td><h1>A table page</h1><p>The first paragraph of a story that lies in a cell.</p><p>And the second one, which is long enough too.</p></td></tr></table>",
     ["A table page", "The first paragraph of a story that lies in a cell.", "And the second one, which is long enough too."]),
    ("<main><p>Short.</p></main>", ["Short."]),
    ("<div id=x><p>One plain paragraph of some words here.</p><p>Another plain paragraph follows it.</p></div>",
     ["One plain paragraph of some words here.", "Another plain paragraph follows it."]),
    (f"<div class=nav>{LINKS}</div><div>Text of a plain div, with no article element around it at all.</div><div>Second plain div of the same story.</div><div class=footer>Copyright 2020 by us</div>",
     ["Text of a plain div, with no article element around it at all.", "Second plain div of the same story."]),
    ("<center><font size=2><b>Old page</b><p>Words of an old page in a font element, which go on for a line or two.<p>More words of it, never closed.</font></center>",
     ["Old page", "Words of an old page in a font element, which go on for a line or two.", "More words of it, never closed."]),
]


@pytest.mark.parametrize("n", range(len(PAGES)))
def test_layouts(n):
    html, wanted = PAGES[n]
    assert html_crf.default_field().extract(html).split("\n") == wanted


def best_labels(field, blocks):
    own = [sum(field.weights.get(f, 0.0) for f in fs) for fs in html_crf.features(blocks)]
    score = lambda y: sum(s for s, k in zip(own, y) if k) + sum(field.transitions[a, b] for a, b in zip(y, y[1:]))
    return max(itertools.product((0, 1), repeat=len(blocks)), key=score)


def test_query_against_all_labellings(spark, tmp_path):
    field = html_crf.default_field()
    made = [h for h, _ in html_crf.labelled_pages(80, seed=123) if 0 < len(leaf_blocks(h)) <= 11]
    pages = [h for h, _ in PAGES] + made[:15] + [None, "", "<p></p>"]
    rows = [(i, f"http://x/{i}", h, "k", 1) for i, h in enumerate(pages)] + [(0, None, pages[0], "k", 1)]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string, _0 int").write.parquet(f"{tmp_path}/pages.parquet")
    assert len(made) >= 5
    for r in html_crf.op2_html_crf(spark, str(tmp_path)).collect():
        blocks = leaf_blocks(pages[r.page_id] or "", field.known)
        text = "\n".join(b.text for b, yes in zip(blocks, best_labels(field, blocks)) if yes)
        assert (r.text, r.n_chars) == (text, len(text)), r.page_id


def test_long_pages(spark):
    html = "<article>" + "<p>A paragraph of some words, which are many.</p>" * 20_000 + "</article>"
    got = html_crf.extract_text(spark.createDataFrame([(1, html)], "page_id long, html string")).first()
    assert got.text.count("\n") == 19_999
