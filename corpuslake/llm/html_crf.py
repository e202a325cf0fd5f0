"""Main-text extraction with a linear-chain conditional random field.

A page is its sequence of leaf blocks. Each block has features: the tags and
the words of class, id and role above it, its own text's length, link share,
punctuation and place, and those of its neighbours. The field scores a labelling
(article or not) by features and by transitions between neighbours; it is
trained on labelled pages (``labelled_pages`` writes them, with the labels known
by construction) by maximum likelihood with forward-backward sums, and decoded
by Viterbi.

Null or empty pages, and pages without text, give an empty text; labellings of
equal score are settled for the label *no*. Pages are read whole, whatever their length. Repeated rows are extracted alike; an empty table
gives no rows; extra columns are kept, but for ``text`` and ``n_chars``, which
are replaced.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html_blocks import Block, leaf_blocks

#: Pages that the field learns from.
TRAIN_PAGES = 800
_STEPS, _RATE, _RIDGE = 250, 0.1, 0.0005
_ENDS = tuple(".!?:;…\"'»”)")


def text_features(block: Block) -> list[str]:
    """Features of a block's own text."""
    text = block.text
    n, spaces = len(text), text.count(" ")
    out = [f"len{min(9, n.bit_length())}", f"words{min(7, (spaces + 1).bit_length())}"]
    share = block.linked / n
    out.append("link0" if not share else "link1" if share < 0.3 else "link2" if share < 0.8 else "link3")
    out.append("stop" if text.endswith(_ENDS) else "open")
    if "©" in text or "\N{REGISTERED SIGN}" in text or "All rights" in text:
        out.append("rights")
    if "|" in text or "·" in text or "»" in text:
        out.append("bars")
    return out


def features(blocks: Sequence[Block]) -> list[list[str]]:
    """Features of every block of a page, its neighbours' lengths and links included, and how the page
    is built: how many blocks it has, whether this one, another or none stands in an article or main element, and
    whether any class, id or role stands above it."""
    own = [text_features(b) for b in blocks]
    inside = ["<article>" in b.names or "<main>" in b.names for b in blocks]
    none, size = not any(inside), f"blocks{min(7, len(blocks).bit_length())}"
    out = []
    for i, (block, f) in enumerate(zip(blocks, own)):
        before = own[i - 1] if i else ("start",)
        after = own[i + 1] if i + 1 < len(own) else ("end",)
        held = "none" if none else "in" if inside[i] else "out"
        plain = "named" if any(n[0] == "." for n in block.names) else "plain"
        out.append([*block.names, *f, held, f"{held} {plain}", f"{plain} {f[2]}", f"{held} {f[0]}", f"{held} {f[2]}", f"{held} {size}", "-" + before[0], "-" + before[min(2, len(before) - 1)], "+" + after[0], "+" + after[min(2, len(after) - 1)], "bias"])
    return out


class Field:
    """Weights of the chain: per feature for the label *article*, and 2 x 2 transitions."""

    def __init__(self, weights: dict[str, float], transitions: np.ndarray):
        self.weights, self.transitions = weights, transitions
        self.known = frozenset(w for w in weights if w[0] in "<.")
        self._cached: dict[tuple, float] = {}

    def label(self, blocks: Sequence[Block]) -> list[bool]:
        """Viterbi: the likeliest labelling, all at once."""
        w, t = self.weights, self.transitions.tolist()
        scores = []
        for block, own in zip(blocks, features(blocks)):
            above = self._cached.get(block.names)
            if above is None:
                if len(self._cached) > 50_000:
                    self._cached.clear()
                above = self._cached[block.names] = sum(w.get(n, 0.0) for n in block.names)
            scores.append(above + sum(w.get(f, 0.0) for f in own[len(block.names):]))
        if not scores:
            return []
        no, yes, back = 0.0, scores[0], []
        for s in scores[1:]:
            from_no, from_yes = no + t[0][0] >= yes + t[1][0], no + t[0][1] > yes + t[1][1]
            back.append((0 if from_no else 1, 0 if from_yes else 1))
            no, yes = (no + t[0][0] if from_no else yes + t[1][0]), s + (no + t[0][1] if from_yes else yes + t[1][1])
        state, out = int(yes > no), []
        for step in reversed(back):
            out.append(bool(state))
            state = step[state]
        out.append(bool(state))
        return out[::-1]

    def extract(self, html: str | None) -> str:
        blocks = leaf_blocks(html or "", self.known)
        return "\n".join(b.text for b, yes in zip(blocks, self.label(blocks)) if yes)


def train(pages: Sequence[tuple[str, set[str]]], steps: int = _STEPS) -> Field:
    """The field of greatest likelihood (with a ridge) for (html, texts of the article's blocks)."""
    names: dict[str, int] = {}
    chains = []
    for html, wanted in pages:
        blocks = leaf_blocks(html)
        chains.append(([[names.setdefault(f, len(names)) for f in own] for own in features(blocks)], [int(b.text in wanted) for b in blocks]))
    longest = max(len(y) for _, y in chains)
    seen = np.zeros((len(chains), longest), bool)
    truth = np.zeros((len(chains), longest), np.int64)
    rows, columns = [], []
    for c, (own, y) in enumerate(chains):
        seen[c, : len(y)] = True
        truth[c, : len(y)] = y
        for i, f in enumerate(own):
            rows += [c * longest + i] * len(f)
            columns += f
    rows, columns = np.array(rows), np.array(columns)
    both = seen[:, 1:] & seen[:, :-1]
    target_w = np.bincount(columns, truth.ravel()[rows], len(names))
    target_t = np.zeros((2, 2))
    np.add.at(target_t, (truth[:, :-1][both], truth[:, 1:][both]), 1)
    w, t = np.zeros(len(names)), np.zeros((2, 2))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    for step in range(1, steps + 1):
        emit = np.zeros((len(chains), longest, 2))
        emit[:, :, 1] = np.bincount(rows, w[columns], len(chains) * longest).reshape(len(chains), longest)
        ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
        ahead[:, 0] = emit[:, 0]
        for i in range(1, longest):
            new = np.logaddexp.reduce(ahead[:, i - 1, :, None] + t[None], axis=1) + emit[:, i]
            ahead[:, i] = np.where(seen[:, i, None], new, ahead[:, i - 1])
        for i in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(t[None] + (emit[:, i + 1] + behind[:, i + 1])[:, None, :], axis=2)
            behind[:, i] = np.where(seen[:, i + 1, None], new, 0)
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        one = np.where(seen, np.exp(ahead[:, :, 1] + behind[:, :, 1] - total[:, None]), 0)
        pair = np.exp(ahead[:, :-1, :, None] + t + (emit + behind)[:, 1:, None, :] - total[:, None, None, None])
        grads = (
            (target_w - np.bincount(columns, one.ravel()[rows], len(names))) / len(chains) - _RIDGE * w,
            (target_t - (pair * both[:, :, None, None]).sum(axis=(0, 1))) / len(chains) - _RIDGE * t,
        )
        for k, (value, grad) in enumerate(zip((w, t), grads)):
            first, second = moments[2 * k], moments[2 * k + 1]
            first += 0.1 * (grad - first)
            second += 0.01 * (grad**2 - second)
            value += _RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Field({n: float(w[i]) for n, i in names.items()}, t)


# ---------------------------------------------------------------- labelled pages

#: What stands around an article: (element, class or id words to choose from).
_AROUND = {
    "menu": (("nav", ""), ("nav", "main-nav"), ("div", "menu"), ("div", "navbar"), ("ul", "nav menu"), ("div", "breadcrumb"), ("div", "topnav"), ("nav", "pagination"), ("div", "navigation"), ("div", "toc")),
    "header": (("header", ""), ("div", "header"), ("div", "masthead"), ("header", "site-header"), ("div", "top banner"), ("div", "logo")),
    "footer": (("footer", ""), ("div", "footer"), ("footer", "site-footer"), ("div", "copyright"), ("div", "bottom colophon")),
    "side": (("aside", ""), ("div", "sidebar"), ("aside", "widget"), ("div", "related"), ("section", "recommended"), ("div", "trending popular"), ("div", "tags"), ("div", "share social"), ("div", "sidebar widget-area")),
    "notice": (("div", "cookie notice"), ("div", "notice"), ("div", "alert"), ("div", "consent gdpr"), ("div", "banner"), ("section", "notice"), ("p", "notice"), ("div", "paywall message"), ("div", "popup modal")),
    "advert": (("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "advertisement"), ("div", "sponsored"), ("div", "promo"), ("aside", "ad"), ("section", "ad banner"), ("p", "ad"), ("div", "sponsor")),
    "form": (("form", ""), ("form", "search"), ("div", "newsletter subscribe"), ("form", "login"), ("div", "signup form"), ("form", "contact")),
    "comments": (("section", "comments"), ("div", "comments"), ("div", "comment"), ("ol", "comment-list"), ("section", "responses"), ("div", "replies"), ("div", "disqus"), ("ul", "comments"), ("article", "comment"), ("div", "user-comments reader")),
}
_HOLDERS = (("article", ""), ("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "post-content entry"), ("div", "article-body"), ("section", "story"), ("div", "main"), ("div", ""), ("div", "text body"))
_WRAPS = (None, None, ("div", "wrapper"), ("div", "container"), ("div", "page"), ("main", ""), ("div", "row"))
_SYLLABLES = "the of and ti er ion en le re ou ch ß ü é è ñ ó ing sch ed al da mo ka in st be no va pi lu ro".split()


def labelled_pages(count: int = TRAIN_PAGES, seed: int = 7) -> list[tuple[str, set[str]]]:
    """Pages of many layouts, each with the texts of its article's blocks.

    Layouts are those of pages in general: articles in article, main, section or div elements with or without
    telling names, in table cells and centred columns, or bare in the body; long and short, with and without
    headings, with and without anything around them."""
    draw = random.Random(seed)

    def word() -> str:
        made = "".join(draw.choice(_SYLLABLES) for _ in range(draw.randint(1, 4)))
        kind = draw.random()
        return f"{made}{draw.choice('#%*+=~')}" if kind < 0.01 else str(draw.randint(1, 3000)) if kind < 0.03 else made

    def inline(text: str) -> str:
        """Some words of a text in inline elements, or a line break among them."""
        if draw.random() > 0.25:
            return text
        words = text.split(" ")
        at = draw.randrange(len(words))
        words[at] = draw.choice(("<b>{}</b>", "<i>{}</i>", "<em>{}</em>", "<strong>{}</strong>", "<span>{}</span>", "<code>{}</code>", "{}<br>", "<b>{}<br>")).format(words[at])
        return " ".join(words)

    def sentence(low: int, high: int) -> str:
        return " ".join(word() for _ in range(draw.randint(low, high))).capitalize() + draw.choice((".", ".", ".", "", "!", "?", ","))

    def prose(low: int, high: int) -> str:
        if draw.random() < 0.08:
            return " | ".join(word() for _ in range(draw.randint(2, 9))) + draw.choice((" |", "", "."))
        return " ".join(sentence(1, 16) for _ in range(draw.randint(low, high)))

    def element(name: tuple[str, str], inner: str) -> str:
        tag, words = name
        attr = f' {draw.choice(("class", "class", "id"))}="{words}"' if words else ""
        return f"<{tag}{attr}>{inner}</{tag}>"

    def links() -> str:
        if draw.random() < 0.7:
            return "<ul>" + "".join(f'<li><a href="/{i}">{sentence(1, 3)}</a></li>' for i in range(draw.randint(2, 8))) + "</ul>"
        return draw.choice((" | ", " ", "<br>", " &middot; ", " &gt; ")).join(f'<a href="/{i}">{sentence(1, 2)}</a>' for i in range(draw.randint(2, 8)))

    def around(kind: str) -> str:
        name = draw.choice(_AROUND[kind])
        if kind == "menu":
            inner = links()
        elif kind == "header":
            inner = f"<p>{sentence(1, 5)}</p>" + (links() if draw.random() < 0.5 else "")
        elif kind == "footer":
            mark = draw.choice(("&copy; ", "&#169; ", "Copyright ", "(c) ", ""))
            inner = f"{mark}{word()}{draw.choice((' ', ', ', ' &middot; ', ' | ', ' - '))}{sentence(1, 6)}" if draw.random() < 0.7 else f"<p>{prose(1, 2)}</p>{links()}"
        elif kind == "side":
            inner = f"<h3>{sentence(1, 3)}</h3>{links()}" if draw.random() < 0.6 else f"<h4>{sentence(1, 3)}</h4><p>{prose(1, 3)}</p>"
        elif kind in ("notice", "advert"):
            inner = draw.choice((prose(1, 3), f"<p>{prose(1, 2)}</p>", f'{sentence(3, 9)} <a href="/x">{word()}</a>'))
        elif kind == "form":
            inner = f'<label>{sentence(1, 3)}</label><input name="q"><p>{prose(1, 2)}</p><button>{word()}</button>'
        else:
            inner = f"<h3>{sentence(1, 2)}</h3>" if draw.random() < 0.5 else ""
            inner += "".join(draw.choice(("<div><b>{}</b><p>{}</p></div>", "<p>{}: {}</p>", "<li><p>{}</p><p>{}</p></li>")).format(word(), prose(1, 6)) for _ in range(draw.randint(1, 5)))
        return element(name, inner)

    def article() -> str:
        out = f"<h1>{sentence(1, 10)}</h1>" if draw.random() < 0.75 else ""
        paragraph = draw.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>", "<div class=\"paragraph\">{}</div>"))
        for _ in range(draw.choice((1, 1, 2, 2, 3, 5, 8, 14))):
            kind = draw.random()
            if kind < 0.75:
                out += paragraph.format(inline(prose(1, 9)))
            elif kind < 0.83:
                out += f"<h2>{sentence(1, 6)}</h2>"
            elif kind < 0.88:
                out += "<ul>" + "".join(f"<li>{prose(1, 2)}</li>" for _ in range(draw.randint(2, 5))) + "</ul>"
            elif kind < 0.92:
                out += f"<blockquote>{prose(1, 4)}</blockquote>"
            elif kind < 0.95:
                out += f'<p>{sentence(4, 9)} <a href="/r">{word()} {word()}</a> {prose(1, 3)}</p>'
            else:
                out += f"<p>{sentence(1, 3)}</p>"
        return out

    def placed(body: str) -> str:
        """The article in its holder: a named element, a table cell beside others, a column, or nothing."""
        kind = draw.random()
        if kind < 0.62:
            return element(draw.choice(_HOLDERS), body)
        if kind < 0.74:
            menu = f"<td>{links()}</td>" if draw.random() < 0.6 else ""
            rest = f"<td>{links()}</td>" if draw.random() < 0.3 else ""
            return f"<table><tr>{menu}<td>{body}</td>{rest}</tr></table>"
        if kind < 0.8:
            return draw.choice(("<center>{}</center>", "<center><font size=2>{}</font></center>")).format(body)
        return f'<div id="{word()}">{body}</div>' if kind < 0.88 else body

    pages = []
    for _ in range(count):
        body = article()
        wanted = {b.text for b in leaf_blocks(body)}
        alone = draw.random() < 0.12
        for _ in range(0 if alone else draw.choice((0, 0, 1, 1, 2))):
            at = body.find("<p>", draw.randint(0, len(body)))
            if at > 0:
                body = body[:at] + around(draw.choice(("advert", "side", "notice", "form"))) + body[at:]
        wrapped = placed(body)
        if not alone and draw.random() < 0.25:
            wrapped = wrapped + around("comments") if draw.random() < 0.7 else element(("main", ""), wrapped + around("comments"))
        before = [around(k) for k in draw.sample(("menu", "header", "notice", "advert", "form", "side"), 0 if alone else draw.randint(0, 4))]
        after = [around(k) for k in draw.sample(("menu", "footer", "notice", "advert", "form", "side", "footer"), 0 if alone else draw.randint(0, 4))]
        page = "".join(before) + wrapped + "".join(after)
        wrap = draw.choice(_WRAPS)
        page = element(wrap, page) if wrap else page
        pages.append((f"<!DOCTYPE html><html><head><title>{sentence(2, 6)}</title></head><body>{page}</body></html>", wanted))
    return pages


@lru_cache(maxsize=1)
def default_field() -> Field:
    """The field trained on the labelled pages; the same every time."""
    return train(labelled_pages())


def extract_text(pages: DataFrame, field: Field | None = None, html_col: str = "html") -> DataFrame:
    """``pages`` with text (main text, blocks joined by line ends) and n_chars."""
    spark = pages.sparkSession
    model = spark.sparkContext.broadcast(field or default_field())
    rest = [f for f in pages.schema if f.name not in ("text", "n_chars")]
    given = [f"_{i}" for i in range(len(rest))]
    inner = pages.select(*[F.col(f"`{f.name}`").alias(g) for f, g in zip(rest, given)], F.col(f"`{html_col}`").alias("_html"))
    schema = ", ".join(f"{g} {f.dataType.simpleString()}" for f, g in zip(rest, given)) + ", text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = model.value
        for batch in batches:
            texts = [field.extract(h) for h in batch.column(batch.num_columns - 1).to_pylist()]
            arrays = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*given, "text", "n_chars"])

    return inner.mapInArrow(run, schema).withColumnsRenamed({g: f.name for g, f in zip(given, rest)})


def op2_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: the main text of all pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract_text(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")

