"""Leaf blocks of an HTML page: one pass, tolerant of anything."""

from __future__ import annotations

import re
from collections.abc import Collection
from html import unescape
from typing import NamedTuple

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I | re.S)
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
#: Elements whose text is never shown as text (an annotation says in source what the formula before it shows).
HIDDEN = frozenset("script style template textarea title head iframe select option datalist annotation annotation-xml".split())
#: Of these, the ones that hold raw text up to their end tag.
RAW = frozenset("script style textarea title iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption button label".split()
)
#: What a start tag closes, if it is open within the nearest of the elements that hold it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
_CLOSES_P = BLOCK - {"button", "label", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
_P_HOLDERS = frozenset("table td th button caption body html".split())


class Block(NamedTuple):
    """A leaf block: its text, the names that stand above it, and its link characters."""

    text: str
    names: tuple[str, ...]
    linked: int


def leaf_blocks(html: str, known: Collection[str] | None = None) -> list[Block]:
    """Blocks with text, in page order. ``names`` are ancestors' tags and the words of
    their class, id and role (only those in ``known``, if given), each once.

    The number of each name above is kept as elements open and close, so depth costs nothing.
    """
    out: list[Block] = []
    above: dict[str, int] = {}
    stack: list[tuple[str, tuple[str, ...]]] = []
    open_tags: dict[str, int] = {}
    parts: list[str] = []
    linked = hidden = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            parts.clear()
            if text:
                out.append(Block(text, tuple(above), linked))
            linked = 0

    def pop() -> None:
        nonlocal hidden
        tag, names = stack.pop()
        open_tags[tag] -= 1
        if tag in HIDDEN:
            hidden -= 1
        if tag in BLOCK:
            flush()
        for n in names:
            above[n] -= 1
            if not above[n]:
                del above[n]

    def close(tags: Collection[str], holders: Collection[str]) -> None:
        """Close the outermost of ``tags`` that is open above the nearest holder."""
        if not any(open_tags.get(t) for t in tags):
            return
        to = None
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                to = i
            elif stack[i][0] in holders:
                break
        if to is not None:
            while len(stack) > to:
                pop()

    def text_of(raw: str) -> None:
        nonlocal linked
        if raw and not hidden:
            shown = unescape(raw)
            parts.append(shown)
            if open_tags.get("a"):
                linked += len(shown)

    at, end = 0, len(html)
    while at < end:
        found = _TOKEN.search(html, at)
        if found is None:
            text_of(html[at:])
            break
        text_of(html[at : found.start()])
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        attrs = found[3] or found[6] or ""
        if found[1] or found[4]:
            if tag == "br" or tag == "p" and not open_tags.get("p"):
                parts.append(" ") if tag == "br" else flush()
            elif open_tags.get(tag):
                while True:
                    last = stack[-1][0]
                    pop()
                    if last == tag:
                        break
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in _CLOSES_P and open_tags.get("p"):
            close(("p",), _P_HOLDERS)
        if tag == "body" or tag in BLOCK and open_tags.get("head"):
            close(("head",), ())
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in BLOCK:
            flush()
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = stop.end() if stop else end
            continue
        names = [f"<{tag}>"] if tag in BLOCK else []
        if attrs:
            for m in _ATTR.finditer(attrs):
                names += [f".{w}" for w in _NAME.findall((m[2] or m[3] or m[4] or "").lower())]
        names = tuple(n for n in dict.fromkeys(names) if known is None or n in known)
        for n in names:
            above[n] = above.get(n, 0) + 1
        stack.append((tag, names))
        open_tags[tag] = open_tags.get(tag, 0) + 1
        if tag in HIDDEN:
            hidden += 1
    parts_left = stack
    while parts_left:
        pop()
    flush()
    return out
