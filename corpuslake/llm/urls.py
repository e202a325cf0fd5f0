"""URL filters with redirect equivalence.

Rules judge a URL by host (and all subdomains) and path prefix; the longest
rule wins. Beyond the rules, URLs that redirect to each other or name each
other as canonical are aliases: distributed connected components over these
links carry a block from any blocked member to every member without a rule of
its own. A member that a rule allows stays allowed, whatever its aliases are;
a component without a blocked member is allowed.

A URL's identity, as a node, is its host, path and query; scheme and fragment
play no part. Null URLs, or such without ``://``, have empty host and path and
are nobody's alias. Repeated rows are judged alike; an empty table gives no
rows; extra columns are kept, but for host, path, rule and verdict, which are
replaced. HTML of any length is scanned once; of a tag's repeated attributes the
first counts. Rules of equal length: the one that sorts last wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components

#: (verdict, host, path) of the fixed rules.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null where there is none."""
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def host(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(_rest(url), r"(?s)\A([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"(?s)\A[^/?#]*([^?#]*)", 1), F.lit(""))


def node(url: Column) -> Column:
    """Identity of a URL: host, path (at least ``/``) and query; null if it is none."""
    rest = _rest(url)
    there = F.when(path(url) == "", F.lit("/")).otherwise(path(url))
    query = F.regexp_extract(rest, r"(?s)\A[^?#]*(\?[^#]*)", 1)
    return F.when(rest.isNotNull() & (host(url) != ""), F.concat(host(url), there, query))


#: One scan from left to right: comments and raw text are passed over, link and meta tags are taken.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|textarea|title|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(link|meta)\b([^>]*)>", re.I | re.S
)
_ATTR = re.compile(r"""([\w-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.S)


def declared_links(url: str, html: str) -> Iterator[str]:
    """Absolute targets of a page's canonical links and refresh redirects.

    Tags inside comments, scripts, styles and other raw text are no tags."""
    for tag in _TAG.finditer(html):
        if not tag[2]:
            continue
        attrs: dict[str, str] = {}
        for m in _ATTR.finditer(tag[3]):
            attrs.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
        to = ""
        if tag[2].lower() == "link" and "canonical" in attrs.get("rel", "").lower().split():
            to = attrs.get("href", "")
        elif tag[2].lower() == "meta" and attrs.get("http-equiv", "").lower() == "refresh":
            found = re.search(r"url\s*=\s*(.*)", attrs.get("content", ""), re.I | re.S)
            to = found[1].strip().strip("'\"") if found else ""
        if to:
            try:
                yield urljoin(url, to.strip())
            except ValueError:
                continue


def links_of_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst): canonical links and refresh redirects that pages declare.

    Pages without such a tag are dropped before Python sees them.
    """
    schema = pa.schema([("src", pa.string()), ("dst", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(u, to) for u, h in zip(*(c.to_pylist() for c in batch.columns)) for to in declared_links(u, h)]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in range(2)], schema=schema)

    tagged = F.col(html_col).rlike("(?i)canonical|http-equiv") & F.col(url_col).isNotNull()
    return pages.where(tagged).select(url_col, html_col).mapInArrow(run, "src string, dst string")


def _rule(rules: Sequence[tuple[str, str, str]], value) -> Column:
    """``value(rule)`` of the longest rule that fits columns host and path; null if none does."""
    name, there = F.col("host"), F.col("path")
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((name == rule[1]) | name.endswith("." + rule[1])) & there.startswith(rule[2])
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def judge(pages: DataFrame, links: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict. ``links`` (src, dst) are redirect and canonical links.

    Rules are few and fixed, so they are one expression. The links and what they
    spread are as many as the links declared; the pages' side of the join may be
    split where a URL is common.
    """
    own = _rule(rules, lambda r: r[0])
    made = ("host", "path", "rule", "verdict")
    rest = [c for c in pages.columns if c not in made]
    given = pages.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(rest)], F.col(f"`{url_col}`").alias("url"))
    judged = given.withColumns({"host": host(F.col("url")), "path": path(F.col("url")), "k": F.reverse(node(F.col("url")))}).withColumns(
        {"rule": _rule(rules, lambda r: r[1] + r[2]), "own": own}
    )
    members = connected_components(links.select(node(F.col("src")).alias("a"), node(F.col("dst")).alias("b")))
    full = F.concat(F.lit("http://"), F.col("node"))
    blocked = members.withColumns({"host": host(full), "path": path(full)}).where(own == "block").select(F.reverse("label").alias("k")).distinct()
    spread = (
        members.withColumn("k", F.reverse("label")).join(blocked, "k", "left_semi")
        .select(F.reverse("node").alias("k"), F.lit(True).alias("spread"))
    )
    # URLs that are no node meet nothing, and must not meet in one task.
    judged = judged.withColumn("k", F.coalesce("k", F.concat(F.lit("#"), F.monotonically_increasing_id().cast("string"))))
    verdict = F.coalesce(F.col("own"), F.when(F.col("spread"), F.lit("block")), F.lit("allow"))
    out = judged.join(spread, "k", "left")
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(rest)], "host", "path", "rule", verdict.alias("verdict"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: judge every page's URL, with the links that the pages declare."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = judge(pages.select("page_id", "url"), links_of_pages(pages))
    return out.select("page_id", "host", "path", "rule", "verdict")


#: Rules, and the default verdict: no row of the driver's ``pages`` declares a link
#: (tests hold what links spread against brute force).
OP7_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u
), rules(verdict, h, p, rule) AS (
  VALUES ('block', 'net', '/', 'net/'), ('allow', 'example.net', '/en/', 'example.net/en/'),
         ('block', 'example.com', '/de/', 'example.com/de/'), ('allow', 'org', '/fr/', 'org/fr/')
), m AS (
  SELECT p.page_id, p.host, p.path, r.rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC NULLS LAST, r.rule) AS n
  FROM p LEFT JOIN rules r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
"""
