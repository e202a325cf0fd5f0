"""Distributed connected components by alternating star contraction.

A round first lets every task replace its own edges by a spanning forest. Then one
step links every node's larger neighbours to its smallest one, and the next every
node's smaller neighbours likewise, until a round changes nothing. Rounds are few
(logarithmic in practice), a step is an aggregation and a join of edges, and a hub
is only ever reduced by ``min`` or met in a join that can be split. A round's table
replaces that of the round before. A caller may let one task finish once ``few``
edges are left, which are counted first; by default the same steps run at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut

#: Edges of a forest that a task holds before it hands them on (some 200 bytes each).
HELD_EDGES = 500_000


def _with_least(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """``pairs`` (u, v) with ``m`` of u. Both sides are dealt anew by a bijection of
    the key, so that a hub's rows may be split between tasks."""
    left = pairs.withColumn("h", F.reverse("u"))
    right = least.select(F.reverse("u").alias("h"), "m")
    return left.join(right, "h").drop("h")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
    else:
        pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = _with_least(pairs, least)
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return out.where("a != b")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of one task as (node, least node that its own edges reach), by blocks of bounded size."""
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    def forest() -> Iterator[pa.RecordBatch]:
        nodes = [n for n in parent if root(n) != n]
        for at in range(0, len(nodes), 10_000):
            part = nodes[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([root(n) for n in part], pa.string())], names=["a", "b"])
        parent.clear()

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        if len(parent) >= HELD_EDGES:
            yield from forest()
    yield from forest()


def connected_components(edges: DataFrame, most_rounds: int = 60, few: int = 0) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b, both strings): label is the
    smallest node that links reach. Nulls and loops are ignored; no edges, no rows.
    The result reads a scratch table, which ``storage.discard`` of it deletes.

    Stops when a round changes nothing; raises if that does not come in
    ``most_rounds`` (each round at least halves the longest path's share).
    """
    edges = edges.select("a", "b").where("a is not null and b is not null and a != b")
    edges = cut(edges.mapInArrow(_forest, "a string, b string").distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        got = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(got)

    before = mark(edges)
    for _ in range(most_rounds if before[0] else 0):
        if before[0] <= min(few, HELD_EDGES):
            edges = cut(edges.coalesce(1).mapInArrow(_forest, "a string, b string"), "edges", edges)
            break
        after = _star(_star(edges, True), False)
        edges = cut(after.mapInArrow(_forest, "a string, b string").distinct(), "edges", edges)
        now = mark(edges)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError("connected components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
    out.scratch_path = edges.scratch_path
    return out
