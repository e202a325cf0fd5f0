"""Exact top-k inner products with an impact-ordered, score-at-a-time index.

Components are whole numbers. The index cuts the candidates into shards; a
shard's postings (candidate, value) are grouped into segments by dimension and
by quantised impact, the bit length of the value's magnitude. A search takes
the segments of all dimensions in descending impact and adds each posting's
product to its candidate's score. Before each impact level it asks for proof:
what a candidate can still gain is bounded by the norm of its components not
yet seen times the query's (Cauchy-Schwarz), and by the level's greatest value
times the query's absolute sum. Once few candidates can still reach the k-th
best sure score, only those possible members are scored again, exactly.

Every shard knows a score that each query's k-th best reaches in any case, from
a first search of a bounded sample of the candidates (``SAMPLE`` vectors); so a
query leaves a shard as soon as nothing there can reach it. The sample only sets
that bound: results are exact, whatever it holds.

Partial sums are floating-point numbers with a slack for their rounding; final
scores are whole numbers, exact at any size, held to the range of 64 bits.
Components beyond 64 bits are held to that range as well. Vectors that are null,
empty, or hold null or non-finite components take no part; a query meets the
vectors of its own length. Ties go to the smaller id; repeated rows with an id
are candidates of their own, but never a query's own. Null ids take no part. An
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Candidates of a shard and queries of a block; their product bounds a task's scores.
SHARD, BLOCK = 4096, 1024
#: Candidates that a query's first bound comes from.
SAMPLE = 4096
#: Blocks that meet one index of a shard; beyond them it is built once more.
BLOCKS_AT_ONCE = 64
#: Proof is worth its price when at most this share of a shard must be scored again.
RESCORE_SHARE = 0.02
_HITS = "query_id long, vec_id long, score long"
_LOW, _HIGH = -(2**63), 2**63 - 1


def quantise(df: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): floor(scale * x) of every component, for vectors that take part."""
    v = F.col(vector_col)
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    return df.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ok).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def _pack(rows: DataFrame, parts: int, key: str) -> DataFrame:
    """``rows`` dealt into ``parts`` parts, numbered in ``key``; each is a row of packed arrays for each vector length."""
    schema = pa.schema([(key, pa.int64()), (f"{key}_ids", pa.binary()), (f"{key}_vectors", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        part = TaskContext.get().partitionId()
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = v.values.to_numpy(zero_copy_only=False)
                held.setdefault(len(x), []).append((i, x))
        for own in held.values():
            ids, vectors = zip(*own)
            columns = [part], [np.array(ids, "<i8").tobytes()], [np.stack(vectors).astype("<i8").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return rows.repartition(parts).mapInArrow(run, f"{key} long, {key}_ids binary, {key}_vectors binary")


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` and ``b`` (64-bit), exact, held to the range of 64 bits."""
    if not len(a):
        return np.zeros(0, np.int64)
    size = lambda x: np.abs(x.astype(np.float64)).max(axis=1, initial=0)
    wide = size(a) * size(b) * a.shape[1] >= 2.0**62
    out = np.zeros(len(a), np.int64)
    out[~wide] = np.einsum("ij,ij->i", a[~wide], b[~wide])
    for i in np.flatnonzero(wide):
        out[i] = min(_HIGH, max(_LOW, sum(x * y for x, y in zip(a[i].tolist(), b[i].tolist()))))
    return out


class ShardIndex:
    """Impact-ordered postings of one shard, whose vectors have one length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.whole = ids[order], vectors[order]
        real = self.whole.astype(np.float64)
        magnitude = np.abs(real)
        impact = np.frexp(magnitude)[1]
        impact[magnitude == 0] = 0
        #: Descending impact; per level its greatest value, what is left of each vector's norm before it, and the segments.
        self.levels = []
        square = real**2
        for level in sorted(set(impact.ravel().tolist()) - {0}, reverse=True):
            own = impact == level
            rest = np.sqrt(np.where(impact <= level, square, 0).sum(axis=1))
            self.levels.append((magnitude[own].max(), rest, np.where(own, real, 0)))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query position, id, score) of every query's k best in this shard, but none below the query's floor.

        A level's segments of all dimensions are one matrix, so that adding its postings is one product."""
        n, m = len(self.ids), len(queries)
        live = np.arange(m)
        q = queries.astype(np.float64)
        norm, total = np.sqrt((q**2).sum(axis=1)), np.abs(q).sum(axis=1)
        slack = 1e-6 + 1e-12 * (norm * max((r.max(initial=0) for _, r, _ in self.levels), default=0.0))
        floor = np.full(m, -np.inf) if floors is None else floors.astype(np.float64)
        floor = floor - 1e-12 * np.abs(floor)
        scores = np.zeros((n, m))
        left, right = np.searchsorted(self.ids, query_ids, "left"), np.searchsorted(self.ids, query_ids, "right")
        for j in np.flatnonzero(left < right):
            scores[left[j] : right[j], j] = -np.inf
        want = min(k, n)
        # Scores beyond 64 bits are held to that range, so they are ties: none may be left out for a higher one.
        edge = 2.0**63 * (1 - 1e-9)
        held = lambda x: np.where(x <= -edge, -np.inf, np.minimum(x, edge))
        kth = lambda s: np.partition(s, n - want, axis=0)[n - want]
        possible = None
        for step, (most, rest, postings) in enumerate(self.levels):
            gain = np.minimum(rest[:, None] * norm[None, live], most * total[None, live]) + slack[None, live]
            least = held(floor[live] if not step else np.maximum(floor[live], kth(scores - gain)))
            possible = scores + gain >= least[None, :]
            some = possible.any(axis=0)
            if not some.all():  # queries that nothing here can answer
                live, scores, possible = live[some], scores[:, some], possible[:, some]
            if step and possible.sum() <= RESCORE_SHARE * n * max(1, len(live)):
                break
            scores += postings @ q[live].T
        else:
            least = held(np.maximum(floor[live], kth(scores) - slack[live]))
            possible = scores + slack[None, live] >= least[None, :]
        possible &= np.isfinite(scores)
        at, j = np.nonzero(possible)
        exact = exact_scores(self.whole[at], queries[live[j]])
        order = np.lexsort((self.ids[at], -exact.astype(np.float64), j)) if not len(exact) or np.abs(exact.astype(np.float64)).max() < 2.0**53 else np.array(
            sorted(range(len(j)), key=lambda i: (j[i], -int(exact[i]), self.ids[at[i]])), np.int64)
        at, j, exact = at[order], j[order], exact[order]
        keep = np.arange(len(j)) - np.searchsorted(j, j) < k
        return live[j[keep]], self.ids[at[keep]], exact[keep]


def search(candidates: DataFrame, queries: DataFrame, k: int = 5, shard: int = SHARD, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of all candidates but its own id.

    Queries are packed in blocks, candidates in shards. Blocks first learn their floors from
    the sample, then each goes to every shard; a shard is indexed once for ``BLOCKS_AT_ONCE``
    blocks, which it takes one after the other. Each (shard, block) gives at most k rows a query, and
    a window over a query's rows picks the k best.
    """
    spark = candidates.sparkSession
    shards = max(1, -(-candidates.count() // shard))
    asked = max(1, -(-queries.count() // block))
    hits_schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    drawn: dict[int, list] = {}
    for i, v in candidates.orderBy(F.xxhash64("id")).limit(sample).collect():
        drawn.setdefault(len(v), []).append((i, v))
    known = spark.sparkContext.broadcast({n: (np.array([i for i, _ in own], np.int64), np.array([v for _, v in own], np.int64)) for n, own in drawn.items()})

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = {n: ShardIndex(*own) for n, own in known.value.items()}
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["b_ids"], "<i8")
                q = np.frombuffer(row["b_vectors"], "<i8").reshape(len(ids), -1)
                floor = np.full(len(ids), _LOW, np.int64)
                if q.shape[1] in indexes:
                    j, _, score = indexes[q.shape[1]].search(ids, q, k)
                    last = np.flatnonzero(np.append(j[1:] != j[:-1], True)) if len(j) else np.zeros(0, np.int64)
                    full = last[np.diff(np.append(-1, last)) == k]
                    floor[j[full]] = score[full]
                made = [row["b"]], [row["b_ids"]], [row["b_vectors"]], [floor.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], names=["b", "b_ids", "b_vectors", "b_floors"])

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        for row in left.to_pylist():
            ids = np.frombuffer(row["s_ids"], "<i8")
            index = ShardIndex(ids, np.frombuffer(row["s_vectors"], "<i8").reshape(len(ids), -1))
            for i in range(right.num_rows):
                qids = np.frombuffer(right.column("b_ids")[i].as_py(), "<i8")
                q = np.frombuffer(right.column("b_vectors")[i].as_py(), "<i8").reshape(len(qids), -1)
                if index.whole.shape[1] == q.shape[1]:
                    j, got, score = index.search(qids, q, k, np.frombuffer(right.column("b_floors")[i].as_py(), "<i8"))
                    found.append(pa.Table.from_arrays([pa.array(qids[j]), pa.array(got), pa.array(score)], schema=hits_schema))
        return pa.concat_tables(found) if found else hits_schema.empty_table()

    last_group = (asked - 1) // BLOCKS_AT_ONCE
    left = _pack(candidates, shards, "s").withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last_group).cast("long"))))
    bounded = _pack(queries, asked, "b").mapInArrow(floors, "b long, b_ids binary, b_vectors binary, b_floors binary")
    right = bounded.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).withColumn("g", F.floor(F.col("b") / BLOCKS_AT_ONCE))
    hits = left.groupBy("s", "g").cogroup(right.groupBy("s", "g")).applyInArrow(run, _HITS)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: the 5 best for every vector whose id is divisible by 50."""
    rows = quantise(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(rows, rows.where(F.col("id") % 50 == 0), 5)


OP9_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM e q JOIN e c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
