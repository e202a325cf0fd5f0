"""Benchmark decontamination by greedy string tiling.

Texts are sequences of words (letters, digits and every non-ASCII character but
white space and the punctuation of East Asia, in lower case; in scripts written
without spaces each character is a word). Seeds, runs of SEED words, are hashed by one
running Karp-Rabin pass over a document and joined with the benchmark's
seeds. For every test item that shares a seed, the matches are the maximal runs
of seeds on one diagonal, checked word by word; the longest is marked, what
overlaps it is cut back to its unmarked part, and so on until no match of SEED
words is left. Where words repeat so often that diagonals would be many, the same
tiles are found by passes instead: the longest match is found by bisection over
window hashes, so the cost follows the texts' lengths and not their product.
Tiles may lie in any order and anywhere, so reordered passages
are caught. A document is contaminated if its tiles cover THRESHOLD of the
words of some item.

A benchmark of at most ITEMS_BYTES is checked to be so small and goes to every
task, so documents are not moved. A larger one meets the documents by a shuffle
join on the seeds' values.

Null or empty texts are clean, and items of fewer than SEED words match nothing.
Of matches of equal length the one first in the item, then in the document, is
marked first. Repeated rows are judged alike; an empty benchmark leaves every
document clean; an empty table gives no rows; extra columns are kept, but for those
named like the three that are made. Of items with one id each counts
by itself, and the id is listed once; items without an id are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import cut
from .textarrays import NOT_ALNUM, _powers, blocks, rows_of, runs, tidy, words

SEED = 5
THRESHOLD = 0.5
#: Bytes of benchmark text that may go to every task.
ITEMS_BYTES = 16_000_000
#: Seed pairs, for each word of an item and a document, up to which their diagonals are listed.
PAIRS_PER_WORD = 4
#: Characters that are words by themselves (Thai, Lao, Burmese, Khmer, kana, Bopomofo, Chinese), or else non-ASCII separators.
_UNSPACED = re.compile(
    "([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u3007\u3021-\u3029\u3031-\u3035\u3038-\u303c\u3041-\u309f"
    "\u30a1-\u30fa\u30fc-\u312f\u31a0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff])"
    "|[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000-\u3004\u3008-\u3020\u302a-\u3030\u3036\u3037\u303d-\u303f\u30a0\u30fb"
    "\uff00-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]"
)


def _bytes(text: str | None) -> bytes:
    """The text with spaces between its words."""
    text = (text or "").lower()
    return (text if text.isascii() else _UNSPACED.sub(r" \1 ", text)).encode()


def _weight(text: str | None) -> int:
    """Bytes that ``_bytes`` gives at most; unspaced text has as many more words."""
    return len(text or "") * (1 if (text or "").isascii() else 6)


class Items:
    """Seeds of a block of test items."""

    def __init__(self, items: list[tuple[int, str]], seed: int = SEED):
        self.ids = [i for i, _ in items]
        self.seed = seed
        values, bounds = words([_bytes(t) for _, t in items], NOT_ALNUM)
        self.words = [values[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        found, at = runs(values, bounds, seed)
        counts = np.diff(at)
        short = np.diff(bounds) < seed
        item = np.repeat(np.arange(len(items)), counts)
        place = np.arange(len(found)) - np.repeat(at[:-1], counts)
        keep = ~short[item]
        order = np.argsort(found[keep], kind="stable")
        self.seeds, self.item, self.place = found[keep][order], item[keep][order], place[keep][order]
        #: Per distinct (seed, item), in order of seeds, how often it is there.
        new = np.ones(len(self.seeds), bool)
        new[1:] = (self.seeds[1:] != self.seeds[:-1]) | (self.item[1:] != self.item[:-1])
        first = np.flatnonzero(new)
        self.pair_seed, self.pair_item = self.seeds[first], self.item[first]
        self.pair_count = np.diff(np.append(first, len(self.seeds)))


def tile(item: np.ndarray, doc: np.ndarray, pairs: list[tuple[int, int]], seed: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (item place, document place, words), from places where seeds agree."""
    runs_by: dict[int, list[int]] = {}
    for i, j in pairs:
        if np.array_equal(item[i : i + seed], doc[j : j + seed]):
            runs_by.setdefault(j - i, []).append(i)
    heap: list[tuple[int, int, int]] = []
    for diagonal, places in runs_by.items():
        places = sorted(set(places))
        start = last = places[0]
        for i in [*places[1:], None]:
            if i is None or i != last + 1:
                heap.append((-(last - start + seed), start, start + diagonal))
                start = i
            last = i
    heapq.heapify(heap)
    item_free, doc_free = np.ones(len(item), bool), np.ones(len(doc), bool)
    tiles = []
    while heap:
        length, i, j = heapq.heappop(heap)
        length = -length
        free = item_free[i : i + length] & doc_free[j : j + length]
        if free.all():
            tiles.append((i, j, length))
            item_free[i : i + length] = False
            doc_free[j : j + length] = False
            continue
        edge = np.diff(np.concatenate(([False], free, [False])).astype(np.int8))
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
            if b - a >= seed:
                heapq.heappush(heap, (-int(b - a), i + int(a), j + int(a)))
    return tiles


def _window_hashes(values: np.ndarray, free: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the windows of ``width`` words that are wholly free."""
    if len(values) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = _powers(len(values) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=total[1:])
        marked = np.concatenate(([0], np.cumsum(~free)))
        at = np.flatnonzero(marked[width:] == marked[: len(marked) - width])
        return at, (total[at + width] - total[at]) * down[at]


def tile_passes(item: np.ndarray, doc: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """The tiles of ``tile``, by passes over the words that are still free, longest matches first."""
    item, doc = item.astype(np.uint64), doc.astype(np.uint64)
    item_free, doc_free = np.ones(len(item), bool), np.ones(len(doc), bool)
    tiles: list[tuple[int, int, int]] = []
    most = min(len(item), len(doc))

    def shared(width: int) -> bool:
        return bool(np.isin(_window_hashes(item, item_free, width)[1], _window_hashes(doc, doc_free, width)[1]).any())

    while most >= seed and shared(seed):
        low = seed
        while low < most:
            middle = (low + most + 1) // 2
            if shared(middle):
                low = middle
            else:
                most = middle - 1
        (at, own), (there, hashes) = _window_hashes(item, item_free, low), _window_hashes(doc, doc_free, low)
        order = np.argsort(hashes, kind="stable")
        there, hashes = there[order], hashes[order]
        first, last = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
        nexts: dict[int, int] = {}
        for i, a, b in zip(at.tolist(), first.tolist(), last.tolist()):
            if a == b or not item_free[i : i + low].all():
                continue
            p = nexts.get(a, a)
            while p < b and not doc_free[there[p] : there[p] + low].all():
                p += 1
            nexts[a] = p
            # Places whose hash agrees and words differ are passed over, and kept for other windows.
            k = p
            while k < b and not (doc_free[there[k] : there[k] + low].all() and np.array_equal(item[i : i + low], doc[there[k] : there[k] + low])):
                k += 1
            if k < b:
                j = int(there[k])
                tiles.append((i, j, low))
                item_free[i : i + low] = False
                doc_free[j : j + low] = False
        most = low - 1
    return tiles


def coverages(texts: list[str | None], items: Items) -> list[list[tuple[int, float]]]:
    """For each text, (item number, covered share) of the items that it shares seeds with."""
    out: list[list] = [[] for _ in texts]
    if not len(items.seeds):
        return out
    values, bounds = words([_bytes(t) for t in texts], NOT_ALNUM)
    found, at = runs(values, bounds, items.seed)
    lower = np.searchsorted(items.seeds, found)
    hit = np.flatnonzero(items.seeds[np.minimum(lower, len(items.seeds) - 1)] == found)
    if not len(hit):
        return out
    text = np.searchsorted(at, hit, "right") - 1
    # Distinct seeds of each text, how often each is there, and the items that have it.
    order = np.lexsort((hit, found[hit], text))
    hit, text = hit[order], text[order]
    seed = found[hit]
    new = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (seed[1:] != seed[:-1]))))
    end = np.append(new[1:], len(hit))
    a, b = np.searchsorted(items.pair_seed, seed[new], "left"), np.searchsorted(items.pair_seed, seed[new], "right")
    each = np.repeat(np.arange(len(new)), b - a)
    pair = np.arange(len(each)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[each]
    number = items.pair_item[pair]
    group = np.lexsort((number, text[new][each]))
    each, pair, number = each[group], pair[group], number[group]
    own = text[new][each]
    starts = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (number[1:] != number[:-1]))))
    for s, e in zip(starts, np.append(starts[1:], len(own))):
        t, n = int(own[s]), int(number[s])
        item, doc = items.words[n], values[bounds[t] : bounds[t + 1]]
        if ((end - new)[each[s:e]] * items.pair_count[pair[s:e]]).sum() > PAIRS_PER_WORD * (len(item) + len(doc)):
            tiles = tile_passes(item, doc, items.seed)
        else:
            pairs = []
            for x in each[s:e]:
                here = (hit[new[x] : end[x]] - at[t]).tolist()
                low, high = np.searchsorted(items.seeds, seed[new[x]], "left"), np.searchsorted(items.seeds, seed[new[x]], "right")
                there = items.place[low:high][items.item[low:high] == n].tolist()
                pairs += [(i, j) for i in there for j in here]
            tiles = tile(item, doc, pairs, items.seed)
        out[t].append((n, sum(size for _, _, size in tiles) / len(item)))
    return out


def _by_broadcast(docs: DataFrame, items: DataFrame, threshold: float, seed: int, at: int) -> DataFrame:
    """``docs`` with coverage and leaked_items; ``items`` (id, text) are few and go to every task."""
    known = docs.sparkSession.sparkContext.broadcast(Items([(r[0], r[1]) for r in items.collect()], seed))
    given = [f"_{i}" for i in range(len(docs.columns))]
    schema = ", ".join(f"{g} {f.dataType.simpleString()}" for g, f in zip(given, docs.schema)) + ", coverage double, leaked_items array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = known.value
        for batch in batches:
            coverage, leaked = [], []
            for texts in blocks(batch.column(at).to_pylist(), _weight, 2_000_000):
                for own in coverages(texts, items):
                    coverage.append(max((c for _, c in own), default=0.0))
                    leaked.append(sorted({items.ids[n] for n, c in own if c >= threshold}))
            arrays = [*batch.columns, pa.array(coverage, pa.float64()), pa.array(leaked, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*given, "coverage", "leaked_items"])

    return docs.toDF(*given).mapInArrow(tidy(run), schema).toDF(*docs.columns, "coverage", "leaked_items")


def _seeds_of(rows: DataFrame, kind: str, seed: int) -> DataFrame:
    """(k, seed): the distinct seeds of every row of ``rows`` (k, text)."""
    schema = pa.schema([("k", pa.string() if kind == "string" else pa.int64()), ("seed", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(rows_of(batch), lambda r: _weight(r[1]), 2_000_000):
                values, bounds = words([_bytes(t) for _, t in block], NOT_ALNUM)
                found, at = runs(values, bounds, seed)
                own = [np.unique(found[at[i] : at[i + 1]]) if bounds[i + 1] - bounds[i] >= seed else found[:0] for i in range(len(block))]
                keys = [k for (k, _), s in zip(block, own) for _ in range(len(s))]
                yield pa.RecordBatch.from_arrays([pa.array(keys, schema[0].type), pa.array(np.concatenate(own).view(np.int64))], schema=schema)

    return rows.mapInArrow(tidy(run), f"k {kind}, seed long")


def _by_join(docs: DataFrame, items: DataFrame, threshold: float, seed: int, at: int) -> DataFrame:
    """The same by joins: seeds of documents and items meet by value, then each pair that shares one is tiled.

    A text stands for all documents that have it, under its SHA-256; documents move once,
    to meet the answers. Items are numbered once, in a table."""
    text = F.col(f"`{docs.columns[at]}`")
    items = cut(items.withColumn("n", F.monotonically_increasing_id()), "items")
    given = [f"_{i}" for i in range(len(docs.columns))]
    keyed = docs.toDF(*given).withColumn("k", F.sha2(F.coalesce(F.col(given[at]), F.lit("")), 256))
    texts = docs.select(F.sha2(F.coalesce(text, F.lit("")), 256).alias("k"), text.alias("text")).groupBy("k").agg(F.first("text").alias("text"))
    of_items = _seeds_of(items.select("n", "text"), "bigint", seed).withColumnRenamed("k", "n")
    pairs = _seeds_of(texts, "string", seed).join(of_items, "seed").select("k", "n").distinct()
    met = pairs.join(items.select("n", "item", F.col("text").alias("item_text")), "n").join(texts, "k").select("k", "item", "item_text", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(rows_of(batch))
            covered = [max((c for _, c in coverages([t], Items([(i, s)], seed))[0]), default=0.0) for _, i, s, t in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(covered, pa.float64())], names=["k", "item", "c"])

    judged = met.mapInArrow(tidy(run), "k string, item long, c double").groupBy("k").agg(
        F.max("c").alias("coverage"), F.sort_array(F.collect_set(F.when(F.col("c") >= threshold, F.col("item")))).alias("leaked_items"))
    none = F.array().cast("array<bigint>")
    out = keyed.join(judged, "k", "left").select(*given, F.coalesce("coverage", F.lit(0.0)), F.coalesce("leaked_items", none))
    return out.toDF(*docs.columns, "coverage", "leaked_items")


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, seed: int = SEED,
               text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` (all columns) with contaminated, coverage (of the item covered most) and
    leaked_items (ids of the items covered to ``threshold``, ascending)."""
    docs = docs.drop("contaminated", "coverage", "leaked_items")
    columns = docs.columns
    items = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("text"))
    size = items.agg(F.sum(F.octet_length("text").cast("long") + 64)).first()[0] or 0
    find = _by_broadcast if size <= ITEMS_BYTES else _by_join
    out = find(docs, items, threshold, seed, columns.index(text_col))
    return out.withColumn("contaminated", F.size("leaked_items") > 0).select(*columns, "contaminated", "coverage", "leaked_items")


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: all documents against all of ``benchmark``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text")
