"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts, up to three bytes long; a context of
full length is kept if its language showed it at least twice, so the order
varies. A byte's probability comes from the longest kept context; a byte new
there costs an escape (method C, with exclusion of the bytes already ruled out)
and is tried one byte shorter, down to all bytes alike. Statistics are frozen
after training, so the code length of a byte depends on its context alone: all
of them are worked out once, and scoring a text is a sum of table entries. The
language with the shortest code wins.

Null text, or text without a letter, is ``und`` with score 0. Ties go to the
language that sorts first. Rows without a language teach nothing; with no
labelled row every text is ``und``. A null id is not held out. Repeated rows are
predicted alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textarrays import blocks, tidy

ORDER = 3
#: About this many labelled rows of each language are learnt from, chosen by a hash of the id.
TRAIN_ROWS = 2000
#: Times a language must show a full-length context for it to be kept.
KEEP = 2
_PAD = b"\n" * ORDER


def _grams(texts: list[bytes]) -> np.ndarray:
    """Every byte with the ORDER bytes before it, as one number; texts start after line ends."""
    data = np.frombuffer(b"".join(_PAD + t for t in texts), np.uint8).astype(np.uint32)
    gram = data[ORDER:].copy()
    for i in range(1, ORDER + 1):
        gram |= data[ORDER - i : len(data) - i] << np.uint32(8 * i)
    keep = np.ones(len(gram), bool)
    at = np.cumsum([len(t) + ORDER for t in texts[:-1]], dtype=np.int64)
    for i in range(ORDER):
        keep[at - ORDER + i] = False
    return gram[keep]


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all texts of ``docs`` (lang, text); combined in each task first."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append((text or "").encode())
            for lang, texts in by.items():
                for block in blocks(texts, len):
                    gram, n = np.unique(_grams(block), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(gram)), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], schema=schema
                    )

    counted = docs.select("lang", "text").mapInArrow(tidy(run), "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class ContextTrees:
    """Frozen code lengths, in bits, of every byte in every kept context."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        seen = np.zeros(256, bool)
        for gram, _ in counts.values():
            for i in range(ORDER + 1):
                seen[np.unique(gram >> (8 * i) & 255)] = True
        #: Bytes that no language showed cost alike; they share the last class.
        self.classes = np.full(256, int(seen.sum()), np.uint8 if seen.sum() < 256 else np.uint16)
        self.classes[seen] = np.arange(seen.sum())
        self.size = int(seen.sum()) + 1
        spare = 256 - int(seen.sum())
        kept = {lang: self._levels(self.classes[gram >> 24 & 255].astype(np.int64), gram, n) for lang, (gram, n) in counts.items()}
        full = np.unique(np.concatenate([level[ORDER][0] for level in kept.values()])) if kept else np.zeros(0, np.int64)
        short = np.arange(self.size ** (ORDER - 1), dtype=np.int64)
        #: Row of the table for each context of ORDER classes.
        self.row = np.tile(np.arange(len(short), dtype=np.int32), self.size)
        self.row[full] = len(short) + np.arange(len(full))
        self.table = np.zeros(((len(short) + len(full)) * self.size, len(self.langs)), np.float32)
        for j, lang in enumerate(self.langs):
            costs = self._costs(kept[lang], spare)
            below = self._longest(short, costs, ORDER - 1)
            above = self._longest(full, costs, ORDER)
            self.table[:, j] = np.concatenate((below, above)).ravel()

    def _levels(self, _first: np.ndarray, gram: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per order: the kept contexts (class numbers, oldest byte most significant) and their counts by class."""
        parts = [self.classes[gram >> (8 * i) & 255].astype(np.int64) for i in range(ORDER + 1)]
        out = []
        for order in range(ORDER + 1):
            context = np.zeros(len(gram), np.int64)
            for i in range(order, 0, -1):
                context = context * self.size + parts[i]
            names, at = np.unique(context, return_inverse=True)
            table = np.zeros((len(names), self.size))
            np.add.at(table, (at, parts[0]), n)
            if order == ORDER:
                own = table.sum(axis=1) >= KEEP
                names, table = names[own], table[own]
            out.append((names, table))
        return out

    def _costs(self, levels: list, spare: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per order: contexts and the bits of each class there."""
        weight = np.ones(self.size)
        weight[-1] = spare
        below_names, below_counts, below_escape = None, None, None
        out = []
        for order, (names, counts) in enumerate(levels):
            has = counts > 0
            n, q = counts.sum(axis=1, keepdims=True), has.sum(axis=1, keepdims=True)
            if order == 0:
                left = np.where(has, 0, weight).sum(axis=1, keepdims=True)
                escaped = np.where(has, 0, 1 / np.maximum(left, 1))
            else:
                at = np.searchsorted(below_names, names % self.size ** (order - 1)) if order > 1 else np.zeros(len(names), np.int64)
                low, low_escape = below_counts[at], below_escape[at]
                new = (low > 0) & ~has
                total = np.where(new, low, 0).sum(axis=1, keepdims=True)
                kinds = new.sum(axis=1, keepdims=True)
                sure = np.maximum(total + kinds, 1)
                escaped = np.where(new, low / sure, np.where(total + kinds > 0, kinds / sure, 1.0) * low_escape)
            chance = np.where(has, counts / (n + q), q / (n + q) * escaped)
            out.append((names, -np.log2(np.maximum(chance, 1e-30))))
            below_names, below_counts, below_escape = names, counts, escaped
        return out

    def _longest(self, contexts: np.ndarray, costs: list, order: int) -> np.ndarray:
        """Costs in each context: those of its longest ending that the language keeps."""
        got = np.repeat(costs[0][1], len(contexts), axis=0)
        for o in range(1, order + 1):
            names, bits = costs[o]
            ending = contexts % self.size**o
            at = np.minimum(np.searchsorted(names, ending), len(names) - 1) if len(names) else None
            if at is not None:
                hit = names[at] == ending
                got[hit] = bits[at[hit]]
        return got

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text in each language."""
        pad = [self.classes[10]] * ORDER
        data = np.frombuffer(b"".join(texts), np.uint8)
        code = np.concatenate((pad, self.classes[data])).astype(np.int32)
        starts = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        context = code[:-ORDER].copy()
        for i in range(1, ORDER):
            context = context * self.size + code[i : len(code) - ORDER + i]
        for s in starts[:-1][np.diff(starts) > 0]:
            window = np.concatenate((pad, code[s + ORDER : s + 2 * ORDER]))
            for i in range(min(ORDER, len(data) - s)):
                context[s + i] = (window[i] * self.size + window[i + 1]) * self.size + window[i + 2]
        rows = self.row[context].astype(np.int64) * self.size + code[ORDER:]
        total = np.zeros((len(texts), len(self.langs)))
        full = np.flatnonzero(np.diff(starts) > 0)
        if len(full):
            total[full] = np.add.reduceat(self.table[rows].astype(np.float64), starts[:-1][full], axis=0)
        return total


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> ContextTrees:
    """Trees from about ``train_rows`` rows of each language of ``docs`` (doc_id, lang, text).

    Only counts of byte strings come to the driver; the bounded sample bounds them.
    """
    docs = docs.where("lang is not null")
    sizes = {r[0]: r[1] for r in docs.groupBy("lang").count().collect()}
    if not sizes:
        return ContextTrees({})
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, train_rows / n))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    got = count_grams(docs.where(draw < share[F.col("lang")])).toArrow()
    lang, gram, n = (got.column(i).to_numpy() for i in range(3))
    return ContextTrees({name: (gram[lang == name].astype(np.int64), n[lang == name].astype(np.float64)) for name in sorted(set(lang))})


def predict(docs: DataFrame, trees: ContextTrees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (all columns) with lang_pred and score; score is the best language's
    posterior when all are equally likely beforehand. Only the text is looked at."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(trees)
    keep = docs.drop("lang_pred", "score")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in keep.schema)}, lang_pred string, score double"
    at = keep.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = model.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            names, scores = [], []
            for block in blocks(texts, lambda t: len(t or ""), 500_000):
                bits = trees.bits([(t or "").encode() for t in block])
                for t, own in zip(block, bits):
                    if t is None or not len(own) or not any(c.isalpha() for c in t):
                        names.append("und")
                        scores.append(0.0)
                    else:
                        best = int(np.argmin(own))
                        names.append(trees.langs[best])
                        scores.append(float(1 / np.exp2(np.maximum(own[best] - own, -1000)).sum()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"]
            )

    return keep.mapInArrow(tidy(run), schema)


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: train on rows that are not held out, predict all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trees = train(docs.where(~held_out()).select("doc_id", "lang", "text"))
    return predict(docs.select("doc_id", "text"), trees).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
