"""Packing by power-of-two decomposition.

A document's token ids, with an end id, are cut into as many full windows as
fit and then into pieces of the binary lengths of the rest, longest first.
Pieces of equal length form a bucket: they are dealt out by length, numbered
within it, and stand in batches of equal token counts. Each piece is a sequence
of its own, so no sequence crosses documents and none needs padding.

Ids are those that the ``tokenizers`` library gives for the whole text, its added
tokens included; with ``ordinary`` their strings in a text are ordinary text instead.
Null text is empty text: its one id is the end id. Repeated rows and null ids
are packed like any other row. An empty table gives no pieces; extra columns,
whatever their names, are ignored. Texts are tokenized whole; a Python worker
holds one block of texts at a time.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import fresh_path, write_table
from .textarrays import blocks, tidy

WINDOW = 1024
#: The tokenizer's file, and the same vocabulary as merge ranks, from which words are encoded several times as fast.
TOKENIZER_FILE, RANKS_FILE = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Distinct words kept per worker; beyond it the cache starts anew.
CACHE_WORDS = 200_000
#: Tokens of a batch: sequences of one length, as many as fit.
BATCH_TOKENS = 65_536

_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def added_tokens(path: str | None = None) -> list[str]:
    """Strings of the added tokens of the tokenizer's file."""
    import public_tokenizers

    with open(path or public_tokenizers.path(TOKENIZER_FILE), encoding="utf-8") as file:
        return [t["content"] for t in json.load(file)["added_tokens"]]


class CachedTokenizer:
    """The library's byte-level BPE, with each distinct space-delimited word encoded once.

    The split pattern never joins a space to what stands before it unless that
    is white space too, so a text without white space before a space can be
    encoded word by word; any other text is encoded as a whole. A text that holds
    the string of an added token goes to the library itself, unless ``ordinary``.
    """

    def __init__(self, path: str | None = None, ranks_path: str | None = None, most: int = CACHE_WORDS, ordinary: bool = False,
                 added: list[str] | None = None):
        import public_tokenizers
        import tiktoken

        with open(ranks_path or public_tokenizers.path(RANKS_FILE), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self._encode = tiktoken.Encoding(
            "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        self._path, self._library = path or public_tokenizers.path(TOKENIZER_FILE), None
        self._added = [] if ordinary else added_tokens(path) if added is None else added
        self._most = most
        self._clear()

    def _whole(self, text: str) -> list[int]:
        """Ids by the library, which few texts need: it takes a second to load."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        return self._library.encode(text, add_special_tokens=False).ids

    def _clear(self) -> None:
        self._code: dict[str, int] = {}
        self._pool = np.empty(1 << 16, np.uint32)
        self._starts = [0]

    def _add(self, word: str) -> int:
        ids = self._encode(word)
        end = self._starts[-1] + len(ids)
        if end > len(self._pool):
            self._pool = np.concatenate((self._pool, np.empty(max(len(self._pool), len(ids)), np.uint32)))
        self._pool[self._starts[-1] : end] = ids
        self._starts.append(end)
        self._code[word] = len(self._starts) - 2
        return len(self._starts) - 2

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as 32-bit unsigned numbers."""
        if len(self._code) > self._most:
            self._clear()
        out: list[np.ndarray | None] = [None] * len(texts)
        words: list[str] = []
        marks: list[tuple[int, int]] = []
        for i, text in enumerate(texts):
            chunks = text.split(" ")
            if any(a in text for a in self._added):
                out[i] = np.array(self._whole(text), np.uint32)
            elif len(text) > 1 and chunks[0] != "" and not any(not c or c[-1].isspace() for c in chunks[:-1]):
                marks.append((i, len(words)))
                words.append(chunks[0])
                words += [" " + c for c in chunks[1:]]
            else:
                out[i] = np.array(self._encode(text), np.uint32)
        get = self._code.get
        codes = [get(w) for w in words]
        if None in codes:
            for at, code in enumerate(codes):
                if code is None:
                    codes[at] = get(words[at]) if words[at] in self._code else self._add(words[at])
        starts = np.array(self._starts)
        code = np.array(codes, np.int64)
        first = starts[code] if len(code) else code
        size = (starts[code + 1] - first) if len(code) else code
        ends = np.concatenate(([0], np.cumsum(size)))
        flat = self._pool[np.repeat(first - ends[:-1], size) + np.arange(ends[-1])]
        for (i, a), b in zip(marks, [m[1] for m in marks[1:]] + [len(words)]):
            out[i] = flat[ends[a] : ends[b]]
        return out


def cuts(total: int, window: int = WINDOW) -> list[int]:
    """Lengths of the pieces of ``total`` ids: full windows, then the rest's powers of two."""
    rest = total % window
    return [window] * (total // window) + [1 << b for b in range(window.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, window: int = WINDOW, end_id: int = 0, tokenizer_path: str | None = None, ranks_path: str | None = None,
           id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, ordinary: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, and the ids (little-endian 32-bit) if asked for."""
    if window & (window - 1) or window < 1:
        raise ValueError("window must be a power of two")
    # The file is parsed once, here: in every task it would cost more memory than all else.
    added = [] if ordinary else added_tokens(tokenizer_path)
    schema = pa.schema([("doc_id", pa.int64())] + [(n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens")] + [("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = CachedTokenizer(tokenizer_path, ranks_path, ordinary=ordinary, added=added)
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for block in blocks(((i, t or "") for i, t in rows), lambda r: len(r[1]), 1_000_000):
                found: list[tuple] = []
                for (doc, _), ids in zip(block, tokenizer.encode([t for _, t in block])):
                    raw = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()
                    total, at = len(raw) // 4, 0
                    for n in cuts(total, window):
                        part = raw[4 * at : 4 * (at + n)]
                        found.append((doc, at, n, zlib.crc32(part), total, part if with_ids else None))
                        at += n
                columns = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    out = rows.mapInArrow(tidy(run), _SCHEMA)
    return out if with_ids else out.drop("ids")


def bucketed(made: DataFrame, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """``made`` (pieces) with sequence_id, offset and batch.

    Pieces are dealt out by length; a length's pieces are cut by the task that they come
    from, so that no bucket has to be in one place, however common its length is. The
    pieces of such a cut stand together, in order, in batches of one length that hold at
    most ``batch_tokens`` tokens (one sequence at least). Sequence numbers are unique, and
    their upper bits are the bucket and the cut."""
    cut_of = F.spark_partition_id().alias("cut")
    dealt = made.select("*", cut_of)
    place = F.row_number().over(Window.partitionBy("length", "cut").orderBy("doc_id", "start", "ids_crc32")) - 1
    # Six bits for the bucket, 26 for the cut, 31 for the place there.
    bucket = F.bit_count(F.col("length") - 1).cast("long")
    base = F.shiftleft(bucket, 57) + F.shiftleft(F.col("cut").cast("long"), 31)
    numbered = dealt.withColumn("place", place.cast("long"))
    batch = base + F.floor(F.col("place") * F.col("length") / F.greatest(F.col("length"), F.lit(batch_tokens)))
    return numbered.withColumns({"sequence_id": base + F.col("place"), "offset": F.lit(0).cast("long"), "batch": batch.cast("long")}).drop("cut", "place")


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = 0, tokenizer_path: str | None = None, ranks_path: str | None = None,
         id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, ordinary: bool = False, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, batch.

    ``with_ids`` adds the ids themselves (little-endian 32-bit). ``length`` is the bucket."""
    out = bucketed(pieces(docs, window, end_id, tokenizer_path, ranks_path, id_col, text_col, with_ids, ordinary), batch_tokens)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "batch"]
    return out.select(*names, *["ids"] * with_ids)


def write_buckets(packed: DataFrame, path: str | None = None) -> str:
    """Write sequences as a table with a folder for each length; returns its path.

    A trainer reads the folder of a length and takes its batches, none of which needs padding."""
    path = path or fresh_path(packed.sparkSession, "buckets")
    write_table(packed, path, "length")
    return path


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: pack all documents."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
