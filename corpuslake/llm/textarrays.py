"""Words and shingles of many texts at once, as 64-bit numbers in numpy arrays.

A word is a run of bytes that are not separators. Every word of a block of
texts gets a 64-bit value from one pass of prefix sums over the block's bytes,
so no Python loop runs over words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

_LIBC = ctypes.CDLL(None)
_U = np.uint64
_RADIX = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_RADIX, -1, 1 << 64)
_POWERS = {"n": 0, "up": np.ones(1, _U), "down": np.ones(1, _U)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Separators of plain words: space and the control characters from tab to carriage return.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
#: Separators of alphanumeric words: every ASCII character that is neither letter nor digit.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS["n"] < n:
        with np.errstate(over="ignore"):
            for name, base in (("up", _RADIX), ("down", _INVERSE)):
                steps = np.full(n + 1, _U(base & (2**64 - 1)))
                steps[0] = 1
                _POWERS[name] = np.cumprod(steps, dtype=_U)
        _POWERS["n"] = n
    return _POWERS["up"], _POWERS["down"]


def words(texts: list[bytes], separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Value of each word of all texts (ASCII letters in lower case), and the bounds.

    The words of text i are ``values[bounds[i]:bounds[i + 1]]``.
    """
    ends = np.cumsum([len(t) + 1 for t in texts])
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    inside = ~separators[data]
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(data))
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, _U)
        np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
        values = mix((total[stop] - total[start]) * down[start])
    return values, np.concatenate(([0], np.searchsorted(start, ends)))


def runs(values: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Value of each run of ``width`` words, and the bounds by text.

    A text with fewer words, but at least one, has its whole sequence as its one run.
    """
    n = np.diff(bounds)
    counts = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    out = np.concatenate(([0], np.cumsum(counts)))
    with np.errstate(over="ignore"):
        padded = np.concatenate((values, np.zeros(width, _U)))
        size = len(values)
        every = np.zeros(size, _U)
        for i in range(width):
            every += padded[i : i + size] * _U((2 * i + 3) * 0xA0761D6478BD642F & (2**64 - 1) | 1)
        every = mix(every)
        first = np.repeat(bounds[:-1], counts) + np.arange(out[-1]) - np.repeat(out[:-1], counts)
        got = every[first]
        for i in np.flatnonzero((n > 0) & (n < width)):
            own = np.arange(1, n[i] + 1, dtype=_U) * _U(0xE7037ED1A0B428DB) | _U(1)
            got[out[i]] = mix(np.array([(values[bounds[i] : bounds[i + 1]] * own).sum(dtype=_U) + _U(n[i])]))[0]
    return got, out


def release() -> None:
    """Give memory that a step of a worker no longer uses back to the system.

    Workers live on between tasks, and what their allocators keep counts for the
    executor's container as if it were in use."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def settled(result):
    """``result``, once what the call that made it held has been given back."""
    release()
    return result


def tidy(run):
    """``run``, a worker's function of batches, followed by ``release`` once its frame, with all it held, is gone."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def rows_of(batch, step: int = 256) -> Iterator[tuple]:
    """Rows of an Arrow batch as tuples, made a few at a time."""
    for at in range(0, batch.num_rows, step):
        yield from zip(*(c.to_pylist() for c in batch.slice(at, step).columns))


def blocks(items: Iterable, size, most: int = 1_500_000) -> Iterator[list]:
    """Lists of items of about ``most`` bytes each; an item is never split."""
    held, total = [], 0
    for item in items:
        held.append(item)
        total += size(item)
        if total >= most:
            yield held
            held, total = [], 0
    if held:
        yield held
