"""Vectorised character arithmetic over Arrow string batches.

A batch of texts becomes one array of code points; counts of any character
class over lines or rows are differences of running sums, so the cost is a few
nanoseconds a character whatever the number of rows."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTER, MARK, DIGIT, SPACE, UPPER, SYMBOL = 1, 2, 4, 8, 16, 32


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class bits of all code points."""
    table = np.full(0x110000, SYMBOL, np.uint8)
    for i in _assigned():
        k = unicodedata.category(chr(i))
        if k[0] == "L":
            table[i] = LETTER | (UPPER if k in ("Lu", "Lt") else 0)
        elif k[0] == "M":
            table[i] = MARK
        elif k[0] == "N":
            table[i] = DIGIT
        elif chr(i).isspace():
            table[i] = SPACE
        else:
            table[i] = SYMBOL
    wide = np.fromiter((chr(i).isalpha() for i in range(0x20000, 0x34000)), bool)
    table[0x20000:0x34000][wide] = LETTER
    return table


def _assigned() -> Iterator[int]:
    """The planes with scripts, and the variation selectors; the planes of ideographs have letters only."""
    yield from range(0x20000)
    yield from range(0xE0100, 0xE01F0)


@functools.lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    table = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x20000):
        low = chr(i).lower()
        if len(low) == 1:
            table[i] = ord(low)
    return table


#: Texts are worked on in chunks of about so many bytes, or one at a time if longer.
CHUNK_BYTES = 2_000_000


def in_chunks(arr: pa.Array, work) -> pa.Array:
    """work(part) over consecutive parts of bounded size, put together."""
    n = len(arr)
    size = pc.fill_null(pc.binary_length(arr), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(size)
    if not n or total[-1] <= CHUNK_BYTES:
        return work(arr)
    parts, a = [], 0
    while a < n:
        base = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, base + CHUNK_BYTES, side="right")))
        parts.append(work(arr.slice(a, b - a)))
        a = b
    return pa.concat_arrays(parts)


def code_points(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts one after another, and the n + 1 bounds of the texts."""
    arr = arr.cast(pa.large_string()) if not pa.types.is_large_string(arr.type) else arr
    n = len(arr)
    bounds = np.zeros(n + 1, np.int64)
    if not n:
        return np.zeros(0, np.uint32), bounds
    np.cumsum(pc.fill_null(pc.utf8_length(arr), 0).to_numpy(zero_copy_only=False), out=bounds[1:])
    arr = pc.fill_null(arr, "")
    offsets = np.frombuffer(arr.buffers()[1], np.int64, n + 1, arr.offset * 8)
    data = arr.buffers()[2]
    raw = b"" if data is None else data.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes()
    return np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32), bounds


def lines(cp: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the lines of all texts (split at LF)."""
    lf = np.flatnonzero(cp == 10)
    starts = np.sort(np.concatenate([bounds[:-1], lf + 1]), kind="stable")
    ends = np.sort(np.concatenate([bounds[1:], lf]), kind="stable")
    n = 1 + np.searchsorted(lf, bounds[1:]) - np.searchsorted(lf, bounds[:-1])
    return starts, ends, np.repeat(np.arange(len(bounds) - 1), n)


def running(flag: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=out[1:])
    return out


_BASE = 0x9E3779B97F4A7C15 | 1


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE, np.uint64)]))
        down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, inverse, np.uint64)]))
    return up, down


def span_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span of code points, equal for equal spans."""
    size = 1 << max(10, int(len(cp) + 1).bit_length())
    up, down = _powers(size)
    with np.errstate(over="ignore"):
        h = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum((cp.astype(np.uint64) + np.uint64(0x1F3)) * up[: len(cp)], out=h[1:])
        x = (h[ends] - h[starts]) * down[starts]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return x


def text_hash(text: str) -> int:
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return int(span_hashes(cp, np.array([0]), np.array([len(cp)]))[0])


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true, cut at the bounds of the texts."""
    before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
    start = inside & ~before
    inner = bounds[(bounds > 0) & (bounds < len(inside))]
    start[inner] |= inside[inner]
    after = np.concatenate([inside[1:], [False]]) if len(inside) else inside
    end = inside & ~after
    end[inner - 1] |= inside[inner - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1
