"""Words of whole columns of texts at once: positions, hashes and classes of bytes, by numpy."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULT, -1, 2**64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(z: np.ndarray) -> np.ndarray:
    """Spreads unsigned 64-bit values; one to one."""
    z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
    return z ^ (z >> U64(31))


#: A value for each byte, so that small changes of a word change its hash everywhere.
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93)) | U64(1)


def powers(base: int, n: int) -> np.ndarray:
    out = np.empty(max(n, 1), U64)
    out[0], k = 1, 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * U64(pow(base, k, 2**64))
        k += m
    return out


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each text begins (one more entry: the end). Null counts as empty."""
    raw = texts.cast(pa.large_binary())
    if raw.null_count:
        raw = raw.fill_null(b"")
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = raw.buffers()[2]
    base = int(offsets[0])
    b = np.frombuffer(data, np.uint8)[base : int(offsets[-1])] if data is not None else np.zeros(0, np.uint8)
    return b, offsets - base


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of marked bytes, cut at the texts' bounds; and the first run of each text."""
    n = len(inside)
    start, end = inside.copy(), inside.copy()
    if n:
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        first = offsets[:-1][offsets[:-1] < n]
        start[first] = inside[first]
        last = offsets[1:] - 1
        last = last[last >= 0]
        end[last] = inside[last]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offsets)


class Hasher:
    """Hashes of any spans of b."""

    def __init__(self, b: np.ndarray, lower: np.ndarray | None = None):
        n = len(b)
        self._sum = np.zeros(n + 1, U64)
        values = (_BYTE[LOWER] if lower is None else _BYTE)[b if lower is None else lower]
        np.cumsum(values * powers(_MULT, n)[:n], out=self._sum[1:])
        self._back = powers(_INVERSE, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sum[end] - self._sum[start]) * self._back[start] + (end - start).astype(U64))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words between white space, and the first word of each text."""
    b, offsets = flat(texts)
    s, e, first = runs(~SPACE[b], offsets)
    return Hasher(b)(s, e), first


def slices(texts: pa.Array, limit: int = 1_000_000) -> list[tuple[int, int]]:
    """Ranges of rows of at most limit bytes each (one row at least), to bound memory."""
    out, at = [], 0
    sizes = np.array([0 if x is None else x for x in pc.binary_length(texts).to_pylist()], np.int64)
    while at < len(texts):
        k = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), limit, "right")))
        out.append((at, min(k, len(texts))))
        at = k
    return out


def release() -> None:
    """Give freed memory back to the system at a task's end: a worker stays for later tasks, idle or not."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
