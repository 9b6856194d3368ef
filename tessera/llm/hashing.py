"""Vectorised 64-bit hashes of words and of windows of words or bytes.

All hashes are fixed functions of the content, alike on every executor and run.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GOAL_BYTES = 2 << 20
#: Bytes that are hashed at a time, and powers that are kept: working memory for a text of any length.
STEP_BYTES = 1 << 20
KEPT_POWERS = 4 << 20
U = np.uint64


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x + U((0x9E3779B97F4A7C15 * (salt + 1)) % (1 << 64))
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed; at most ``KEPT_POWERS`` stay."""

    def __init__(self, base: int) -> None:
        self.base = base | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, min(2 * len(self.up), KEPT_POWERS))
            up = np.cumprod(np.concatenate([[U(1)], np.full(size - 1, self.base, U)]))
            down = np.cumprod(np.concatenate([[U(1)], np.full(size - 1, self.inverse, U)]))
            if size > KEPT_POWERS:
                return up, down
            self.up, self.down = up, down
        return self.up[:n], self.down[:n]


_BYTE_POWERS = _Powers(0xD1342543DE82EF95)
_WORD_POWERS = (_Powers(0xA0761D6478BD642F), _Powers(0xE7037ED1A0B428DB))
_BYTES = mix(np.arange(256, dtype=U), 7)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same, giving freed memory back to the machine at the end: workers are kept and used again."""

    @functools.wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return inner


def texts(batch: pa.RecordBatch, column: int, goal: int = GOAL_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of about ``goal`` text bytes, with their bytes and row offsets (null: empty)."""
    size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(size) // goal
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            part = batch.slice(a, b - a)
            text = part.column(column)
            if text.null_count:
                text = text.fill_null(b"" if pa.types.is_binary(text.type) else "")
            buffers = text.buffers()
            at = np.frombuffer(buffers[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
            data = np.frombuffer(buffers[2] or b"", np.uint8)[at[0] : at[-1]]
            yield part, data, at - at[0]


def words(data: np.ndarray, at: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of no ASCII white space) of texts laid end to end.

    Returns the hash, begin and end of every word, and the offsets of the rows in them.
    """
    if lower:
        data = LOWER[data]
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.concatenate([[False], solid[:-1]]) if len(data) else solid
    begin = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.concatenate([solid[1:], [False]]) if len(data) else solid
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    hashed = np.zeros(len(begin), U)
    cuts = np.flatnonzero(np.diff(begin // STEP_BYTES)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(begin)]):
        if b > a:
            first = begin[a]
            part = _BYTES[data[first : end[b - 1]]]
            up, down = _BYTE_POWERS(len(part) + 1)
            total = np.concatenate([[U(0)], np.cumsum(part * up[: len(part)])])
            x, y = begin[a:b] - first, end[a:b] - first
            hashed[a:b] = mix((total[y] - total[x]) * down[x] + (y - x).astype(U))
    return hashed, begin, end, np.searchsorted(begin, at)


def windows(hashed: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hash of the ``length`` consecutive words from each position on (the last ones lack words and are left out)."""
    n = len(hashed) - length + 1
    if n <= 0:
        return np.zeros(0, U)
    up, down = _WORD_POWERS[which](len(hashed) + 1)
    total = np.concatenate([[U(0)], np.cumsum(hashed * up[:-1])])
    return mix((total[length:] - total[:-length]) * down[:n], 11 + which)


def row_of(at: np.ndarray) -> np.ndarray:
    """Row number of each element, from row offsets."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def lists(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from laid-out values and row offsets."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values).cast(kind))
