"""Words, lines and hashes of whole texts, computed on Arrow string buffers with numpy.

Spark hands Python record batches; every function here works on one slice of a batch at a time, so memory
follows SLICE_BYTES and the longest single text, never the table.
"""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Functions of this module travel inside the pickled task, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE_BYTES = 1_000_000
# Separators are \x20 and \x09-\x0D.
SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, _U)
            p[0] = 1
            _POWERS[name] = np.cumprod(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _byte_codes(lower: bool) -> np.ndarray:
    b = np.arange(256, dtype=_U)
    if lower:
        b[65:91] += _U(32)
    return mix(b + _U(0x1234567))


_CODES = {False: _byte_codes(False), True: _byte_codes(True)}
_WORD = np.ones(256, bool)
_WORD[list(SEPARATORS)] = False


def release() -> None:
    """Give freed memory back to the system; workers outlive their tasks and would keep it beside the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass                            # another C library; nothing to trim


def slices(batches: Iterator[pa.RecordBatch], text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of a piece stay near ``limit`` bytes; a longer text is a piece of its own."""
    for batch in batches:
        col = batch.column(text)
        if len(col) == 0:
            continue
        ends = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, 4 * col.offset).astype(np.int64)
        first = 0
        while first < len(col):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last
    _POWERS.clear()
    release()


@dataclass
class Texts:
    """The bytes of a string column: text i is data[ends[i]:ends[i + 1]]. Null counts as empty."""

    data: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, col: pa.Array) -> Texts:
        if col.null_count:
            col = col.fill_null("")
        ends = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, 4 * col.offset).astype(np.int64)
        raw = col.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[ends[0]:ends[-1]] if raw is not None else np.empty(0, np.uint8)
        return cls(data, ends - ends[0])

    def __len__(self) -> int:
        return len(self.ends) - 1

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of bytes for which ``inside`` holds, never across texts: (text, start, end)."""
        n = len(self.data)
        cut = np.zeros(n + 1, bool)
        cut[self.ends] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        starts = np.flatnonzero(inside & (~before | cut[:-1]))
        ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
        return np.searchsorted(self.ends, starts, "right") - 1, starts, ends

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.runs(_WORD[self.data])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces between \\n bytes, empty ones left out."""
        return self.runs(self.data != 10)

    def hasher(self, lower: bool = False):
        """Function (starts, ends) -> 64-bit hash of those byte ranges; equal bytes give equal hashes everywhere."""
        n = len(self.data)
        up, down = _powers(n + 1)
        total = np.zeros(n + 1, _U)
        np.cumsum(_CODES[lower][self.data] * up[:n], out=total[1:])

        def hashes(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
            return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U))

        return hashes

    def count(self, wanted: np.ndarray) -> np.ndarray:
        """Bytes marked in the table ``wanted`` before each position: differences count ranges."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(wanted[self.data], out=total[1:])
        return total


CODE_POINT_STARTS = np.ones(256, bool)
CODE_POINT_STARTS[0x80:0xC0] = False


def window_hashes(hashes: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``width`` consecutive items of one owner: (first item's index, hash)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, _U)
    acc = hashes[:n].copy()
    for k in range(1, width):
        acc *= _U(0xD6E8FEB86659FD93)
        acc += hashes[k:k + n]
    first = np.flatnonzero(owner[:n] == owner[width - 1:])
    return first, mix(acc[first])
