"""Words of many texts at once: spans, owners and hash names as numpy arrays.

Texts arrive as Arrow string columns; the UTF-8 buffer is scanned without building a Python
string for each word. All separators used here are ASCII, so bytes and characters agree.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_000_000

_SEED = np.random.default_rng(20240607)
_TABLES = [_SEED.integers(0, 2**64, 256, dtype=np.uint64) for _ in range(2)]
_BASES = [0x9E3779B97F4A7C15, 0xD1342543DE82EF95]
_WINDOW = _SEED.integers(0, 2**63, (2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags: which bytes separate words."""
    table = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: Words are ``[^\x20\x09-\x0D]+``.
SPACES = separators((0x20, 0x20), (0x09, 0x0D))
#: Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, after lower-casing.
NON_WORD = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


@dataclass
class Texts:
    """The words of a slice of texts.

    ``starts`` and ``ends`` are byte positions in ``buf``; ``first[i]`` is the index of the
    first word of text ``i`` (``first[-1]`` is the number of words).
    """

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def names(self, which: int = 0) -> np.ndarray:
        """A 64-bit name for each word: equal words, equal names."""
        return mixed(_poly(self.buf, self.starts, self.ends, which))

    def word(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes over which letters are added up at once; bounds the tables of powers, too.
_SPAN = 1 << 17


@cache
def _powers(which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    out = []
    for b in (_BASES[which], pow(_BASES[which], -1, 2**64)):
        x = np.full(_SPAN, b, dtype=np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def _poly(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """Polynomials of the bytes from ``starts`` to ``ends`` (in order), span by span of ``buf``."""
    out = np.zeros(len(starts), dtype=np.uint64)
    power, inverse = _powers(which)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(ends, base + _SPAN, side="right")))
        own, last = slice(at, stop), int(ends[stop - 1])
        if last - base > _SPAN:  # one word alone is longer
            out[at] = _long(buf[base:last], which)
        else:
            sums = np.zeros(last - base + 1, dtype=np.uint64)
            np.cumsum(_TABLES[which][buf[base:last]] * power[: last - base], out=sums[1:])
            first = starts[own] - base
            # an empty word at the very end has no power of its own, and needs none
            out[own] = (sums[ends[own] - base] - sums[first]) * inverse[np.minimum(first, _SPAN - 1)]
        at = stop
    return out


def _long(word: np.ndarray, which: int) -> np.uint64:
    power = _powers(which)[0]
    total, scale = 0, 1
    for lo in range(0, len(word), _SPAN):
        part = word[lo : lo + _SPAN]
        total += scale * int(np.sum(_TABLES[which][part] * power[: len(part)], dtype=np.uint64))
        scale = scale * pow(_BASES[which], len(part), 2**64) % 2**64
    return np.uint64(total % 2**64)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    return np.frombuffer(data, dtype=np.uint8)[lo:hi], offsets - lo


def split(buf: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> Texts:
    """Find the words of the texts that lie end to end in ``buf``."""
    inside = ~separator[buf]
    if not len(buf):
        return Texts(buf, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(buf), dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(buf), dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Texts(buf, starts, ends, np.searchsorted(starts, offsets))


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a piece have about ``limit`` bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffer_of(batch.column(batch.schema.get_field_index(text)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi
    release()


def release() -> None:
    """Give freed memory back to the system: workers live on for other tasks."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def window_names(names: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Names of all runs of ``size`` consecutive words, by their first word."""
    n = len(names) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        out += names[j : j + n] * _WINDOW[which, j]
    return mixed(out)


def fits(first: np.ndarray, size: int, total: int) -> np.ndarray:
    """Flags for the words at which a window of ``size`` words of one text starts."""
    ok = np.zeros(total + 1, dtype=np.int32)
    n = np.diff(first)
    starts, stops = first[:-1], first[:-1] + np.maximum(n - size + 1, 0)
    np.add.at(ok, starts, 1)
    np.add.at(ok, stops, -1)
    return np.cumsum(ok[:-1]) > 0
