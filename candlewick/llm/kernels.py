"""Vectorised byte kernels shared by the operators of this subpackage.

Every kernel works on the raw UTF-8 buffer of an Arrow string column, so texts
are never turned into Python strings one by one.  A *slice* is a run of
consecutive rows whose texts hold at most ``limit`` bytes together (one longer
text forms a slice of its own), which bounds the working memory of a task.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of a slice.
SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}
#: Powers that a worker keeps; longer texts have them made anew.
POWERS_KEPT = (1 << 21) + 1


@dataclass
class TextSlice:
    """Rows ``first .. first+n-1`` of a batch; ``buf[offsets[i]:offsets[i+1]]`` is a text."""

    first: int
    buf: np.ndarray
    offsets: np.ndarray
    valid: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.buf[self.offsets[i] : self.offsets[i + 1]].tobytes()


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte buffer, offsets and validity of a string or binary column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = np.ones(len(column), bool) if column.null_count == 0 else np.asarray(column.is_valid())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, raw, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(raw, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64) if raw is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    base = offsets[0]
    buf = np.frombuffer(data, np.uint8)[base : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, offsets - base, valid


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[TextSlice]:
    return cut(*text_column(column), limit)


def cut(buf: np.ndarray, offsets: np.ndarray, valid: np.ndarray, limit: int = SLICE) -> Iterator[TextSlice]:
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, n)
        yield TextSlice(first, buf[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], valid[first:last])
        first = last


def long_column(column: pa.Array) -> np.ndarray:
    return np.asarray(column.cast(pa.int64()).fill_null(-1))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_WORDS = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i in 0..n."""
    made = _POWERS
    if len(made.get("up", ())) <= n:
        size = max(n + 1, 1 << 16)
        if size > POWERS_KEPT:
            made = {}
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            out = np.empty(size, U64)
            out[0] = 1
            done = 1
            while done < size:
                step = min(done, size - done)
                out[done : done + step] = out[:step] * U64(pow(base, done, 1 << 64))
                done += step
            made[key] = out
    return made["up"], made["down"]


class SpanHash:
    """64-bit hashes of any spans of a symbol sequence, by prefix sums of a polynomial."""

    def __init__(self, words: np.ndarray):
        up, self.down = powers(len(words))
        self.sums = np.zeros(len(words) + 1, U64)
        np.cumsum(words * up[: len(words)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(U64) * U64(0xA24BAED4963EE407))


def runs(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true flags that cross no offset."""
    n = len(flags)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = flags.copy()
    begin[1:] &= ~flags[:-1]
    end = np.zeros(n + 1, bool)
    end[1:n] = flags[: n - 1] & ~flags[1:]
    end[n] = flags[-1]
    cut = offsets[(offsets > 0) & (offsets < n)]
    cut = cut[flags[cut] & flags[cut - 1]]
    begin[cut] = True
    end[cut] = True
    return np.flatnonzero(begin), np.flatnonzero(end)


def by_text(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index bounds: spans ``bounds[i]:bounds[i+1]`` start in text i."""
    bounds = np.searchsorted(starts, offsets)
    return bounds


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges ``starts[i] .. starts[i]+lengths[i]-1``."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    out = np.arange(total, dtype=np.int64)
    out += np.repeat(starts - (ends - lengths), lengths)
    return out



LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that are white space: blank and the controls from tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Bytes of alphanumeric words: digits, ASCII letters, and all bytes of other characters.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def packed(array: np.ndarray) -> bytes:
    """zstd of the bytes, with the raw length in front."""
    raw = np.ascontiguousarray(array).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpacked(blob: bytes, kind: np.dtype | type) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    if not size:
        return np.zeros(0, kind)
    return np.frombuffer(pa.decompress(memoryview(blob)[8:], decompressed_size=size, codec="zstd", asbytes=True), kind)


def pack_columns(*arrays: np.ndarray) -> bytes:
    """Several arrays in one blob; sorted integer arrays shrink best as differences."""
    parts = [packed(a) for a in arrays]
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def unpack_columns(blob: bytes, *kinds: type) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        size = int.from_bytes(blob[at : at + 8], "little")
        out.append(unpacked(blob[at + 8 : at + 8 + size], kind))
        at += 8 + size
    return out


#: What a worker has built for all tasks of an operator: one thing at a time.
_BUILT: dict[Any, Any] = {}


def built(key: Any, make: Callable[[], Any]) -> Any:
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = make()
    return _BUILT[key]


def give_back() -> None:
    """Memory that this worker holds without use goes back to the system: workers stay from task to task and from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim:
        trim(0)


def released(step: Callable) -> Callable:
    """The step of a task, which frees what its worker built for another operator, and at its end what it no longer uses."""

    @functools.wraps(step)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _BUILT.clear()
        yield from step(batches)
        give_back()

    return run


def deltas(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))
