"""Vectorised word scanning over a packed buffer of UTF-8 texts.

A batch of texts is handled as one byte buffer plus offsets, as Arrow lays strings out. Words are maximal runs
of bytes that a 256-entry table does not map to a separator, so a word never spans two texts. Hashes are 64-bit
and equal in every process, executor and run: they depend on bytes alone.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WHITE = bytes([0x20, *range(0x09, 0x0E)])
_U = np.uint64


def _splitmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit scrambler."""
    with np.errstate(over="ignore"):
        return _splitmix(x + _U((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF))


BYTE_CODE = mix(np.arange(256, dtype=np.uint64), 7) | _U(1)
BASE = 0x9E3779B97F4A7C55
BASE_INV = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    if n > 1:
        with np.errstate(over="ignore"):
            size, step = 1, base & 0xFFFFFFFFFFFFFFFF
            while size < n:
                more = min(size, n - size)
                out[size : size + more] = out[:more] * _U(step)
                size += more
                step = step * step & 0xFFFFFFFFFFFFFFFF
    return out


#: Bytes that are hashed at once, and so the powers that a process keeps.
SEGMENT = 1 << 20
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; those beyond a segment (for a word that long) are not kept."""
    if n > SEGMENT + 1:
        return _powers(BASE, n), _powers(BASE_INV, n)
    if not _POWERS:
        _POWERS.extend((_powers(BASE, SEGMENT + 1), _powers(BASE_INV, SEGMENT + 1)))
    return _POWERS[0][:n], _POWERS[1][:n]


def ascii_lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def separator_table(separators: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(separators)] = True
    return table


class Covered:
    """What some spans cover; whether a span meets it is looked up by bisection."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        i = bisect_right(self.ends, a)
        return i < len(self.starts) and self.starts[i] < b


@dataclass
class Words:
    """Words of a chunk. starts/ends: byte offsets in data; doc: index of the text of each word; per_doc: counts."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    per_doc: np.ndarray
    first: np.ndarray  # index of each text's first word

    def hashes(self, mapped: np.ndarray | None = None) -> np.ndarray:
        return span_hashes(self.data if mapped is None else mapped, self.starts, self.ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for every span, by prefix sums of a polynomial. Spans are ascending and disjoint.

    Spans are taken in segments of SEGMENT bytes, so memory does not grow with a text; a hash depends on the span's bytes alone.
    """
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, base + SEGMENT, side="right")))
        a, b = starts[at:to] - base, ends[at:to] - base
        n = int(b[-1])
        up, down = powers(n + 1)
        with np.errstate(over="ignore"):
            total = np.empty(n + 1, dtype=np.uint64)
            total[0] = 0
            np.cumsum(BYTE_CODE[data[base : base + n]] * up[:n], out=total[1:])
            out[at:to] = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
        at = to
    return out


def scan(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> Words:
    """Words of the texts data[offsets[i]:offsets[i + 1]]."""
    n, docs = len(data), len(offsets) - 1
    inside = np.zeros(n + 1, dtype=bool)
    np.logical_not(separators[data], out=inside[:n])
    edge = np.zeros(n + 1, dtype=bool)  # a text starts here
    edge[offsets] = True
    before = np.empty(n + 1, dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge))
    ends = np.flatnonzero(before & (~inside | edge))
    bounds = np.searchsorted(starts, offsets)
    per_doc = np.diff(bounds)
    return Words(data, starts, ends, np.repeat(np.arange(docs), per_doc), per_doc, bounds[:-1])


def rolled(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of width consecutive values; len(hashes) - width + 1 of them."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = out * _U(0xD6E8FEB86659FD93) + hashes[i : i + n]
    return mix(out, seed)


def window_starts(per_doc: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word of every window that lies in one text, and the window's text."""
    count = np.maximum(per_doc - width + 1, 0)
    doc = np.repeat(np.arange(len(per_doc)), count)
    base = np.cumsum(count) - count
    return first[doc] + (np.arange(int(count.sum())) - base[doc]), doc


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ..., start + length - 1 of every pair, one after another."""
    total = int(lengths.sum())
    base = np.cumsum(lengths) - lengths
    return np.repeat(starts - base, lengths) + np.arange(total)


def chunks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string or binary column into (begin row, end row, bytes, offsets) of about most bytes; nulls are empty.

    A text is never cut; one that is longer than most makes a chunk by itself.
    """
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    begin = 0
    while begin < n:
        end = int(np.searchsorted(offsets, offsets[begin] + most, side="right")) - 1
        end = min(n, max(end, begin + 1))
        yield begin, end, data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
        begin = end
