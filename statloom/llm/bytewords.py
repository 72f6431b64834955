"""Words and 64-bit word hashes of many texts at once, from their UTF-8 bytes.

A batch of texts is one byte array; word borders come from a table over the 256
byte values, and a word's hash from differences of a running polynomial sum, so
the cost is a few array operations a byte, whatever the number of words.
Two words get one hash with a chance of about 2**-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of one block of the running sum.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

#: Space and the five ASCII control characters from tab to carriage return.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Every ASCII byte but letters and digits; bytes of longer characters belong to words.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, BLOCK)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), BLOCK)


def _sum(block: np.ndarray) -> int:
    return int((_BYTE[block] * _UP[: len(block)]).sum(dtype=U64))


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of buf[s:e] for each s, e; the spans are sorted and apart."""
    out = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = int(np.searchsorted(ends, base + BLOCK, "right"))
        if to <= at:  # one word longer than a block
            total, end = 0, int(ends[at])
            for k in range(base, end, BLOCK):
                total += _sum(buf[k : min(end, k + BLOCK)]) * pow(_BASE, k - base, 1 << 64)
            out[at] = total & _MASK
            at += 1
            continue
        block = buf[base : int(ends[to - 1])]
        run = np.zeros(len(block) + 1, U64)
        np.cumsum(_BYTE[block] * _UP[: len(block)], out=run[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (run[e] - run[s]) * _DOWN[s]
        at = to
    return mix(out + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def release() -> None:
    """Give freed memory back to the system, so that a long-lived worker doesn't keep what a heavy task needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and the n + 1 borders between them; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    borders = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, kind)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[int(borders[0]) : int(borders[-1])], borders.astype(np.int64) - int(borders[0])


def slices(borders: np.ndarray, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most `most` bytes each, but at least one text."""
    lo, n = 0, len(borders) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(borders, borders[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def split(buf: np.ndarray, borders: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; no word reaches over the border of a text."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = sep[buf]
    first, last = ~gap, ~gap
    first[1:] &= gap[:-1]
    last[:-1] &= gap[1:]
    inner = borders[(borders > 0) & (borders < len(buf))]
    first[inner] = ~gap[inner]
    last[inner - 1] = ~gap[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


@dataclass
class Words:
    """Words of texts lo..hi of a batch: where[i]..where[i+1] are those of text lo + i."""

    lo: int
    hi: int
    buf: np.ndarray
    borders: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    where: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.where))


def words(texts: pa.Array, sep: np.ndarray = NOT_ALNUM, lower: str = "unicode", most: int = 2 << 20) -> Iterator[Words]:
    """Slices of a batch with their words. lower: unicode, ascii or none."""
    if lower == "unicode":
        texts = pc.utf8_lower(texts)
    data, borders = buffers(texts)
    for lo, hi in slices(borders, most):
        own = borders[lo : hi + 1] - borders[lo]
        buf = data[int(borders[lo]) : int(borders[hi])]
        if lower == "ascii":
            buf = _LOWER[buf]
        s, e = split(buf, own, sep)
        yield Words(lo, hi, buf, own, s, e, hash_spans(buf, s, e), np.searchsorted(s, own))


def shingles(w: Words, width: int = 5) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of `width` words; a shorter text has one, of all its words; one without words none."""
    h, n = w.hashes, len(w.hashes)
    run = np.zeros(max(0, n - width + 1), U64)
    for k in range(width):
        run = mix(run + h[k : k + len(run)])
    for i in range(w.hi - w.lo):
        a, b = int(w.where[i]), int(w.where[i + 1])
        if b - a >= width:
            x = np.sort(run[a : b - width + 1])
            yield x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif b > a:
            one = np.zeros(1, U64)
            for k in range(a, b):
                one = mix(one + h[k : k + 1])
            yield one
        else:
            yield np.zeros(0, U64)
