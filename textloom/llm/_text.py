"""Vectorised word scanning of Arrow string columns.

A word is a maximal run of ASCII letters and digits (folded to lower case) and
of bytes above 127; everything else separates. A null text counts as empty. All
of a text is scanned, whatever its length. Equal words have equal 64-bit hashes
in every process, so the hashes can be shuffled and joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.default_rng(20240601)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.zeros(256, np.uint8)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _FOLD[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _FOLD[_c] = _c + 32
_FOLD[128:] = np.arange(128, 256)
_VALUE = np.where(_FOLD > 0, _BYTE[_FOLD], np.uint64(0))
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
GRAM = np.uint64(0xD1342543DE82EF95)
MAX64 = np.uint64(2**64 - 1)
WORD = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")


def plain_words(text: str | None) -> list[str]:
    """The same words by a regular expression; for tests and small inputs."""
    return WORD.findall(re.sub(r"[A-Z]+", lambda m: m[0].lower(), text or ""))


def _powers(n: int, base: np.uint64 = _STEP) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(1 << 12)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of a batch of texts; those of text i are first[i]:first[i+1]."""

    hash: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    off: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def last(self) -> np.ndarray:
        """For each word, the end of its text's words."""
        return np.repeat(self.first[1:], np.diff(self.first))

    def chars(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each word in characters of its text."""
        lead = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        base = np.repeat(lead[self.off[:-1]], np.diff(self.first))
        return lead[self.start] - base, lead[self.end] - base


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    off = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    bytes_ = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return bytes_, off - off[0]


def scan(texts: pa.Array) -> Words:
    data, off = raw(texts)
    n = len(data)
    if not n:
        zero = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(off), np.int64), zero, zero, data, off)
    inside = _FOLD[data] > 0
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    at = off[:-1][off[:-1] < n]
    begin[at] |= inside[at]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | begin[1:]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    if not len(start):
        zero = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(off), np.int64), zero, zero, data, off)
    within = np.arange(start[0], n, dtype=np.int32) - np.repeat(start.astype(np.int32), np.diff(start, append=n))
    powers = _POWERS if (most := int((end - start).max())) <= len(_POWERS) else _powers(most)
    value = _VALUE.take(data[start[0] :])
    value *= powers.take(within, mode="clip")
    hashes = mix(np.add.reduceat(value, start - start[0]))
    return Words(hashes, np.searchsorted(start, off), start, end, data, off)


def beginnings(w: Words, size: int) -> np.ndarray:
    """Hash of the first `size` bytes, folded, of every word that is longer; 0 for the others."""
    at = np.flatnonzero(w.end - w.start > size)
    out = np.zeros(len(w.hash), np.uint64)
    for k in range(size):
        out[at] += _VALUE[w.data[w.start[at] + k]] * _POWERS[k]
    out[at] = mix(out[at])
    return out


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position; the last n - 1 positions have none."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    total, size, power, low = hashes, 1, int(GRAM), 2**64 - 1
    parts: list[tuple[np.ndarray, int]] = []
    left = n
    while left:
        if left & 1:
            parts.append((total, size))
        left >>= 1
        if left:
            total = total[: len(total) - size] + np.uint64(power) * total[size:]
            power, size = power * power & low, size * 2
    m, at, out = len(hashes) - n + 1, 0, np.zeros(len(hashes) - n + 1, np.uint64)
    for values, size in parts:
        out += np.uint64(pow(int(GRAM), at, 2**64)) * values[at : at + m]
        at += size
    return mix(out)


def slide(x: np.ndarray, n: int, least: bool = True) -> np.ndarray:
    """Least or largest of the n values from each position."""
    op = np.minimum if least else np.maximum
    if len(x) < n:
        return x[:0]
    size, out = 1, x
    while size * 2 <= n:
        out = op(out[: len(out) - size], out[size:])
        size *= 2
    return op(out[: len(x) - n + 1], out[n - size : n - size + len(x) - n + 1]) if size < n else out


def pieces(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows so that each piece has about limit bytes of text."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def binary(parts: list[np.ndarray]) -> pa.Array:
    """Each array as one binary value."""
    return pa.array([p.tobytes() for p in parts], pa.binary())
