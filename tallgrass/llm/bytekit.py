"""Vectorised hashing of UTF-8 text held in Arrow buffers.

Texts are handled as one run of bytes with offsets. Polynomial prefix sums
modulo 2**64 give the hash of any byte range in constant time, so words,
shingles and q-grams cost a few array operations each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> U64(31))
    x *= U64(0x9FB21C651E98DF25)
    x ^= x >> U64(29)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)

_power: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _power.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base & _MASK, dtype=U64)
        have[0] = 1
        np.cumprod(have, out=have)
        _power[base] = have
    return have[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    at = at[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def pieces(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text stands alone."""
    row, last = 0, len(offsets) - 1
    while row < last:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), last)
        yield row, end
        row = end


class Prefix:
    """Hashes of byte ranges of one run of bytes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(BYTE_CODES[data] * powers(BASE, n + 1)[:n], out=self.sums[1:])
        self.inverse = powers(INVERSE, n + 1)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def grams(self, q: int) -> np.ndarray:
        """Hashes of all q-byte ranges, in order."""
        return (self.sums[q:] - self.sums[:-q]) * self.inverse[: len(self.sums) - q]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_ranges(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word; words don't cross rows."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    solid = ~_SPACE[data]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = solid[:-1]
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = solid[1:]
    start = np.flatnonzero(solid & (~before | cut[:-1]))
    end = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix(Prefix(data).ranges(start, end) + (end - start).astype(U64))


def shingle_sets(offsets: np.ndarray, data: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted: (hashes, row offsets).

    A row of fewer words than ``size`` has its whole sequence as its only
    shingle; a row without words has none.
    """
    rows = len(offsets) - 1
    start, end, row = word_ranges(offsets, data)
    if not len(start):
        return np.zeros(0, dtype=U64), np.zeros(rows + 1, dtype=np.int64)
    words = word_hashes(data, start, end)
    count = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(count)])
    n = len(words)
    parts, owners = [], []
    if n >= size:
        whole = row[: n - size + 1] == row[size - 1 :]
        acc = words[: n - size + 1].copy()
        for k in range(1, size):
            acc = mix(acc * U64(3) + words[k : n - size + 1 + k])
        parts.append(acc[whole])
        owners.append(row[: n - size + 1][whole])
    for r in np.flatnonzero((count > 0) & (count < size)):
        acc = words[first[r] : first[r] + 1] ^ U64(count[r])
        for k in range(1, count[r]):
            acc = mix(acc * U64(3) + words[first[r] + k : first[r] + k + 1])
        parts.append(acc)
        owners.append(np.array([r]))
    hashes, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(rows + 1))


def strings(offsets: np.ndarray, data: np.ndarray, row: int, end: int) -> list[str]:
    raw = data[offsets[row] : offsets[end]].tobytes()
    base = offsets[row]
    return [raw[offsets[i] - base : offsets[i + 1] - base].decode("utf-8") for i in range(row, end)]
