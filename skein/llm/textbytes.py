"""Vectorised kernels over the UTF-8 bytes of a batch of texts.

A batch is ``(data, offsets)``: all bytes in one ``uint8`` array and where each text begins, plus the total at the end.
Every word class used here puts all bytes from 0x80 up inside words, so classes of code points are classes of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: About how many bytes are worked on at once; working arrays take some 80 bytes for each.
RUN_BYTES = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_class(separators: bytes) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: Words end at space, tab, line feed, vertical tab, form feed and carriage return.
SPACED = word_class(b" \t\n\v\f\r")
#: Words are digits, lower-case letters and everything beyond ASCII.
PLAIN = word_class(bytes(b for b in range(128) if not (48 <= b < 58 or 97 <= b < 123)))

_SEED = 0x9E3779B97F4A7C15


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection on 64-bit numbers in which every input bit reaches every output bit."""
    h = h + np.uint64((seed * _SEED + 0x632BE59BD9B4E019) % 2**64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def batch_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The batch of an Arrow string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, ends, values = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def part(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    return data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of the first word of each text with the total at the end."""
    return spans_of(table[data], offsets)


def spans_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of the runs of bytes that are inside words."""
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Spans of more bytes are hashed one by one.
LONG = 128
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Spans:
    """Hashes and comparisons of spans of a byte array, eight bytes at a time."""

    def __init__(self, data: np.ndarray):
        self.padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self.eight = np.ndarray((len(data) + 1,), "<u8", self.padded, 0, (1,))

    def hash(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        """64-bit hashes: each eight bytes are mixed into all bits, so spans of up to eight bytes never collide with spans
        of their length, and no two texts collide whatever the position, unlike with sums of powers."""
        size = ends - starts
        out = mix(size.astype(np.uint64), seed)
        some, k = np.flatnonzero(size > 0), 0
        long = some[size[some] > LONG]
        some = some[size[some] <= LONG] if len(long) else some
        while len(some):
            out[some] = mix(out[some] ^ (self.eight[starts[some] + k] & _MASKS[np.minimum(size[some] - k, 8)]))
            k += 8
            some = some[size[some] > k]
        if len(long):
            view = memoryview(self.padded)
            key = seed.to_bytes(8, "little")
            out[long] = [int.from_bytes(blake2b(view[s:e], digest_size=8, key=key).digest(), "little") for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        return out

    def equal(self, a: np.ndarray, b: np.ndarray, sizes: np.ndarray, other: Spans | None = None) -> np.ndarray:
        """Whether the bytes from a and those from b, of another array if one is given, are equal; sizes are those of both."""
        other = other or self
        out, some, k = np.ones(len(a), bool), np.flatnonzero(sizes > 0), 0
        while len(some):
            if k > LONG:  # long spans, one by one
                for i in some.tolist():
                    x, y, n = int(a[i]), int(b[i]), int(sizes[i])
                    out[i] = np.array_equal(self.padded[x : x + n], other.padded[y : y + n])
                break
            differ = ((self.eight[a[some] + k] ^ other.eight[b[some] + k]) & _MASKS[np.minimum(sizes[some] - k, 8)]) != 0
            out[some[differ]] = False
            k += 8
            some = some[~differ & (sizes[some] > k)]
        return out

    def same_bytes(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bool:
        """Whether spans of equal hashes are spans of equal bytes."""
        order = np.argsort(hashes, kind="stable")
        twin = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
        a, b = order[twin], order[twin + 1]
        if not len(twin):
            return True
        size = ends - starts
        return bool((size[a] == size[b]).all() and self.equal(starts[a], starts[b], size[a]).all())


def shingles(word_hash: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of n neighbouring words, by the first one; those that run past a text's end are the caller's to skip."""
    count = max(0, len(word_hash) - n + 1)
    total = np.zeros(count, dtype=np.uint64)
    factor = 1
    for i in range(n):
        total += word_hash[i : i + count] * np.uint64(factor)
        factor = factor * 0xC2B2AE3D27D4EB4F % 2**64
    return mix(total, seed)
