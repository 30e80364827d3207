"""Removal of bytes that a repeated string of ``LENGTH`` bytes covers, by suffix arrays of shards.

Which strings can be equal is found first, without loss. Every window of LENGTH bytes names the least hash among its
``GRAM``-byte grams as its anchor (the leftmost of equal ones), so equal windows name equal anchors. Neighbouring windows with
one anchor form a region. Then

1. regions of equal bytes, told by 128-bit BLAKE2 digests, form a class: all but the first occurrence is repeated as a whole;
2. classes of one anchor that differ may still share windows. Their first occurrences go, as bytes, to the anchor's
   shard, whose suffix array shows equal windows: neighbours in it with a common prefix of LENGTH bytes or more.

The array is built by induced sorting: suffixes are classified as larger or smaller than the next; the leftmost-smaller
substrings are sorted by induction and named; if names repeat, the string of names is sorted by the same method; the order of the
leftmost-smaller suffixes then induces all others in linear time. Buckets are worked off as whole arrays where they are few,
suffix by suffix where there are many. Common prefixes are computed in text order (permuted), by comparing each suffix with its
predecessor in the array, eight bytes at a time.

Equal regions of a map task's run collapse before the shuffle and a partition's sorted rows stream through its task. An anchor with
more than ``HOT`` classes would be a shard without bound, so its regions are divided again by the anchors of two further hashes, on
which equal windows agree as well. What then still stands under one busy key, windows that differ in a few bytes, is no longer
sorted: its windows meet under their own digests. So no group has to fit in memory.

Defined results: a null or empty text has no bytes; rows with a null id keep all their bytes and are no source; rows of one
id are one document, and if their texts differ, a place repeated in one counts for each; bytes are cut where they are,
even inside a character.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import textbytes as tb
from skein.llm.storage import Scratch

LENGTH, GRAM = 100, 20
HOT, SHARD_BYTES = 20_000, 2 << 20
#: The further hashes that divide the regions of a busy anchor.
DIVIDERS = (1, 2)
#: Parts of a key's rows where they meet what is known of the key.
SALTS = 16
_PLACE = np.uint64((1 << 21) - 1)

# --- suffix arrays -------------------------------------------------------------------------------------------------


def _induce(s: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, names: int) -> np.ndarray:
    """All suffixes in order, from leftmost-smaller ones in the order of seeds within each first symbol.

    The first pass goes up through the symbols and places larger suffixes, the second goes down and places smaller ones.
    """
    return (_induce_buckets if names * 64 <= len(s) else _induce_suffixes)(s, smaller, seeds, names)


def _induce_suffixes(s: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, names: int) -> np.ndarray:
    """Induction one suffix at a time, for many small buckets; places of the array that are still free hold -1."""
    n = len(s)
    ends = np.cumsum(np.bincount(s, minlength=names))
    by = np.argsort(s[seeds], kind="stable")
    seeds = seeds[by]
    last = np.searchsorted(s[seeds], np.arange(names), "right")
    begun = np.full(n, -1, np.int32)
    begun[np.arange(len(seeds)) - last[s[seeds]] + ends[s[seeds]]] = seeds
    symbol, order = s[:-1].astype(np.int32), array("i", begun.tobytes())
    for want, at, step in ((False, np.append(0, ends[:-1]), 1), (True, ends - 1, -1)):
        # the symbol before each suffix if the suffix there is of the wanted kind; the last entry serves free places
        before = array("i", np.concatenate([[-1], np.where(smaller[:-1] == want, symbol, -1), [-1]]).astype(np.int32).tobytes())
        free = at.tolist()
        for j in order if step == 1 else reversed(order):
            c = before[j]
            if c >= 0:
                place = free[c]
                order[place] = j - 1
                free[c] = place + step
    return np.array(order)


def _induce_buckets(s: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, names: int) -> np.ndarray:
    """Induction a bucket at a time; what its suffixes induce into itself is taken in rounds, one for each repeat of its symbol."""
    by = np.argsort(s[seeds], kind="stable")
    cuts = np.searchsorted(s[seeds][by], np.arange(names + 1))
    seeds = seeds[by]
    larger_of: list[list[np.ndarray]] = [[] for _ in range(names)]
    smaller_of: list[list[np.ndarray]] = [[] for _ in range(names)]

    def hand_out(found: np.ndarray, want: bool, into: list[list[np.ndarray]], own: int) -> np.ndarray:
        """Suffixes one before those found go to their buckets; those of the bucket itself come back."""
        before = found[found > 0] - 1
        before = before[smaller[before] == want]
        if not len(before):
            return before
        symbol = s[before]
        order = np.argsort(symbol, kind="stable")
        symbol, before = symbol[order], before[order]
        at = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
        rest = before[:0]
        for c, part in zip(symbol[at].tolist(), np.split(before, at[1:]), strict=True):
            if c == own:
                rest = part
            else:
                into[c].append(part)
        return rest

    def bucket(parts: list[np.ndarray], want: bool, into: list[list[np.ndarray]], c: int) -> np.ndarray:
        todo = np.concatenate(parts) if parts else np.zeros(0, seeds.dtype)
        done = [todo]
        while len(todo):
            todo = hand_out(todo, want, into, c)
            done.append(todo)
        return np.concatenate(done)

    larger = []
    for c in range(names):
        larger.append(bucket(larger_of[c], False, larger_of, c))
        hand_out(seeds[cuts[c] : cuts[c + 1]], False, larger_of, -1)
    smaller_parts = [np.zeros(0, seeds.dtype)] * names
    for c in range(names - 1, -1, -1):
        down = bucket(smaller_of[c], True, smaller_of, c)
        hand_out(larger[c][::-1], True, smaller_of, -1)
        smaller_parts[c] = down[::-1]
    end = seeds[:1] if len(seeds) and s[seeds[0]] == 0 else np.zeros(0, seeds.dtype)  # nothing induces the end mark
    smaller_parts[0] = end
    return np.concatenate([x for c in range(names) for x in (larger[c], smaller_parts[c])])


def suffix_array(s: np.ndarray, names: int) -> np.ndarray:
    """The suffix array of s, whose last symbol is 0 and stands nowhere else; symbols are below names."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int32)
    step = np.sign(np.diff(s.astype(np.int64)))
    places = np.where(step != 0, np.arange(n - 1), n)
    following = np.minimum.accumulate(places[::-1])[::-1]  # of an equal run, the step at its end
    smaller = np.ones(n, bool)
    smaller[:-1] = step[following] > 0
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]).astype(np.int32) + 1
    is_leftmost = np.zeros(n, bool)
    is_leftmost[leftmost] = True
    order = _induce(s, smaller, leftmost, names)
    order = order[is_leftmost[order]]
    ends = np.empty(n, np.int64)
    ends[leftmost] = np.append(leftmost[1:], n - 1)
    a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
    differ = ends[a] - a != ends[b] - b
    left, k = np.flatnonzero(~differ), 0
    while len(left):
        unequal = s[a[left] + k] != s[b[left] + k]
        differ[left[unequal]] = True
        k += 1
        left = left[~unequal]
        left = left[a[left] + k <= ends[a[left]]]
    name = np.empty(n, np.int64)
    name[order] = np.concatenate([[0], np.cumsum(differ)])
    reduced, distinct = name[leftmost], int(differ.sum()) + 1
    if distinct < len(leftmost):
        order = leftmost[suffix_array(reduced, distinct)]
    return _induce(s, smaller, order.astype(np.int32), names)


def permuted_prefixes(data: np.ndarray, suffixes: np.ndarray, most: int) -> np.ndarray:
    """For each place of data, its common prefix with the suffix before it in the array, in whole steps up to most."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(most + 8, np.uint8)])
    before = np.full(n, -1, np.int64)
    before[suffixes[1:]] = suffixes[:-1]
    prefix = np.zeros(n, np.int32)
    here = np.flatnonzero(before >= 0)
    for at in range(0, most, 8):
        size = min(8, most - at)
        words = np.ndarray((len(padded) - 7,), "<u8", padded.data, 0, (1,))
        mask = np.uint64((1 << 8 * size) - 1)
        here = here[((words[here + at] ^ words[before[here] + at]) & mask) == 0]
        prefix[here] += size
    return prefix


def repeated_windows(regions: list[bytes], documents: np.ndarray, begins: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, start) of all windows of the regions that also start at an earlier (document, start)."""
    sizes = np.array([len(r) for r in regions], np.int64)
    data = np.frombuffer(b"\xff".join(regions), np.uint8)  # no byte of UTF-8
    s = np.zeros(len(data) + 1, np.int16)
    s[:-1] = data.astype(np.int16) + 1
    suffixes = suffix_array(s, 257)[1:]
    prefix = permuted_prefixes(data, suffixes, length)
    block = np.empty(len(data), np.int64)
    block[suffixes] = np.cumsum(prefix[suffixes] < length)
    windows = sizes - length + 1
    first = np.cumsum(sizes + 1) - sizes - 1
    inner = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    block = block[np.repeat(first, windows) + inner]
    document, start = np.repeat(documents, windows), np.repeat(begins, windows) + inner
    order = np.lexsort((start, document, block))
    block, document, start = block[order], document[order], start[order]
    new = np.concatenate([[True], block[1:] != block[:-1]])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    again = (document != document[head]) | (start != start[head])
    return document[again], start[again]


def joined_spans(document: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of spans by document."""
    if not len(document):
        return document, begin, end
    order = np.lexsort((begin, document))
    document, begin, end = document[order], begin[order], end[order]
    number = np.concatenate([[0], np.cumsum(document[1:] != document[:-1])])
    most = int(end.max()) + 1
    reach = np.maximum.accumulate(end + number * most) - number * most  # documents apart
    new = np.concatenate([[True], (number[1:] != number[:-1]) | (begin[1:] > reach[:-1])])
    at = np.flatnonzero(new)
    return document[at], begin[at], np.maximum.reduceat(end, at)


# --- anchors and regions -------------------------------------------------------------------------------------------

#: n > 0: a region of n windows from ``at``; n < 0: a span of -n bytes known to be repeated, under a key of its own.
REGIONS = "key long, class long, class2 long, doc_id long, at long, n int"
#: kind 0: the bytes from ``at``, n of them, are repeated; kind 1: a region of n windows to compare under its key.
EVENTS = "kind int, key long, doc_id long, at long, n int"
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0x632BE59BD9B4E019)


def _gram_hashes(data: np.ndarray, gram: int, level: int) -> np.ndarray:
    """Hashes of all grams (of eight bytes or more). They only say where windows meet; equal ones need not be equal grams."""
    n, eight = len(data) - gram + 1, tb.Spans(data).eight
    out = np.full(n, level + 1, np.uint64)
    for i, at in enumerate([*range(0, gram - 8, 8), gram - 8]):
        out *= np.uint64(_ODD[i % 4])
        out += tb.mix(eight[at : at + n], level) if level else eight[at : at + n]
        out ^= out >> np.uint64(29)
    return tb.mix(out, level)


def _digests(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit digests of spans, as two columns of numbers."""
    view = memoryview(np.ascontiguousarray(data))
    joined = b"".join([blake2b(view[b:e], digest_size=16).digest() for b, e in zip(begin.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(joined, "<i8").reshape(-1, 2)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each width neighbouring values."""
    out, have = values, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


def regions_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, levels: tuple[int, ...] = (0,)) -> tuple[np.ndarray, ...]:
    """(anchor hash, text number, begin in data, windows) of all regions of a run of texts; with several hashes windows of a region agree on all anchors."""
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    if len(data) < length:
        return none
    at = np.arange(len(data) - gram + 1)
    n = len(data) - length + 1
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    starts = np.flatnonzero(offsets[text + 1] - at[:n] >= length)
    if not len(starts):
        return none
    text = text[starts]
    new = np.concatenate([[True], text[1:] != text[:-1]])
    anchors = []
    for level in levels:
        hashes = _gram_hashes(data, gram, level)
        anchor = (_least((hashes & ~_PLACE) | at.astype(np.uint64), length - gram + 1) & _PLACE).astype(np.int64)[starts]
        new[1:] |= anchor[1:] != anchor[:-1]
        anchors.append(hashes[anchor])
    cut = np.flatnonzero(new)
    key = np.zeros(len(cut), np.uint64)
    for level, anchor in zip(levels, anchors, strict=True):
        key = tb.mix(key ^ anchor[cut], 3 + level)
    return key, text[cut], starts[cut], np.diff(np.append(cut, len(starts)))


def _first_of_each(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the first of each (key, class, class2) by the other columns (document, at), and of those that repeat it elsewhere."""
    order = np.lexsort(columns[::-1])
    sorted_ = [c[order] for c in columns]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in sorted_[:3]:
        new[1:] |= c[1:] != c[:-1]
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else order
    return order[new], order[np.any([c != c[head] for c in sorted_[3:]], axis=0)]


def _region_rows(data: np.ndarray, key: np.ndarray, begin: np.ndarray, windows: np.ndarray, document: np.ndarray, at: np.ndarray, length: int) -> pa.RecordBatch:
    """REGIONS rows: the first of each class, and the joined spans of the others."""
    digest = _digests(data, begin, begin + windows - 1 + length)
    first, again = _first_of_each(key, digest[:, 0], digest[:, 1], document, at)
    d, b, e = joined_spans(document[again], at[again], at[again] + windows[again] - 1 + length)
    own = tb.mix(tb.mix(d.astype(np.uint64), 7) + b.astype(np.uint64))
    zero = np.zeros(len(d), np.int64)
    columns = (
        np.concatenate([key[first], own]).view(np.int64),
        *(np.concatenate([digest[first, k], zero]) for k in (0, 1)),
        np.concatenate([document[first], d]),
        np.concatenate([at[first], b]),
        np.concatenate([windows[first], b - e]).astype(np.int32),
    )
    return pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["key", "class", "class2", "doc_id", "at", "n"])


def _anchors(length: int, gram: int) -> Callable:
    def rows(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, base: int) -> pa.RecordBatch:
        key, text, begin, windows = regions_of(data, offsets, length, gram)
        return _region_rows(data, key, begin, windows, ids[text], begin - offsets[text] + base, length)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = tb.batch_of(batch.column(1))
            for lo, hi in tb.runs(offsets):
                some, own = tb.part(data, offsets, lo, hi)
                for base in range(0, max(1, len(some) - length + 1), tb.RUN_BYTES) if hi - lo == 1 else (0,):
                    piece = some[base : base + tb.RUN_BYTES + length - 1] if hi - lo == 1 else some
                    yield rows(ids[lo:hi], piece, own if hi - lo > 1 else np.array([0, len(piece)]), base)

    return run


def _divided(length: int, gram: int) -> Callable:
    """Regions of busy keys, divided by the anchors of further hashes: REGIONS rows under all anchors together."""

    def run(batches):
        for batch in batches:
            data, offsets = tb.batch_of(batch.column("text"))
            for i, (document, regions) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("regions"), strict=True)):
                flat, own = regions.values, data[offsets[i] : offsets[i + 1]]
                key, at, n = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("key", "at", "n"))
                fits = at + n - 1 + length <= len(own)
                key, at, n = key[fits], at[fits], n[fits].astype(np.int64)
                sizes = n - 1 + length
                for lo, hi in tb.runs(np.concatenate([[0], np.cumsum(sizes)])):
                    bounds = np.concatenate([[0], np.cumsum(sizes[lo:hi])])
                    piece = own[np.repeat(at[lo:hi] - bounds[:-1], sizes[lo:hi]) + np.arange(bounds[-1])]
                    anchor, region, begin, windows = regions_of(piece, bounds, length, gram, DIVIDERS)
                    anchor = tb.mix(anchor ^ key[lo:hi].view(np.uint64)[region])
                    yield _region_rows(piece, anchor, begin, windows, np.full(len(begin), document, np.int64), begin - bounds[region] + at[lo:hi][region], length)

    return run


class _Classes:
    """Walks rows sorted by key, class, document and place, batch after batch; keeps only the last group's head."""

    def __init__(self):
        self.key = self.kind = self.head = self.waiting = None
        self.heads = 0

    def take(self, key: np.ndarray, kind: tuple[np.ndarray, np.ndarray], document: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
        """Rows that repeat their class's head elsewhere, and heads whose key has several classes."""
        new_key = np.concatenate([[key[0] != self.key], key[1:] != key[:-1]])
        new = new_key | np.concatenate([[self.kind != (kind[0][0], kind[1][0])], (kind[0][1:] != kind[0][:-1]) | (kind[1][1:] != kind[1][:-1])])
        heads = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        head_doc, head_at = (np.append(x[heads], self.head[i] if self.head else 0) for i, x in enumerate((document, at)))  # -1: the head of the batch before
        again = (document != head_doc[of]) | (at != head_at[of])
        group = np.cumsum(new_key)  # 0: the group of the batch before
        count = np.bincount(group[heads], minlength=group[-1] + 1)
        count[0] += self.heads
        several = heads[count[group[heads]] > 1]
        out = [tuple(x[several] for x in (key, document, at, n))]
        if self.waiting is not None and count[0] > 1:
            out.append(self.waiting)
        if self.waiting is not None and (count[0] > 1 or group[-1] > 0):
            self.waiting = None
        self.heads = min(2, int(count[group[-1]]))
        if self.heads == 1 and len(heads) and group[heads[-1]] == group[-1]:
            self.waiting = tuple(x[heads[-1:]] for x in (key, document, at, n))
        if len(heads):
            self.head = document[heads[-1]], at[heads[-1]]
        self.key, self.kind = key[-1], (kind[0][-1], kind[1][-1])
        return again, out


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def _spans_batch(document: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(document, pa.int64()), pa.array(begin, pa.int64()), pa.array(end - begin, pa.int32())], ["doc_id", "at", "n"])


def _resolve(length: int) -> Callable:
    def event(kind: int, key: np.ndarray, document: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(key), pa.array(document), pa.array(at), pa.array(n.astype(np.int32))], ["kind", "key", "doc_id", "at", "n"])

    def run(batches):
        classes = _Classes()
        for batch in batches:
            key, a, b, document, at, n = _numbers(batch, "key", "class", "class2", "doc_id", "at", "n")
            known = n < 0
            if known.any():
                yield event(0, key[known], document[known], at[known], -n[known])
                key, a, b, document, at, n = (x[~known] for x in (key, a, b, document, at, n))
            if len(key):
                again, heads = classes.take(key, (a, b), document, at, n)
                d, b, e = joined_spans(document[again], at[again], at[again] + n[again] - 1 + length)
                yield event(0, np.zeros(len(d), np.int64), d, b, e - b)
                for h in heads:
                    yield event(1, *h)

    return run


SHARD_ROWS = "hot boolean, key long, class long, class2 long, doc_id long, at long, n int, region binary"


def _cut(length: int) -> Callable:
    """Bytes of regions; of keys that stay busy, windows under their own digests."""

    def run(batches):
        names = ["hot", "key", "class", "class2", "doc_id", "at", "n", "region"]
        for batch in batches:
            data, offsets = tb.batch_of(batch.column("text"))
            lists = batch.column("regions")
            ends, flat = np.cumsum([0, *lists.value_lengths().to_pylist()]), lists.flatten()
            key, at, n, hot = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("key", "at", "n", "hot"))
            ids, (document,) = np.repeat(np.arange(batch.num_rows), np.diff(ends)), _numbers(batch, "doc_id")
            begin, document = offsets[ids] + at, document[ids]
            fits = begin + n - 1 + length <= offsets[ids + 1]
            for rows in np.array_split(np.flatnonzero(fits & ~hot.astype(bool)), max(1, len(key) // 20_000)):
                if len(rows):
                    cut = pa.array([data[b : b + m].tobytes() for b, m in zip(begin[rows], n[rows] - 1 + length, strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(rows), bool)), *(pa.array(x) for x in (key[rows], *np.zeros((2, len(rows)), np.int64), document[rows], at[rows], n[rows])), cut], names)
            for i in np.flatnonzero(fits & hot.astype(bool)):
                spot = np.arange(n[i])
                pair = _digests(data, begin[i] + spot, begin[i] + spot + length)
                columns = pair[:, 0], pair[:, 0], pair[:, 1], np.full(n[i], document[i]), at[i] + spot, np.ones(n[i], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(n[i], bool)), *map(pa.array, columns), pa.nulls(n[i], pa.binary())], names)

    return run


def _shards(length: int, shard_bytes: int) -> Callable:
    def compare(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        d, a = repeated_windows(table["region"].to_pylist(), table["doc_id"].to_numpy(), table["at"].to_numpy(), length)
        return _spans_batch(*joined_spans(d, a, a + length))

    def run(batches):
        classes, held, size, last = _Classes(), [], 0, None
        for batch in batches:
            hot = batch.column("hot").to_numpy(zero_copy_only=False).astype(bool)
            if hot.any():
                key, a, b, document, at, n = (x[hot] for x in _numbers(batch, "key", "class", "class2", "doc_id", "at", "n"))
                again, _ = classes.take(key, (a, b), document, at, n)
                yield _spans_batch(*joined_spans(document[again], at[again], at[again] + length))
            batch = batch.filter(pa.array(~hot))
            if not batch.num_rows:
                continue
            # a shard ends with a key once it has enough bytes
            key = batch.column("key").to_numpy()
            ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, batch.num_rows)
            sizes, lo = np.concatenate([[0], np.cumsum(_numbers(batch, "n")[0].astype(np.int64) + length)]), 0
            if held and key[0] != last and size >= shard_bytes:
                yield compare(held)
                held, size = [], 0
            for hi in ends[:-1]:
                if size + sizes[hi] - sizes[lo] >= shard_bytes:
                    yield compare([*held, batch.slice(lo, hi - lo)])
                    held, size, lo = [], 0, int(hi)
            held.append(batch.slice(lo))
            size, last = size + int(sizes[-1] - sizes[lo]), key[-1]
        if held:
            yield compare(held)

    return run


def _clean(batches):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"]
    for batch in batches:
        data, offsets = tb.batch_of(batch.column("text"))
        lists = batch.column("spans").to_pylist()
        out = [[] for _ in names[1:]]
        for i, spans in enumerate(lists):
            own = data[offsets[i] : offsets[i + 1]]
            keep, n_spans = own, 0
            if spans:
                begin, n = (np.array([x[k] for x in spans], np.int64) for k in ("at", "n"))
                _, begin, end = joined_spans(np.zeros(len(n), np.int64), np.minimum(begin, len(own)), np.minimum(begin + n, len(own)))
                begin, end = begin[end > begin], end[end > begin]
                change = np.zeros(len(own) + 1, np.int8)
                change[begin] += 1
                change[end] -= 1
                keep, n_spans = own[np.cumsum(change[:-1]) == 0], len(begin)
            kept = keep.tobytes()
            for column, value in zip(out, (len(own), len(own) - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                column.append(value)
        kinds = pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes.

    Texts are dealt out by id once, for cutting regions and for the result; Spark reuses that exchange.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = rows.where("doc_id IS NOT NULL")
    dealt = named.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")

    def resolved(regions: DataFrame) -> DataFrame:
        met = regions.repartition("key").sortWithinPartitions("key", "class", "class2", "doc_id", "at")
        return scratch.keep(met.mapInArrow(_resolve(length), EVENTS), "events")

    def busy_marked(events: DataFrame) -> DataFrame:
        """Regions to compare, and whether their key has more than ``hot`` of them."""
        regions = events.where("kind = 1").select("key", "doc_id", "at", "n", F.pmod(F.xxhash64("doc_id", "at"), F.lit(SALTS)).alias("salt"))
        busy = regions.groupBy("key").agg(F.count(F.lit(1)).alias("classes")).where(F.col("classes") > hot)
        busy = busy.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"), F.lit(True).alias("hot"))
        return regions.join(busy, ["key", "salt"], "left").select("key", "doc_id", "at", "n", F.coalesce("hot", F.lit(False)).alias("hot"))

    def by_doc(regions: DataFrame) -> DataFrame:
        return regions.groupBy("doc_id").agg(F.collect_list(F.struct("key", "at", "n", "hot")).alias("regions"))

    events = resolved(named.mapInArrow(_anchors(length, gram), REGIONS))
    repeated, regions = events.where("kind = 0").select("doc_id", "at", "n"), busy_marked(events)
    busy = scratch.keep(by_doc(regions.where("hot")), "busy")  # stored, so that Spark knows its size when it plans the join
    if not busy.isEmpty():
        events = resolved(named.join(busy, "doc_id").select("doc_id", "text", "regions").mapInArrow(_divided(length, gram), REGIONS))
        repeated = repeated.union(events.where("kind = 0").select("doc_id", "at", "n"))
        regions = regions.where("NOT hot").union(busy_marked(events))
    compared = dealt.join(by_doc(regions), "doc_id").select("doc_id", "text", "regions").mapInArrow(_cut(length), SHARD_ROWS)
    compared = compared.repartition("key").sortWithinPartitions("hot", "key", "class", "class2", "doc_id", "at").mapInArrow(_shards(length, shard_bytes), "doc_id long, at long, n int")
    spans = repeated.union(compared)
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    cleaned = dealt.join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    unnamed = rows.where("doc_id IS NULL").withColumn("spans", F.lit(None).cast(cleaned.schema["spans"].dataType))
    out = cleaned.union(unnamed).mapInArrow(_clean, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")
    return out.withColumnRenamed("doc_id", id_col)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_bytes")
