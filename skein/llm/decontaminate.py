"""Benchmark decontamination that also catches re-parameterised questions.

Words are made canonical: numbers, units and names become typed placeholders. A name is a word with a capital; a unit is a
word of a fixed list that follows a number. A word that begins a sentence may be a name or not, and a verbatim copy may
differ in case and line breaks, so texts have three readings: words as they are, names where no sentence begins, and names
wherever a capital is. Where numbers hold points or commas, texts are also read with such numbers as one word each.

1. The windows of ``WINDOW`` tokens of all items, by reading, are a table with their canonical words and a hash of these. A window with
   placeholders needs ``LITERAL`` words that are none, since a row of numbers or a list of names says nothing about where it is from;
   as it is written, any window counts.
2. A pass over the documents makes their windows and lets through those whose hash may be in that table, told by a Bloom filter that is
   made from the table in Spark and has at most ``FILTER_BITS`` bits, however many items there are.
3. What is left is joined with the table on hash and canonical words, so words decide. Equal texts are judged once.
4. The windows of a text and an item that stand one behind the other (at one distance between text and item) form an alignment, by
   the second reading alone and by all together. A stretch of it is consistent if each placeholder value of the item goes
   to one value of the document only; different ones may go to the same.

A document is contaminated if a consistent stretch has ``MIN_WORDS`` words in a row, or if half of an item stands in a
verbatim stretch or between two conflicts, where each stretch ends at the first value that conflicts with it. An item of
fewer words than a window is one window as a whole; items under ``LEAST_WORDS`` words name nothing and match nothing.

Texts themselves are not shuffled; hits are, and the findings meet the documents by the digest of the text, broadcast by Spark
where their stored size allows it.

Defined results: there is one row per input row, whatever its id; null and empty texts match nothing and are kept; repeated rows give
repeated results; items without id or text are left out, equal ones both named; without items every document is kept; an empty
table gives no row; other columns stay in ``remove_contaminated`` and are ignored in ``contamination``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import textbytes as tb
from skein.llm.storage import Scratch

WINDOW, MIN_WORDS, LEAST_WORDS, LITERAL = 8, 12, 5, 2
#: The reading of words as they are.
WRITTEN = 1
#: Most bits of the filter (32 MB), bits for each window where that is less, and probes.
FILTER_BITS, BITS_PER_WINDOW, PROBES = 1 << 28, 16, 3
# fixed values: unit words that follow a number
UNITS = ("kg", "g", "mg", "km", "m", "cm", "mm", "miles", "mile", "meters", "metres", "hours", "hour", "minutes", "minute", "seconds", "days", "day", "weeks", "years", "dollars", "cents", "euros", "percent", "liters", "litres", "pounds", "degrees")
_WORD = tb.word_class(bytes(b for b in range(128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)))
KINDS = ("", "<number>", "<name>", "<unit>")
_KIND_HASHES = np.array([0, 0x51, 0x52, 0x53], np.uint64)
READINGS = 3
#: Bytes that UTF-8 never has stand for the commas and points of numbers.
_COMMA, _POINT = 0xFE, 0xFF


def _join_numbers(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bytes with commas and points between two digits of a text made part of the word."""
    digit = (data >= 48) & (data < 58)
    at = np.flatnonzero((data == 44) | (data == 46))
    at = at[(at > 0) & (at < len(data) - 1)]
    at = at[digit[at - 1] & digit[at + 1]]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    at = at[~edge[at] & ~edge[at + 1]]
    if len(at):
        data = data.copy()
        data[at] = np.where(data[at] == 44, _COMMA, _POINT)
    return data


class Tokens:
    """The words of a batch of texts, and by reading the kind of each (0: a word, then as in KINDS) and a hash of word or kind."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, joined: bool = False):
        data = _join_numbers(data, offsets) if joined else data
        self.data, self.low = data, tb.LOWER[data]
        self.starts, self.ends, self.first = tb.words(data, offsets, _WORD)
        self.own = tb.Spans(self.low).hash(self.starts, self.ends)
        self.kinds = np.zeros((READINGS, len(self.starts)), np.uint8)  # with names inside sentences, words as they are, names anywhere
        if len(self.starts):
            self._read(data)
        self.readings = [np.where(k > 0, _KIND_HASHES[k], self.own) for k in self.kinds]
        self.numbers = bool((self.kinds[0] == 1).any())

    def _read(self, data: np.ndarray) -> None:
        digit = ((data >= 48) & (data < 58)) | (data >= _COMMA)
        number = np.logical_and.reduceat(np.append(digit, True), np.stack([self.starts, self.ends], 1).ravel())[::2]
        after = np.append([False], number[:-1])
        new = np.zeros(len(self.starts), bool)
        new[self.first[:-1][np.diff(self.first) > 0]] = True
        # a sentence begins with a text or after . ! ? : or a line's end
        stop = np.isin(data, np.frombuffer(b".!?:\n", np.uint8))
        stops = np.concatenate([[0], np.cumsum(stop)])
        begins = new.copy()
        begins[1:] |= stops[self.starts[1:]] > stops[self.ends[:-1]]
        capital = (data[self.starts] >= 65) & (data[self.starts] < 91) & ~number
        inside, _, anywhere = self.kinds
        inside[number] = 1
        inside[capital & ~begins] = 2
        inside[np.isin(self.own, _UNIT_HASHES) & after & ~begins] = 3
        anywhere[:] = inside
        anywhere[capital & begins] = 2

    def words(self, at: int, n: int) -> list[str]:
        """The words from one on, in lower case."""
        raw = (self.low[s:e].tobytes() for s, e in zip(self.starts[at : at + n].tolist(), self.ends[at : at + n].tolist(), strict=True))
        return [x.replace(b"\xfe", b",").replace(b"\xff", b".").decode("utf-8", "replace") for x in raw]

    def windows(self, size: int, wanted: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[int, int, int, list[str], list[str], list[bool]]]:
        """(at, hash, readings as bits, canonical words, words, whether each is a placeholder) of the wanted windows; equal readings are one."""
        if len(self.starts) < size:
            return
        hashes = [tb.shingles(r, size, seed=size) for r in self.readings]
        last = np.repeat(self.first[1:], np.diff(self.first))[: len(hashes[0])]
        whole = np.arange(len(last)) + size <= last
        told: dict[tuple[int, int], int] = {}
        for reading, own in enumerate(hashes):
            new = whole & np.all([own != other for other in hashes[:reading]], axis=0) if reading else whole
            if reading != WRITTEN:
                literal = np.concatenate([[0], np.cumsum(self.kinds[reading] == 0)])
                new = new & (literal[size:] - literal[:-size] >= LITERAL)
            at = np.flatnonzero(new)
            for i in at[wanted(own[at])].tolist():
                told[i, reading] = sum(1 << r for r in range(reading, READINGS) if hashes[r][i] == own[i])
        for (i, reading), bits in told.items():
            words = self.words(i, size)
            kinds = self.kinds[reading, i : i + size].tolist()
            yield i, int(hashes[reading][i].view(np.int64)), bits, [KINDS[k] or w for k, w in zip(kinds, words, strict=True)], words, (self.kinds[0, i : i + size] > 0).tolist()


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    starts, ends, _ = tb.words(data, np.array([0, len(data)]), _WORD)
    return tb.Spans(data).hash(starts, ends)


_UNIT_HASHES = _unit_hashes()


_LIST = pa.list_(pa.string())
#: joined: whether numbers are read as one word each.
WINDOWS = "hash long, size int, joined boolean, item string, n_item int, there int, item_bits int, canonical array<string>, item_words array<string>, item_slots array<boolean>"
HITS = "text_key string, hash long, size int, joined boolean, here int, doc_bits int, canonical array<string>, doc_words array<string>, doc_slots array<boolean>"


def _item_windows(batches):
    names = [x.split()[0] for x in WINDOWS.split(", ")]
    kinds = pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.int32(), _LIST, _LIST, pa.list_(pa.bool_())
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            out, data = [], tb.batch_of(pa.array([text]))
            for joined in (False, True):
                tokens = Tokens(*data, joined)
                n = len(tokens.starts)
                if n < LEAST_WORDS or joined and not tokens.numbers:
                    continue
                size = min(n, WINDOW)
                for at, h, bits, canonical, words, slots in tokens.windows(size, lambda x: np.ones(len(x), bool)):
                    out.append((h, size, joined, key, n, at, bits, canonical, words, slots))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)


class Filter:
    """A Bloom filter over window hashes."""

    def __init__(self, table: np.ndarray, forms: list[tuple[int, bool]]):
        self.table, self.forms = table, forms  # forms: sizes of windows, and whether numbers are read as one

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for k in range(PROBES):
            bit = _bit(hashes, k) & np.uint64(64 * len(self.table) - 1)
            out &= (self.table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
        return out


def _bit(hashes: np.ndarray, probe: int) -> np.ndarray:
    return hashes >> np.uint64(17 * probe)


def _filter_of(windows: DataFrame) -> Filter | None:
    """The filter over a stored table of windows; its words are put together in Spark, at most FILTER_BITS / 64 of them."""
    forms = [(r["size"], r["joined"]) for r in windows.select("size", "joined").distinct().collect()]  # at most eight
    if not forms:
        return None
    bits = min(FILTER_BITS, max(1 << 12, 1 << (BITS_PER_WINDOW * windows.count()).bit_length()))
    probes = F.explode(F.array(*(F.shiftrightunsigned("hash", 17 * k).bitwiseAND(F.lit(bits - 1)) for k in range(PROBES)))).alias("bit")
    words = windows.select(probes).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("set")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[words["word"].to_numpy()] = words["set"].to_numpy().view(np.uint64)
    return Filter(table, forms)


def _probe(shared) -> Callable:
    names = [x.split()[0] for x in HITS.split(", ")]
    kinds = pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), _LIST, _LIST, pa.list_(pa.bool_())

    def run(batches):
        known = shared.value
        for batch in batches:
            data, offsets = tb.batch_of(batch.column(1))
            for lo, hi in tb.runs(offsets):
                part = tb.part(data, offsets, lo, hi)
                for joined in sorted({j for _, j in known.forms}):
                    tokens, out = Tokens(*part, joined), []
                    for size in sorted(n for n, j in known.forms if j == joined):
                        for at, h, bits, canonical, words, slots in tokens.windows(size, known):
                            text = int(np.searchsorted(tokens.first, at, "right")) - 1
                            out.append((batch.column(0)[lo + text].as_py(), h, size, joined, at - int(tokens.first[text]), bits, canonical, words, slots))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return run


def _stretches(mine: list[str], theirs: list[str], slot: list[bool]) -> tuple[list, list, list]:
    """Longest consistent stretches, which may overlap; those between conflicts, from the left; and verbatim ones."""
    longest, between, since, begin = [], [], 0, 0
    seen: dict = {}  # by item value: its last document value, where, and where the last other one was
    for s, (key, value, is_slot) in enumerate(zip(theirs, mine, slot, strict=True)):
        if not is_slot:
            continue
        old, last, other = seen.get(key, (value, s, -1))
        if old != value:
            other = last
        seen[key] = value, s, other
        if other >= since:
            longest.append((since, s))
            since = other + 1
        if other >= begin:
            between.append((begin, s))
            begin = s
    same = np.array([False, *(x == y for x, y in zip(mine, theirs, strict=True)), False])
    edges = np.flatnonzero(np.diff(same.astype(np.int8)))
    return [*longest, (since, len(mine))], [*between, (begin, len(mine))], edges.reshape(-1, 2).tolist()


def _found(rows: list[dict]) -> tuple[int, bool]:
    """The words of the longest stretch that counts between a text and an item, 0 without one, and whether one is verbatim."""
    rows.sort(key=lambda r: (r["here"] - r["there"], r["here"]))
    first = [r for r in rows if r["bits"] & 1]
    longest, verbatim = _aligned(rows)
    if 0 < len(first) < len(rows):
        more, equal = _aligned(first)
        longest, verbatim = max(longest, more), verbatim or equal
    return longest, verbatim


def _aligned(rows: list[dict]) -> tuple[int, bool]:
    best, equal, at = 0, False, 0
    while at < len(rows):
        end, begin = at + 1, rows[at]
        reach = begin["here"] + begin["size"]
        while end < len(rows) and rows[end]["here"] - rows[end]["there"] == begin["here"] - begin["there"] and rows[end]["here"] <= reach:
            reach = max(reach, rows[end]["here"] + rows[end]["size"])
            end += 1
        n = reach - begin["here"]
        mine, theirs, slot = [""] * n, [""] * n, [False] * n
        for r in rows[at:end]:
            k = r["here"] - begin["here"]
            mine[k : k + r["size"]], theirs[k : k + r["size"]] = r["doc_words"], r["item_words"]
            slot[k : k + r["size"]] = [a or b for a, b in zip(r["doc_slots"], r["item_slots"], strict=True)]
        slot = [x or a != b for x, a, b in zip(slot, mine, theirs, strict=True)]
        longest, between, same = _stretches(mine, theirs, slot)
        half = min(MIN_WORDS, (begin["n_item"] + 1) // 2)
        for stretches, least in ((longest, MIN_WORDS), (between, half), (same, half)):
            for lo, hi in stretches:
                if hi - lo >= least:
                    best, equal = max(best, hi - lo), equal or stretches is same
        at = end
    return best, equal


def _judge(batches):
    """Rows sorted by text, item and distance; those of one distance are held together, no more than the text has words."""
    key, held = None, []

    def judged() -> Iterator[pa.RecordBatch]:
        n, verbatim = _found(held)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([n], pa.int64()), pa.array([verbatim])], ["text_key", "item", "n_words", "verbatim"])

    for batch in batches:
        for row in batch.to_pylist():
            if (line := (row["text_key"], row["item"], row["joined"], row["here"] - row["there"])) != key:
                yield from judged() if held else ()
                key, held = line, []
            held.append(row)
    yield from judged() if held else ()


def find_items(texts: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per contaminated text: text_key (SHA-256 of the text), item_ids it holds, longest n_words, verbatim. A stored table."""
    spark = texts.sparkSession
    scratch = Scratch(spark, "decontaminate")
    named = items.select(F.col(item_col).cast("long").alias("item_id"), F.sha2(item_text_col, 256).alias("item"), F.col(item_text_col).alias("text")).where("item_id IS NOT NULL AND item IS NOT NULL")
    windows = scratch.keep(named.select("item", "text").dropDuplicates(["item"]).mapInArrow(_item_windows, WINDOWS), "windows")
    known = _filter_of(windows)
    if known is None:
        return spark.createDataFrame([], "text_key string, item_ids array<long>, n_words long, verbatim boolean")
    rows = texts.select(F.sha2(text_col, 256).alias("text_key"), F.col(text_col).alias("text")).where(F.col(text_col).isNotNull())
    hits = rows.mapInArrow(_probe(spark.sparkContext.broadcast(known)), HITS).dropDuplicates(["text_key", "joined", "size", "here", "hash"])
    met = scratch.keep(hits, "hits").join(windows, ["hash", "size", "joined", "canonical"]).withColumn("bits", F.col("doc_bits").bitwiseAND(F.col("item_bits"))).where("bits != 0")
    met = met.select("text_key", "item", "joined", "here", "there", "size", "n_item", "bits", "doc_words", "item_words", "doc_slots", "item_slots")
    judged = met.repartition("text_key", "item").sortWithinPartitions("text_key", "item", "joined", F.col("here") - F.col("there")).mapInArrow(_judge, "text_key string, item string, n_words long, verbatim boolean")
    found = judged.join(named.select("item", "item_id").distinct(), "item").groupBy("text_key")
    found = found.agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("n_words").alias("n_words"), F.max("verbatim").alias("verbatim"))
    return scratch.keep(found, "found")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per input row: id, the item_ids it holds, its longest n_words, verbatim, and kept if it holds none."""
    found = find_items(docs, items, text_col, item_col, item_text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text_col, 256).alias("text_key")).join(found, "text_key", "left")
    none = F.array().cast("array<long>")
    out = rows.select("doc_id", F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"), F.coalesce("verbatim", F.lit(False)).alias("verbatim"), F.col("n_words").isNull().alias("kept"))
    return out.withColumnRenamed("doc_id", id_col)


def remove_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that hold no item."""
    key = max(docs.columns, key=len) + "_key"  # no column's name
    found = find_items(docs, items, text_col, item_col, item_text_col).select(F.col("text_key").alias(key))
    return docs.join(found, F.sha2(docs[text_col], 256) == F.col(key), "left_anti")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, items)
