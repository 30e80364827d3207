"""Language identification of mixed-language texts.

Per-word scores are sums of byte-trigram log probabilities by language. Words are runs of letters; a word's script, told by the
ranges of its code points, narrows the languages to those that use the script in the learned texts. Viterbi over a text's words with a penalty for each
switch labels spans; the prediction is the language of most words, the score its share of the words.

Learning counts trigrams of a bounded sample: of each language the ``per_lang`` documents whose ids hash lowest, whole
texts. Documents of a batch go through Viterbi side by side, one word of each at a time.

Letters are the code points of category L; one outside all ranges goes with any script, so it is judged among all languages.

Defined results: ``und`` and score 0 for a null text, a text without a letter, or when nothing could be learned; a text
whose script no language uses is judged among all languages; ties go to the first language by name; repeated rows give repeated
results, also with different texts; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm import textbytes as tb

PER_LANG, SWITCH = 2000, 10.0
_BITS = 16
BINS = 1 << _BITS
#: Letters: a-z and all beyond ASCII.
LETTERS = tb.word_class(bytes(b for b in range(128) if not 97 <= b < 123))
# fixed values: first code points of the ranges of scripts, each up to the next; "" has no letters, "mark" goes with any script
SCRIPT_STARTS = {
    0x0: "", 0x41: "latin", 0x5B: "", 0x61: "latin", 0x7B: "", 0xAA: "latin", 0xAB: "", 0xB5: "mark", 0xB6: "", 0xBA: "latin", 0xBB: "",
    0xC0: "latin", 0xD7: "", 0xD8: "latin", 0xF7: "", 0xF8: "latin", 0x2B9: "mark", 0x370: "greek", 0x37E: "", 0x37F: "greek", 0x387: "", 0x388: "greek",
    0x400: "cyrillic", 0x482: "mark", 0x48A: "cyrillic", 0x530: "armenian", 0x55A: "", 0x560: "armenian", 0x589: "", 0x591: "hebrew", 0x5F3: "",
    0x600: "", 0x610: "arabic", 0x61B: "", 0x620: "arabic", 0x660: "", 0x66E: "arabic", 0x6D4: "", 0x6D5: "arabic", 0x6F0: "", 0x6FA: "arabic",
    0x700: "other", 0x750: "arabic", 0x780: "other", 0x860: "other", 0x870: "arabic", 0x900: "south asian", 0xE00: "southeast asian",
    0x10A0: "georgian", 0x1100: "hangul", 0x1200: "other", 0x1C80: "cyrillic", 0x1C90: "georgian", 0x1CC0: "other", 0x1D00: "mark", 0x1E00: "latin", 0x1F00: "greek",
    0x2000: "", 0x2090: "mark", 0x209D: "", 0x2C00: "other", 0x2C60: "latin", 0x2C80: "other", 0x2D00: "georgian", 0x2D30: "other", 0x2DE0: "cyrillic", 0x2E00: "", 0x2E80: "han", 0x3000: "",
    0x3005: "han", 0x3008: "", 0x3041: "kana", 0x3100: "han", 0x3130: "hangul", 0x3190: "", 0x31A0: "han", 0x31F0: "kana", 0x3200: "", 0x3400: "han", 0x4DC0: "", 0x4E00: "han",
    0xA000: "other", 0xA640: "cyrillic", 0xA6A0: "other", 0xA722: "latin", 0xA800: "other", 0xA8E0: "south asian", 0xA900: "other", 0xA960: "hangul", 0xA980: "other", 0xAB30: "latin", 0xAB65: "greek", 0xAB66: "latin",
    0xAB70: "other", 0xAC00: "hangul", 0xD800: "", 0xF900: "han", 0xFB00: "latin", 0xFB13: "armenian", 0xFB1D: "hebrew", 0xFB50: "arabic", 0xFD3E: "", 0xFD50: "arabic",
    0xFDFD: "", 0xFE70: "arabic", 0xFEFF: "", 0xFF21: "latin", 0xFF3B: "", 0xFF41: "latin", 0xFF5B: "", 0xFF66: "kana", 0xFFA0: "hangul", 0xFFE0: "",
    0x10000: "other", 0x1F000: "", 0x20000: "han", 0xE0000: "",
}
#: 0 for marks, whose words go with any script.
SCRIPT_NAMES = ["mark", *sorted(set(SCRIPT_STARTS.values()) - {"", "mark"})]
SCRIPTS = len(SCRIPT_NAMES)
_FIRST = np.array(list(SCRIPT_STARTS), np.int32)
_NO_LETTER = 255
_SCRIPT_OF = np.array([SCRIPT_NAMES.index(x) if x else _NO_LETTER for x in SCRIPT_STARTS.values()], np.uint8)
_ASCII = _SCRIPT_OF[np.searchsorted(_FIRST, np.arange(128), "right") - 1]
SALTS = 64


@functools.cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter, by its Unicode category."""
    return np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _scripts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte the script of its character, and where letters begin. A letter outside all ranges goes with any script."""
    out = _ASCII[data & 127]
    if not len(data) or data.max() < 128:
        return out, out != _NO_LETTER
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    far = lead[data[lead] >= 128]
    padded = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.int32)
    one, two, three, four = (padded[far + k] for k in range(4))
    point = np.where(one < 0xE0, (one & 31) << 6 | two & 63, np.where(one < 0xF0, (one & 15) << 12 | (two & 63) << 6 | three & 63, (one & 7) << 18 | (two & 63) << 12 | (three & 63) << 6 | four & 63))
    script, letter = _SCRIPT_OF[np.searchsorted(_FIRST, point, "right") - 1], _letters()[point]
    script = np.where(letter & (script == _NO_LETTER), 0, script).astype(np.uint8)
    begins = (out != _NO_LETTER) & (data < 128)
    begins[far] = letter
    size = 2 + (one >= 0xE0) + (one >= 0xF0)
    for k in range(4):
        some = (size > k) & (far + k < len(data))
        out[far[some] + k] = script[some]
    return out, begins


#: A group of texts for Viterbi: bytes, so scores of a group stay bounded.
GROUP_BYTES = 12 << 20


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram bins of all letters, where each word's begin among them, words' scripts, each text's first word, and whether it has a letter."""
    low = tb.LOWER[data]
    script, letter = _scripts(low)
    inside = script != _NO_LETTER
    starts, ends, first = tb.spans_of(inside, offsets)
    x = low.astype(np.uint32)
    left, right = np.full(len(x), 32, np.uint32), np.full(len(x), 32, np.uint32)
    left[1:], right[:-1] = x[:-1], x[1:]
    left[starts], right[ends - 1] = 32, 32
    code = ((left << 16) | (x << 8) | right)[inside]
    bins = ((code * np.uint32(2654435761)) >> np.uint32(32 - _BITS)).astype(np.int32)
    at = np.concatenate([[0], np.cumsum(ends - starts)])[:-1]
    scripts = np.maximum.reduceat(script[inside], at) if len(at) else np.zeros(0, np.uint8)
    some = np.diff(np.concatenate([[0], np.cumsum(letter)])[offsets]) > 0
    return bins, at, scripts, first, some


def _count(batches):
    for batch in batches:
        data, offsets = tb.batch_of(batch.column(1))
        langs = np.array(batch.column(0).to_pylist(), object)
        for lang in sorted(set(langs)):
            total = np.zeros(BINS + SCRIPTS, np.int64)
            for i in np.flatnonzero(langs == lang):
                bins, _, scripts, _, _ = _grams(*tb.part(data, offsets, i, i + 1))
                total[:BINS] += np.bincount(bins, minlength=BINS)
                total[BINS:] += np.bincount(scripts, minlength=SCRIPTS)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(used), "bin": pa.array(used, pa.int32()), "n": pa.array(total[used], pa.int64())})


class Model:
    """Log probabilities (bins by languages) and the languages of each script."""

    def __init__(self, langs: list[str], bins: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        smooth = bins + 0.05
        self.scores = np.log(smooth / smooth.sum(axis=0)).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(axis=0), 1)
        self.uses = share >= 0.0005
        self.uses[~self.uses.any(axis=1)] = True
        self.uses[0] = True

    def word_scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bins, at, scripts, first, some = _grams(data, offsets)
        if not len(at):
            return np.zeros((0, len(self.langs)), np.float32), first, some
        out = np.stack([np.add.reduceat(np.ascontiguousarray(self.scores[:, k])[bins], at) for k in range(len(self.langs))], axis=1)
        out[~self.uses[scripts]] = -1e4
        return out, first, some

    def spans(self, scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
        """The language of every word: Viterbi over all texts side by side."""
        n_words = np.diff(first)
        order = np.argsort(-n_words, kind="stable")
        begin, left = first[:-1][order], n_words[order]
        best = np.zeros((len(order), scores.shape[1]), np.float32)
        came = np.empty(scores.shape, np.uint8 if scores.shape[1] < 256 else np.uint16)
        own = np.arange(scores.shape[1], dtype=came.dtype)
        active = np.searchsorted(-left, -np.arange(left[0] if len(left) else 0), "left")  # texts with more than t words
        for t, k in enumerate(active):
            now = best[:k]
            top = now.argmax(axis=1)
            other = np.take_along_axis(now, top[:, None], 1) - np.float32(switch)
            stay = now >= other
            at = begin[:k] + t
            came[at] = np.where(stay, own, top[:, None])
            np.maximum(now, other, out=now)
            now += scores[at]
            now -= now.max(axis=1, keepdims=True)
        label = np.empty(len(scores), came.dtype)
        state = best.argmax(axis=1)
        for t in range(len(active) - 1, -1, -1):
            at = begin[: active[t]] + t
            label[at] = state[: active[t]]
            state[: active[t]] = came[at, state[: active[t]]]
        return label


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, usable: Column, per_lang: int = PER_LANG) -> Model | None:
    """Trigram counts of a bounded sample of the usable rows with a language; None if there are none."""
    named = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    ids = named.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h")).withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(SALTS)))
    for of in (("lang", "salt"), ("lang",)):  # of each part of a language first, so no language has to pass one task as a whole
        ids = ids.withColumn("r", F.row_number().over(Window.partitionBy(*of).orderBy("h", "id"))).where(F.col("r") <= per_lang)
    picked = F.broadcast(ids.select("id").distinct())  # at most per_lang ids for each language
    sample = named.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).join(picked, "id", "left_semi").select("lang", "text").repartition(24)
    counts = sample.mapInArrow(_count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts.lang.unique())
    if not langs:
        return None
    table = np.zeros((BINS + SCRIPTS, len(langs)))
    table[counts["bin"].to_numpy(), counts.lang.map({x: i for i, x in enumerate(langs)}).to_numpy()] = counts.n
    return Model(langs, table[:BINS], table[BINS:])


def _predict(shared, switch: float) -> Callable:
    def run(batches):
        model = shared.value
        for batch in batches:
            data, offsets = tb.batch_of(batch.column(2))
            for lo, hi in tb.runs(offsets, GROUP_BYTES):
                rows = batch.slice(lo, hi - lo)
                names, share = np.full(hi - lo, "und", object), np.zeros(hi - lo)
                if model is not None:
                    scored = [model.word_scores(*tb.part(data, offsets, a + lo, b + lo)) for a, b in tb.runs(offsets[lo : hi + 1] - offsets[lo])]
                    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(f) for _, f, _ in scored]))])
                    label = model.spans(np.concatenate([s for s, _, _ in scored]), first, switch)
                    doc = np.repeat(np.arange(hi - lo), np.diff(first))
                    n = np.bincount(doc * len(model.langs) + label, minlength=(hi - lo) * len(model.langs)).reshape(hi - lo, -1)
                    some = np.concatenate([x for _, _, x in scored])
                    names[some] = np.array(model.langs, object)[n.argmax(axis=1)][some]
                    share[some] = (n.max(axis=1) / np.maximum(n.sum(axis=1), 1))[some]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(names, pa.string()), pa.array(share)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, switch: float = SWITCH) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score. Learns from rows that are not held out."""
    model = learn(docs, id_col, text_col, lang_col, ~F.coalesce(held_out, F.lit(True)), per_lang)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_predict(shared, switch), f"doc_id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("doc_id", id_col)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, F.crc32(F.col("doc_id").cast("string")) % 3 == 1)
