"""Text quality by logistic regression over hashed word n-grams.

Words are runs of letters, digits and characters beyond ASCII, and runs of other signs. Features are words and pairs of
neighbours in two readings, as they are written (in lower case) and by their form: lower case, capital first, more
capitals, or the signs themselves; a word that repeats the one before makes one pair for all words. Features are hashed to
2 ** ``BITS`` places; a text's value of a feature is its share of the text's n-grams times ``SCALE``.

The weights come from updates that follow the regularised leader, coordinate by coordinate, one document at a time, in one
task. They see a bounded sample: of the labelled documents that may be learnt from, the ``sample`` whose ids hash lowest, as often as ``passes``
says. A score is a sparse dot product: a mean of weights over a text's n-grams; documents are scored where they are read,
without a shuffle, and a long text in pieces that end between words.

Defined results: a null or empty text, or one of spaces only, scores what the constant says; without labels of both kinds
that is the share of positive ones, one half without any; labels with a null id or null label are left out, of a document
labelled more than once the largest label counts, of labelled rows of one id the smallest text; repeated rows give repeated results;
a null id is not held out and not learnt from; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import textbytes as tb

BITS, SCALE, THRESHOLD = 18, 4.0, 0.3
SAMPLE, PASSES = 6000, 4
#: Step size, smoothing, and the weights of the absolute and the squared penalty.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.05, 0.1

_KIND = np.full(256, 2, np.uint8)  # 0 space, 1 word, 2 sign
_KIND[~tb.SPACED] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_REPEAT = np.uint64(0x5BD1E995)


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, data, offsets) of runs of texts; a long text comes in pieces that end at spaces."""
    for lo, hi in tb.runs(offsets):
        begin, end = int(offsets[lo]), int(offsets[hi])
        if hi - lo > 1 or end - begin <= tb.RUN_BYTES:
            yield lo, data[begin:end], offsets[lo : hi + 1] - begin
            continue
        while begin < end:
            cut = begin + tb.RUN_BYTES
            while cut < end and _KIND[data[cut]]:
                space = np.flatnonzero(_KIND[data[cut : cut + tb.RUN_BYTES]] == 0)
                cut += int(space[0]) if len(space) else tb.RUN_BYTES
            cut = min(cut, end)
            yield lo, data[begin:cut], np.array([0, cut - begin])
            begin = cut


def _grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text numbers and feature numbers of every n-gram, some texts at a time."""
    text, last = -1, None
    for first, piece, ends_of in _pieces(data, offsets):
        kind = _KIND[piece]
        edge = np.zeros(len(piece) + 1, bool)
        edge[ends_of] = True
        turn = np.concatenate([[True], kind[1:] != kind[:-1], [True]]) if len(kind) else np.ones(1, bool)
        inside = kind > 0
        starts = np.flatnonzero(inside & (turn[:-1] | edge[:-1]))
        ends = np.flatnonzero(inside & (turn[1:] | edge[1:])) + 1
        doc = first + np.searchsorted(ends_of, starts, "right") - 1
        word = tb.Spans(tb.LOWER[piece]).hash(starts, ends, seed=1)
        capitals = np.concatenate([[0], np.cumsum(_CAPITAL[piece])])
        n = capitals[ends] - capitals[starts]
        form = np.where(n == 0, 1, np.where((n == 1) & _CAPITAL[piece[starts]], 2, 3)).astype(np.uint64)
        form = np.where(kind[starts] == 2, word, form)
        features = [(doc, tb.mix(word, 2)), (doc, tb.mix(form, 3))]
        if last is not None and first == text:  # the pair across a cut
            doc, word, form = (np.concatenate([[old], new]).astype(new.dtype) for old, new in zip(last, (doc, word, form), strict=True))
        pair = doc[1:] == doc[:-1]
        same = np.where(word[1:] == word[:-1], _REPEAT, tb.mix(word[:-1], 4) + word[1:])
        features += [(doc[1:][pair], tb.mix(same[pair], 5)), (doc[1:][pair], tb.mix((tb.mix(form[:-1], 6) + form[1:])[pair], 7))]
        text, last = (int(doc[-1]), (doc[-1], word[-1], form[-1])) if len(doc) else (text, last)
        for which, hashed in features:
            yield which, (hashed >> np.uint64(64 - BITS)).astype(np.int64)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, place, label) to (place, label, features, values)."""
    for batch in batches:
        for row in range(batch.num_rows):
            found = [f for _, f in _grams(*tb.batch_of(batch.column(0).slice(row, 1)))]
            feature, n = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
            value = n * (SCALE / max(1, n.sum()))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(feature)], pa.int32()), x) for x in (pa.array(feature.astype(np.int32)), pa.array(value.astype(np.float32)))]
            yield pa.RecordBatch.from_arrays([*batch.slice(row, 1).columns[1:], *lists], ["place", "label", "features", "values"])


class Leader:
    """Weights by following the regularised leader; the last place is the constant."""

    def __init__(self):
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, some) -> np.ndarray:
        z = self.z[some]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(self.n[some])) / ALPHA + L2))

    def learn(self, features: np.ndarray, values: np.ndarray, label: float) -> None:
        some, x = np.append(features, 1 << BITS), np.append(values, 1.0)
        w = self.weights(some)
        slope = (logistic(w @ x) - label) * x
        now = self.n[some]
        self.n[some] = now + slope * slope
        self.z[some] += slope - (np.sqrt(self.n[some]) - np.sqrt(now)) / ALPHA * w


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _learnt(passes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in _rows(batch)]
        labels = np.array([y for _, _, y in rows], float)
        leader = Leader()
        if len(set(labels)) < 2:
            share = np.clip(labels.mean() if len(labels) else 0.5, 1e-6, 1 - 1e-6)
            yield pa.RecordBatch.from_arrays([pa.array([1 << BITS]), pa.array([float(np.log(share / (1 - share)))])], ["place", "weight"])
            return
        for _ in range(passes):
            for features, values, y in rows:
                leader.learn(features, values, y)
        w = leader.weights(slice(None))
        used = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(w[used])], ["place", "weight"])

    return run


def _rows(batch: pa.RecordBatch):
    for i in range(batch.num_rows):
        f, v = (batch.column(c).slice(i, 1).flatten() for c in ("features", "values"))
        yield f.to_numpy(), v.to_numpy(), float(batch.column("label")[i].as_py())


def train(docs: DataFrame, labels: DataFrame, held_out: Callable[[Column], Column], label: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, passes: int = PASSES) -> np.ndarray:
    """Weights by feature, the constant last. held_out: whether an id is; such rows are not learnt from."""
    named = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).dropna().where(~held_out(F.col("id")))
    picked = named.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), "id")  # ``sample`` rows at most
    texts = texts.groupBy("id", "label").agg(F.min("text").alias("text"))
    rows = texts.select("text", F.xxhash64("id").alias("place"), "label").mapInArrow(_featured, "place long, label int, features array<int>, values array<float>")
    found = rows.repartition(1).sortWithinPartitions("place").mapInArrow(_learnt(passes), "place long, weight double").toArrow()
    weights = np.zeros((1 << BITS) + 1)
    weights[found["place"].to_numpy()] = found["weight"].to_numpy()
    return weights


def _scores(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            n = batch.num_rows
            total, count = np.zeros(n), np.zeros(n)
            for doc, feature in _grams(*tb.batch_of(batch.column(2))):
                total += np.bincount(doc, weights[feature], n)
                count += np.bincount(doc, minlength=n)
            score = logistic(total * (SCALE / np.maximum(count, 1)) + weights[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["id", "held_out", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, held_out: Callable[[Column], Column], label: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sample: int = SAMPLE, passes: int = PASSES) -> DataFrame:
    """One row per input row: id, held_out, score, predicted. held_out: whether an id is; such rows are not learnt from."""
    weights = train(docs, labels, held_out, label, id_col, text_col, sample, passes)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(_scores(shared), f"id {rows.schema['id'].dataType.simpleString()}, held_out boolean, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_quality(docs, labels, lambda id_: F.crc32(id_.cast("string")) % 5 == 0)
