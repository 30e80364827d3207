"""Toxicity by a classifier chain.

The label columns form a chain; the category of a later one is predicted from the words and from the probabilities of the
earlier ones. What a later model is trained on comes from out-of-fold predictions, so it meets earlier probabilities as
unsure in training as in use. The models are logistic and linear in log counts of words and word beginnings, which also
catch compounds; each fold selects its own features by the difference of their means between the classes.

Training uses a bounded sample: the ``sample`` labelled documents whose ids hash lowest. Scoring reads every document once,
without a shuffle.

Defined results: a null or empty text has the probability of a text without any known word; without labelled documents of
both classes a category's probability is the share of its positives (0 without any); repeated rows give repeated results;
rows of ``labels`` with a null id or label are left out, of a document labelled more than once each category's largest label
counts, of labelled rows of one id the smallest text; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import textbytes as tb
from skein.llm.langid import LETTERS

SAMPLE, FOLDS, FEATURES, RIDGE, THRESHOLD = 6000, 5, 400, 0.3, 0.5
_BITS = 20
#: Bytes of word beginnings; 0 is the whole word.
BEGINNINGS = (0, 5, 6, 7, 8)
CHAIN = ("low_quality", "toxic")


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and feature numbers, one pair for each word and beginning."""
    low = tb.LOWER[data]
    starts, ends, first = tb.words(low, offsets, LETTERS)
    spans, doc = tb.Spans(low), np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    docs, features = [], []
    for n in BEGINNINGS:
        some = slice(None) if n == 0 else np.flatnonzero(ends - starts > n)
        s = starts[some]
        features.append((spans.hash(s, s + n if n else ends, seed=n) >> np.uint64(64 - _BITS)).astype(np.int64))
        docs.append(doc[some])
    return np.concatenate(docs), np.concatenate(features)


def _counts(docs: np.ndarray, features: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    both, n = np.unique(docs * width + features, return_counts=True)
    return both // width, both % width, n


def _sample(batches):
    for batch in batches:
        data, offsets = tb.batch_of(batch.column(0))
        for lo, hi in tb.runs(offsets):
            doc, feature, n = _counts(*_features(*tb.part(data, offsets, lo, hi)), 1 << _BITS)
            ends = pa.array(np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (feature, n)]
            rows = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([*lists, *rows.columns[1:]], ["features", "counts", *rows.schema.names[1:]])


class Linear:
    """A logistic model over selected features and extra columns."""

    def __init__(self, chosen: np.ndarray, weights: np.ndarray, base: float):
        self.chosen, self.weights, self.base = chosen, weights, base

    def of(self, table: np.ndarray, extra: np.ndarray) -> np.ndarray:
        x = np.hstack([table, extra])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.base, -30, 30)))


#: Entries of a sample that are worked on at once.
ENTRIES = 1 << 19


class Sample:
    """Sparse log counts of the training documents, as features (32-bit) and values by document."""

    def __init__(self, ends: np.ndarray, features: np.ndarray, values: np.ndarray):
        self.ends, self.features, self.values = ends, features, values
        self.n = len(ends) - 1

    def parts(self):
        """(rows, features, values) of runs of documents."""
        lo = 0
        while lo < self.n:
            hi = max(lo + 1, int(np.searchsorted(self.ends, self.ends[lo] + ENTRIES, "right")) - 1)
            some = slice(self.ends[lo], self.ends[hi])
            yield np.repeat(np.arange(lo, hi), np.diff(self.ends[lo : hi + 1])), self.features[some], self.values[some]
            lo = hi

    def select(self, some: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
        """The features whose mean log counts differ most between the classes, in standard errors."""
        width, n1 = 1 << _BITS, max(1, int(y[some].sum()))
        n0 = max(1, int(some.sum()) - n1)
        s1, s0, squares = np.zeros(width), np.zeros(width), np.zeros(width)
        for rows, features, values in self.parts():
            use = some[rows]
            f, v, positive = features[use], values[use].astype(float), y[rows[use]] > 0
            s1 += np.bincount(f[positive], v[positive], width)
            s0 += np.bincount(f[~positive], v[~positive], width)
            squares += np.bincount(f, v * v, width)
        spread = squares / (n0 + n1) - ((s0 + s1) / (n0 + n1)) ** 2 + 1e-3
        z = np.abs(s1 / n1 - s0 / n0) / np.sqrt(spread * (1 / n1 + 1 / n0))
        best = np.argsort(-z, kind="stable")[:most]
        return np.sort(best[z[best] > 3])

    def table(self, chosen: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, len(chosen)))
        for rows, features, values in self.parts() if len(chosen) else ():
            at = np.searchsorted(chosen, features)
            hit = (at < len(chosen)) & (chosen[np.minimum(at, len(chosen) - 1)] == features)
            out[rows[hit], at[hit]] = values[hit]
        return out


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(sample: Sample, some: np.ndarray, y: np.ndarray, extra: np.ndarray) -> Linear:
    """Newton's method with a ridge; without both classes a constant."""
    n1, n = y[some].sum(), max(1, some.sum())
    if n1 in (0, n):
        return Linear(np.zeros(0, np.int64), np.zeros(extra.shape[1]), float(_logit(np.array(n1 / n))))
    chosen = sample.select(some, y, FEATURES)
    x = np.hstack([sample.table(chosen), extra])[some]
    x1, t = np.hstack([x, np.ones((len(x), 1))]), y[some]
    w, ridge = np.zeros(x1.shape[1]), np.full(x1.shape[1], RIDGE)
    ridge[-1] = 1e-6
    w[-1] = _logit(np.array(n1 / n))
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(ridge), x1.T @ (p - t) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return Linear(chosen, w[:-1], float(w[-1]))


def fit_chain(sample: Sample, labels: np.ndarray, fold: np.ndarray) -> list[Linear]:
    """labels: documents by categories, in chain order. Later models see earlier out-of-fold logits."""
    models, extra = [], np.zeros((sample.n, 0))
    for k in range(labels.shape[1]):
        y, out = labels[:, k].astype(float), np.zeros(sample.n)
        if k + 1 < labels.shape[1]:
            for f in range(FOLDS):
                test = fold == f
                model = fit(sample, ~test, y, extra)
                out[test] = model.of(sample.table(model.chosen), extra)[test]
        models.append(fit(sample, np.ones(sample.n, bool), y, extra))
        extra = np.hstack([extra, _logit(out)[:, None]])
    return models


class _Chain:
    """The models with one table of all features that they use."""

    def __init__(self, models: list[Linear]):
        self.models = models
        self.union = np.unique(np.concatenate([m.chosen for m in models]).astype(np.int64))
        self.wanted = np.full(1 << _BITS, -1, np.int32)
        self.wanted[self.union] = np.arange(len(self.union))

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """Texts by categories."""
        data, offsets = tb.batch_of(texts)
        parts = [self._run(*tb.part(data, offsets, lo, hi)) for lo, hi in tb.runs(offsets)]
        return np.concatenate([np.zeros((0, len(self.models))), *parts])

    def _run(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        doc, feature = _features(data, offsets)
        at = self.wanted[feature]
        hit = at >= 0
        table, logits = np.zeros((len(offsets) - 1, len(self.union))), np.zeros((len(offsets) - 1, 0))
        doc, at, n = _counts(doc[hit], at[hit].astype(np.int64), max(1, len(self.union)))
        table[doc, at] = np.log1p(n)
        out = np.zeros((len(table), len(self.models)))
        for k, m in enumerate(self.models):
            out[:, k] = m.of(table[:, np.searchsorted(self.union, m.chosen)], logits)
            logits = np.hstack([logits, _logit(out[:, k])[:, None]])
        return out


def _score(shared, categories: tuple[str, ...]) -> Callable:
    def run(batches):
        chain = _Chain(shared.value)
        for batch in batches:
            p = chain.probabilities(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, k]) for k in range(p.shape[1]))], ["doc_id", *(f"p_{c}" for c in categories)])

    return run


def _reject(shared, text_col: str, threshold: float) -> Callable:
    def run(batches):
        chain = _Chain(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(chain.probabilities(batch.column(text_col))[:, -1] < threshold))

    return run


def _fitted(categories: tuple[str, ...]) -> Callable:
    def run(batches):
        sizes, features, values, labels = [], [], [], []
        for batch in batches:  # at most the sample, as four bytes for each feature and value
            f, n = batch.column("features"), batch.column("counts")
            sizes.append(f.value_lengths().to_numpy(zero_copy_only=False))
            features.append(f.flatten().to_numpy().astype(np.int32))
            values.append(np.log1p(n.flatten().to_numpy()).astype(np.float32))
            labels.append(np.stack([batch.column(c).to_numpy() for c in categories], axis=1))
        if not labels:
            return
        y = np.concatenate(labels)
        sample = Sample(np.cumsum(np.concatenate([[0], *sizes])).astype(np.int64), np.concatenate(features), np.concatenate(values))
        yield pa.RecordBatch.from_pydict({"models": [pickle.dumps(fit_chain(sample, y, np.arange(len(y)) % FOLDS))]})

    return run


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> list[Linear]:
    """labels: the id and a 0/1 column of each category, in chain order. One task fits the chain on the sample; the driver gets the models."""
    full = labels.select(id_col, *categories).dropna().groupBy(id_col).agg(*(F.max(c).cast("int").alias(c) for c in categories))
    picked = full.orderBy(F.xxhash64(id_col), id_col).limit(sample)  # at most ``sample`` rows, so small enough to broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked.withColumnRenamed(id_col, "id")), "id")
    rows = rows.groupBy("id", *categories).agg(F.min("text").alias("text"))
    schema = "features array<int>, counts array<int>, id string, " + ", ".join(f"{c} int" for c in categories)
    table = rows.select("text", F.col("id").cast("string").alias("id"), *categories).mapInArrow(_sample, schema)
    fitted = table.repartition(1).sortWithinPartitions("id").mapInArrow(_fitted(categories), "models binary").collect()  # one row, or none without a sample
    if not fitted:
        none = np.zeros(0, np.int32)
        return fit_chain(Sample(np.zeros(1, np.int64), none, none.astype(np.float32)), np.zeros((0, len(categories))), none)
    return pickle.loads(fitted[0]["models"])


def score_toxicity(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """One row per input row: id, a probability per category, and kept unless the last category's reaches the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, categories, id_col, text_col, sample))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"p_{c} double" for c in categories)
    scored = rows.mapInArrow(_score(shared, categories), schema).withColumn("kept", F.col(f"p_{categories[-1]}") < threshold)
    return scored.withColumnRenamed("doc_id", id_col)


def reject_toxic(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, all columns, whose last category's probability is below the threshold; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, categories, id_col, text_col, sample))
    return docs.mapInArrow(_reject(shared, text_col, threshold), docs.schema)


def chain_labels(labels: DataFrame) -> DataFrame:
    """The two label columns of ``labels`` as a chain: low quality, then toxic."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_toxicity(docs, chain_labels(labels), CHAIN)
