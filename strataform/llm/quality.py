"""Quality classifier by positive-unlabelled learning.

A linear model on statistics of the text and on its hashed words minimises the non-negative unbiased risk
    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])
with logistic loss, over trusted positives P and unlabelled documents U. The prior is the share of label 1 among all
training labels where they hold both labels, else what a probe that tells P from U gives (its mean score over U by that
over P). Centre and scale of the features come
from all documents; fitting takes bounded samples of P and U, chosen by hash; U
are labelled rows whatever their label where both labels occur, as the prior is a share of these, else any documents. The
scores cover every whole text.

Null text counts as empty, a text of any length as a whole. Documents whose ids repeat are scored each by itself, and one of
them is learned from; labels that repeat count once, and those that disagree about one id as label 0; null labels don't
count. Without documents there are no rows, without labels nothing is rejected. Other columns than those named are ignored."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, small_batches, text_buffer
from .textvec import Words

#: Most documents of each kind that a fit looks at.
MAX_POSITIVES, MAX_UNLABELLED = 6_000, 12_000
_PUNCT = np.frombuffer(bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum()), np.uint8)
_GROUPS = np.full(256, 5, np.int64)  # 0 lower, 1 upper, 2 digit, 3 blank, 4 line end, 5 control, 6 beyond ASCII, 7.. each punctuation mark
_GROUPS[97:123], _GROUPS[65:91], _GROUPS[48:58], _GROUPS[32], _GROUPS[9], _GROUPS[10], _GROUPS[128:] = 0, 1, 2, 3, 3, 4, 6
_GROUPS[_PUNCT] = 7 + np.arange(len(_PUNCT))
_N_GROUPS = 7 + len(_PUNCT)
N_STATS = _N_GROUPS + 8
#: Buckets that words are hashed into, and how much their shares weigh against the statistics.
WORD_BUCKETS, WORD_WEIGHT = 1024, 4.0
N_FEATURES, _N_INPUTS = N_STATS + WORD_BUCKETS, 3 * N_STATS + WORD_BUCKETS


def statistics(words: Words, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row for each text: square roots of the densities of kinds of bytes, and word statistics."""
    n, size = len(offsets) - 1, np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    kinds = np.bincount(doc * _N_GROUPS + _GROUPS[data], minlength=n * _N_GROUPS).reshape(n, _N_GROUPS).astype(np.float64)
    count = np.diff(words.first).astype(np.float64)
    some, per = np.maximum(count, 1), np.maximum(size, 1)
    repeats = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1]) if len(words.doc) else np.zeros(0, bool)
    again = np.bincount(words.doc[1:][repeats], minlength=n) / some if len(repeats) else np.zeros(n)
    keys = np.unique((words.doc.astype(np.uint64) << np.uint64(40)) | (words.hash >> np.uint64(24)))
    distinct = np.bincount((keys >> np.uint64(40)).astype(np.int64), minlength=n) / some
    long = np.bincount(words.doc[words.end - words.start > 12], minlength=n) / some
    letters = np.maximum(kinds[:, 0] + kinds[:, 1], 1)
    marks = kinds[:, 7:]
    out = np.empty((n, N_STATS), np.float32)
    out[:, :_N_GROUPS] = np.sqrt(kinds / per[:, None])
    out[:, _N_GROUPS:] = np.stack([np.log1p(count) / 10, again, distinct, size / some / 10, long, kinds[:, 1] / letters, np.log1p(marks.sum(1) / some), np.log1p(count / (kinds[:, 4] + 1)) / 5], axis=1)
    return out


def word_shares(words: Words) -> np.ndarray:
    """A row for each text: square roots of the shares of its words in each bucket. It has length 1 (0 without words), so it is
    centred but not scaled; half precision is what travels."""
    n = len(words.first) - 1
    out = np.empty((n, WORD_BUCKETS), np.float16)
    for a in range(0, n, 1000):
        b = min(n, a + 1000)
        own = slice(words.first[a], words.first[b])
        at = (words.doc[own] - a) * WORD_BUCKETS + (words.hash[own] >> np.uint64(32)).astype(np.int64) % WORD_BUCKETS
        counts = np.bincount(at, minlength=(b - a) * WORD_BUCKETS).reshape(b - a, WORD_BUCKETS)
        out[a:b] = np.sqrt(counts / np.maximum(np.diff(words.first[a : b + 1]), 1)[:, None])
    return out


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The statistics and then the word shares of each text."""
    words = Words(data, offsets)
    return np.concatenate([statistics(words, data, offsets), word_shares(words)], axis=1, dtype=np.float32)


@dataclass
class Model:
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def inputs(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), _N_INPUTS), np.float32)
        for a in range(0, len(x), 1000):
            part = x[a : a + 1000]
            z = np.clip((part[:, :N_STATS] - self.center[:N_STATS]) / self.scale[:N_STATS], -4, 4)
            out[a : a + 1000] = np.concatenate([z, np.maximum(z - 1, 0), np.maximum(-1 - z, 0), WORD_WEIGHT * (part[:, N_STATS:] - self.center[N_STATS:])], axis=1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Each row summed by itself, so that equal texts get equal scores wherever they are."""
        sums = [(self.inputs(x[a : a + 1000]) * self.weights).sum(1) for a in range(0, len(x), 1000)]
        return 1 / (1 + np.exp(-np.clip(np.concatenate([*sums, np.zeros(0)]) + self.bias, -30, 30)))


def _descend(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int, decay: float = 1e-3, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk; where the bracket is negative, only that is undone."""
    w = np.zeros(xp.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        own = w[:-1].astype(xp.dtype)
        fp, fu = xp @ own + xp.dtype.type(w[-1]), xu @ own + xu.dtype.type(w[-1])
        gp_pos, gp_neg, gu_neg = sig(fp) - 1, sig(fp), sig(fu)  # d loss / d f for labels +, -, -
        rest = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        bracket = lambda: (np.append(xu.T @ gu_neg, gu_neg.sum()) / len(xu) - prior * np.append(xp.T @ gp_neg, gp_neg.sum()) / len(xp))
        g = -bracket() if rest < 0 else prior * np.append(xp.T @ gp_pos, gp_pos.sum()) / len(xp) + bracket()
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(positives: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int = 400, moments: tuple[np.ndarray, np.ndarray] | None = None) -> Model:
    """The model for features of both samples, with the moments of all documents or else of the samples; no positives: a
    model that rejects nothing."""
    if not len(positives) or not len(unlabelled):
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(_N_INPUTS), 1.0, 1.0)
    if moments is None:
        both = np.concatenate([positives, unlabelled]).astype(np.float64)
        moments = both.mean(0), both.std(0)
    center, scale = moments
    model = Model(center, np.maximum(scale, 1e-3), np.zeros(_N_INPUTS), 0.0, prior or 1.0)
    xp, xu = model.inputs(positives), model.inputs(unlabelled)
    if prior is None:
        w, b = _descend(xp, xu, 0.5, steps // 2)
        told = lambda x: (1 / (1 + np.exp(-(x @ w + b)))).mean()
        model.prior = float(np.clip(told(xu) / max(told(xp), 1e-9), 0.05, 0.99))
    model.weights, model.bias = _descend(xp, xu, model.prior, steps)
    return model


def held_out(id_column: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; false for null."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _collect_features(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and _kind, one row for each _id and _kind of docs, of which there must be a bounded number: of rows that repeat
    an id the text with the least hash counts. It is picked before the shuffle, so a very common id is a row from each task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            x = features(*text_buffer(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_id", "_kind", "_h")), pa.array([r[:N_STATS].tobytes() + r[N_STATS:].astype(np.float16).tobytes() for r in x], pa.binary())], names=["_id", "_kind", "_h", "x"])

    kind = docs.schema["_id"].dataType.simpleString()
    rows = docs.select("_id", "_kind", F.xxhash64("text").alias("_h"), "text").mapInArrow(run, f"_id {kind}, _kind int, _h long, x binary")
    rows = rows.groupBy("_id", "_kind").agg(F.min(F.struct("_h", "x")).alias("m")).select("_kind", "m.x").collect()
    x = np.empty((len(rows), N_FEATURES), np.float32)
    for own, r in zip(x, rows):
        own[:N_STATS], own[N_STATS:] = np.frombuffer(r.x, np.float32, N_STATS), np.frombuffer(r.x, np.float16, offset=4 * N_STATS)
    return x, np.array([r._kind for r in rows], np.int64)


def feature_moments(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each feature over all rows, rounded so that no order of summing shows; a task sends one row
    for each feature."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, square = 0, np.zeros(N_FEATURES), np.zeros(N_FEATURES)
        for batch in small_batches(batches, "text"):
            every = features(*text_buffer(batch.column("text")))
            for x in (every[a : a + 1000].astype(np.float64) for a in range(0, len(every), 1000)):
                step, own = x.mean(0) - mean, n + len(x)
                square += ((x - x.mean(0)) ** 2).sum(0) + step**2 * (n * len(x) / own)
                mean, n = mean + step * (len(x) / own), own
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(N_FEATURES), pa.int32()), pa.array([n] * N_FEATURES, pa.int64()), pa.array(mean), pa.array(square)], names=["i", "n", "mean", "square"])

    parts = docs.select("text").mapInArrow(run, "i int, n long, mean double, square double")
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("s"), F.sum(F.col("square") + F.col("n") * F.col("mean") ** 2).alias("q")).orderBy("i").collect()
    n, s, q = (np.array([r[k] for r in rows], np.float64) for k in ("n", "s", "q"))
    rounded = lambda x: x.astype(np.float32).astype(np.float64)
    return rounded(s / n), rounded(np.sqrt(np.maximum(q / n - (s / n) ** 2, 0)))


def train(docs: DataFrame, labels: DataFrame, allowed: Callable[[Column], Column] | None = None, max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality") -> Model:
    """A model from the labels whose ids allowed() takes (all by default) and the documents' texts."""
    own = labels.select(F.col(label_id).alias("_id"), F.col(label_col).alias("_label")).where("_id is not null and _label is not null")
    if allowed is not None:
        own = own.where(allowed(F.col("_id")))
    own = own.groupBy("_id").agg(F.min("_label").alias("_label"))
    total, good = own.agg(F.count(F.lit(1)), F.sum(F.when(F.col("_label") == 1, 1).otherwise(0))).first()
    prior = good / total if total and 0 < good < total else None
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    order = F.xxhash64("_id")
    sample_p = own.where("_label = 1").orderBy(order, "_id").limit(max_positives).select("_id", F.lit(1).alias("_kind"))
    # the prior is a share of labelled rows, so where it is known the sample is of these, whatever their labels
    ids = own if prior is not None else texts.where("_id is not null")
    sample_u = ids.select("_id").distinct().orderBy(F.xxhash64("_id", F.lit(1)), "_id").limit(max_unlabelled).select("_id", F.lit(0).alias("_kind"))
    # at most max_positives + max_unlabelled ids are broadcast
    chosen = cut_lineage(sample_p.unionByName(sample_u))
    x, kind = _collect_features(texts.join(F.broadcast(chosen), "_id"))
    order = np.lexsort((*x.T, kind)) if len(x) else np.zeros(0, np.int64)  # any order of rows gives one model
    p, u = (x[order[kind[order] == k]] for k in (1, 0))
    some = len(p) and len(u)
    del x  # samples of bounded size, but the driver holds them once
    return fit(p, u, prior, moments=feature_moments(texts) if some else None)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            s = model.score(features(*text_buffer(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
