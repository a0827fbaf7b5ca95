"""A quality classifier: a factorisation machine over hashed words, structure statistics and length.

The score is the logistic of ``w0 + sum(w x) + sum over pairs of <v_i, v_j> x_i x_j``. The pairs' sum equals
half of ``sum over factors of (sum v x)**2 - sum (v x)**2``, so a document is scored in time linear in its
features. Trained by minibatch gradient steps of falling size (Adagrad) on a bounded sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, trim
from .features import STATISTICS, extracted, fold, sample

BITS = 16
FACTORS = 8
#: Labelled documents that a model is trained on, at most.
SAMPLE = 12_000
CUT = 0.3


@dataclass
class Machine:
    """``w`` and ``v`` have a row for each bucket and after those one for each statistic."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def inputs(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -6, 6)


def weights_of(doc: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
    """Words weigh as the logarithm of their count, each document's to a unit vector."""
    x = np.log1p(times).astype(np.float32)
    norm = np.sqrt(np.bincount(doc, x * x, n)).astype(np.float32)
    return x / norm[doc]


def _totals(m: Machine, n: int, doc, bucket, x, z):
    """(score before the logistic, sums of v x by document and factor)."""
    gathered = m.v[bucket] * x[:, None]
    zv = m.v[-z.shape[1] :]
    total = z @ zv
    square = (z * z) @ (zv * zv)
    if len(doc):
        has = np.flatnonzero(np.bincount(doc, minlength=n))
        first = np.searchsorted(doc, has)
        total[has] += np.add.reduceat(gathered, first)
        square[has] += np.add.reduceat(gathered * gathered, first)
    linear = m.w0 + np.bincount(doc, m.w[bucket] * x, n) + z @ m.w[-z.shape[1] :]
    return linear + 0.5 * (total * total - square).sum(1), total


def score(m: Machine, stats, doc, bucket, times) -> np.ndarray:
    n = len(stats)
    z = m.inputs(stats)
    s, _ = _totals(m, n, doc, bucket, weights_of(doc, times, n), z)
    return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def train(y: np.ndarray, stats: np.ndarray, cut: np.ndarray, bucket: np.ndarray, times: np.ndarray, bits: int = BITS, factors: int = FACTORS, rounds: int = 6, batch: int = 256, rate: float = 0.08, decay: float = 1e-4, seed: int = 7) -> Machine:
    rng = np.random.default_rng(seed)
    size, k = (1 << bits) + stats.shape[1], stats.shape[1]
    mean = stats.mean(0) if len(stats) else np.zeros(k)
    scale = np.maximum(stats.std(0), 1e-4) if len(stats) else np.ones(k)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
    m = Machine(float(np.log(share / (1 - share))), np.zeros(size, np.float32), (rng.standard_normal((size, factors)) * 0.01).astype(np.float32), mean, scale)
    if not len(y):
        return m
    gw, gv, g0 = np.full(size, 1e-4, np.float32), np.full((size, factors), 1e-4, np.float32), 1e-4
    z_all = m.inputs(stats).astype(np.float32)
    for _ in range(rounds):
        order = rng.permutation(len(y))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            n = len(rows)
            length = cut[rows + 1] - cut[rows]
            doc = np.repeat(np.arange(n), length)
            at = np.repeat(cut[rows] - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
            b, x, z = bucket[at], weights_of(doc, times[at], n), z_all[rows]
            s, total = _totals(m, n, doc, b, x, z)
            e = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y[rows]).astype(np.float32) / n
            used, place = np.unique(b, return_inverse=True)
            stat_rows = np.arange(size - k, size)
            rows_ = np.concatenate((used, stat_rows))
            d = np.concatenate((np.bincount(place, e[doc] * x, len(used)), e @ z)).astype(np.float32) + decay * m.w[rows_]
            dv = np.empty((len(rows_), factors), np.float32)
            for f in range(factors):
                mine = e[doc] * x * (total[doc, f] - m.v[b, f] * x)
                dv[: len(used), f] = np.bincount(place, mine, len(used))
                dv[len(used) :, f] = (e[:, None] * z * (total[:, f : f + 1] - z * m.v[stat_rows, f])).sum(0)
            dv += decay * m.v[rows_]
            gw[rows_] += d * d
            gv[rows_] += dv * dv
            m.w[rows_] -= rate * d / np.sqrt(gw[rows_])
            m.v[rows_] -= 0.3 * rate * dv / np.sqrt(gv[rows_])
            step = float(e.sum())
            g0 += step * step
            m.w0 -= rate * step / g0**0.5
    return m


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> Machine:
    """Train on at most ``most`` labelled documents whose fold is not 0."""
    y, stats, cut, bucket, times = sample(docs, labels, [label], most, BITS, ())
    model = train(y[:, 0] if len(y) else np.zeros(0), stats, cut, bucket, times)
    del y, stats, cut, bucket, times
    trim()
    return model


def scored(docs: DataFrame, model: Machine, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with all its columns and ``out``, the model's score of the whole text; the text alone decides it.

    Only the text goes to Python and only the score comes back.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    bounded_batches(docs.sparkSession)

    @F.arrow_udf(T.DoubleType())
    def of(texts: pa.Array) -> pa.Array:
        parts = [score(sent.value, stats, doc, bucket, times) for _, _, stats, doc, bucket, times in extracted(texts, BITS)]
        return pa.array(np.concatenate(parts).astype(np.float64) if parts else np.zeros(0))

    return docs.withColumn(out, of(F.col(text_col)))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """One row a document: its id, ``held_out``, ``score`` and ``predicted``.

    Null and empty texts are scored as texts without a word; repeated rows and null ids get rows of their own;
    without a usable label every score is 0.5. Columns other than id and text are not read.
    """
    model = fit(docs, labels)
    out = scored(docs.select(id_col, text_col), model, text_col)
    return out.select(id_col, (fold(id_col) == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
