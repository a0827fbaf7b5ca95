"""Toxicity categories by a classifier chain.

The categories, which are columns of the labels, are predicted one after another. Each link is a logistic model
on the presence of hashed words and of hashed word beginnings (which catch inflected forms), on structure
statistics, and on the probabilities of all earlier links. For training, those earlier probabilities are out of
fold: of models that have not seen the document, so that later links meet the same kind of inputs as when they
are used.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, trim
from .features import extracted, fold, sample

BITS = 18
PREFIXES = (4, 5, 6)
#: Labelled documents that a chain is trained on, at most.
SAMPLE = 12_000
FOLDS = 4
#: Buckets a link uses: those that tell its classes apart best.
SELECTED = 1024
CUT = 0.3
#: Columns of the labels in the order of the chain; the last is the one that ``score`` and ``toxic`` tell.
CATEGORIES = ("quality", "toxic")


@dataclass
class Link:
    buckets: np.ndarray
    weights: np.ndarray  # of the buckets
    dense: np.ndarray  # of the statistics and the earlier probabilities
    bias: float


@dataclass
class Chain:
    names: tuple[str, ...]
    links: list[Link]
    mean: np.ndarray
    scale: np.ndarray

    def inputs(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -6, 6)


def telling(y: np.ndarray, doc: np.ndarray, bucket: np.ndarray, most: int, bits: int = BITS) -> np.ndarray:
    """The buckets with the largest difference of presence between the classes, in standard errors."""
    seen = np.bincount(bucket, minlength=1 << bits)
    yes = np.bincount(bucket, y[doc], 1 << bits)
    n, p = len(y), max(y.mean(), 1e-9)
    z = (yes - seen * p) / np.sqrt(np.maximum(seen, 1) * p * (1 - p) * (1 - seen / (n + 1)) + 1)
    z[seen < 4] = 0
    best = np.argsort(-np.abs(z), kind="stable")[:most]
    return best[np.abs(z[best]) > 3]


def train_link(y: np.ndarray, doc: np.ndarray, bucket: np.ndarray, dense: np.ndarray, decay: float = 2e-4, rounds: int = 150) -> Link:
    """Full-batch Adam on the mean logistic loss plus half ``decay`` times the squared weights."""
    n = len(y)
    if not n or y.min() == y.max():
        return Link(np.zeros(0, np.int64), np.zeros(0), np.zeros(dense.shape[1]), 8.0 if n and y.min() > 0 else -8.0)
    used = np.sort(telling(y, doc, bucket, SELECTED))
    place = np.full(1 << BITS, -1)
    place[used] = np.arange(len(used))
    at = place[bucket]
    doc, at = doc[at >= 0], at[at >= 0]
    k = len(used)
    w = np.zeros(k + dense.shape[1] + 1)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    m, s = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        logit = np.bincount(doc, w[at], n) + dense @ w[k:-1] + w[-1]
        e = (logistic(logit) - y) / n
        g = np.concatenate((np.bincount(at, e[doc], k), e @ dense, [e.sum()]))
        g[:-1] += decay * w[:-1]
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    return Link(used, w[:k], w[k:-1], float(w[-1]))


def logits(link: Link, doc: np.ndarray, bucket: np.ndarray, dense: np.ndarray) -> np.ndarray:
    place = np.full(1 << BITS, -1)
    place[link.buckets] = np.arange(len(link.buckets))
    at = place[bucket]
    hit = at >= 0
    return np.bincount(doc[hit], link.weights[at[hit]], len(dense)) + dense @ link.dense + link.bias


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train_chain(names: tuple[str, ...], y: np.ndarray, stats: np.ndarray, cut: np.ndarray, bucket: np.ndarray, folds: int = FOLDS) -> Chain:
    """One link for each column of ``y``; rows are in an order of their own, so folds go by place."""
    n, k = len(y), stats.shape[1]
    chain = Chain(names, [], stats.mean(0) if n else np.zeros(k), np.maximum(stats.std(0), 1e-4) if n else np.ones(k))
    doc = np.repeat(np.arange(n), np.diff(cut))
    dense = chain.inputs(stats).astype(float)
    part = np.arange(n) % folds
    for c in range(len(names)):
        chain.links.append(train_link(y[:, c], doc, bucket, dense))
        outside = np.zeros(n)
        for f in range(folds if c + 1 < len(names) else 0):
            mine = part != f
            new = np.cumsum(mine) - 1
            keep = mine[doc]
            link = train_link(y[mine, c], new[doc[keep]], bucket[keep], dense[mine])
            outside[~mine] = logistic(logits(link, doc, bucket, dense))[~mine]
        dense = np.column_stack((dense, outside))
    return chain


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, categories: tuple[str, ...] = CATEGORIES) -> Chain:
    """A chain over ``categories`` on at most ``most`` labelled documents whose fold is not 0."""
    y, stats, cut, bucket, _ = sample(docs, labels, list(categories), most, BITS, PREFIXES)
    chain = train_chain(categories, y, stats, cut, bucket)
    del y, stats, cut, bucket
    trim()
    return chain


def chained(chain: Chain, stats: np.ndarray, doc: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Probabilities, a column a category."""
    dense, out = chain.inputs(stats).astype(float), []
    for link in chain.links:
        out.append(logistic(logits(link, doc, bucket, dense)))
        dense = np.column_stack((dense, out[-1]))
    return np.stack(out, 1)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: Chain | None = None, cut: float = CUT) -> DataFrame:
    """One row a document: its id, ``held_out``, a probability ``p_<category>`` each, ``score`` and ``toxic``.

    ``score`` is that of the last category, and ``toxic`` whether it reaches ``cut``. Whole texts are read,
    null and empty ones as texts without a word; repeated rows and null ids get rows of their own; without a
    usable label no document is toxic. Columns other than id and text are not read.
    """
    chain = chain or fit(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    bounded_batches(docs.sparkSession)
    names = [f"p_{c}" for c in chain.names]

    def run(batches):
        for b in batches:
            for at, end, stats, doc, bucket, _ in extracted(b.column(1), BITS, PREFIXES):
                p = chained(sent.value, stats, doc, bucket)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, end - at), *(pa.array(x) for x in p.T)], [id_col, *names])

    kind = dict(docs.dtypes)[id_col]
    out = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{n} double" for n in names))
    return out.select(id_col, (fold(id_col) == 0).alias("held_out"), *names, F.col(names[-1]).alias("score"), (F.col(names[-1]) >= cut).alias("toxic"))
