"""Hashed words and structure statistics of whole texts, and bounded samples of labelled ones.

The metadata that the text itself decides, its bytes, characters, words and lines, are statistics too. Ids,
languages, sources and stored counts never are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import bounded_batches, text_of
from .mixing import fixed_hash

STATISTICS = ("bytes", "characters", "words", "word length", "distinct", "top word", "doubled", "upper", "digits", "marks", "odd marks", "lines")
_UPPER, _DIGIT, _ODD, _LINE = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_ODD[[ord(c) for c in "!#$%&*+<=>@[]^_`{|}~\\/"]] = True
_LINE[10] = True


def _sums(marked: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(marked, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def extracted(column: pa.Array, bits: int, prefixes: tuple[int, ...] = ()):
    """For parts of a text column: (from, to, statistics, document and bucket and count of each distinct word feature)."""
    for at, end, data, offsets in words.slices(column):
        n = end - at
        h, doc, start, stop, *heads = words.words(data, offsets, words.MARKS, prefixes)
        size, count = np.diff(offsets), np.bincount(doc, minlength=n)
        key = (doc.astype(np.int64) << bits) | (h >> np.uint64(64 - bits)).astype(np.int64)
        key, times = np.unique(key, return_counts=True)
        owner = key >> bits
        top = np.zeros(n, np.int64)
        np.maximum.at(top, owner, times)
        doubled = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=n)
        some, chars = np.maximum(count, 1), np.maximum(size, 1)
        odd = _sums(_ODD[data], offsets)
        stats = np.stack([
            np.log1p(size), np.log1p(_sums((data & 0xC0) != 0x80, offsets)), np.log1p(count), np.bincount(doc, stop - start, n) / some / 8, np.bincount(owner, minlength=n) / some, top / some, doubled / some,
            _sums(_UPPER[data], offsets) / chars, _sums(_DIGIT[data], offsets) / chars, _sums(words.MARKS[data], offsets) / chars, odd / chars, _sums(_LINE[data], offsets) / some,
        ], 1).astype(np.float32)
        if heads:
            more = [((doc.astype(np.int64) << bits) | (x >> np.uint64(64 - bits)).astype(np.int64))[x > 0] for x in heads[0]]
            more = np.unique(np.concatenate(more))
            key, times = np.concatenate((key, more)), np.concatenate((times, np.ones(len(more), np.int64)))
            order = np.argsort(key, kind="stable")
            key, times = key[order], times[order]
        yield at, end, stats, key >> bits, key & ((1 << bits) - 1), times


def fold(id_col: str) -> Column:
    """CRC-32 of the id as text, mod 5; a null id is the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def sample(docs: DataFrame, labels: DataFrame, columns: list[str], most: int, bits: int, prefixes: tuple[int, ...], id_col: str = "doc_id", text_col: str = "text"):
    """(labels, statistics, offsets, buckets, counts) of at most ``most`` labelled documents outside fold 0.

    Documents come in the order of a hash of their ids, so reruns agree. Rows without an id or one of the
    labels take no part. An id is labelled once, by the least of its rows of labels, and of several texts of one
    id the one of the least hash counts. Only features are gathered, and only of the sample.
    """
    chosen = labels.select(id_col, *[F.col(c).cast("double").alias(f"l{k}") for k, c in enumerate(columns)]).where(F.col(id_col).isNotNull()).dropna()
    names = [f"l{k}" for k in range(len(columns))]
    chosen = chosen.where(fold(id_col) != 0).groupBy(id_col).agg(F.min(F.struct(*names)).alias("y")).select(id_col, *[F.col(f"y.{c}").alias(c) for c in names])
    chosen = chosen.withColumn("h", fixed_hash(F.col(id_col).cast("string"))).orderBy("h", id_col).limit(most)
    texts = docs.select(id_col, text_of(text_col).alias("text")).join(F.broadcast(chosen.select(id_col)), id_col)
    texts = texts.groupBy(id_col).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = texts.join(F.broadcast(chosen), id_col)
    n = len(columns)
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            for at, end, stats, doc, bucket, times in extracted(b.column(1), bits, prefixes):
                cut = np.searchsorted(doc, np.arange(end - at + 1))
                lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x.astype(np.int32))) for x in (bucket, times)]
                yield pa.RecordBatch.from_arrays([b.column(2 + n).slice(at, end - at), *(b.column(2 + k).slice(at, end - at) for k in range(n)), pa.array(list(stats), pa.list_(pa.float32())), *lists], names)

    names = ["h", *(f"l{k}" for k in range(n)), "stats", "buckets", "times"]
    schema = "h bigint, " + "".join(f"l{k} double, " for k in range(n)) + "stats array<float>, buckets array<int>, times array<int>"
    table = rows.select(id_col, "text", *(f"l{k}" for k in range(n)), "h").mapInArrow(run, schema).toArrow().sort_by("h").combine_chunks()
    if not table.num_rows:
        return np.zeros((0, n)), np.zeros((0, len(STATISTICS)), np.float32), np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    y = np.stack([table.column(f"l{k}").to_numpy() for k in range(n)], 1)
    lists = table.column("buckets").combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    stats = table.column("stats").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
    return y, stats, np.concatenate(([0], np.cumsum(lengths))), lists.flatten().to_numpy(), table.column("times").combine_chunks().flatten().to_numpy()
