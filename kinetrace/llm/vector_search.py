"""Exact top-k search by inner product over a vector-approximation file.

The file holds, for every vector, the number of a cell for each dimension, one byte each. For a query the
cells give a lower and an upper bound of the score. A bounded sample of the file gives each query a first
threshold, the kth best lower bound there; a scan of the whole file then keeps the vectors whose upper bound
reaches it and the kth best lower bound of their part, and the kth best lower bound of all that is left parts
those again. The exact vectors of the rest are read in the order of the upper bounds (for a distance: the lower
bounds), some for each query at a time, until no unread bound reaches the kth exact score.

Queries go out in blocks of at most ``QUERY_BLOCK``, so what is broadcast is bounded; every block scans the
file once and its result is a table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NULL_ID, id_or_last, stored, tables

CELLS = 256
QUERY_BLOCK = 8192
#: Vectors of the file from which queries get their first threshold, about.
SAMPLE = 1 << 16
#: Candidate rows broadcast to the scan of exact vectors, at most; more meet them in a shuffle.
MAX_SENT = 500_000
#: Rounds in which exact vectors are read, each of WIDEN times as many a query; the last one takes all that are left.
ROUNDS, WIDEN = 4, 8
SCALE = 1024.0


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: float = SCALE) -> DataFrame:
    """(id, v): ``floor(scale * x)`` of each component, of the vectors that have components and only finite ones."""
    fine = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    good = vectors.where(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)).where(fine)
    v = F.transform(F.col(vec_col), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint"))
    return good.select(id_or_last(id_col).alias("id"), v.alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _ranges(dim: int):
    def run(batches):
        low = high = None
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(0), dim)
                low = m.min(0) if low is None else np.minimum(low, m.min(0))
                high = m.max(0) if high is None else np.maximum(high, m.max(0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["d", "low", "high"])

    return run


class Grid:
    """Cells of equal width for each dimension, from its least to its largest component over all vectors."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low, self.width = low, np.maximum(1, -(-(high - low + 1) // CELLS))

    def codes(self, m: np.ndarray) -> np.ndarray:
        return ((m - self.low) // self.width).astype(np.uint8)

    def bounds(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest integer of each cell."""
        low = self.low + codes.astype(np.int64) * self.width
        return low.astype(float), (low + self.width - 1).astype(float)


def _encode(grid: Grid, dim: int):
    def run(batches):
        for b in batches:
            codes = grid.codes(_matrix(b.column(3), dim))
            data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(dim), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], data], ["id", "s1", "s2", "codes"])

    return run


def slack(q: np.ndarray, grid: Grid) -> np.ndarray:
    """By how much rounding can move a bound of each query: nothing while all sums stay below 2**53."""
    most = np.abs(q) @ np.maximum(np.abs(grid.low), np.abs(grid.low + CELLS * grid.width)).astype(float)
    return np.where(most < 2.0**53, 0.0, most * (q.shape[1] + 4) * 2.0**-52)


def _scan(sent, grid: Grid, dim: int, k: int):
    """Of a part of the file: (query, id, low, high) of what may be among the k best."""

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts).combine_chunks()
        ids, s1, s2 = (table.column(c).to_numpy() for c in ("id", "s1", "s2"))
        codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8).reshape(-1, dim)
        order = np.lexsort((ids, s2, s1))  # of equal vectors only the k + 1 smallest ids can be among the k best
        a, b = s1[order], s2[order]
        first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        place = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
        order = order[place <= k]
        ids, codes = ids[order], codes[order]
        q_ids, q, least = sent.value
        plus, minus, wide = np.maximum(q, 0.0).T, np.minimum(q, 0.0).T, slack(q, grid)[:, None]
        best = np.full((len(q), k), -np.inf)
        found = []
        step = max(64, (1 << 21) // max(1, len(q)))
        for i in range(0, len(ids), step):
            low, high = grid.bounds(codes[i : i + step])
            upper = (high @ plus + low @ minus).T + wide
            lower = (low @ plus + high @ minus).T - wide
            own = q_ids[:, None] == ids[None, i : i + step]
            upper[own] = lower[own] = -np.inf
            both = np.concatenate((best, lower), 1)
            best = np.partition(both, both.shape[1] - k, 1)[:, -k:]
            row, at = np.nonzero((upper >= np.maximum(best.min(1), least)[:, None]) & (upper > -np.inf))
            found.append((row, at + i, lower[row, at], upper[row, at]))
        row, at, low, high = (np.concatenate(x) for x in zip(*found))
        keep = high >= np.maximum(best.min(1), least)[row]
        out = [pa.array(q_ids[row[keep]]), pa.array(ids[at[keep]]), pa.array(low[keep]), pa.array(high[keep])]
        yield pa.RecordBatch.from_arrays(out, ["query_id", "id", "low", "high"])

    return run


_FOUND = "query_id bigint, id bigint, low double, high double"


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best inner products for each query, ties to the smaller id.

    Components are integers, ``floor(1024 * x)``; a score that does not fit a long is an error. Vectors
    that are null, empty or hold null or non-finite components take no part; vectors of another length than
    the query's are no candidates. All rows of the query's own id are none either; of others a repeated row
    counts as often as it is there. Of several vectors with one query id the least, component by component, is the
    query. A null id counts as the largest and is no query. Fewer than ``k`` candidates give fewer rows, an empty
    table none.
    """
    spark = vectors.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    out = None
    with tables(spark) as keep:
        rows = quantised(vectors.where(F.col(vec_col).isNotNull()), id_col, vec_col).groupBy("id", "v").agg(F.count("*").alias("times"))
        rows = stored(rows.withColumns({"s1": F.xxhash64("v"), "s2": F.xxhash64(F.lit(7), "v")}), "vectors")
        for (dim,) in sorted(rows.select(F.size("v")).distinct().collect()):
            own = rows.where(F.size("v") == dim)
            edges = own.select("v").mapInArrow(_ranges(dim), "d int, low bigint, high bigint").groupBy("d").agg(F.min("low"), F.max("high")).orderBy("d").collect()
            grid = Grid(np.array([r[1] for r in edges]), np.array([r[2] for r in edges]))
            file = stored(own.select("id", "s1", "s2", "v").mapInArrow(_encode(grid, dim), "id bigint, s1 bigint, s2 bigint, codes binary"), "va-file")
            share = -(-file.count() // SAMPLE)
            queries = own.where(F.col("id") != F.lit(NULL_ID)).withColumnRenamed("id", id_col).where(is_query)
            queries = stored(queries.groupBy(F.col(id_col).alias("query_id")).agg(F.min("v").alias("q")), "queries")
            blocks = -(-queries.count() // QUERY_BLOCK)
            for block in range(blocks):
                some = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block) if blocks > 1 else queries
                with tables(spark) as keep_block:
                    part = stored(_block(some, own, file, share, grid, dim, k), "top")
                    keep_block(part)
                keep(part)
                out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("id") != F.lit(NULL_ID), F.col("id")).alias("vec_id"), "score")


def _best(*order: Column | str) -> Column:
    return F.row_number().over(W.partitionBy("query_id").orderBy(*order))


def _least(found: DataFrame, by: str, k: int, name: str) -> DataFrame:
    """(query_id, name): the kth best ``by`` of each query that has k; tasks send their k best only."""
    best = found.select("query_id", by).withColumn("place", _best(F.desc(by))).where(F.col("place") <= k)
    return best.groupBy("query_id").agg(F.min(by).alias(name), F.count("*").alias("n")).where(F.col("n") == k).drop("n")


def _block(queries: DataFrame, exact: DataFrame, file: DataFrame, share: int, grid: Grid, dim: int, k: int) -> DataFrame:
    spark = queries.sparkSession
    table = queries.toArrow()
    q_ids, q = table.column("query_id").to_numpy(), _matrix(table.column("q").combine_chunks(), dim).astype(float)
    least = np.full(len(q), -np.inf)

    def scanned(part: DataFrame, name: str) -> DataFrame:
        sent = spark.sparkContext.broadcast((q_ids, q, least))
        return stored(part.mapInArrow(_scan(sent, grid, dim, k), _FOUND), name)

    if share > 1 and len(q):
        first = _least(scanned(file.where(F.pmod("s1", F.lit(share)) == 0), "sample"), "low", k, "least").toArrow()  # a row a query of the block
        at = {i: n for n, i in enumerate(q_ids.tolist())}
        for i, x in zip(first.column(0).to_pylist(), first.column(1).to_pylist()):
            least[at[i]] = x
    found = scanned(file, "bounds")
    sure = F.broadcast(_least(found, "low", k, "sure"))  # at most a row a query of the block
    found = stored(found.join(sure, "query_id", "left").where(F.col("sure").isNull() | (F.col("high") >= F.col("sure"))).select("query_id", "id", "high"), "candidates")
    scores, seen, kth = None, 0, None
    for turn in range(ROUNDS):
        due = found if kth is None else found.join(F.broadcast(kth), "query_id", "left").where(F.col("kth").isNull() | (F.col("high") >= F.col("kth"))).drop("kth")
        due = due.withColumn("turn", _best(F.desc("high"), "id"))
        upto = 2 * k * WIDEN**turn
        if turn < ROUNDS - 1:
            due = due.where(F.col("turn") <= upto)
        due = stored(due.where(F.col("turn") > seen).select("query_id", "id"), "due")
        n = due.count()
        if not n:
            break
        new = stored(_read(exact, due, queries, n), "scores")
        scores = new if scores is None else scores.unionByName(new)
        kth, seen = _least(scores.withColumn("score", F.explode(F.array_repeat("score", F.least("times", F.lit(k)).cast("int")))), "score", k, "kth"), upto
    if scores is None:
        return spark.createDataFrame([], "query_id bigint, id bigint, score bigint, rank int")
    every = scores.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least("times", F.lit(k).cast("bigint")))))
    ranked = every.withColumn("rank", _best(F.desc("score"), "id", "copy"))
    return ranked.where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def _read(exact: DataFrame, due: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """(query_id, id, times, score): exact scores of the pairs that are due."""
    pairs = exact.select("id", "v", "times").join(F.broadcast(due) if n <= MAX_SENT else due, "id").join(F.broadcast(queries), "query_id")
    score = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return pairs.select("query_id", "id", "times", score.alias("score"))
