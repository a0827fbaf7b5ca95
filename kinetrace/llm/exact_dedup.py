"""Exact deduplication with a two-pass Bloom filter.

Pass one keeps, for every bit of a Bloom filter, whether it was set at least once and at least twice.
Each task sends the positions that its own rows set, by segment of the filter; the tasks that merge a segment
make its two planes: what is set again, or was set twice by one task, is in ``twos``. A hash that occurs twice
has all its bits in ``twos``. Pass two tests every row against ``twos``: rows that miss a bit are unique for
certain and pass straight through; only the others, the possibly repeated ones, shuffle to be grouped exactly.

All bits of a hash lie in one segment, and slices of segments are tested one after another; the table of
hashes is kept apart by slice, so that all tests together read it once. The filter has ``bits_per_row`` bits a
row up to ``MAX_SLICES * SLICE_BYTES``, some 10**9 rows; beyond that more rows shuffle and the result stays
the same: at 4 * 10**9 rows some 15 % of the unique ones.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, P, drop_stored, id_or_last, join_groups, stored, tables, text_of

SEGMENT_BITS = 1 << 18
#: Broadcast at once, at most.
SLICE_BYTES = 64 << 20
MAX_SLICES = 32
HASHES = 3
#: Hashes of a task that are sorted together.
CHUNK = 1 << 20
A_SLICE = SLICE_BYTES * 8 // SEGMENT_BITS


def _positions(h: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The segment and the bit positions within it, one row of positions a hash."""
    h = h.view(np.uint64)
    segment = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    step = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (h >> np.uint64(29))
    bits = np.stack([((step >> np.uint64(20 * k)) & np.uint64(SEGMENT_BITS - 1)).astype(np.int64) for k in range(HASHES)], 1)
    return segment.astype(np.int64), bits


def _binaries(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """32-bit numbers as one binary value between each two cuts."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((4 * cuts).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _mark(segments: int):
    """(segment, ones, twos): positions that a chunk of hashes sets, and those it sets more than once."""

    def marked(held: list[np.ndarray]) -> pa.RecordBatch:
        segment, bits = _positions(np.concatenate(held), segments)
        key, times = np.unique(segment[:, None] * SEGMENT_BITS + bits, return_counts=True)
        owner, position, twice = key // SEGMENT_BITS, (key % SEGMENT_BITS).astype("<u4"), times > 1
        cuts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1], [True])))
        before = np.concatenate(([0], np.cumsum(twice)))
        return pa.RecordBatch.from_arrays([pa.array(owner[cuts[:-1]]), _binaries(position, cuts), _binaries(position[twice], before[cuts])], ["segment", "ones", "twos"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(np.asarray(b.column(0)))
            n += b.num_rows
            if n >= CHUNK:
                yield marked(held)
                held, n = [], 0
        if n:
            yield marked(held)

    return run


def _merge(batches):
    """Of segments in order: the plane of what was set twice, left out where nothing was."""
    now, ones, twos = None, np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)

    def closed():
        if now is not None and twos.any():
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([zlib.compress(np.packbits(twos).tobytes(), 1)], pa.binary())], ["segment", "twos"])

    for b in batches:
        for s, *both in zip(*(c.to_pylist() for c in b.columns)):
            once, twice = (np.frombuffer(x, "<u4") for x in both)
            if s != now:
                yield from closed()
                now = s
                ones[:] = twos[:] = False
            twos[once[ones[once]]] = True
            twos[twice] = True
            ones[once] = True
    yield from closed()


def filter_size(rows: int, bits_per_row: int = 16) -> int:
    """Segments of the filter for so many rows."""
    return min(max(1, -(-rows * bits_per_row // SEGMENT_BITS)), MAX_SLICES * A_SLICE)


def slice_of(h: Column, segments: int) -> Column:
    """The slice that a hash is tested in; ``_positions`` says the same of its segment."""
    return F.floor(F.shiftright(F.shiftrightunsigned(h, 32) * F.lit(segments), 32) / F.lit(A_SLICE)).cast("int")


def possibly_repeated(hashes: DataFrame, column: str, segments: int) -> DataFrame:
    """``hashes`` with a boolean ``__kt_maybe``: false only for values of the bigint ``column`` that occur once.

    ``hashes`` is read twice and should be a stored table without nulls in ``column``; where it is partitioned by
    a column ``__kt_slice``, which is ``slice_of`` the hash, each test reads its slice only.
    """
    spark = hashes.sparkSession
    marked = hashes.select(column).mapInArrow(_mark(segments), "segment bigint, ones binary, twos binary")
    merged = marked.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merge, "segment bigint, twos binary")
    merged = stored(merged, "bloom")
    apart = F.col(P + "slice") if P + "slice" in hashes.columns else slice_of(F.col(column), segments)
    out = None
    for k, low in enumerate(range(0, segments, A_SLICE)):
        plane = np.zeros((min(A_SLICE, segments - low), SEGMENT_BITS // 8), np.uint8)
        for r in merged.where(F.col("segment").between(low, low + len(plane) - 1)).toLocalIterator():
            plane[r.segment - low] = np.frombuffer(zlib.decompress(bytes(r.twos)), np.uint8)
        sent = spark.sparkContext.broadcast(plane)

        def test(batches, sent=sent, low=low):
            plane = sent.value
            for b in batches:
                segment, bits = _positions(np.asarray(b.column(b.schema.get_field_index(column))), segments)
                at, hit = segment - low, np.ones(len(segment), bool)
                for i in range(HASHES):
                    hit &= (plane[at, bits[:, i] >> 3] >> (7 - (bits[:, i] & 7)).astype(np.uint8)) & 1 > 0
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hit)], [*b.schema.names, P + "maybe"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hashes.schema)
        part = (hashes.where(apart == k) if segments > A_SLICE else hashes).mapInArrow(test, f"{schema}, {P}maybe boolean")
        out = part if out is None else out.unionByName(part)
    drop_stored(merged)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when identical, null counting as empty. Of equal texts the row with the largest id stays;
    a null id is larger than all others, and then ``keep_id`` is null. Rows repeated with the same id and
    text are one group; all of them that carry the largest id count as kept. An empty table gives no rows.
    Other columns are not read. SHA-256 stands for the text; the filter uses 64 bits of a hash of it.
    """
    sha = F.sha2(text_of(text_col), 256)
    total = docs.count()
    segments = filter_size(total)
    with tables(docs.sparkSession) as keep:
        rows = docs.select(id_or_last(id_col).alias("id"), F.unhex(sha).alias("sha")).withColumn("h", F.xxhash64("sha"))
        if segments > A_SLICE:
            rows = stored(rows.withColumn(P + "slice", slice_of(F.col("h"), segments)), "sha", P + "slice")
        else:
            rows = stored(rows, "sha")
        tested = stored(possibly_repeated(rows, "h", segments).select("id", "sha", P + "maybe"), "tested")
        maybe = tested.where(F.col(P + "maybe")).drop(P + "maybe")
        groups = stored(maybe.groupBy("sha").agg(F.max("id").alias("keep"), F.count("*").alias("size")), "groups")
        keep(tested, groups)
    repeated = join_groups(maybe, groups, ["sha"], "size", total)
    single = tested.where(~F.col(P + "maybe")).drop(P + "maybe").withColumns({"keep": F.col("id"), "size": F.lit(1).cast("bigint")})
    both = single.unionByName(repeated)
    null_id = lambda c: F.when(F.col(c) != F.lit(NULL_ID), F.col(c))
    return both.select(
        null_id("id").alias(id_col),
        null_id("keep").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("id") == F.col("keep")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def brute_force(rows: list[tuple]) -> pd.DataFrame:
    """The same over (id, text) pairs in memory, for tests."""
    import hashlib

    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    key = lambda i: (i is None, i)
    out = []
    for i, t in rows:
        g = groups[t or ""]
        keep = None if None in g else max(g)
        out.append((i, keep, len(g), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return pd.DataFrame(out, columns=["doc_id", "keep_id", "group_size", "kept", "text_sha256"])
