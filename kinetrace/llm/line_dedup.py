"""Line deduplication against levelled sorted runs of line hashes, in DataFrame operations only.

Documents are taken in batches, in the order of their ids. A run is a table of (hash, owner), bucketed and
sorted by hash; a hash is in one run only. A batch groups its own lines by hash, merge-joins the runs to
learn which hashes an earlier document owns, and adds the rest, each with the smallest id of the batch that
holds it, as a new run of level 0. When a level has ``FAN_OUT`` runs they are compacted into one of the next
level, so a batch meets a number of runs that grows with the logarithm of the batches. Joining runs needs no
shuffle of them. Batches have a bounded number of documents, so they and the levels grow with the input.

Runs and all else on the way lie in the shared folder and go when the operator is done or fails. In the end
only documents that lose a line meet the places of their dropped lines; the others stay where they are read.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import P, drop_stored, id_or_last, join_groups, new_path, parallelism, stored, tables, text_of

#: Documents of a batch, at most, but for ties of the sketch that parts them; there are ``BATCHES`` at least.
BATCH_DOCS, BATCHES = 1 << 27, 4
FAN_OUT = 2
MIN_CHARS = 10
#: Lines for each bucket of a run, some 30 bytes each.
BUCKET_LINES = 1 << 22
#: Documents that lose lines and are named to the scan of the texts, at most (some 40 bytes each).
MAX_SENT = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = " \t\n\x0b\f\r"


class Runs:
    """The levelled runs; ``owners`` looks up hashes, ``add`` takes hashes that no run has."""

    def __init__(self, spark: SparkSession, buckets: int, fan_out: int = FAN_OUT):
        self.spark, self.buckets, self.fan_out = spark, buckets, fan_out
        self.levels: dict[int, list[str]] = {}

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"kinetrace_run_{uuid.uuid4().hex}"
        place = new_path(self.spark, "run")  # a path of its own: the warehouse need not be shared
        rows.repartition(self.buckets, "h1", "h2").write.option("path", place).bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").format("parquet").saveAsTable(name)
        self.levels.setdefault(level, []).append(name)

    def add(self, rows: DataFrame) -> None:
        self._write(rows, 0)
        level = 0
        while len(names := self.levels.get(level, [])) >= self.fan_out:
            self._write(reduce(DataFrame.unionByName, map(self.spark.table, names)), level + 1)
            self.levels[level] = []
            self._drop(names)
            level += 1

    def owners(self, keys: DataFrame) -> DataFrame:
        """``keys`` with ``earlier``: the id that owns the hash in some run, or null."""
        for k, name in enumerate(n for names in self.levels.values() for n in names):
            run = self.spark.table(name).withColumnRenamed("owner", f"{P}o{k}")
            keys = keys.join(run.hint("merge"), ["h1", "h2"], "left")
        found = [F.col(c) for c in keys.columns if c.startswith(P + "o")]
        own = [c for c in keys.columns if not c.startswith(P + "o")]
        return keys.select(*own, (F.coalesce(*found) if found else F.lit(None).cast("bigint")).alias("earlier"))

    def _drop(self, names: list[str]) -> None:
        """Out of the catalogue; the files go with the operator's other tables."""
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def close(self) -> None:
        for names in self.levels.values():
            self._drop(names)
        self.levels = {}


def line_key(line):
    """The line without blanks at both ends and with A-Z lowered."""
    return F.translate(F.btrim(line, F.lit(_BLANK)), _UPPER, _LOWER)


def _dropped(lines: DataFrame, last: int, buckets: int) -> list[DataFrame]:
    """Tables (id, th, gone): of each batch the documents that lose lines, with the places of those."""
    runs, dropped = Runs(lines.sparkSession, buckets), []
    try:
        for k in range(last + 1):
            own = lines.where(F.col("batch") == k)
            keys = own.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("size"))
            keys = stored(runs.owners(keys), "keys")
            # a line goes if an earlier batch owns its key, or a smaller id of this one does
            shared = keys.where(F.col("earlier").isNotNull() | (F.col("first") < F.col("last")))
            owner = F.coalesce("earlier", "first")
            drops = join_groups(own.select("id", "th", "pos", "h1", "h2"), shared.select("h1", "h2", owner.alias("owner"), "size"), ["h1", "h2"], "size", own.count())
            dropped.append(stored(drops.where(F.col("id") > F.col("owner")).groupBy("id", "th").agg(F.collect_set("pos").alias("gone")), "drops"))
            if k < last:
                runs.add(keys.where(F.col("earlier").isNull()).select("h1", "h2", F.col("first").alias("owner")))
            drop_stored(keys)
    finally:
        runs.close()
    return dropped


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, batches: int | None = None) -> DataFrame:
    """``docs`` with all its columns and ``__kt_n_lines``, ``__kt_n_dropped`` and ``__kt_kept`` (the text left).

    Lines are what ``\\n`` separates; null and empty texts are one empty line. A key (see ``line_key``) of at
    least ``min_chars`` code points that several documents hold loses all its lines but those of the smallest
    id. A null id counts as the largest, and rows of one id as one document, so repeated rows keep the same
    lines. Extra columns pass through, but ``docs`` has none that begins with ``__kt_``. Keys stand as two
    independent 64-bit hashes. An empty table stays empty.
    """
    spark = docs.sparkSession
    text = text_of(text_col)
    whole = docs.withColumns({P + "id": id_or_last(id_col), P + "th": F.xxhash64(text)})
    batches = batches or max(BATCHES, -(-docs.count() // BATCH_DOCS))
    edges = sorted(set(whole.agg(F.percentile_approx(P + "id", [k / batches for k in range(1, batches)], 10000)).first()[0] or []))
    batch = reduce(lambda c, e: c + (F.col(P + "id") > F.lit(e)).cast("int"), edges, F.lit(0)).cast("int")
    with tables(spark) as keep:
        lines = whole.select(P + "id", P + "th", batch.alias("batch"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
        lines = lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
        lines = stored(lines.select(F.col(P + "id").alias("id"), F.col(P + "th").alias("th"), "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"), "batch"), "lines", "batch")
        buckets = max(parallelism(spark), -(-lines.count() // BUCKET_LINES))
        dropped = _dropped(lines, len(edges), buckets)
        keep(*dropped)
    gone = reduce(DataFrame.unionByName, dropped).select(F.col("id").alias(P + "id"), F.col("th").alias(P + "th"), F.col("gone").alias(P + "gone"))
    n_lines = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint")
    none = {P + "n_lines": n_lines, P + "n_dropped": F.lit(0).cast("bigint"), P + "kept": text}
    if gone.count() <= MAX_SENT:
        named = whole.join(F.broadcast(gone.select(P + "id", P + "th", F.lit(True).alias(P + "loses"))), [P + "id", P + "th"], "left")
        same = named.where(F.col(P + "loses").isNull()).withColumns(none).drop(P + "loses")
        moved = named.where(F.col(P + "loses")).drop(P + "loses").join(gone.hint("shuffle_hash"), [P + "id", P + "th"])
    else:
        same, moved = None, whole.join(gone.hint("shuffle_hash"), [P + "id", P + "th"], "left")
    moved = moved.withColumn(P + "lines", F.split(text, "\n", -1))
    at = F.array_except(F.sequence(F.lit(0), F.size(P + "lines") - 1), F.col(P + "gone"))
    kept = F.when(F.col(P + "gone").isNull(), text).otherwise(F.array_join(F.transform(at, lambda i: F.get(F.col(P + "lines"), i)), "\n"))
    lost = F.coalesce(F.size(P + "gone"), F.lit(0)).cast("bigint")
    moved = moved.withColumns({P + "n_lines": F.size(P + "lines").cast("bigint"), P + "n_dropped": lost, P + "kept": kept}).drop(P + "lines", P + "gone")
    out = moved if same is None else same.unionByName(moved)
    return out.drop(P + "id", P + "th")
