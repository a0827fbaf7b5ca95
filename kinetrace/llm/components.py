"""Connected components of a link table, by contraction in joins and aggregations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, tables


def _forest(batches):
    """Of a part's links only a star for each of the part's own components: same reach, fewer links."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        r = x
        while above.setdefault(r, r) != r:
            r = above[r]
        while above[x] != r:
            above[x], x = r, above[x]
        return r

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                above[max(a, b)] = min(a, b)
    pairs = [(r, x) for x in list(above) if (r := root(x)) != x]
    for k in range(0, len(pairs), 50_000):
        a, b = zip(*pairs[k : k + 50_000])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(v, label): for each end of the links (a, b: bigint) the smallest end that can be reached from it.

    Each round hooks every vertex to its smallest neighbour, follows that pointer once more, and renames the
    links' ends; links within one vertex go. Links at least halve, and stars, which are the usual case, end in
    two rounds. Links are never gathered in one place.
    """
    with tables(links.sparkSession) as keep:
        edges = links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        edges = stored(edges.mapInArrow(_forest, "a bigint, b bigint").distinct(), "links")
        labels = None
        while edges.take(1):
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            hook = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("p"))
            up = hook.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            hook = stored(hook.join(up, "p", "left").select("v", F.coalesce("pp", "p").alias("p")), "hooks")
            if labels is None:
                labels = hook.select("v", F.col("p").alias("label"))
            else:
                labels = labels.join(hook.select(F.col("v").alias("label"), "p"), "label", "left").select("v", F.coalesce("p", "label").alias("label"))
            labels = stored(labels, "labels")
            edges = edges.join(hook.withColumnsRenamed({"v": "a", "p": "pa"}), "a").join(hook.withColumnsRenamed({"v": "b", "p": "pb"}), "b").where(F.col("pa") != F.col("pb"))
            edges = stored(edges.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).mapInArrow(_forest, "a bigint, b bigint").distinct(), "links")
        keep(edges if labels is None else labels)
    return edges.select(F.col("a").alias("v"), F.col("b").alias("label")) if labels is None else labels
