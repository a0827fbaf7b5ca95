"""Mixing sources to target weights with hash-threshold histograms.

Every source has a budget in tokens. What a budget holds in whole turns of its source, every document gets;
for the rest, documents are taken in the order of a fixed hash until the budget is met. No sort finds that
place: tokens are summed by source and hash bucket, the bucket in which the running sum crosses the budget is
the boundary, and only that bucket is summed again by finer buckets, until a bucket is a single hash value.
Everything below the threshold is then taken by a filter. Thresholds are nested: a larger budget takes a
superset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import P, join_groups, stored, tables, text_of

WEIGHTS = (5, 2, 1)
MOST_TURNS = 3
#: Rules of sources (some 60 bytes each) sent to every task, at most.
MAX_SENT = 100_000
#: The hash has 60 bits; each level sums over this many of them.
HASH_BITS, LEVEL_BITS = 60, 12


def word_count(text: Column) -> Column:
    return F.regexp_count(text_of(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def fixed_hash(*parts: Column) -> Column:
    """60 bits of an MD5 of texts put together, null as the empty one: the same on any engine."""
    whole = F.concat(*[F.coalesce(c, F.lit("")) for c in parts])
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("bigint")


def order_of(id_col: str, text_col: str) -> Column:
    """A document's place in the order in which its source is taken: rows of one id, or of none, have their texts to tell them apart."""
    return fixed_hash(F.col(id_col).cast("string"), F.lit(" "), F.col(text_col))


def targets(sizes: DataFrame, source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: float = MOST_TURNS) -> DataFrame:
    """From a table (source, size): ``target`` of each source, weights dealt in code-point order, null last.

    The total of all sizes is shared by weight. A source that would get more than ``most`` times its size
    stops there and its excess is shared by weight among the others, until none is above: the level ``x``
    with ``sum(min(most * size, weight * x)) = total``. Ordered by where sources stop, each level follows from
    running sums. One row a source passes through a single task, never one a document.
    """
    deal = F.array(*[F.lit(w) for w in weights])
    rank = F.row_number().over(W.orderBy(F.col(source).asc_nulls_last()))
    t = sizes.withColumn("weight", F.element_at(deal, ((rank - 1) % len(weights) + 1).cast("int")).cast("bigint"))
    every = W.partitionBy()
    order = W.orderBy((F.col("size") / F.col("weight")), F.col(source).asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumns({
        P + "total": F.sum("size").over(every),
        P + "weights": F.sum("weight").over(every),
        P + "below": F.coalesce(F.sum("size").over(order), F.lit(0)),
        P + "used": F.coalesce(F.sum("weight").over(order), F.lit(0)),
    })
    level = (F.col(P + "total") - most * F.col(P + "below")).cast("double") / (F.col(P + "weights") - F.col(P + "used")).cast("double")
    # the first source, in that order, that the level of those from it on does not lift above its stop
    open_ = F.col("weight") * level <= most * F.col("size")
    found = F.min(F.when(open_, F.struct((F.col("size") / F.col("weight")).alias("o"), F.col(source).isNull().alias("n"), F.col(source).alias("s"), level.alias("level")))).over(every)
    target = F.least(F.col("weight") * F.coalesce(found["level"], F.lit(float("inf"))), (most * F.col("size")).cast("double"))
    return t.select(source, "size", "weight", target.alias("target"))


def _source_key(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))


def rules(rows: DataFrame, total: int, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TURNS) -> DataFrame:
    """(source_key, docs, source_size, target, turns, threshold) of a stored table (source_key, src, size, h).

    A document of the source is taken ``turns`` times, and once more if its hash is not above ``threshold``.
    """
    per = rows.groupBy("source_key", "src").agg(F.sum("size").alias("size"), F.count("*").alias("docs"))
    per = stored(per, "sources")
    plan = targets(per.select("src", "size"), "src", weights, most).withColumnRenamed("size", "source_size")
    turns = F.least(F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))), F.lit(most)).cast("bigint")
    plan = plan.withColumns({"turns": turns, "source_key": _source_key("src")}).withColumn("rest", F.col("target") - F.col("turns") * F.col("source_size"))
    plan = stored(plan.join(per.select("source_key", "docs"), "source_key"), "plan")
    found = _thresholds(rows, plan.select("source_key", "rest", "docs"), total)
    out = plan.join(found, "source_key", "left").select("source_key", "docs", "source_size", "target", "turns", F.coalesce("threshold", F.lit(-1)).alias("threshold"))
    return stored(out, "rules")


def _sizes(docs: DataFrame, size: Column, id_col: str, source_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col), F.col(source_col).alias("src"), _source_key(source_col).alias("source_key"), size.alias("size"), order_of(id_col, text_col).alias("h"))


def _copies() -> Column:
    return F.col("turns") + (F.col("h") <= F.col("threshold")).cast("bigint")


def mix(docs: DataFrame, size: Column | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TURNS) -> DataFrame:
    """One row a document: its id, ``size``, ``source_size``, ``target``, ``taken = copies * size`` and ``copies``.

    A document's order is a hash of its id and text, so reruns agree; only rows with both alike go together.
    Of the two whole-document sums next to the rest of a budget the nearer is taken, at a tie the smaller.
    A null source is a source of its own, after all others; empty and null texts have size 0; an empty table
    gives no rows. Other columns are not read.
    """
    with tables(docs.sparkSession) as keep:
        rows = stored(_sizes(docs, word_count(F.col(text_col)) if size is None else size, id_col, source_col, text_col), "sizes")
        total = rows.count()
        found = rules(rows, total, weights, most)
        keep(rows, found)
    out = join_groups(rows.drop("src"), found, ["source_key"], "docs", total)
    return out.withColumn("copies", _copies()).select(id_col, "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(docs: DataFrame, size: Column | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TURNS) -> DataFrame:
    """The mix itself: each row of ``docs``, with all its columns, as often as ``mix`` takes it.

    Texts do not move: the rules of up to ``MAX_SENT`` sources go to them.
    """
    with tables(docs.sparkSession) as keep:
        rows = stored(_sizes(docs, word_count(F.col(text_col)) if size is None else size, id_col, source_col, text_col), "sizes")
        total = rows.count()
        found = rules(rows, total, weights, most)
        keep(found)
    found = found.select("source_key", "docs", "turns", "threshold")
    own = {"source_key": P + "source_key", "docs": P + "docs", "turns": P + "turns", "threshold": P + "threshold"}
    named = docs.withColumns({P + "source_key": _source_key(source_col), P + "h": order_of(id_col, text_col)})
    found = found.withColumnsRenamed(own)
    if found.count() <= MAX_SENT:
        out = named.join(F.broadcast(found), P + "source_key")
    else:
        out = join_groups(named, found, [P + "source_key"], P + "docs", total)
    copies = F.col(P + "turns") + (F.col(P + "h") <= F.col(P + "threshold")).cast("bigint")
    out = out.where(copies > 0).withColumn(P + "copy", F.explode(F.sequence(F.lit(1).cast("bigint"), copies)))
    return out.select(*docs.columns)


def _thresholds(rows: DataFrame, budgets: DataFrame, total: int) -> DataFrame:
    """(source_key, threshold): the largest hash taken, of rows (source_key, h, size) for the budgets' ``rest``."""
    # low: where the boundary bucket begins; below: tokens before it; last: the largest hash before it, or -1
    start = [F.lit(0).cast("bigint").alias("low"), F.lit(0).cast("bigint").alias("below"), F.lit(-1).cast("bigint").alias("last")]
    state = budgets.where(F.col("rest") > 0).select("source_key", "rest", "docs", *start)
    done = state.select("source_key", F.col("last").alias("threshold")).limit(0)
    before = W.partitionBy("source_key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    for bits in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        inside = join_groups(rows, state, ["source_key"], "docs", total)
        inside = inside.where((F.col("h") >= F.col("low")) & (F.col("h") - F.col("low") < F.lit(1 << (bits + LEVEL_BITS))))
        if bits == HASH_BITS - 2 * LEVEL_BITS:  # a small share of the rows: all further levels read only those
            rows = stored(inside.select("source_key", "h", "size"), "inside")
            inside = join_groups(rows, state, ["source_key"], "docs", total)
        buckets = inside.groupBy("source_key", "rest", "docs", "low", "below", "last", F.shiftright("h", bits).alias("bucket")).agg(
            F.sum("size").alias("tokens"), F.min("h").alias("least"), F.max("h").alias("top"))
        run = buckets.withColumns({
            "below": F.col("below") + F.coalesce(F.sum("tokens").over(before), F.lit(0)),
            "last": F.greatest("last", F.coalesce(F.max("top").over(before), F.lit(-1))),
        })
        boundary = stored(run.where((F.col("below") < F.col("rest")) & (F.col("below") + F.col("tokens") >= F.col("rest"))), "boundary")
        single = F.col("least") == F.col("top")
        closer = F.col("below") + F.col("tokens") - F.col("rest") < F.col("rest") - F.col("below")
        done = done.unionByName(boundary.where(single).select("source_key", F.when(closer, F.col("top")).otherwise(F.col("last")).alias("threshold")))
        state = boundary.where(~single).select("source_key", "rest", "docs", F.shiftleft("bucket", bits).alias("low"), "below", "last")
        if not state.take(1):
            break
    return done
