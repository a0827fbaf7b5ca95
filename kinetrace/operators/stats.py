"""Statistics of vectors, scalars and images, and their pooling over episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import nan_to_null

QUANTILES = {"q01": 0.01, "q10": 0.1, "q50": 0.5, "q90": 0.9, "q99": 0.99}
STATISTICS = ["min", "max", "mean", "std", *QUANTILES, "count"]
#: Rows of a group whose values one aggregation buffer may hold; quantiles of larger groups are found by rank.
HELD = 1 << 20
#: The rank of a sketched quantile is right to a share of 1 / ACCURACY.
ACCURACY = 10_000


def _moments(x: Column) -> list[Column]:
    return [F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.count(F.lit(1)).alias("count")]


def _in_buffers(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of (keys, x) with all distinct values of a group in one buffer."""
    q = F.percentile("x", F.array(*map(F.lit, QUANTILES.values()))).alias("q")
    out = rows.groupBy(*keys).agg(*_moments(F.col("x")), q)
    return out.select(*keys, "min", "max", "mean", "std", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(QUANTILES)], "count")


def _by_rank(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The same for groups of any size, exactly.

    A sketch brackets each quantile within a few ten thousandths of the group; a second pass counts what lies
    before the bracket and how often each value in it occurs, and the ranks of those few values give the quantile.
    """
    rows, names, keys = rows.select(F.struct(*keys).alias("group"), "x"), keys, ["group"]  # a key with a null in it joins too
    wide = 3 / ACCURACY
    ends = [e for p in QUANTILES.values() for e in (max(0.0, p - wide), min(1.0, p + wide))]
    x = F.col("x")
    per = rows.groupBy(*keys).agg(*_moments(x), F.count(x).alias("n"), F.percentile_approx(x, ends, ACCURACY).alias("ends")).persist()
    # of few values a sketch's ranks may be off by one: then all are in every bracket
    end = lambda i, all_: F.when(F.col("n") > 100 * ACCURACY, F.get("ends", F.lit(i))).otherwise(F.col(all_))
    brackets = F.array(*[F.struct(F.lit(i).alias("i"), end(2 * i, "min").alias("a"), end(2 * i + 1, "max").alias("b")) for i in range(len(QUANTILES))])
    few = F.broadcast if per.count() <= 1 << 16 else (lambda df: df)
    joined = rows.where(x.isNotNull()).join(few(per.select(*keys, brackets.alias("brackets"))), keys)
    before = joined.groupBy(*keys).agg(*[F.sum((x < F.get("brackets", F.lit(i))["a"]).cast("bigint")).alias(f"b{i}") for i in range(len(QUANTILES))])
    inside = joined.select(*keys, "x", F.explode(F.filter("brackets", lambda b: (x >= b["a"]) & (x <= b["b"]))["i"]).alias("i"))
    inside = inside.groupBy(*keys, "i", "x").agg(F.count("*").alias("times"))
    upto = F.sum("times").over(W.partitionBy(*keys, "i").orderBy("x").rowsBetween(W.unboundedPreceding, W.currentRow))
    known = before.select(*keys, F.array(*[f"b{i}" for i in range(len(QUANTILES))]).alias("before")).join(per.select(*keys, "n"), keys)
    inside = inside.withColumn("upto", upto).join(few(known), keys)
    place = (F.col("n") - 1) * F.element_at(F.array(*map(F.lit, QUANTILES.values())), F.col("i") + 1)
    first = F.get("before", F.col("i")) + F.col("upto") - F.col("times")  # the rank of the first row of a value
    at = lambda rank: F.max(F.when((first <= rank) & (rank < first + F.col("times")), x))
    picked = inside.groupBy(*keys, "i").agg(at(F.floor(place)).alias("low"), at(F.ceil(place)).alias("high"), F.first(place - F.floor(place)).alias("part"))
    value = F.col("low") * (1 - F.col("part")) + F.col("high") * F.col("part")
    wide_ = picked.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, value)).alias(n) for i, n in enumerate(QUANTILES)])
    return per.join(wide_, keys, "left").select(*[F.col("group").getField(k).alias(k) for k in names], *STATISTICS)


def described(rows: DataFrame, value: Column, keys: list[str], total: int) -> DataFrame:
    """min, max, mean, population std and linear quantiles of what is neither null nor NaN; count of all rows.

    No group has more than ``total`` rows.
    """
    rows = rows.select(*keys, nan_to_null(value.cast("double")).alias("x"))
    if total <= HELD:  # then no group has more
        return _in_buffers(rows, keys)
    if not keys:
        return _by_rank(rows.withColumn("all", F.lit(0)), ["all"]).drop("all")
    large = rows.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > HELD)
    large = large.select(*[F.col(k).alias(f"large_{i}") for i, k in enumerate(keys)]).persist()
    n = large.count()  # at most total / HELD
    if not n:
        return _in_buffers(rows, keys)
    on = [F.col(k).eqNullSafe(F.col(f"large_{i}")) for i, k in enumerate(keys)]
    large = F.broadcast(large) if n <= 1 << 16 else large
    return _in_buffers(rows.join(large, on, "left_anti"), keys).unionByName(_by_rank(rows.join(large, on, "left_semi"), keys))


def describe(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    return described(rows, F.col(value), list(keys), rows.count())


def describe_vector(rows: DataFrame, vector: str, *keys: str) -> DataFrame:
    """A row for each key and place in the vector."""
    long = rows.select(*keys, F.posexplode(vector).alias("pos", "x"))
    return described(long, F.col("x"), [*keys, "pos"], rows.count())


def as_arrays(described: DataFrame, *keys: str) -> DataFrame:
    """``describe_vector`` with one row a key and each statistic an array in the order of places."""
    sorted_ = described.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", *STATISTICS))).alias("s"))
    return sorted_.select(*keys, *[F.col("s").getField(n).alias(n) for n in STATISTICS])


def pooled(per_episode: DataFrame, *keys: str) -> DataFrame:
    """Statistics of all from those of parts with a ``count``.

    min and max are exact; the mean is weighted; the variance is that of the parts plus that between their
    means; quantiles are weighted means of the parts' quantiles, an approximation.
    """
    n, m, v = F.col("count"), F.col("mean"), F.col("std") * F.col("std")
    weighted = lambda x: F.sum(n * x) / F.sum(n)
    # the mean square less the squared mean; a variance of rounding alone is none
    var = F.greatest(weighted(v + m * m) - weighted(m) * weighted(m), F.lit(0.0))
    std = F.sqrt(F.when(var > 1e-13 * weighted(m * m), var).otherwise(F.greatest(weighted(v), F.lit(0.0))))
    return per_episode.groupBy(*keys).agg(
        F.min("min").alias("min"), F.max("max").alias("max"), weighted(m).alias("mean"), std.alias("std"),
        *[weighted(F.col(q)).alias(q) for q in QUANTILES], F.sum(n).alias("count"),
    )


def image_moments(pixels: DataFrame, *keys: str) -> DataFrame:
    """Statistics in 0..1 from rows (n, min, max, sum, sumsq) of 8-bit pixels; the variance is never below 0."""
    g = pixels.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("min").alias("lo"), F.max("max").alias("hi"), F.sum("sum").alias("s"), F.sum("sumsq").alias("q"))
    mean = F.col("s") / F.col("n")
    var = F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))
    return g.select(*keys, (F.col("lo") / 255.0).alias("min"), (F.col("hi") / 255.0).alias("max"), (mean / 255.0).alias("mean"), (F.sqrt(var) / 255.0).alias("std"), "n")
