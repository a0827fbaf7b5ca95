"""Alignment of independently clocked streams onto one regular grid.

A grid point takes, of every stream, the first reading that is not earlier. On a regular grid that needs no
join: a reading whose predecessor is at ``p`` answers exactly the grid points in ``(p, t]``, so each reading is
exploded into those. Rows that answer none vanish, and the only shuffle is the one by stream.

A stream may hold most of all rows. Its predecessors are then found in slices of time: within a slice by a
window, across slices by the slices' ends, of which there are few. Unless a width is given, the fullest stream's
number of rows chooses it, where the planner expects an input too large for one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes that the planner expects of an input up to which no stream is cut, and rows of a slice beyond that, about.
ONE_TASK, SLICE_ROWS = 1 << 30, 1 << 22


def common_range(readings: DataFrame, episode: str, stream: str, time: str) -> DataFrame:
    """(episode, start, end): from the latest first to the earliest last reading of the streams that have any."""
    ends = readings.where(F.col(time).isNotNull()).groupBy(episode, stream).agg(F.min(time).alias("first"), F.max(time).alias("last"))
    return ends.groupBy(episode).agg(F.max("first").alias("start"), F.min("last").alias("end"))


def grid_size(start: Column, end: Column, step: Column) -> Column:
    """Points from ``start`` on that lie before ``end``; none if the range is empty."""
    return F.greatest(F.lit(0).cast("bigint"), F.ceil((end - start) / step))


def with_grid(ranges: DataFrame, step: int) -> DataFrame:
    """Ranges in integer time with ``n`` grid points ``start + k * step``."""
    return ranges.withColumns({"step": F.lit(step).cast("bigint"), "n": grid_size(F.col("start"), F.col("end"), F.lit(step))})


def with_float_grid(ranges: DataFrame, hz: float) -> DataFrame:
    """Ranges in double seconds with ``n`` points ``start + k * step``.

    The step is ``(start + 1/hz) - start`` in doubles, as a ranged array of doubles has it: at the size of an
    epoch it differs from ``1/hz`` by up to 2e-7 s.
    """
    exact = F.lit(1.0) / F.lit(float(hz))
    return ranges.withColumns({"step": (F.col("start") + exact) - F.col("start"), "n": grid_size(F.col("start"), F.col("end"), exact)})


def time_grid(gridded: DataFrame, episode: str) -> DataFrame:
    """(episode, k, t): the grid points; those that rounding puts behind the end are left out."""
    points = gridded.where(F.col("n") > 0).select(episode, "start", "end", "step", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("k"))
    return points.withColumn("t", F.col("start") + F.col("k") * F.col("step")).where(F.col("t") <= F.col("end")).select(episode, "k", "t")


def previous(rows: DataFrame, keys: list[str], time: str, order: list[str], width: float | None = None) -> DataFrame:
    """``rows`` with ``previous``: the time of the row before it, by ``time`` and then ``order``, among equal ``keys``."""
    if width is None:
        return rows.withColumn("previous", F.lag(time).over(W.partitionBy(*keys).orderBy(time, *order)))
    part = F.floor(F.col(time) / F.lit(width)).alias("slice")
    ends = rows.groupBy(*keys, part).agg(F.max(time).alias("slice_end"))
    ends = ends.withColumn("before", F.lag("slice_end").over(W.partitionBy(*keys).orderBy("slice"))).drop("slice_end")
    own = rows.withColumn("slice", part)
    own = own.withColumn("previous", F.lag(time).over(W.partitionBy(*keys, "slice").orderBy(time, *order)))
    return own.join(ends, [*keys, "slice"], "left").withColumn("previous", F.coalesce("previous", "before")).drop("before", "slice")


def slice_width(readings: DataFrame, keys: list[str], time: str) -> float | None:
    """A width of time by which no slice of a stream has far more than ``SLICE_ROWS`` rows; None where streams may stay whole."""
    expected = readings._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(expected)) <= ONE_TASK:
        return None
    per = readings.groupBy(*keys).agg(F.count("*").alias("n"), (F.max(time) - F.min(time)).cast("double").alias("span"))
    n, span = per.agg(F.max("n"), F.max_by("span", "n")).first()
    return span / -(-n // SLICE_ROWS) if n and n > SLICE_ROWS and span else None


def forward_asof(readings: DataFrame, gridded: DataFrame, episode: str, stream: str, time: str, order: list[str] | None = None, width: float | str | None = "auto") -> DataFrame:
    """Readings with ``k`` and ``grid_t``: each grid point with the first reading of each stream not before it.

    ``width`` cuts streams into slices of time (None: not at all; by default ``slice_width`` says).
    Of equal times the first in ``order`` answers. Readings without a time answer nothing. Works on integer
    and on double time; bounds on doubles are taken one wider and then tested exactly.
    """
    columns = readings.columns
    rows = readings.where(F.col(time).isNotNull())
    rows = previous(rows, [episode, stream], time, order or [], slice_width(rows, [episode, stream], time) if width == "auto" else width)
    rows = rows.join(gridded.where(F.col("n") > 0), episode)
    t, p, start, step, last = F.col(time), F.col("previous"), F.col("start"), F.col("step"), F.col("n") - 1
    wide = 1 if dict(gridded.dtypes)["step"] == "double" else 0
    low = F.when(p.isNull() | (p < start), F.lit(0).cast("bigint")).otherwise(F.greatest(F.floor((p - start) / step) + 1 - wide, F.lit(0)))
    high = F.least(F.floor((t - start) / step) + wide, last)
    rows = rows.where(t >= start).withColumns({"low": low.cast("bigint"), "high": high.cast("bigint")}).where(F.col("low") <= F.col("high"))
    rows = rows.withColumn("k", F.explode(F.sequence("low", "high"))).withColumn("grid_t", start + F.col("k") * step)
    rows = rows.where((F.col("grid_t") <= t) & (F.col("grid_t") <= F.col("end")) & (p.isNull() | (p < F.col("grid_t"))))
    return rows.select(*columns, "k", "grid_t")


def assembled(aligned: DataFrame, episode: str, stream: str, value: str) -> DataFrame:
    """One row a grid point with a map from stream to value."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(stream).alias("key"), F.col(value).alias("value"))))
    return aligned.groupBy(episode, "k", "grid_t").agg(F.map_from_entries(entries).alias("values"))


def assembled_wide(aligned: DataFrame, episode: str, stream: str, value: str, streams: list[str]) -> DataFrame:
    """One row a grid point with a column for each of ``streams``: the names are given, so no pass finds them."""
    picks = [F.max(F.when(F.col(stream) == s, F.col(value))).alias(s) for s in streams]
    return aligned.groupBy(episode, "k", "grid_t").agg(*picks)
