"""Selections, lookups and checks over streams, frames, episodes and tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stream_entities(readings: DataFrame, episode: str, stream: str, category: str) -> DataFrame:
    """The streams that each episode has, with the path of each as ``entity``."""
    from ..functions.expressions import entity_path

    found = readings.select(episode, stream).distinct()
    return found.withColumn("entity", entity_path(episode, F.lit(category), stream))


def only(rows: DataFrame, column: str, *names: str) -> DataFrame:
    """The rows of the named categories, streams or cameras."""
    return rows.where(F.col(column) == names[0] if len(names) == 1 else F.col(column).isin(*names))


def named_joints(rows: DataFrame, vector: str, joints: list[str], *keep: str | Column) -> DataFrame:
    """A column for each place of the vector, null where it is shorter."""
    return rows.select(*keep, *[F.get(vector, F.lit(i)).alias(j) for i, j in enumerate(joints)])


def uniform_formats(frames: DataFrame, format: str, *keys: str) -> DataFrame:
    """(keys, formats, uniform): how many formats there are, and whether it is one."""
    out = frames.groupBy(*keys).agg(F.countDistinct(format).alias("formats"))
    return out.withColumn("uniform", F.col("formats") == 1)


def frame_at(frames: DataFrame, i: int, keys: list[str], order: list[str]) -> DataFrame:
    """The i-th frame, from 0, in the given order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return frames.withColumn("place", F.row_number().over(w)).where(F.col("place") == i + 1).drop("place")


def first_of(frames: DataFrame, keys: list[str], order: str, **columns: str) -> DataFrame:
    """The least ``order`` of each key as ``first_<order>``, and of that frame other columns under new names."""
    return frames.groupBy(*keys).agg(F.min(order).alias(f"first_{order}"), *[F.min_by(c, order).alias(n) for n, c in columns.items()])


def frame_totals(frames: DataFrame, keys: list[str], size: Column) -> DataFrame:
    """(keys, num_frames, bytes)."""
    return frames.groupBy(*keys).agg(F.count("*").alias("num_frames"), F.sum(size).cast("bigint").alias("bytes"))


def successful(episodes: DataFrame, success: Column) -> DataFrame:
    """Episodes of which success is true, neither false nor unknown; the filter reaches the scan."""
    return episodes.where(success)


def with_task(episodes: DataFrame, tasks: DataFrame, task: str, key: str, *columns: Column) -> DataFrame:
    """Episodes with columns of their task; the planner decides by the tables' sizes whether tasks are sent."""
    return episodes.join(tasks.select(F.col(key).alias(task), *columns), task)


def with_some(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key is among ``others``."""
    return rows.join(others.select(*keys), keys, "left_semi")


def without_any(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key is not among ``others``."""
    return rows.join(others.select(*keys), keys, "left_anti")


def frame_guard(data: DataFrame, video: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, data_frames, video_frames, consistent) of tables (keys, data_frames) and (keys, video_frames); none counts as 0."""
    both = data.join(video, keys, "left").withColumn("video_frames", F.coalesce("video_frames", F.lit(0).cast("bigint")))
    return both.select(*keys, "data_frames", "video_frames", (F.col("data_frames") == F.col("video_frames")).alias("consistent"))


def totals(frames: DataFrame, episode: str, task: str, cameras: int, chunk: int = 1000) -> DataFrame:
    """One row: frames, episodes, tasks, videos and chunks of a dataset."""
    t = frames.agg(F.count("*").alias("total_frames"), F.countDistinct(episode).alias("total_episodes"), F.countDistinct(task).alias("total_tasks"))
    return t.withColumns({"total_videos": F.col("total_episodes") * cameras, "total_chunks": F.ceil(F.col("total_episodes") / chunk).cast("bigint")})


def split_ranges(counted: DataFrame, n: str, share: float) -> DataFrame:
    """``train`` and ``val`` as ranges of ``n`` episodes; val is null where train has them all."""
    from ..functions.expressions import train_end

    end, upto = train_end(n, share).cast("string"), F.col(n).cast("string")
    return counted.withColumns({"train": F.concat(F.lit("0:"), end), "val": F.when(train_end(n, share) < F.col(n), F.concat(end, F.lit(":"), upto))})


def video_times(lengths: DataFrame, file: list[Column | str], order: str, length: str, fps: float) -> DataFrame:
    """``from_timestamp`` and ``to_timestamp`` of each episode in its file, where episodes follow each other in order."""
    upto = F.sum(length).over(W.partitionBy(*file).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return lengths.withColumns({"from_timestamp": (upto - F.col(length)) / F.lit(float(fps)), "to_timestamp": upto / F.lit(float(fps))})


def mismatches(others: DataFrame, first: DataFrame, *columns: str) -> DataFrame:
    """``others`` with ``mismatch``: whether a column differs from the one row of ``first``, null equal to null."""
    named = first.select(*[F.col(c).alias(f"first_{c}") for c in columns]).limit(1)
    same = [F.col(c).eqNullSafe(F.col(f"first_{c}")) for c in columns]
    out = others.crossJoin(F.broadcast(named))  # one row
    for i, s in enumerate(same):
        out = out.withColumn("mismatch", ~s if not i else F.col("mismatch") | ~s)
    return out.drop(*named.columns)


def long_series(rows: DataFrame, vector: str, entity: Column, time: str) -> DataFrame:
    """(entity, timestamp, scalar): a row for each element; ``entity`` may use the place ``pos``, from 0."""
    long = rows.select("*", F.posexplode(vector).alias("pos", "scalar"))
    return long.select(entity.alias("entity"), F.col(time).alias("timestamp"), F.col("scalar").cast("double").alias("scalar"))
