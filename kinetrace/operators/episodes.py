"""Dense indices over episodes, tasks and frames, packing into files, and set operations on datasets."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import file_place

#: Positions are dense integers, as places in a list are: so many of them are numbered by one task.
SPAN = 1 << 16


def running(rows: DataFrame, order: list[str], total: Column | None = None, span: int = SPAN) -> DataFrame:
    """``rows`` with ``rows_before`` and, where ``total`` is given, ``total_before``: counts and sums of all rows before it.

    The last of the integer columns ``order`` is cut into spans. Rows are numbered within a span; what lies
    before a span follows from one row a span, the only thing that one task sees all of. Order is unique.
    """
    total = F.lit(0).cast("bigint") if total is None else total
    cut = rows.withColumns({"span": F.floor(F.col(order[-1]) / span), "part": total})
    key = [*order[:-1], "span"]
    per = cut.groupBy(*key).agg(F.count("*").alias("n"), F.sum("part").alias("s"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    every, own = W.orderBy(*key), W.partitionBy(*key).orderBy(order[-1])
    per = per.select(*key, before("n", every).alias("rows_before"), before("s", every).alias("total_before"))
    cut = cut.withColumns({"own_rows": F.row_number().over(own) - 1, "own_total": before("part", own)})
    out = cut.join(per, key).withColumns({"rows_before": (F.col("rows_before") + F.col("own_rows")).cast("bigint"), "total_before": F.col("total_before") + F.col("own_total")})
    return out.drop("span", "part", "own_rows", "own_total")


def episode_remap(episodes: DataFrame, position: str, out: str = "episode_index") -> DataFrame:
    """Dense indices of the episodes that are left, in their order."""
    return running(episodes, [position]).withColumnRenamed("rows_before", out).drop("total_before")


def task_remap(used: DataFrame, task: str, out: str = "new_task_index") -> DataFrame:
    """Dense indices of the tasks in use, by their old index."""
    return running(used.select(task).distinct(), [task]).withColumnRenamed("rows_before", out).drop("total_before")


def global_index(lengths: DataFrame, order: str, length: str) -> DataFrame:
    """``dataset_from_index`` and ``dataset_to_index`` of each episode: where its frames lie among all."""
    at = running(lengths, [order], F.col(length)).drop("rows_before")
    return at.withColumns({"dataset_from_index": F.col("total_before").cast("bigint"), "dataset_to_index": (F.col("total_before") + F.col(length)).cast("bigint")}).drop("total_before")


def frame_columns(frames: DataFrame, episode: str, frame_index: str, fps: float) -> DataFrame:
    last = F.count(F.lit(1)).over(W.partitionBy(episode)) - 1
    return frames.withColumns({"timestamp": F.col(frame_index) / F.lit(float(fps)), "last_frame_index": last.cast("bigint")})


def packed_files(sizes: DataFrame, order: str, size: str, limit: float) -> DataFrame:
    """``file_seq``, ``chunk_index`` and ``file_index``: files are filled in order and one closes when the next
    episode would take it to ``limit``; an episode that is larger has a file of its own.

    Where a file closes depends on where the last one did, so this is a fold over the episodes in order: one
    task streams over (order, size), one row of 16 bytes an episode; no other operator here has but one task.
    """

    def fold(batches):
        file, held, any_ = 0, 0.0, False
        for b in batches:
            files = []
            for s in b.column(1).to_pylist():
                if any_ and held + s >= limit:
                    file, held = file + 1, 0.0
                held, any_ = held + s, True
                files.append(file)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(files, pa.int64())], [order, "file_seq"])

    narrow = sizes.select(F.col(order).cast("bigint").alias(order), F.col(size).cast("double").alias("s"))
    out = narrow.repartitionByRange(1, order).sortWithinPartitions(order).mapInArrow(fold, f"`{order}` bigint, file_seq bigint")
    chunk, file = file_place(F.col("file_seq"))
    return out.withColumns({"chunk_index": chunk.cast("bigint"), "file_index": file.cast("bigint")})


def merged_tasks(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tasks, map) of rows (dataset_pos, task_index, prompt, description).

    Tasks are one a prompt, in the order in which prompts are first met; the first description stays.
    """
    first = tasks.groupBy("prompt").agg(F.min(F.struct("dataset_pos", "task_index", "description")).alias("f"))
    first = running(first.select("prompt", "f.*"), ["dataset_pos", "task_index"])
    merged = first.select(F.col("rows_before").alias("new_task_index"), "prompt", "description")
    mapping = tasks.join(merged.select("prompt", "new_task_index"), "prompt").select("dataset_pos", "task_index", "new_task_index")
    return merged, mapping


def merged_episodes(episodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Episodes (dataset_pos, episode_pos, success, task_index) of all datasets, numbered anew, tasks remapped."""
    e = episodes.join(mapping, ["dataset_pos", "task_index"])
    return running(e, ["dataset_pos", "episode_pos"]).select("dataset_pos", "episode_pos", F.col("rows_before").cast("string").alias("id"), "success", F.col("new_task_index").alias("task_index"))
