"""Whole-dataset operations on folders: repair and merge."""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from .dataset import Dataset
from .sources.metadata import write_document


def repaired_table(table: pa.Table) -> tuple[pa.Table, int, int]:
    """(table, repaired, left): single gaps of each list column become the mean of their neighbours.

    A null list counts as a gap in every element, of the width that the first list has; a column without any list stays, all its rows left.
    """
    done = left = 0
    for at, name in enumerate(table.column_names):
        if name == "timestamp":
            continue
        column = table.column(name).combine_chunks()
        cells = column.to_pylist()
        width = next((len(c) for c in cells if c is not None), None)
        if width is None:
            left += len(cells)
            continue
        m = np.array([[np.nan] * width if c is None else [np.nan if x is None else x for x in c] for c in cells], float).reshape(len(cells), width)
        gap = np.isnan(m)
        if not gap.any():
            continue
        mean = np.full_like(m, np.nan)
        mean[1:-1] = (m[:-2] + m[2:]) / 2
        fixed = gap & ~np.isnan(mean)
        m[fixed] = mean[fixed]
        done += int(fixed.sum())
        left += int((gap & ~fixed).sum())
        if fixed.any():
            keep = (gap & ~fixed).any(1)  # rows with a gap left are put together by hand, so nulls stay nulls
            new = [[m[i, j] if fixed[i, j] else (None if cells[i] is None else cells[i][j]) for j in range(width)] if keep[i] else m[i].tolist() for i in range(len(cells))]
            new = [cells[i] if keep[i] and not fixed[i].any() else v for i, v in enumerate(new)]
            table = table.set_column(at, table.schema.field(at), pa.array(new, column.type))
    return table, done, left


def repair(dataset: Dataset, output: str | os.PathLike | None = None, on_repair: Callable[[str], None] | None = None, on_error: Callable[[str], None] | None = None) -> tuple[int, int]:
    """Repair a dataset in place, or a copy in ``output``; (repaired, left) elements. One task a bad file.

    Only files in which ``validate`` finds a gap are opened; a changed one is replaced by a rename. A copy has the
    latest layout, and links to the cameras, which repairing leaves alone.
    """
    if output is not None:
        dataset.write(output, link_cameras=True)
        dataset = Dataset(output, dataset.spark, dataset._camera_names)
    root = dataset.root

    def run(batches):
        from .dataset import relative

        for b in batches:
            rows = []
            for path in b.column(0).to_pylist():
                place = os.path.join(root, relative(path, root))
                table, done, left = repaired_table(pq.read_table(place))
                if done:
                    temp = f"{place}.new"
                    pq.write_table(table, temp)
                    os.chmod(temp, os.stat(place).st_mode)
                    os.replace(temp, place)
                rows.append((relative(path, root), done, left))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["path", "done", "n_left"])

    bad = dataset.gaps().select("path", "episode_pos", "category", "key_pos").collect()  # one row a bad file
    order = {r.path: (r.episode_pos, r.category != "obs", r.key_pos) for r in bad}
    if not order:
        return 0, 0
    paths = dataset.spark.createDataFrame([(p,) for p in sorted(order)], "path string").repartition(len(order))
    out = paths.mapInArrow(run, "path string, done bigint, n_left bigint").collect()
    rank = {os.path.relpath(os.path.join(root, k.split("/episodes/", 1)[-1]), root): v for k, v in order.items()}
    out.sort(key=lambda r: rank.get(r.path.removeprefix("episodes/"), (0,)))
    for r in out:
        if r.done and on_repair:
            on_repair(f"{r.path}: repaired {r.done} value(s)")
        if r.n_left and on_error:
            on_error(f"{r.path}: {r.n_left} value(s) can't be repaired")
    return sum(r.done for r in out), sum(r.n_left for r in out)


def check_compatible(datasets: list[Dataset]) -> None:
    """All must have the version, equipment and frequencies of the first, which must have a version."""
    first = datasets[0].meta
    if first.version is None:
        raise ValueError("dataset 0 has no version; convert it first")
    for i, d in enumerate(datasets[1:], 1):
        if d.meta.version != first.version:
            raise ValueError(f"dataset {i} has version {d.meta.version}, dataset 0 {first.version}")
        if d.meta.equipment != first.equipment:
            raise ValueError(f"dataset {i} has other equipment than dataset 0")
        if d.meta.frequencies != first.frequencies:
            raise ValueError(f"dataset {i} has other frequencies than dataset 0")


def merge(inputs: list[str | os.PathLike], output: str | os.PathLike, symlink: bool = False, spark=None) -> None:
    """One dataset of all episodes, numbered anew, with tasks of one prompt merged; folders are copied or linked."""
    output = Path(output)
    if len(inputs) < 2:
        raise ValueError("merging needs two datasets or more")
    if output.exists():
        raise ValueError(f"{output} exists")
    datasets = [Dataset(p, spark) for p in inputs]
    check_compatible(datasets)
    spark = datasets[0].spark
    tasks: dict[str, tuple[int, dict]] = {}
    episodes, jobs = [], []
    for d in datasets:  # metadata only: a row a task or episode
        new = [tasks.setdefault(t["prompt"], (len(tasks), t))[0] for t in d.meta.tasks]
        for e in d.meta.episodes:
            i = str(len(episodes))
            episodes.append({"id": i, "success": e["success"], "task_index": new[e["task_index"]]})
            jobs.append((str(d.episode_path(e).resolve()), str((output / "episodes" / i).resolve())))
    data = dict(datasets[0].meta.data) | {"tasks": [t for _, t in tasks.values()], "episodes": episodes}
    write_document(data, output)

    def run(batches):
        for b in batches:
            for src, dst in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                os.makedirs(os.path.dirname(dst), exist_ok=True)
                os.symlink(src, dst, True) if symlink else shutil.copytree(src, dst, dirs_exist_ok=True)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    if jobs:
        spark.createDataFrame(jobs, "src string, dst string").repartition(min(len(jobs), 64)).mapInArrow(run, "n bigint").agg(F.sum("n")).collect()
