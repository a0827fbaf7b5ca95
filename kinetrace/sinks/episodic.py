"""LeRobot 2.1: one Parquet file an episode; and GR00T, which adds a description of the vectors' parts."""

from __future__ import annotations

import os
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, SCALARS, Export, dump, layout, plain, statistics_of

DATA = "data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet"
VIDEO = "videos/chunk-{episode_chunk:03d}/{video_key}/episode_{episode_index:06d}.mp4"
EPISODE_SCALARS = [c for c in SCALARS if c not in ("success", "last_frame_index")]


def write(dataset, output: Path, **options) -> None:
    """Options: fps=30, train_split=0.8, smoothing_cutoff=1.0, success_only=False, videos=True, encoder="ffmpeg"."""
    x = Export(dataset, output, **options)
    try:
        x.check_cameras()
        write_frames(plain(x.frames), output)
        if dataset.camera_names:
            x.videos(output, "videos/chunk-{chunk:03d}/{key}/episode_{file:06d}.mp4")
        write_metadata(x, output)
    finally:
        x.close()


def write_frames(frames: DataFrame, output: Path) -> None:
    """A file for each episode of frames (the columns of ``plain``), in the order of ``frame_index``."""
    base = str(output.resolve())

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        e = key[0].as_py()
        path = os.path.join(base, DATA.format(episode_chunk=e // CHUNK, episode_index=e))
        os.makedirs(os.path.dirname(path), exist_ok=True)
        pq.write_table(layout(table, "frame_index"), path)
        return pa.table({"n": pa.array([len(table)], pa.int64())})

    frames.groupBy("episode_index").applyInArrow(run, "n bigint").agg(F.sum("n")).collect()


def write_metadata(x: Export, output: Path) -> None:
    meta = output / "meta"
    dump([{"episode_index": r["episode_index"], "tasks": [r["prompt"]], "length": r["length"]} for r in x.rows], meta / "episodes.jsonl", lines=True)
    dump([{"task_index": i, "task": p} for i, p in x.tasks], meta / "tasks.jsonl", lines=True)
    per: dict[int, dict] = {}
    for r in x.statistics("episode_index").where(F.col("feature").isin("action", "observation.state", *EPISODE_SCALARS)).collect():
        per.setdefault(r.episode_index, {})[r.feature] = statistics_of(r)
    for (e, camera), s in x.image_statistics().items():
        per.setdefault(e, {})[f"observation.images.{camera}"] = s
    dump([{"episode_index": r["episode_index"], "dataset_from_index": r["dataset_from_index"], "dataset_to_index": r["dataset_to_index"], "stats": per.get(r["episode_index"], {})} for r in x.rows], meta / "episodes_stats.jsonl", lines=True)
    dump({r.feature: statistics_of(r) for r in x.statistics().collect()}, meta / "stats.json")
    n = len(x.rows)
    dump(x.info("v2.1", False) | {"total_videos": n * len(x.dataset.camera_names), "total_chunks": -(-n // CHUNK), "data_path": DATA, "video_path": VIDEO}, meta / "info.json")


def modality_ranges(dataset) -> dict[str, dict[str, int]]:
    """Which elements of the vectors belong to which part; a last joint called gripper is a part of its own."""
    out: dict[str, dict[str, int]] = {}
    at = 0

    def add(name: str, width: int) -> None:
        nonlocal at
        if name in out:
            raise NotImplementedError(f"two ranges would be called {name!r}")
        out[name] = {"start": at, "end": at + width}
        at += width

    for e in dataset.meta.embodiments.values():
        for side in e.components or ("",):
            prefix = f"{side}_" if side else ""
            for _ in e.attributes:
                held = e.joints[-1] == "gripper"
                add(prefix + e.name.removesuffix("s"), len(e.joints) - held)
                if held:
                    add(prefix + "gripper", 1)
    return out


def write_gr00t(dataset, output: Path, **options) -> None:
    write(dataset, output, **options)
    ranges = modality_ranges(dataset)
    dump({
        "state": ranges,
        "action": ranges,
        "video": {c: {"original_key": f"observation.images.{c}"} for c in dataset.camera_names},
        "annotation": {"human.action.task_description": {"original_key": "task_index"}},
    }, output / "meta" / "modality.json")
