"""The native layout, written at its latest version."""

from __future__ import annotations

import io
import os
import shutil
import tarfile
from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from ..functions.expressions import camera_name
from ..sources.metadata import WRISTS
from ..sources.streams import camera_folders, catalogue, frame_bytes
from .common import counted, runs


def write(dataset, output: Path, camera_format: str = "dir", link_cameras: bool = False) -> None:
    """Metadata, sensor files and frames; ``camera_format`` is dir or tar. ``link_cameras`` links what the dataset has instead."""
    if camera_format not in ("dir", "tar"):
        raise ValueError(f"unknown camera format {camera_format!r}")
    dataset.meta.write(output)
    write_sensors(dataset, output)
    (link if link_cameras else write_cameras)(dataset, output, camera_format)


def jobs_of(dataset, jobs: list[tuple[str, str]], do) -> None:
    """``do(source, target)`` for each pair, on the executors."""

    def run(batches):
        for b in batches:
            for src, dst in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                do(src, dst)
            yield counted(b.num_rows)

    if jobs:
        spark = dataset.spark
        spark.createDataFrame(jobs, "src string, dst string").repartition(min(len(jobs), 4 * spark.sparkContext.defaultParallelism)).mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


def write_sensors(dataset, output: Path) -> None:
    """State files are copied once, ``positions`` becomes ``value``, all else is copied; each file that exists by one task."""
    places = set()
    for category in ("action", "obs"):
        for state in (True, False):
            for s in catalogue(dataset.meta, category, lambda *_, state=state: state):
                places.add((s.path, "/".join(x for x in (category, s.embodiment, s.component, s.path.rpartition("/")[2]) if x)))
    ids = [str(e["id"]) for e in dataset.meta.episodes]
    jobs = [(f"{dataset.root}/episodes/{e}/{src}", str(output.resolve() / "episodes" / e / dst)) for e in ids for src, dst in sorted(places)]

    def copy(src: str, dst: str) -> None:
        state = f"{os.path.dirname(src)}/state.parquet"
        if not os.path.exists(src) or (src != state and os.path.exists(state)):  # a state file counts before others
            return
        os.makedirs(os.path.dirname(dst), exist_ok=True)
        if "positions" in pq.read_schema(src).names:
            t = pq.read_table(src)
            pq.write_table(t.rename_columns(["value" if c == "positions" else c for c in t.column_names]), dst)
        else:
            shutil.copy2(src, dst)

    jobs_of(dataset, jobs, copy)


def write_cameras(dataset, output: Path, camera_format: str) -> None:
    """The frames of each camera of each episode, as files or one flat tar; one task writes a camera, a frame at a time."""
    rename = dataset.meta.version in (None, "0.1.0")
    rows = dataset.frames().withColumn("camera", camera_name("camera") if rename else F.col("camera"))
    base = str(output.resolve())

    def run(batches):
        for (episode, camera), frames in runs(batches, 2):
            folder = os.path.join(base, "episodes", episode, "cameras")
            os.makedirs(folder, exist_ok=True)
            place = os.path.join(folder, camera)
            files = ((r[2], frame_bytes(*r[3:])) for r in frames)
            if camera_format == "dir":
                os.mkdir(place)
                for name, data in files:
                    Path(place, name).write_bytes(data)
            else:
                with tarfile.open(place + ".tar", "w") as tar:
                    for name, data in files:
                        info = tarfile.TarInfo(name)
                        info.size = len(data)
                        tar.addfile(info, io.BytesIO(data))
            yield counted(1)

    rows = rows.select("episode_id", "camera", "name", "path", "container", "offset", "size")
    rows.repartition("episode_id", "camera").sortWithinPartitions("episode_id", "camera", "name").mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


def link(dataset, output: Path, camera_format: str | None = None) -> None:
    """The cameras' folders and tars as links to those of the dataset, under their present names."""
    rename = dataset.meta.version in (None, "0.1.0")
    jobs = []
    for e in dataset.meta.episodes:
        for camera in dataset.camera_names:
            new = output.resolve() / "episodes" / str(e["id"]) / "cameras" / (WRISTS.get(camera, camera) if rename else camera)
            for folder in camera_folders(dataset.meta, camera):
                jobs.append((f"{dataset.root}/episodes/{e['id']}/{folder}", str(new)))

    def make(src: str, dst: str) -> None:
        os.makedirs(os.path.dirname(dst), exist_ok=True)
        for end in ("", ".tar"):
            if os.path.exists(src + end) and not os.path.lexists(dst) and not os.path.lexists(f"{dst}.tar"):
                os.symlink(src + end, dst + end)

    jobs_of(dataset, jobs, make)


def pack_cameras(dataset) -> None:
    """Turn camera folders of the present layout into tars in place, each by one task."""
    names = {n for c in dataset.camera_names for n in (c, WRISTS.get(c, c))}
    jobs = [(str(dataset.episode_path(e) / "cameras" / n), "") for e in dataset.meta.episodes for n in sorted(names)]

    def pack(folder: str, _: str) -> None:
        if not os.path.isdir(folder):
            return
        with tarfile.open(f"{folder}.tar.new", "w") as tar:
            for f in sorted(Path(folder).iterdir()):
                if f.is_file():
                    tar.add(f, f.name)
        os.replace(f"{folder}.tar.new", f"{folder}.tar")
        shutil.rmtree(folder)

    jobs_of(dataset, jobs, pack)
