"""LeRobot 3.0: many episodes a file, statistics pooled from those of the episodes."""

from __future__ import annotations

import os
from pathlib import Path

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import episodes as E
from ..operators import stats as S
from .common import Export, dump, layout, plain, statistics_of
from .episodic import EPISODE_SCALARS

DATA = "data/chunk-{chunk_index:03d}/file-{file_index:03d}.parquet"
VIDEO = "videos/{video_key}/chunk-{chunk_index:03d}/file-{file_index:03d}.mp4"
DATA_MB, VIDEO_MB = 100, 200


def write(dataset, output: Path, data_mb: float = DATA_MB, video_mb: float = VIDEO_MB, **options) -> None:
    """Options: fps=30, train_split=0.8, smoothing_cutoff=1.0, success_only=False, videos=True, encoder="ffmpeg"."""
    x = Export(dataset, output, **options)
    try:
        x.check_cameras()
        files = write_frames(plain(x.frames), output, data_mb)
        places = x.video_places(video_mb) if x.program else {}
        if dataset.camera_names:
            x.videos(output, "videos/{key}/chunk-{chunk:03d}/file-{file:03d}.mp4", places or None)
        write_metadata(x, output, files, places, data_mb, video_mb)
    finally:
        x.close()


def file_sizes(frames: DataFrame) -> DataFrame:
    """(episode_index, mb): what each episode's frames need as a file of their own."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        out = pa.BufferOutputStream()
        pq.write_table(layout(table, "frame_index"), out)
        return pa.table({"episode_index": pa.array([key[0].as_py()], pa.int64()), "mb": pa.array([out.getvalue().size / 2**20])})

    return frames.groupBy("episode_index").applyInArrow(run, "episode_index bigint, mb double")


def write_frames(frames: DataFrame, output: Path, data_mb: float) -> dict[int, tuple[int, int]]:
    """{episode: (chunk, file)}: files of many episodes, filled by the measured sizes of those."""
    place = E.packed_files(file_sizes(frames), "episode_index", "mb", data_mb).persist()
    base = str(output.resolve())

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        path = os.path.join(base, DATA.format(chunk_index=key[0].as_py(), file_index=key[1].as_py()))
        os.makedirs(os.path.dirname(path), exist_ok=True)
        pq.write_table(layout(table, "index"), path)
        return pa.table({"n": pa.array([len(table)], pa.int64())})

    rows = frames.join(place.select("episode_index", "chunk_index", "file_index"), "episode_index")
    rows.groupBy("chunk_index", "file_index").applyInArrow(run, "n bigint").agg(F.sum("n")).collect()
    out = {r.episode_index: (r.chunk_index, r.file_index) for r in place.toLocalIterator()}
    place.unpersist()
    return out


def write_metadata(x: Export, output: Path, files: dict[int, tuple[int, int]], places: dict, data_mb: float, video_mb: float) -> None:
    per = x.statistics("episode_index").where(F.col("feature").isin("action", "observation.state", *EPISODE_SCALARS)).persist()
    stats: dict[int, dict] = {}
    for r in per.toLocalIterator():
        for name, v in statistics_of(r).items():
            stats.setdefault(r.episode_index, {})[f"stats/{r.feature}/{name}"] = v
    shown = x.image_statistics()
    for (e, camera), s in shown.items():
        for name, v in s.items():
            stats.setdefault(e, {})[f"stats/observation.images.{camera}/{name}"] = v
    rows = []
    for r in x.rows:
        e = r["episode_index"]
        row = {"episode_index": e, "tasks": [r["prompt"]], "length": r["length"], "data/chunk_index": files[e][0], "data/file_index": files[e][1], "dataset_from_index": r["dataset_from_index"], "dataset_to_index": r["dataset_to_index"], "meta/episodes/chunk_index": 0, "meta/episodes/file_index": 0}
        for c in x.dataset.camera_names:
            if (c, e) in places:
                names = ("chunk_index", "file_index", "from_timestamp", "to_timestamp")
                row |= {f"videos/observation.images.{c}/{n}": v for n, v in zip(names, places[c, e])}
        rows.append(row | stats.get(e, {}))
    path = output / "meta" / "episodes" / "chunk-000" / "file-000.parquet"
    path.parent.mkdir(parents=True, exist_ok=True)
    pd.DataFrame(rows).to_parquet(path, index=False)
    pd.DataFrame({"task_index": [i for i, _ in x.tasks]}, index=pd.Index([p for _, p in x.tasks], name="task")).to_parquet(output / "meta" / "tasks.parquet")
    names = ["min", "max", "mean", "std", *S.QUANTILES, "count"]
    long = per.select("feature", "episode_index", F.posexplode(F.arrays_zip(*names)).alias("pos", "s")).select("feature", "pos", *[F.col("s").getField(n).alias(n) for n in names])
    overall = {r.feature: statistics_of(r) for r in S.as_arrays(S.pooled(long, "feature", "pos"), "feature").orderBy("feature").collect()}
    dump(overall | pooled_images(shown), output / "meta" / "stats.json")
    per.unpersist()
    info = x.info("v3.0", True)
    dump(info | {"data_files_size_in_mb": data_mb, "video_files_size_in_mb": video_mb, "data_path": DATA, "video_path": VIDEO}, output / "meta" / "info.json")


def pooled_images(shown: dict[tuple[int, str], dict]) -> dict:
    """Image statistics of all episodes: a row an episode and camera, so pooled on the driver."""
    out = {}
    for camera in sorted({c for _, c in shown}):
        own = [s for (_, c), s in shown.items() if c == camera]
        n = [s["count"][0] for s in own]
        total = sum(n)
        merged = {"min": [], "max": [], "mean": [], "std": [], "count": [total]}
        for k in range(3):
            mean = [s["mean"][k][0][0] for s in own]
            mu = sum(a * b for a, b in zip(mean, n)) / total
            var = sum(w * (s["std"][k][0][0] ** 2 + (m - mu) ** 2) for w, s, m in zip(n, own, mean)) / total
            merged["min"].append([[min(s["min"][k][0][0] for s in own)]])
            merged["max"].append([[max(s["max"][k][0][0] for s in own)]])
            merged["mean"].append([[mu]])
            merged["std"].append([[var**0.5]])
        out[f"observation.images.{camera}"] = merged
    return out
