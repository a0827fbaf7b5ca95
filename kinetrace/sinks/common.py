"""What the training layouts share: the frame table, per-episode statistics, descriptions of features."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cached_property
from itertools import groupby
from pathlib import Path
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import images
from ..operators import episodes as E
from ..operators import frames as fr
from ..operators import stats as S
from ..sources.streams import as_files, frame_bytes
from . import video

CHUNK = 1000
FRAME_SCHEMA = pa.schema([("action", pa.list_(pa.float32())), ("observation.state", pa.list_(pa.float32())), ("timestamp", pa.float64()), *((c, pa.int64()) for c in ("frame_index", "episode_index", "index", "task_index", "success", "last_frame_index"))])
SCALARS = ("timestamp", "frame_index", "episode_index", "index", "task_index", "success", "last_frame_index")


def runs(batches, keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """(key, rows) of rows that come one after another with equal first columns; nothing is held but a batch."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    return groupby(rows, key=lambda r: r[:keys])


def counted(n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])


class Export:
    """The frames of the kept episodes, numbered anew; ``close`` gives back what it keeps.

    Videos need ``encoder`` on every executor, or it is an error before anything is written. With ``videos`` False
    none are made, and ``meta/frames`` has the frames that they would show.
    """

    def __init__(self, dataset, output: Path, fps: float = 30, train_split: float = 0.8, smoothing_cutoff: float | None = 1.0, success_only: bool = False, videos: bool = True, encoder: str = "ffmpeg"):
        if not 0 <= train_split <= 1:
            raise ValueError("train_split must lie in 0..1")
        if fps <= 0:
            raise ValueError("fps must be positive")
        self.dataset = dataset.with_smoothing(smoothing_cutoff)
        self.output, self.fps, self.train_split = output, fps, train_split
        chosen = self.dataset.chosen(success_only)
        if not chosen:
            raise ValueError("there are no episodes to write")
        self.program = encoder if videos and dataset.camera_names else None
        if self.program:
            video.require(dataset.spark, self.program)
        self.vectors = vectors = self.dataset.features(fps, chosen).persist()
        lengths = vectors.groupBy("episode_pos").agg(F.count(F.lit(1)).alias("length"))
        kept = self.dataset.episodes.join(lengths, "episode_pos")  # episodes without a sample are left out
        table = E.global_index(E.episode_remap(kept, "episode_pos"), "episode_index", "length")
        table = table.join(E.task_remap(kept, "task_index"), "task_index")
        self.table = fr.with_task(table, self.dataset.tasks, "task_index", "task_index", F.col("prompt")).persist()
        self.rows = [r.asDict() for r in self.table.orderBy("episode_index").collect()]  # metadata: one an episode
        self.frames = vectors.join(F.broadcast(self.table) if len(self.rows) < 100_000 else self.table, "episode_pos").select(
            F.col("action"), F.col("`observation.state`"), (F.col("k") / F.lit(float(fps))).alias("timestamp"), F.col("k").alias("frame_index"),
            F.col("episode_index"), (F.col("dataset_from_index") + F.col("k")).alias("index"), F.col("new_task_index").alias("task_index"),
            F.col("success").cast("bigint").alias("success"), (F.col("length") - 1).alias("last_frame_index"), "cameras", "episode_pos",
        )

    def close(self) -> None:
        self.vectors.unpersist()
        if "_shown" in self.__dict__:
            self._shown.unpersist()
        self.table.unpersist()

    @property
    def joint_names(self) -> list[str]:
        return [j for _, names in self.dataset.feature_keys() for j in names]

    @property
    def tasks(self) -> list[tuple[int, str]]:
        return sorted({(r["new_task_index"], r["prompt"]) for r in self.rows})

    @cached_property
    def _shown(self) -> DataFrame:
        long = self.frames.select("episode_index", "episode_pos", F.col("frame_index").alias("k"), F.explode("cameras").alias("camera", "path"))
        pointers = self.dataset.frames([r["episode_pos"] for r in self.rows]).select("path", "container", "offset", "size", "episode_pos", "camera")
        return long.join(pointers, ["episode_pos", "camera", "path"]).drop("episode_pos").persist()

    def shown(self) -> DataFrame:
        """(episode_index, camera, k, path, container, offset, size): the frame that each row shows of each camera."""
        return self._shown

    def check_cameras(self) -> None:
        """An error unless every episode shows a frame of each camera in each row."""
        if not self.dataset.camera_names:
            return
        cameras = F.explode(F.array(*map(F.lit, self.dataset.camera_names))).alias("camera")
        data = self.table.select("episode_index", cameras, F.col("length").alias("data_frames"))
        video_ = self.shown().groupBy("episode_index", "camera").agg(F.count("*").alias("video_frames"))
        bad = fr.frame_guard(data, video_, ["episode_index", "camera"]).where(~F.col("consistent")).join(self.table.select("episode_index", "episode_pos"), "episode_index")
        if r := bad.orderBy("episode_index", "camera").first():
            raise ValueError(f"camera {r.camera!r} of episode {r.episode_pos} has {r.video_frames} video frames, but its data has {r.data_frames} rows")

    def statistics(self, *keys: str) -> DataFrame:
        """(keys, feature, min.., count as arrays): vectors by place, scalars as one-element arrays; one pass over the frames."""
        entry = lambda name, i, x: F.struct(F.lit(name).alias("feature"), i.alias("pos"), x.cast("double").alias("x"))
        places = lambda c: F.transform(F.col(f"`{c}`"), lambda x, i: entry(c, i, x))
        vectors = [places("action"), places("observation.state")]
        scalars = F.array(*[entry(c, F.lit(0), F.col(c)) for c in SCALARS])
        long = self.frames.select(*keys, F.explode(F.concat(*vectors, scalars)).alias("e")).select(*keys, "e.*")
        described = S.described(long, F.col("x"), [*keys, "feature", "pos"], sum(r["length"] for r in self.rows))
        return S.as_arrays(described, *keys, "feature")

    @contextmanager
    def decoded(self, shown: DataFrame):
        """``shown`` with height, width, channels and data; the JVM decodes files, so the frames are copied to the output meanwhile."""
        folder = self.output.resolve() / f"frames-{uuid4().hex}"
        try:
            files = as_files(self.dataset.spark, shown, str(folder))
            name = lambda c: F.element_at(F.split(c, "/"), -1)
            data = images.decoded(self.dataset.spark, str(folder)) if folder.is_dir() else self.dataset.spark.createDataFrame([], images.DECODED)
            yield files.withColumn("file", name(F.col("file"))).drop("path").join(data.withColumn("file", name(F.col("path"))).drop("path"), "file")
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    def image_statistics(self) -> dict[tuple[int, str], dict]:
        """{(episode, camera): statistics} of evenly spread frames."""
        if not self.dataset.camera_names:
            return {}
        shown = images.chosen_frames(self.shown(), ["episode_index", "camera"], "k")
        frames = shown.groupBy("episode_index", "camera").agg(F.count("*").alias("frames"))
        out: dict = {}
        with self.decoded(shown) as both:
            d = images.describe(both, ["episode_index", "camera"])
            for r in d.join(frames, ["episode_index", "camera"]).orderBy("channel").collect():
                own = out.setdefault((r.episode_index, r.camera), {n: [] for n in ("min", "max", "mean", "std")} | {"count": [r.frames]})
                for n in ("min", "max", "mean", "std"):
                    own[n].append([[r[n]]])
        return out

    def image_shapes(self) -> dict[str, tuple[int, int]]:
        """{camera: (height, width)} by the first frame of the first episode."""
        if not self.dataset.camera_names:
            return {}
        with self.decoded(self.shown().where((F.col("episode_index") == 0) & (F.col("k") == 0))) as first:
            sizes = {r.camera: (r.height, r.width) for r in first.select("camera", "height", "width").collect()}
        return {c: sizes[c] for c in self.dataset.camera_names if c in sizes}

    def feature_description(self, with_fps: bool) -> dict:
        extra = {"fps": self.fps} if with_fps else {}
        out = {c: {"dtype": "float32", "names": self.joint_names, "shape": [len(self.joint_names)]} | extra for c in ("action", "observation.state")}
        for c in ("timestamp", "frame_index", "episode_index", "index", "task_index", "success", "last_frame_index"):
            out[c] = {"dtype": "float64" if c == "timestamp" else "int64", "shape": [1], "names": None} | extra
        for camera, (h, w) in self.image_shapes().items():
            info = {"height": h, "width": w, "codec": video.CODEC, "pix_fmt": video.PIXELS, "is_depth_map": False, "fps": self.fps, "channels": 3}
            out[f"observation.images.{camera}"] = {"dtype": "video", "shape": [h, w, 3], "names": ["height", "width", "channels"], "info": {f"video.{k}": v for k, v in info.items()} | {"has_audio": False}}
        return out

    def info(self, version: str, with_fps: bool) -> dict:
        n = len(self.rows)
        end = round(n * self.train_split)
        kinds = [e for e in self.dataset.meta.embodiments.values() if e.components]
        robot = kinds[0].id.lower() + ("_bimanual" if len(kinds[0].components) == 2 else "") if kinds else None
        return {
            "codebase_version": version, "robot_type": robot, "total_episodes": n, "total_frames": sum(r["length"] for r in self.rows), "total_tasks": len(self.tasks),
            "chunks_size": CHUNK, "fps": self.fps, "splits": {"train": f"0:{end}"} | ({"val": f"{end}:{n}"} if end < n else {}), "features": self.feature_description(with_fps),
        }

    def video_ratios(self) -> dict[str, float]:
        """{camera: what a video needs of its frames' bytes}, measured by encoding the first episode once."""
        fps, program = self.fps, self.program

        def run(batches):
            for (camera,), rows in runs(batches, 1):
                rows = list(rows)  # pointers of one episode
                with tempfile.TemporaryDirectory() as folder:
                    video.encode((frame_bytes(*r[2:]) for r in rows), fps, Path(folder, "first.mp4"), program)
                    needs = os.path.getsize(f"{folder}/first.mp4") / max(1, sum(r[-1] for r in rows))
                yield pa.RecordBatch.from_arrays([pa.array([camera]), pa.array([needs])], ["camera", "needs"])

        first = self.shown().where(F.col("episode_index") == 0).select("camera", "k", "path", "container", "offset", "size")
        found = first.repartition("camera").sortWithinPartitions("camera", "k").mapInArrow(run, "camera string, needs double")
        return {r.camera: r.needs for r in found.collect()}

    def video_places(self, limit_mb: float) -> dict[tuple[str, int], tuple[int, int, float, float]]:
        """{(camera, episode): (chunk, file, from, to)}: a camera's episodes one after another in files of some size.

        A row an episode and camera, so folded on the driver. The first episode's ratio stands for all, as files
        are encoded side by side and none can wait for the size of another.
        """
        ratios = self.video_ratios()
        sizes = fr.frame_totals(self.shown(), ["camera", "episode_index"], F.col("size")).orderBy("camera", "episode_index")
        out, last = {}, None
        for r in sizes.toLocalIterator():
            mb = r["bytes"] * ratios.get(r.camera, 1.0) / 2**20
            if r.camera != last:
                last, seq, held, before = r.camera, 0, 0.0, 0
            elif held + mb >= limit_mb:
                seq, held, before = seq + 1, 0.0, 0
            out[r.camera, r.episode_index] = (seq // CHUNK, seq % CHUNK, before / self.fps, (before + r.num_frames) / self.fps)
            held, before = held + mb, before + r.num_frames
        return out

    def videos(self, output: Path, place: str, places: dict | None = None) -> None:
        """An MP4 for each camera and episode, or for each camera and file of ``places``; ``place`` formats chunk, key and file.

        One task encodes one file at a time and reads its frames one after another.
        """
        shown = self.shown()
        if self.program is None:
            shown.write.mode("overwrite").parquet(str(output / "meta" / "frames"))
            return
        if places is None:
            shown = shown.withColumns({"chunk": F.floor(F.col("episode_index") / CHUNK).cast("bigint"), "file": F.col("episode_index")})
        else:
            table = self.dataset.spark.createDataFrame([(c, e, v[0], v[1]) for (c, e), v in places.items()], "camera string, episode_index bigint, chunk bigint, file bigint")
            shown = shown.join(table, ["camera", "episode_index"])
        fps, base, program = self.fps, str(output.resolve()), self.program

        def run(batches):
            for (camera, chunk, file), rows in runs(batches, 3):
                video.encode((frame_bytes(*r[5:]) for r in rows), fps, Path(base, place.format(chunk=chunk, key=f"observation.images.{camera}", file=file)), program)
                yield counted(1)

        file = ["camera", "chunk", "file"]
        rows = shown.select(*file, "episode_index", "k", "path", "container", "offset", "size")
        rows.repartition(*file).sortWithinPartitions(*file, "episode_index", "k").mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


#: Grouped maps can't take a column name with a dot.
_PLAIN = {"observation.state": "state"}


def plain(frames: DataFrame, *more: str) -> DataFrame:
    return frames.select(*[F.col(f"`{c}`").alias(_PLAIN.get(c, c)) for c in FRAME_SCHEMA.names], *more)


def layout(table: pa.Table, order: str) -> pa.Table:
    """A group's rows in order, with the columns of the layout."""
    table = table.sort_by(order).select([_PLAIN.get(c, c) for c in FRAME_SCHEMA.names])
    return table.rename_columns(FRAME_SCHEMA.names).cast(FRAME_SCHEMA)


def dump(value, path: Path, lines: bool = False) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    text = "".join(json.dumps(v, ensure_ascii=False) + "\n" for v in value) if lines else json.dumps(value, ensure_ascii=False, indent=4)
    path.write_text(text, encoding="utf-8")


def digits(x: float | None) -> float | None:
    """Twelve significant digits: those after them follow the order in which tasks happen to add."""
    return None if x is None else float(f"{x:.12g}")


def statistics_of(row) -> dict:
    """One feature's arrays as lists; the count is one number."""
    d = row.asDict()
    return {n: list(map(digits, d[n])) for n in ("min", "max", "mean", "std")} | {"count": [int(d["count"][0])]} | {q: list(map(digits, d[q])) for q in S.QUANTILES}
