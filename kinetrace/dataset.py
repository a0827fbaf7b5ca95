"""The user-facing dataset: one folder of recorded episodes."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.expressions import concat_float32, has_gap, unix_seconds
from .operators import align, smooth
from .operators import frames as fr
from .sources import streams
from .sources.metadata import Metadata

KEYS = ["episode_pos", "category", "key"]


@dataclass(frozen=True)
class Sample(Mapping):
    """One grid point: its time, and the value of every stream there."""

    timestamp: float
    obs: dict
    action: dict
    cameras: dict

    _names = ("timestamp", "obs", "action", "cameras")

    def __getitem__(self, name):
        if name not in self._names:
            raise KeyError(name)
        return getattr(self, name)

    def __iter__(self):
        return iter(self._names)

    def __len__(self):
        return len(self._names)


@dataclass(frozen=True)
class Camera:
    """The frames of one camera in one episode, as a DataFrame of pointers."""

    name: str
    rows: DataFrame

    def frames(self) -> DataFrame:
        return self.rows.orderBy("t_ns", "name")

    def get_frame(self, i: int):
        return fr.frame_at(self.rows, i, ["episode_pos", "camera"], ["t_ns", "name"]).first()

    @property
    def num_frames(self) -> int:
        return self.rows.count()

    @property
    def format(self) -> str | None:
        r = self.rows.first()
        return None if r is None else "dir" if r.container is None else "tar"

    def load_timestamps(self) -> list[float]:
        return [r[0] for r in self.frames().select(unix_seconds("t_ns")).collect()]

    def read_bytes(self) -> DataFrame:
        return streams.with_bytes(self.rows.sparkSession, self.rows)

    def load(self, i: int):
        """The i-th frame as height x width x 3 in red, green, blue; the driver's JVM decodes its bytes."""
        from .functions.images import decoded_bytes

        f = self.get_frame(i)
        return decoded_bytes(self.rows.sparkSession, streams.frame_bytes(f.path, f.container, f.offset, f.size))

    def materialize(self, folder: str | os.PathLike, frame) -> str:
        """A file that holds the frame: its own where it has one, else an extracted copy in ``folder``."""
        if frame.container is None:
            return frame.path
        path = Path(folder, frame.name)
        path.write_bytes(streams.frame_bytes(frame.path, frame.container, frame.offset, frame.size))
        return str(path)


class Dataset:
    """A recorded dataset of any layout version; nothing is read but metadata until a DataFrame is asked for.

    Episodes are named by position or by their metadata entry. ``smoothing`` is a cut-off in Hz that loads use
    where they are given none; a cut-off of 0 counts as none.
    """

    def __init__(self, path: str | os.PathLike, spark: SparkSession | None = None, camera_names: list[str] | None = None, smoothing: float | None = None):
        self.spark = spark or SparkSession.builder.getOrCreate()
        #: A path, or a URI of any store that Spark reads; only what writes into the dataset needs a path.
        self.is_local = "://" not in str(path)
        self.root = str(Path(path).resolve()) if self.is_local else str(path).rstrip("/")
        self.meta = Metadata.load(self.root, self.spark)
        self._camera_names = camera_names
        self.smoothing = smoothing

    def with_smoothing(self, cutoff: float | None) -> Dataset:
        return Dataset(self.root, self.spark, self._camera_names, cutoff)

    @property
    def root_path(self) -> Path:
        if not self.is_local:
            raise ValueError(f"{self.root} is no path; this needs one that every machine mounts")
        return Path(self.root)

    def set_smoothing(self, cutoff: float | None) -> None:
        self.smoothing = cutoff

    @property
    def num_episodes(self) -> int:
        return self.meta.num_episodes

    @property
    def camera_names(self) -> list[str]:
        return list(self.meta.cameras) if self._camera_names is None else list(self._camera_names)

    def position(self, episode: int | dict) -> int:
        if isinstance(episode, dict):
            return next(i for i, e in enumerate(self.meta.episodes) if str(e["id"]) == str(episode["id"]))
        if not 0 <= episode < self.num_episodes:
            raise IndexError(episode)
        return episode

    def episode_path(self, episode: int | dict) -> Path:
        return self.root_path / "episodes" / str(self.meta.episodes[self.position(episode)]["id"])

    def chosen(self, success_only: bool = False) -> list[int]:
        return [i for i, e in enumerate(self.meta.episodes) if not success_only or e.get("success")]

    # tables

    @cached_property
    def episodes(self) -> DataFrame:
        rows = [(i, str(e["id"]), bool(e.get("success")), int(e.get("task_index", 0))) for i, e in enumerate(self.meta.episodes)]
        return self.spark.createDataFrame(rows, "episode_pos int, episode_id string, success boolean, task_index int")

    @cached_property
    def tasks(self) -> DataFrame:
        rows = [(i, t.get("prompt"), t.get("description")) for i, t in enumerate(self.meta.tasks or [])]
        return self.spark.createDataFrame(rows, "task_index int, prompt string, description string")

    def readings(self, chosen: list[int] | None = None, cutoff: float | None = None) -> DataFrame:
        return self._smoothed(streams.readings(self.spark, self.root, self.meta, chosen), cutoff)

    def _smoothed(self, rows: DataFrame, cutoff: float | None = None) -> DataFrame:
        cutoff = cutoff or self.smoothing
        return smooth.smoothed(rows, KEYS, cutoff) if cutoff else rows

    def frames(self, chosen: list[int] | None = None) -> DataFrame:
        return streams.frames(self.spark, self.root, self.meta, self.camera_names, chosen)

    def streams(self, category: str, episode: int | dict) -> list[streams.Stream]:
        """The streams an episode has by its files; state files are found by looking."""
        place = lambda c, e, part: f"{c}/{part}" if self.meta.version is None else f"{c}/{e}/{part}"
        if self.is_local:
            base = self.episode_path(episode)
            return streams.catalogue(self.meta, category, lambda *p: (base / place(*p) / "state.parquet").exists())
        folder = f"{self.root}/episodes/{self.meta.episodes[self.position(episode)]['id']}"
        states = [r.path for r in streams.listing(self.spark, [folder], "state.parquet").select("path").collect()]  # of one episode
        return streams.catalogue(self.meta, category, lambda *p: any(x.endswith(f"/{place(*p)}/state.parquet") for x in states))

    # one episode

    def _load(self, category: str, episode, use_unixtime: bool, cutoff: float | None) -> dict[str, DataFrame]:
        at = self.position(episode)
        rows = fr.only(self.readings([at], cutoff), "category", category)
        out = {}
        for s in self.streams(category, at):
            joints = self.meta.embodiments[s.embodiment].joints
            time = unix_seconds("t_ns").alias("timestamp") if use_unixtime else F.col("t_ns").alias("timestamp")
            out[s.key] = fr.named_joints(fr.only(rows, "key", s.key).orderBy("row_pos"), "values", joints, time)
        return out

    def load_obs(self, episode, use_unixtime: bool = False, cutoff: float | None = None) -> dict[str, DataFrame]:
        """Stream key to a DataFrame of ``timestamp`` (ns, or seconds) and one column a joint, in file order."""
        return self._load("obs", episode, use_unixtime, cutoff)

    def load_action(self, episode, use_unixtime: bool = False, cutoff: float | None = None) -> dict[str, DataFrame]:
        return self._load("action", episode, use_unixtime, cutoff)

    def load_camera(self, name: str, episode) -> Camera:
        if name not in self.camera_names:
            raise KeyError(name)
        return Camera(name, fr.only(self.frames([self.position(episode)]), "camera", name))

    def load_cameras(self, episode) -> dict[str, Camera]:
        return {n: self.load_camera(n, episode) for n in self.camera_names}

    @property
    def camera_format(self) -> str | None:
        """dir or tar; None without a frame; mixed formats are an error."""
        kinds = {r[0] for r in self.frames().select(F.when(F.col("container").isNull(), "dir").otherwise("tar")).distinct().collect()}
        if len(kinds) > 1:
            raise ValueError(f"cameras mix formats: {sorted(kinds)}")
        return next(iter(kinds), None)

    # alignment

    def aligned(self, hz: float, chosen: list[int] | None = None) -> DataFrame:
        """(episode_pos, kind, name, k, t, values, frame): the first reading of each stream not before each grid point."""
        if hz <= 0:
            raise ValueError("the rate must be positive")

        def long(r: DataFrame) -> DataFrame:
            return r.select("episode_pos", F.col("category").alias("kind"), F.col("key").alias("name"), F.concat("category", F.lit(":"), "key").alias("stream"), unix_seconds("t_ns").alias("src_t"), F.col("values").cast("array<double>").alias("values"), F.lit(None).cast("string").alias("frame"), F.col("row_pos").alias("pos"))

        f = self.frames(chosen)
        f = f.select("episode_pos", F.lit("camera").alias("kind"), F.col("camera").alias("name"), F.concat(F.lit("camera:"), "camera").alias("stream"), unix_seconds("t_ns").alias("src_t"), F.lit(None).cast("array<double>").alias("values"), F.col("path").alias("frame"), F.lit(0).cast("bigint").alias("pos"))
        # smoothing moves no time: ranges come from what is recorded, so nothing is filtered for them
        raw = streams.readings(self.spark, self.root, self.meta, chosen)
        recorded = long(raw).unionByName(f).select("episode_pos", "stream", "src_t")
        grid = align.with_float_grid(align.common_range(recorded, "episode_pos", "stream", "src_t"), hz)
        out = align.forward_asof(long(self._smoothed(raw)).unionByName(f), grid, "episode_pos", "stream", "src_t", ["pos", "frame"])
        return out.select("episode_pos", "kind", "name", "k", F.col("grid_t").alias("t"), "values", "frame")

    def samples(self, hz: float, chosen: list[int] | None = None) -> DataFrame:
        """(episode_pos, k, t, obs, action, cameras): one row a grid point, a map from stream to value for each kind."""
        entry = lambda kind, v: F.map_from_entries(F.filter(F.collect_list(F.when(F.col("kind") == kind, F.struct("name", v))), lambda x: x.isNotNull())).alias({"camera": "cameras"}.get(kind, kind))
        return self.aligned(hz, chosen).groupBy("episode_pos", "k", "t").agg(entry("obs", "values"), entry("action", "values"), entry("camera", "frame"))

    def sample(self, hz: float, episode) -> list[Sample]:
        """The samples of one episode in time order."""
        rows = self.samples(hz, [self.position(episode)]).orderBy("k").collect()
        return [Sample(r.t, r.obs, r.action, r.cameras) for r in rows]

    # features

    def feature_keys(self) -> list[tuple[str, list[str]]]:
        """(stream key, joint names) in the order in which vectors are put together; velocities and torques are left out."""
        out = []
        for e in self.meta.embodiments.values():
            for c in e.components or (None,):
                for a in e.attributes:
                    out.append(("/".join(x for x in (e.name, c, a) if x), [f"{c}_{j}.pos" if c else f"{j}.pos" for j in e.joints]))
        return out

    def features(self, fps: float, chosen: list[int] | None = None) -> DataFrame:
        """(episode_pos, k, action, observation.state, cameras): float vectors of all streams, one row a frame."""
        keys = [k for k, _ in self.feature_keys()]
        s = self.samples(fps, chosen)
        vector = lambda c: concat_float32(*[F.element_at(F.col(c), F.lit(k)) for k in keys])
        return s.select("episode_pos", "k", vector("action").alias("action"), vector("obs").alias("observation.state"), "cameras")

    # quality

    def gaps(self) -> DataFrame:
        """(path, rows, bad): files with a null, an empty vector or a NaN."""
        r = streams.readings(self.spark, self.root, self.meta)
        out = r.groupBy("path", "episode_pos", "category").agg(F.count("*").alias("rows"), F.sum(has_gap("values").cast("int")).alias("bad"), F.min("key_pos").alias("key_pos"))
        return out.where("bad > 0")

    def validate(self, on_error: Callable[[str], None] | None = None) -> bool:
        """Whether no sensor file has a gap; one message a bad file, observations first, in catalogue order."""
        bad = self.gaps().orderBy("episode_pos", F.desc("category"), "key_pos").collect()
        for r in bad:
            if on_error:
                on_error(f"{relative(r.path, self.root)}: includes null values")
        return not bad

    def write(self, output: str | os.PathLike, format: str | None = None, **options) -> None:
        from . import sinks

        sinks.write(self, Path(output), format, **options)


def relative(path: str, root: str) -> str:
    """A scanned file's path below the dataset."""
    from urllib.parse import unquote, urlparse

    return os.path.relpath(unquote(urlparse(path).path), root)
