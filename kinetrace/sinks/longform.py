"""Long series for a viewer: one row an entity and time, a manifest of camera frames, and a description of the layout."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import entity_path
from ..operators.frames import long_series
from .common import dump

SHARES = (0.3, 0.35, 0.35)


def series(dataset, fps: float = 30) -> DataFrame:
    """(entity, timestamp, scalar) of every joint of every sampled stream."""
    joints = dataset.spark.createDataFrame([("/".join(filter(None, (e.name, c, a))), i, j) for e in dataset.meta.embodiments.values() for c in e.components or (None,) for a in (*e.attributes, "qvel", "qtorque") for i, j in enumerate(e.joints)], "name string, pos int, joint string")
    named = joints.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "joint"))), lambda x: x["joint"]).alias("joints"))
    rows = dataset.aligned(fps).where(F.col("kind") != "camera").join(F.broadcast(named), "name").join(dataset.episodes, "episode_pos")
    return long_series(rows, "values", entity_path("episode_id", "kind", "name", F.get("joints", F.col("pos"))), "t")


def camera_references(dataset, fps: float = 30) -> DataFrame:
    """(entity, timestamp, frame_nanos, path): which frame of the camera's video shows at each time."""
    rows = dataset.aligned(fps).where(F.col("kind") == "camera").join(dataset.episodes, "episode_pos")
    return rows.select(entity_path("episode_id", F.lit("camera"), "name").alias("entity"), F.col("t").alias("timestamp"), F.round(F.col("k") * F.lit(1e9 / fps)).cast("bigint").alias("frame_nanos"), F.col("frame").alias("path"))


def blueprint(dataset) -> dict:
    """A tab an episode, with columns of cameras, actions and observations."""
    tabs = []
    for i, e in enumerate(dataset.meta.episodes):
        views = lambda category: [{"kind": "time_series", "origin": f"ep{e['id']}/{category}/{s.key}", "name": f"{category}/{s.key}"} for s in dataset.streams(category, i)]  # noqa: E731, B023
        cameras = [{"kind": "spatial_2d", "origin": f"ep{e['id']}/camera/{c}", "name": f"camera/{c}"} for c in dataset.camera_names]
        tabs.append({"name": f"ep{e['id']}", "column_shares": list(SHARES), "columns": [cameras, views("action"), views("obs")]})
    return {"tabs": tabs}


def write(dataset, output: Path, application_id: str | None = None, fps: float = 30) -> None:
    """Parquet tables and the description in a folder; the viewer's own binary file needs its SDK."""
    rows = series(dataset, fps).withColumn("episode", F.split_part("entity", F.lit("/"), F.lit(1)))
    # a folder an episode; within it the entities are sorted, so a reader of one skips to it
    rows.repartition("episode").sortWithinPartitions("episode", "entity", "timestamp").write.mode("overwrite").partitionBy("episode").parquet(str(output / "series"))
    camera_references(dataset, fps).write.mode("overwrite").parquet(str(output / "cameras"))
    dump(blueprint(dataset) | {"application_id": application_id or "kinetrace"}, output / "blueprint.json")
