"""Small recordings in all four layouts, made by rule."""

from __future__ import annotations

import json
import tarfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import yaml

START = 1772010251614229214
FRAMES = {
    "ceiling": [1772010251619682157, 1772010251629083055, 1772010251663250683],
    "head": [1772010251618790832, 1772010251629774985, 1772010251663461200],
    "wrist_left": [1772010251620214727, 1772010251653000000, 1772010251686000000],
    "wrist_right": [1772010251610000000, 1772010251628789283, 1772010251664000000],
}
TASKS = [{"prompt": "Run test.", "description": "Longer task description if need."}]
EPISODES = [{"id": "0", "success": False, "task_index": 0}, {"id": "3", "success": True, "task_index": 0}]


def jpeg(spark, height: int, width: int, rgb: tuple[int, int, int]) -> bytes:
    """A JPEG of one colour, by the JVM."""
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(width, height, 5)
    g = image.createGraphics()
    g.setColor(jvm.java.awt.Color(*rgb))
    g.fillRect(0, 0, width, height)
    g.dispose()
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(image, "jpeg", out)
    return bytes(out.toByteArray())


def series(n: int, width: int, seed: int, start: int = START, step: int = 4_000_000) -> tuple[list[int], np.ndarray]:
    x = np.random.default_rng(seed).normal(0, 0.05, (n, width)).cumsum(0).astype(np.float32)
    return [start + 1000 * seed + k * step for k in range(n)], x


def table(t: list[int], **columns: np.ndarray) -> pa.Table:
    names = ["timestamp", *columns]
    arrays = [pa.array(t, pa.timestamp("ns")), *(pa.array(list(v), pa.list_(pa.float32())) for v in columns.values())]
    return pa.table(arrays, names)


def put(t: pa.Table, path: Path) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(t, path)


def frequencies(lifter: bool) -> dict:
    arms = {"arms": {"left": 250.0, "right": 250.0}} | ({"lifter": 250.0} if lifter else {})
    return {"action": dict(arms), "obs": dict(arms), "cameras": {c: 30.303030303030305 for c in FRAMES}}


def write(spark, root: Path, version: str | None, cameras: str = "dir", tasks=TASKS, episodes=EPISODES, size=(60, 96)) -> Path:
    """One dataset; ``cameras`` is dir or tar."""
    root.mkdir(parents=True)
    kind = "Test" + "Arm"
    if version is None:
        arm = {"name": f"{kind}-R1", "hardware_version": "1.2"}
        equipment = {"equipment_id": "Test", "equipment_version": "1.0", "leader": {"arms": {"right_arm": arm, "left_arm": arm}}, "follower": {"arms": {}, "cameras": {f"cam_{c}": {} for c in ("left_wrist", "right_wrist", "ceiling", "head")}}}
        meta = {"meta": {"location": "Test", "operator": "Tester", "tasks": tasks, "equipment": equipment}}
        (root / "episodes.jsonl").write_text("".join(json.dumps(e) + "\n" for e in episodes))
    else:
        parts = {"arms": {"id": kind, "version": "2.0"}}
        if version == "0.3.0":
            parts["lifter"] = {"id": kind + "CellLifter", "version": "1.0", "stroke": 300}
        meta = {"version": version, "location": "Test", "operator": "Tester", "tasks": tasks, "episodes": episodes, "equipment": {"id": "Test", "version": "1.0", "embodiments": parts, "perceptions": {"cameras": {c: {} for c in FRAMES}}}}
        if version != "0.1.0":
            meta |= {"operation_type": "teleop", "frequencies": frequencies(version == "0.3.0")}
    (root / "metadata.yaml").write_text(yaml.safe_dump(meta, sort_keys=False))
    value = "value" if version in ("0.2.0", "0.3.0") else "positions"
    pictures = {c: jpeg(spark, *size, (200, 50, 10 + 40 * k)) for k, c in enumerate(FRAMES)}
    for e in episodes:
        base = root / "episodes" / str(e["id"])
        for k, side in enumerate(("right", "left")):
            for category, n in (("obs", 746 - k), ("action", 90)):
                folder = base / category / (f"{side}_arm" if version is None else f"arms/{side}")
                t, x = series(n, 8, 1 + k + 10 * (category == "obs"))
                if version == "0.3.0" and category == "obs":
                    put(table(t, qpos=x, qvel=x * np.float32(0.1), qtorque=x * np.float32(0.01)), folder / "state.parquet")
                else:
                    put(table(t, **{value: x}), folder / "qpos.parquet")
        if version == "0.3.0":
            for category, n in (("obs", 745), ("action", 90)):
                t, x = series(n, 1, 5 + 10 * (category == "obs"))
                put(table(t, value=x), base / category / "lifter" / "elevation.parquet")
        for c, times in FRAMES.items():
            folder = base / "cameras" / c
            if version is None:
                folder = base / ({"wrist_left": "left_image", "wrist_right": "right_image"}.get(c, f"{c}_image"))
            folder.mkdir(parents=True)
            for x in times:
                (folder / f"{x}.jpeg").write_bytes(pictures[c])
            if cameras == "tar":
                with tarfile.open(f"{folder}.tar", "w") as tar:
                    for f in sorted(folder.iterdir(), reverse=True):
                        tar.add(f, f.name)
                        f.unlink()
                folder.rmdir()
    return root


def break_cells(path: Path, column: str, cells: dict) -> None:
    """Replace whole cells (a value for the cell) or elements (a dict of element to value)."""
    t = pq.read_table(path)
    values = t.column(column).to_pylist()
    for i, v in cells.items():
        if isinstance(v, dict):
            for j, x in v.items():
                values[i][j] = x
        else:
            values[i] = v
    at = t.column_names.index(column)
    pq.write_table(t.set_column(at, t.schema.field(at), pa.array(values, t.schema.field(at).type)), path)
