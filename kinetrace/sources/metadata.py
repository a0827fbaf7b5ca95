"""The metadata document of a dataset: a few kilobytes, read on the driver."""

from __future__ import annotations

import copy
import json
from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path

import yaml

LATEST = "0.3.0"
WRISTS = {"left_wrist": "wrist_left", "right_wrist": "wrist_right"}


@dataclass(frozen=True)
class Embodiment:
    """A part of the robot with its joints; ``components`` is empty where it has no sides."""

    name: str
    id: str
    version: str | None
    components: tuple[str, ...]
    attributes: tuple[str, ...]
    joints: tuple[str, ...]
    data: dict = field(default_factory=dict, compare=False, repr=False)


def embodiment(name: str, data: dict) -> Embodiment:
    """By the kind its id ends with: an arm pair or a cell lifter. Any other id is an error."""
    kind = str(data.get("id"))
    if kind.endswith("CellLifter"):
        parts: tuple = ((), ("elevation",), ("elevation",))
    elif kind.endswith("Arm"):
        parts = (("right", "left"), ("qpos",), (*(f"joint{k}" for k in range(1, 8)), "gripper"))
    else:
        raise ValueError(f"unknown embodiment id {kind!r} of {name!r}")
    return Embodiment(name, kind, data.get("version"), *parts, data=data)


class Metadata:
    """Typed access to ``metadata.yaml`` of any layout version; ``version`` is None for the first, unversioned one."""

    def __init__(self, data: dict):
        self.data = data

    @classmethod
    def load(cls, root: str | Path, spark=None) -> Metadata:
        """From the folder ``root``; Spark reads what no local path names."""
        if "://" in str(root):
            read = lambda name: spark.read.text(f"{root}/{name}", wholetext=True).first()[0]
        else:
            read = lambda name: Path(str(root).removeprefix("file:"), name).read_text(encoding="utf-8")
        data = yaml.safe_load(read("metadata.yaml")) or {}
        if "meta" in data:  # the unversioned layout keeps its episodes beside
            data = data["meta"]
            data["episodes"] = [json.loads(x) for x in read("episodes.jsonl").splitlines() if x.strip()]
        return cls(data)

    @property
    def version(self) -> str | None:
        return self.data.get("version")

    @property
    def operator(self):
        return self.data.get("operator")

    @property
    def operation_type(self) -> str:
        return self.data.get("operation_type", "teleop")

    @property
    def location(self):
        return self.data.get("location")

    @property
    def tasks(self) -> list[dict]:
        return self.data.get("tasks")

    @property
    def episodes(self) -> list[dict]:
        return self.data.get("episodes", [])

    @property
    def num_episodes(self) -> int:
        return len(self.episodes)

    @property
    def frequencies(self) -> dict:
        return self.data.get("frequencies", {})

    @cached_property
    def equipment(self) -> dict:
        """id, version, embodiments and perceptions, in the present form whatever the layout."""
        raw = copy.deepcopy(self.data["equipment"])
        if self.version is not None:
            return raw
        arm = raw["leader"]["arms"]["right_arm"]
        if "name" not in arm:  # its kind, a hyphen and a model
            raise ValueError("equipment.leader.arms.right_arm has no name, which tells the kind of arm")
        cameras = raw["follower"]["cameras"]
        return {k: v for k, v in raw.items() if k not in ("equipment_id", "equipment_version", "leader", "follower")} | {
            "id": raw["equipment_id"],
            "version": raw["equipment_version"],
            "embodiments": {"arms": {"id": str(arm["name"]).partition("-")[0], "version": arm["hardware_version"]}},
            "perceptions": {"cameras": {c.removeprefix("cam_"): {} for c in cameras}},
        }

    @cached_property
    def embodiments(self) -> dict[str, Embodiment]:
        return {n: embodiment(n, d) for n, d in self.equipment["embodiments"].items()}

    @property
    def cameras(self) -> dict[str, dict]:
        return (self.equipment.get("perceptions") or {}).get("cameras") or {}

    def upgraded(self) -> dict:
        """The document as the latest version writes it."""
        data = copy.deepcopy(self.data)
        data["version"] = LATEST
        if self.version is None:
            data["equipment"] = copy.deepcopy(self.equipment)
        if self.version in (None, "0.1.0") and self.cameras:
            cameras = data["equipment"]["perceptions"]["cameras"]
            data["equipment"]["perceptions"]["cameras"] = {WRISTS.get(c, c): v for c, v in cameras.items()}
        return data

    def write(self, output: str | Path) -> None:
        write_document(self.upgraded(), output)


def write_document(data: dict, output: str | Path) -> None:
    output = Path(output)
    output.mkdir(parents=True, exist_ok=True)
    (output / "metadata.yaml").write_text(yaml.safe_dump(data), encoding="utf-8")
