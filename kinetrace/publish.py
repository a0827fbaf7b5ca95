"""What a dataset needs to be published: tars instead of folders, and a card. Uploading is left to a publisher."""

from __future__ import annotations

from pathlib import Path
from typing import Protocol

import yaml

from .sinks.native import pack_cameras

IGNORED = ("*.jpeg", "*.jpg", "*.png")


class Publisher(Protocol):
    def publish(self, folder: Path, repository: str, ignore: tuple[str, ...], tags: list[str]) -> None: ...


def card(dataset, license: str | None = None, tags: list[str] | None = None, description: str = "", **fields: str) -> str:
    """The card's text: a YAML head, and sections with the metadata as it is."""
    head = {"license": license, "tags": ["robotics", *(tags or [])], "task_categories": ["robotics"]}
    head = {k: v for k, v in head.items() if v}
    if dataset.camera_names:
        head["configs"] = [{"config_name": c, "data_files": f"episodes/*/cameras/{c}.tar"} for c in dataset.camera_names]
    more = "[More Information Needed]"
    metadata = (dataset.root_path / "metadata.yaml").read_text(encoding="utf-8")
    return f"""---
{yaml.safe_dump(head, sort_keys=False)}---

## Dataset Description

{description}

- **Homepage:** {fields.get("url", more)}
- **Paper:** {fields.get("paper", more)}
- **License:** {license or more}

## Dataset Structure

[metadata.yaml](metadata.yaml):
```yaml
{metadata}
```

## Citation

**BibTeX:**

```bibtex
{fields.get("citation", more)}
```
"""


def publish(dataset, repository: str, publisher: Publisher, tags: list[str] | None = None, **fields) -> None:
    """Pack cameras kept as folders, write ``README.md`` and hand the folder over."""
    if dataset.camera_format == "dir":
        pack_cameras(dataset)
    (dataset.root_path / "README.md").write_text(card(dataset, tags=tags, **fields), encoding="utf-8")
    publisher.publish(dataset.root_path, repository, IGNORED, tags or [])
