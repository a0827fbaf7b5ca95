"""Writers of training layouts."""

from __future__ import annotations

from pathlib import Path


def write(dataset, output: Path, format: str | None = None, **options) -> None:
    """Dispatch by format: native (also None), lerobot_v2.1, lerobot_v3.0, gr00t or rrd."""
    from . import episodic, longform, native, packed

    known = {None: native.write, "native": native.write, "lerobot_v2.1": episodic.write, "lerobot_v3.0": packed.write, "gr00t": episodic.write_gr00t, "rrd": longform.write}
    if format not in known:
        raise ValueError(f"unknown format {format!r}")
    known[format](dataset, output, **options)
