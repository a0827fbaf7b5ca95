"""MP4 files of frame sequences through an external encoder."""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from collections.abc import Iterable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession

CODEC, PIXELS = "h264", "yuv420p"


def usable(program: str) -> bool:
    """Whether this machine has the encoder and it runs."""
    if not (found := shutil.which(program)):
        return False
    return subprocess.run([found, "-version"], stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL).returncode == 0


def require(spark: SparkSession, program: str) -> None:
    """An error unless the executors have the encoder: looked for where the videos will be made."""

    def look(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([usable(program)] * b.num_rows)], ["ok"])

    n = spark.sparkContext.defaultParallelism
    if spark.range(n, numPartitions=n).mapInArrow(look, "ok boolean").where("not ok").take(1):
        raise RuntimeError(f"videos need {program}, which an executor does not have; install it there and put it on PATH, or pass videos=False")


def quoted(path: str) -> str:
    """A path as the encoder's list file wants it."""
    return "'" + path.replace("'", "'\\''") + "'"


def encode(frames: Iterable[bytes], fps: float, output: Path, program: str = "ffmpeg") -> None:
    """Encode JPEG frames at a constant rate; no frames, no file. One frame is in memory at a time."""
    with tempfile.TemporaryDirectory() as folder:
        lines = []
        for i, data in enumerate(frames):
            path = Path(folder, f"{i:08d}.jpeg")
            path.write_bytes(data)
            lines += [f"file {quoted(str(path))}", f"duration {1 / fps:.9f}"]
        if not lines:
            return
        output.parent.mkdir(parents=True, exist_ok=True)
        Path(folder, "list.txt").write_text("\n".join(lines) + "\n")
        call = [program, "-y", "-loglevel", "error", "-f", "concat", "-safe", "0", "-i", f"{folder}/list.txt", "-r", str(fps), "-c:v", "libx264", "-preset", "veryfast", "-pix_fmt", PIXELS, str(output)]
        subprocess.run(call, check=True)
