import atexit
import os
import shutil
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

#: A stand-in for the encoder: its video is the first 100 bytes of each frame of the list.
ENCODER = """#!/bin/sh
[ "$1" = -version ] && exit 0
while [ $# -gt 1 ]; do [ "$1" = -i ] && list=$2; shift; done
sed -n "s/^file '\\(.*\\)'$/\\1/p" "$list" | while read -r f; do head -c 100 "$f"; done > "$1"
"""
_bin = tempfile.mkdtemp(prefix="kinetrace-bin-")
atexit.register(shutil.rmtree, _bin, True)
Path(_bin, "ffmpeg").write_text(ENCODER)
Path(_bin, "ffmpeg").chmod(0o755)
os.environ["PATH"] = _bin + os.pathsep + os.environ["PATH"]
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF
