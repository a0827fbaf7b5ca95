"""Commands: convert, merge, repair, validate, pack, card."""

from __future__ import annotations

import argparse
import sys

from . import maintenance, publish
from .dataset import Dataset
from .sinks.native import pack_cameras


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kinetrace")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert", help="write a dataset in another format")
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("--format", default="native", choices=["native", "lerobot_v2.1", "lerobot_v3.0", "gr00t", "rrd"])
    c.add_argument("--fps", type=int, default=30)
    c.add_argument("--smoothing-cutoff", type=float, default=1.0)
    c.add_argument("--train-split", type=float, default=0.8)
    c.add_argument("--success-only", action="store_true")
    c.add_argument("--camera-format", default="dir", choices=["dir", "tar"])
    m = sub.add_parser("merge", help="make one dataset of several")
    m.add_argument("inputs", nargs="+")
    m.add_argument("-o", "--output", required=True)
    m.add_argument("--symlink", action="store_true")
    r = sub.add_parser("repair", help="fill single gaps in sensor data")
    r.add_argument("input")
    r.add_argument("-o", "--output")
    for name, text in (("validate", "look for gaps; the exit code is 1 if there are any"), ("pack", "turn camera folders into tars"), ("card", "print a dataset card")):
        sub.add_parser(name, help=text).add_argument("input")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    error = lambda text: print(text, file=sys.stderr)
    if a.command == "merge":
        maintenance.merge(a.inputs, a.output, a.symlink)
        return 0
    d = Dataset(a.input)
    if a.command == "convert":
        options = {"native": {"camera_format": a.camera_format}, "rrd": {"fps": a.fps}}
        export = {"fps": a.fps, "train_split": a.train_split, "smoothing_cutoff": a.smoothing_cutoff, "success_only": a.success_only}
        d.write(a.output, a.format, **options.get(a.format, export))
    elif a.command == "repair":
        maintenance.repair(d, a.output, print, error)
    elif a.command == "validate":
        return 0 if d.validate(error) else 1
    elif a.command == "pack":
        pack_cameras(d)
    else:
        print(publish.card(d))
    return 0


if __name__ == "__main__":
    sys.exit(main())
