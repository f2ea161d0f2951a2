"""python -m voxlake.cli compress|decompress: .npy label volumes to and from the palette codec. Sources are kept."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

import numpy as np

from voxlake.functions import codec


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="voxlake")
    p.add_argument("action", choices=("compress", "decompress"))
    p.add_argument("files", nargs="+", type=Path)
    p.add_argument("--block", type=lambda s: tuple(map(int, s.split(","))), default=(8, 8, 8))
    p.add_argument("--shape", type=lambda s: tuple(map(int, s.split(","))), help="needed to decompress")
    p.add_argument("--dtype", choices=("uint32", "uint64"), default="uint64")
    a = p.parse_args(args)
    for f in a.files:
        if a.action == "compress":
            f.with_suffix(f.suffix + ".pal").write_bytes(codec.compress(np.load(f), a.block))
        elif a.shape is None:
            p.error("--shape is needed")
        else:
            np.save(f.with_suffix(""), codec.decompress(f.read_bytes(), a.shape, a.dtype, a.block))
    return 0


if __name__ == "__main__":
    sys.exit(main())
