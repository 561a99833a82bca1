"""Command line: encode and decode EXR files on this machine, and tell what a file holds.

    python -m lumengrid encode image.exr image.lg [--preset balanced]
    python -m lumengrid decode image.lg image.exr
    python -m lumengrid info image.exr|image.lg
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from . import api
from .operators import containers as K
from .sources import images as I


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lumengrid")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("encode", "decode"):
        command = commands.add_parser(name)
        command.add_argument("source", type=Path)
        command.add_argument("target", type=Path)
        if name == "encode":
            command.add_argument("--preset", choices=sorted(api.PRESETS), default="balanced")
    commands.add_parser("info").add_argument("source", type=Path)
    given = parser.parse_args(arguments)
    if given.command == "encode":
        api.encode_file(given.source, given.target, given.preset)
    elif given.command == "decode":
        api.decode_file(given.source, given.target)
    else:
        data = given.source.read_bytes()
        if data.startswith(K.FILE_MAGIC):
            print(", ".join(f"{k} {v}" for k, v in api.file_header(data).items()))
        else:
            print("height {}, width {}, channels {}".format(*I.read_exr(data).shape))
    return 0


if __name__ == "__main__":
    sys.exit(main())
