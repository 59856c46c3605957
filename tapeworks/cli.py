"""Command line: list pipelines, compress, decode, inspect."""

from __future__ import annotations

import argparse
import json
import sys

from .operators import catalog
from .schema import TapeError
from .sources import artifacts as A
from .sources import views as V


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tapeworks")
    p.add_argument("--list-pipelines", action="store_true")
    p.add_argument("command", nargs="?", choices=["compress", "decode", "inspect"])
    p.add_argument("input", nargs="?")
    p.add_argument("output", nargs="?")
    p.add_argument("--pipeline", default="std.zstd_jsonl_blocks_v1")
    p.add_argument("--view", choices=V.VIEWS, help="view of a transform or entropy artifact; header fields without it")
    p.add_argument("--stream", choices=["trades", "bookticker", "depth"], default="trades")
    a = p.parse_args(argv)
    try:
        if a.list_pipelines:
            for row in catalog.rows():
                d = dict(zip(catalog.COLUMNS, row))
                print("\t".join(d[c] for c in ("pipeline_id", "availability", "stream_scope", "representation", "entropy")))
        elif a.command == "inspect":
            with open(a.input, "rb") as f:
                data = f.read()
            print(V.view(data, a.view).rstrip("\n") if a.view else json.dumps(A.inspect(data), indent=2))
        elif a.command:
            with open(a.input, "rb") as f:
                data = f.read()
            if a.command == "compress":
                d = catalog.find(a.pipeline)
                std = a.pipeline.startswith("std.")
                data = A.write_container(data, a.stream, a.pipeline.split(".")[1].split("_")[0]) if std else A.compress(data, a.stream, None if d["entropy"] == "none" else d["entropy"])
            else:
                data = A.decompress(data)
            with open(a.output, "wb") as f:
                f.write(data)
        else:
            p.print_usage()
            return 2
    except TapeError as e:
        print(json.dumps({"status": e.status, "error": str(e)}), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
