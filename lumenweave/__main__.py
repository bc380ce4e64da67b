"""Command surface: `python -m lumenweave filters | queries | plan SPEC... | run QUERY DIR [--out PATH]`.

Exit codes: 0 done, 1 the query failed, 2 the command is wrong.
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    from lumenweave import catalog
    from lumenweave.plans import filters

    p = argparse.ArgumentParser("lumenweave", description="Queries over frames, measurements and tables.")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("filters", help="filters and their parameters")
    sub.add_parser("queries", help="names of queries")
    plan = sub.add_parser("plan", help="check a chain and print the frames it gives")
    plan.add_argument("specs", nargs="+")
    plan.add_argument("--video", default="64x64:yuv420p8", help="WxH:format of the input")
    run = sub.add_parser("run", help="run a query over a folder of tables")
    run.add_argument("query", choices=sorted(catalog.QUERIES), metavar="QUERY")
    run.add_argument("dir")
    run.add_argument("--out", help="folder for Parquet; else rows are shown")
    a = p.parse_args(argv)
    if a.command == "filters":
        print("pattern=" + "|".join(filters.PATTERNS))
        for name, kind in filters.FILTERS.items():
            print(name + ("=" + ":".join(f"{k}=<{v}..>" for k, v in kind.least.items()) if kind.least else ""))
        return 0
    if a.command == "queries":
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    if a.command == "plan":
        try:
            size, _, fmt = a.video.partition(":")
            w, _, h = size.lower().partition("x")
            if not (w.isdigit() and h.isdigit()):
                raise filters.FilterError(f"no such size: {size}")
            info = filters.FrameInfo(int(w), int(h), fmt)
            _, transforms = filters.chain(a.specs, has_input=not a.specs[0].startswith("pattern"))
            out = filters.output_info(info, transforms)
        except filters.FilterError as e:
            print(e, file=sys.stderr)
            return 2
        print(f"{out.width}x{out.height}:{out.format}")
        return 0
    from pyspark.sql import SparkSession

    df = None
    try:
        df = catalog.QUERIES[a.query](SparkSession.builder.getOrCreate(), a.dir)
        if a.out:
            df.write.parquet(a.out)
        else:
            df.show(50, truncate=False)
    except Exception as e:  # the command reports any failure by its code
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
