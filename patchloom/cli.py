"""Command line: `python -m patchloom.cli cover ...` and `python -m patchloom.cli stats ...`."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from .functions.bits import checkpoint
from .operators import cover, ingest, stats
from .sources import patchfile, statsfile, synthetic

SHOWN = 16


def parser() -> argparse.ArgumentParser:
    main = argparse.ArgumentParser(prog="patchloom")
    kinds = main.add_subparsers(dest="kind", required=True)
    for kind in ("cover", "stats"):
        p = kinds.add_parser(kind)
        p.add_argument("--N", type=int, default=1000, help="size of the hash pool")
        p.add_argument("--M", type=int, default=100, help="number of patches")
        p.add_argument("--K", type=int, default=30, help="mean elements of a patch")
        p.add_argument("--overlap", type=float, default=0.3)
        p.add_argument("--seed", type=int, default=1)
        at = p.add_mutually_exclusive_group()
        at.add_argument("--input", help="read this patch file instead")
        at.add_argument("--dump", help="write the synthetic patches to this file and stop")
        if kind == "cover":
            p.add_argument("--partition", choices=("patch", "element"), default="patch")
            p.add_argument("--print-solution", action="store_true")
            p.add_argument("--profile", action="store_true")
        else:
            p.add_argument("--output", help="the statistics file")
            p.add_argument("--output-limit", type=int, default=None, help="report this many hashes (default: all)")
    return main


def _occurrences(spark: SparkSession, a: argparse.Namespace, located: bool) -> DataFrame:
    if a.input:
        header = patchfile.read_header(a.input)
        if located and not header.located:
            raise patchfile.PatchFileError(f"{a.input}: statistics need locations")
        return patchfile.read_patches(spark, a.input, coords=located, located=located)
    return synthetic.generate(spark, synthetic.Parameters(a.N, a.M, a.K, a.overlap, a.seed), located)


def run(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    located = a.kind == "stats"
    if located and not a.dump and not a.output:
        print("stats needs --output (or --dump)", file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.appName("patchloom").getOrCreate()
    try:
        rows = _occurrences(spark, a, located)
        if a.dump:
            patchfile.write_patches(ingest.nest_occurrences(rows), a.dump, coords=located)
            print(f"dumped M={a.M} patches to {a.dump}")
            return 0
        began = time.time()
        return (_cover if a.kind == "cover" else _stats)(rows, a, began)
    except patchfile.PatchFileError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def _cover(rows: DataFrame, a: argparse.Namespace, began: float) -> int:
    selector = cover.PatchSelector(a.partition)
    selection = selector.select(rows)
    total = cover.summary(selection).first()
    print(f"cover\n  partition={a.partition}\n  result: selected={total['selected']} covered={total['covered']} iterations={total['iterations']}\n  timing (ms): {1000 * (time.time() - began):.0f}")
    if a.print_solution:
        ids = [str(r["patch_id"]) for r in selection.orderBy("step").limit(SHOWN + 1).collect()]
        print(f"  selected ({total['selected']}): " + " ".join(ids[:SHOWN]) + (" ..." if len(ids) > SHOWN else ""))
    if a.profile:
        print(selector.profile.report())
    return 0


def _stats(rows: DataFrame, a: argparse.Namespace, began: float) -> int:
    every = checkpoint(stats.hash_stats(stats.require_locations(rows)))
    unique = every.count()
    n = statsfile.write_stats(every if a.output_limit is None else stats.top_k(every, a.output_limit), a.output)
    print(f"stats\n  unique_hashes={unique} reported={n} limit={'all' if a.output_limit is None else a.output_limit}\n  timing (ms): {1000 * (time.time() - began):.0f}")
    return 0


if __name__ == "__main__":
    sys.exit(run())
