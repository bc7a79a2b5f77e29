"""Command line: extract a network, filter it to a tissue, run the study.

    python -m graphsieve.plans.cli extract --links L --info I --threshold 700 --output O
    python -m graphsieve.plans.cli filter --input O --output P --expression G [--tissue Liver]
    python -m graphsieve.plans.cli run --config study.json [--step N | --only N | --validate | --list]
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..sources import readers, sinks
from . import runner
from .study import Study, steps


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphsieve")
    sub = p.add_subparsers(dest="command", required=True)
    extract = sub.add_parser("extract")
    for name in ("links", "info", "output"):
        extract.add_argument(f"--{name}", required=True)
    extract.add_argument("--threshold", type=int, choices=(700, 900), required=True)
    keep = sub.add_parser("filter")
    for name in ("input", "output", "expression"):
        keep.add_argument(f"--{name}", required=True)
    keep.add_argument("--tissue", default="Liver")
    run = sub.add_parser("run")
    run.add_argument("--config", required=True)
    one = run.add_mutually_exclusive_group()
    one.add_argument("--step", type=int)
    one.add_argument("--only", type=int)
    one.add_argument("--validate", action="store_true")
    one.add_argument("--list", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("graphsieve").getOrCreate()
    if args.command == "extract":
        sinks.parquet(graph.extract(readers.edges(spark, args.links), readers.names(spark, args.info), args.threshold), args.output)
        return 0
    if args.command == "filter":
        e = readers.graph(spark, args.input)
        keep = readers.expressed(spark, args.expression, args.tissue).select(F.col("gene").alias("node"))
        sinks.parquet(graph.induced(e, graph.filter_to(e, graph.nodes_of(e), keep)), args.output)
        return 0
    raw = json.loads(Path(args.config).read_text())
    all_steps = steps(Study(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()}))
    if args.list:
        for s in all_steps:
            print(f"{s.number:3} {s.name}")
        return 0
    only = next(s.number for s in all_steps if s.name == "validate") if args.validate else args.only
    done = runner.run(spark, all_steps, args.step, only)
    for o in done:
        print(f"{o.number:3} {o.name}: {o.status}, {o.seconds:.1f} s {o.error}")
    return 0 if runner.succeeded(done) else 1


if __name__ == "__main__":
    raise SystemExit(main())
