"""Command line: ``python -m clusterloom --algo ikc-2 --input-edgelist e.csv --output-dir out --run-stats``."""

from __future__ import annotations

import argparse
import logging
import re
import sys

from pyspark.sql import SparkSession

from clusterloom.plans.config import parse_algorithm, routes
from clusterloom.plans.runner import WEEK, Runner, Settings

_UNITS = {"": 1, "s": 1, "m": 60, "h": 3600, "d": 86400}


def seconds(text: str) -> float:
    """``90``, ``90s``, ``5m``, ``2h`` or ``7d``."""
    m = re.fullmatch(r"([0-9]+(?:\.[0-9]+)?)([smhd]?)", text)
    if not m:
        raise argparse.ArgumentTypeError(f"no duration: {text!r}")
    return float(m[1]) * _UNITS[m[2]]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="clusterloom")
    p.add_argument("--algo", required=True)
    p.add_argument("--input-edgelist")
    p.add_argument("--output-dir")
    p.add_argument("--input-gt-clustering")
    p.add_argument("--network", default="")
    p.add_argument("--generator", default="")
    p.add_argument("--gt-clustering-id", default="")
    p.add_argument("--run-id", default="")
    p.add_argument("--real", action="store_true")
    p.add_argument("--synthetic", action="store_true")
    p.add_argument("--criterion", default="")
    p.add_argument("--seed", type=int, default=1234)
    p.add_argument("--weighted", action="store_true", help="the third column of the edge list is a weight")
    p.add_argument("--n-iterations", type=int, default=2, help="runs of Leiden, each from the one before; below one: until nothing changes")
    p.add_argument("--timeout", type=seconds, default=WEEK)
    for flag in ("stats", "acc", "cc", "wcc", "cm"):
        p.add_argument(f"--run-{flag}", action="store_true")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    parse_algorithm(a.algo)  # before any job
    found = routes(edges=a.input_edgelist, out_dir=a.output_dir, real=a.real, synthetic=a.synthetic, network=a.network, generator=a.generator, gt_id=a.gt_clustering_id, run_id=a.run_id, truth=a.input_gt_clustering)
    refinements = tuple(r for r in ("cc", "wcc", "cm") if getattr(a, f"run_{r}"))
    settings = Settings(a.run_stats, a.run_acc, refinements, a.criterion, a.seed, a.timeout, a.weighted, a.n_iterations)
    report = Runner(spark or SparkSession.builder.appName("clusterloom").getOrCreate(), found, settings).run(a.algo)
    for folder, state in report.steps.items():
        print(f"{state}\t{folder}")
    return int(any(s.startswith("failed") for s in report.steps.values()))


if __name__ == "__main__":
    sys.exit(main())
