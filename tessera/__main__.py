"""Command line: run the experiment sweep on a ratings CSV.

    python -m tessera RATINGS_CSV [--two-nodes-only] [--early-configs]
        [--inferred] [--master URL] [--executor-memory 4g] [--checkpoint]
        [--out PATH [--run NAME]]

Mirrors the reference program: each configuration runs on its own, a
failing one is reported and does not stop the rest, and a summary table is
printed at the end (and written as Parquet with ``--out``, where a rerun
under the same ``--run`` replaces its rows).
"""

from __future__ import annotations

import argparse
import os
import sys

from tessera.plans import experiment
from tessera.session import build_session
from tessera.sources.csv import read_ratings_csv


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="tessera")
    ap.add_argument("ratings")
    ap.add_argument("--two-nodes-only", action="store_true")
    ap.add_argument("--early-configs", action="store_true")
    ap.add_argument("--inferred", action="store_true", help="infer CSV types, then cast by name")
    ap.add_argument("--master", default=os.environ.get("SPARK_MASTER"))
    ap.add_argument("--executor-memory", default=os.environ.get("EXECUTOR_MEMORY", "4g"))
    ap.add_argument("--split", choices=["hash", "random"], default="hash")
    ap.add_argument("--checkpoint", action="store_true", help="keep both sides in the checkpoint folder, not the cache")
    ap.add_argument("--out")
    ap.add_argument("--run", default="default")
    ap.add_argument(
        "--reference-shuffle", action="store_true", help="fixed 20 shuffle partitions, as the reference"
    )
    args = ap.parse_args(argv)

    from pyspark.sql import SparkSession

    owned = SparkSession.getActiveSession() is None
    spark = build_session(
        "tessera-als-sweep", args.master, args.executor_memory, reference_shuffle=args.reference_shuffle or args.early_configs, early=args.early_configs
    )
    mode = "inferred" if args.inferred else "explicit"
    configs = experiment.choose_configs(args.two_nodes_only, args.early_configs, args.executor_memory)
    results, phases = experiment.sweep(
        spark, lambda: read_ratings_csv(spark, args.ratings, mode=mode), configs, split=args.split,
        keep="checkpoint" if args.checkpoint else "cache",
    )
    results = results.cache()
    experiment.summary(results).show(truncate=False)
    phases.show(100, truncate=False)
    if args.out:
        experiment.save_results(results, args.out, args.run)
    failed = results.where("error IS NOT NULL").count()
    if owned:
        spark.stop()
    return 1 if failed == len(configs) else 0


if __name__ == "__main__":
    sys.exit(main())
