"""Command line: the programs as ``spark-submit`` jobs.

    spark-submit --py-files flowdetect.zip flowdetect/__main__.py stats <xml_dir>
    python -m flowdetect day <xml_dir> --day Jun14 [--csv <out>]
    python -m flowdetect each-day <xml_dir> --out <dir> [--csv <out>] [--save-models]
    python -m flowdetect all-days <xml_dir>
    python -m flowdetect ingest <xml_dir> --out <parquet_dir>

``<xml_dir>`` holds the six day files; with ``--parquet`` it is a table
written by ``ingest`` (partitioned by day). The session comes from the
submitting environment; results are shown, and written where asked.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from flowdetect.operators.stats import flow_stats
from flowdetect.plans import programs
from flowdetect.session import ensure_checkpoint_dir
from flowdetect.sources.parquet import read_flows
from flowdetect.sources.xml import read_flow_days


def _flows(spark: SparkSession, args) -> DataFrame:
    if args.parquet:
        return read_flows(spark, args.path)
    return read_flow_days(spark, args.path)


def _forest_options(args) -> dict:
    out = {"num_trees": args.trees, "seed": args.seed, "subsampling_rate": args.subsampling_rate}
    if args.max_bins:
        out["max_bins"] = int(args.max_bins) if args.max_bins != "auto" else "auto"
    if args.partitions:
        out["partitions"] = args.partitions
    if args.max_categories:
        out["max_categories"] = args.max_categories
    return out


def _show(title: str, df: DataFrame, out: str | None = None, name: str = "", n: int = 1_000) -> None:
    """Print a result, all of it up to ``n`` rows; with ``out``, write it whole as Parquet to ``<out>/<name>``."""
    if out:
        df.write.mode("overwrite").parquet(f"{out.rstrip('/')}/{name}")
    rows = df.limit(n + 1).count()
    print(title if rows <= n else f"{title} (first {n} rows; --out writes all)")
    df.show(min(rows, n), truncate=False)


def parse(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="flowdetect")
    p.add_argument("command", choices=["stats", "day", "each-day", "all-days", "ingest"])
    p.add_argument("path", help="folder of the day XML files (or a Parquet table with --parquet)")
    p.add_argument("--nodes", action="store_true", help="day, all-days: also show the forest's nodes (with --out always written)")
    p.add_argument("--partitions", type=int, help="partitions of the forest's input")
    p.add_argument("--parquet", action="store_true", help="path is a Parquet table partitioned by day")
    p.add_argument("--day", default="Jun14", help="day of the one-day program")
    p.add_argument("--out", help="output folder: the ingest table, the each-day results, or every result of the command as Parquet")
    p.add_argument("--csv", help="write the prepared table as CSV under this folder")
    p.add_argument("--save-models", action="store_true", help="each-day: also save the fitted pipelines")
    p.add_argument("--days", help="each-day: comma-separated days (default: every day in the data)")
    p.add_argument("--parallelism", type=int, help="each-day: days trained at once (default: all, at most 8)")
    p.add_argument("--trees", type=int, default=32)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--max-bins", help='a number (default 10000, all-days 20000) or "auto" (faster, coarser)')
    p.add_argument("--max-categories", type=int, help="fold rarer text values beyond this many")
    p.add_argument("--subsampling-rate", type=float, default=1.0, help="share of training rows per tree")
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    args = parse(sys.argv[1:] if argv is None else argv)
    spark = spark or SparkSession.builder.appName(f"flowdetect-{args.command}").getOrCreate()
    ensure_checkpoint_dir(spark)
    out: dict = {}

    if args.command == "ingest":
        if not args.out:
            raise SystemExit("ingest needs --out")
        table = programs.ingest_days(spark, args.path, args.out)
        out["flows"] = table
        _show("Flows per day and tag:", flow_stats(table).orderBy("day", "Tag"))
        return out

    flows = _flows(spark, args)
    if args.command == "stats":
        out["stats"] = flow_stats(flows)
        _show("Flows per day and tag:", out["stats"].orderBy("day", "Tag"), args.out, "stats")
    elif args.command in ("day", "all-days"):
        opts = _forest_options(args)
        if args.command == "day":
            run = programs.train_day(flows, args.day, csv_path=args.csv, **opts)
        else:
            run = programs.train_all_days(flows, csv_path=args.csv, **opts)
        out["run"] = run
        _show("Sample of scored test flows:", run.sample(5))
        _show("Test error:", run.test_error(), args.out, "test_error")
        _show("Feature importances:", run.importances().orderBy("rank"), args.out, "importances")
        if args.out:
            run.scored().write.mode("overwrite").parquet(f"{args.out.rstrip('/')}/scored")
        if args.nodes or args.out:
            _show("Forest nodes:", run.nodes().orderBy("tree", "node"), args.out, "nodes")
    elif args.command == "each-day":
        res = programs.train_each_day(
            flows,
            args.days.split(",") if args.days else None,
            out_path=args.out,
            csv_path=args.csv,
            save_models=args.save_models,
            parallelism=args.parallelism,
            **_forest_options(args),
        )
        out["result"] = res
        _show("Test error per day:", res.test_error().orderBy("day"))
        _show("Feature importances per day:", res.importances_wide().orderBy("day"))
    return out


if __name__ == "__main__":
    main()
