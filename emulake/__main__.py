"""Command line: declarative runs, evaluation of stored runs, dataset reports and campaign reports."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame

from emulake.plans.evaluation import evaluate_run
from emulake.plans.reports import campaign_report, dataset_report
from emulake.plans.workflow import run_workflow
from emulake.session import build_session
from emulake.sources.readers import load_table, read_snapshot

SHOWN_ROWS = 200


def _report(df: DataFrame, out: str | None) -> None:
    """Store the whole report where ``out`` names a folder; print its head and say how many rows there are."""
    if out:
        df.write.mode("overwrite").parquet(out)
        df = df.sparkSession.read.parquet(out)
    df.show(SHOWN_ROWS, truncate=False)
    total = df.count()
    print(f"{min(total, SHOWN_ROWS)} of {total} rows shown" + (f"; all are in {out}" if out else "; --out DIR stores them all" if total > SHOWN_ROWS else ""))


def _load_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml  # optional

            return yaml.safe_load(f)
        return json.load(f)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="emulake")
    parser.add_argument("--master", help="Spark master; leave out on a cluster")
    sub = parser.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="run a specification")
    run.add_argument("spec")
    report = sub.add_parser("report", help="shape, roles, missing values and statistics of a table")
    report.add_argument("path")
    report.add_argument("--format", default="auto")
    report.add_argument("--key", nargs="*", default=[])
    report.add_argument("--metadata", help="JSON or YAML file with inputs, outputs and groups")
    campaign = sub.add_parser("campaign", help="status of a campaign snapshot")
    campaign.add_argument("path")
    judge = sub.add_parser("evaluate", help="judge the blocks of a table by a stored run")
    judge.add_argument("run", help="the run's output_dir")
    judge.add_argument("path")
    judge.add_argument("--format", default="auto")
    judge.add_argument("--row-idx", required=True)
    judge.add_argument("--block-size", type=int, required=True)
    judge.add_argument("--output")
    judge.add_argument("--key", nargs="*", default=[])
    for command in (run, report, campaign, judge):
        command.add_argument("--out", help="folder for the whole report")
    args = parser.parse_args(argv)
    spark = build_session(args.master)
    if args.command == "run":
        _report(run_workflow(spark, _load_spec(args.spec)).metrics.orderBy("model", "split"), args.out)
    elif args.command == "report":
        table = load_table(spark, args.path, args.format)
        metadata = _load_spec(args.metadata) if args.metadata else None
        _report(dataset_report(table, metadata, key=args.key), args.out)
    elif args.command == "evaluate":
        table = load_table(spark, args.path, args.format)
        judged = evaluate_run(spark, args.run, table, args.row_idx, args.block_size, args.output, args.key)
        _report(judged.orderBy("block", "model", "output"), args.out)
    else:
        _report(campaign_report(read_snapshot(spark, args.path)), args.out)


if __name__ == "__main__":
    main()
