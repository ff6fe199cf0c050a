"""Look for plan shapes that do not scale in the final plan of every registered query.

usage: python tools/check_plans.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from emulake.plans import catalog  # noqa: E402
from emulake.session import build_session  # noqa: E402

SUSPECTS = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "Exchange SinglePartition", "CollectLimit")


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.001")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = build_session("local[4]", "plans", **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    for name, fn in catalog.QUERIES.items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        plan = fn(spark, args.sf)._jdf.queryExecution().executedPlan().toString()
        found = {s: len(re.findall(re.escape(s), plan)) for s in SUSPECTS if s in plan}
        exchanges = len(re.findall(r"Exchange (?:hash|range|RoundRobin)", plan))
        print(f"{name:40s} shuffles={exchanges} {found or ''}", flush=True)


if __name__ == "__main__":
    main()
