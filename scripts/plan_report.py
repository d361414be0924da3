"""Physical-plan summary of every registered query (docs/PLANS.md).

For each query: shuffles (Exchange hashpartitioning / range / single), broadcast
exchanges, join kinds, windows and partial window-group limits, generators,
Python evaluation, and the parquet scans' pushed filters and read schemas.
usage: python scripts/plan_report.py [sf_dir [query ...]] > docs/PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stereoscope.plans import catalog  # noqa: E402
from stereoscope.session import get_session  # noqa: E402

COUNTS = [
    ("shuffles", r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange RoundRobin"),
    ("single-partition", r"Exchange SinglePartition"),
    ("broadcasts", r"BroadcastExchange"),
    ("BHJ", r"BroadcastHashJoin"),
    ("SMJ", r"SortMergeJoin"),
    ("BNLJ", r"BroadcastNestedLoopJoin|CartesianProduct"),
    ("hash aggs", r"HashAggregate\(keys=\[[^\]]"),
    ("windows", r"^\s*[:+\- ]*Window \["),
    ("group limits", r"WindowGroupLimit"),
    ("generators", r"Generate "),
    ("python", r"MapInPandas|ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas"),
]


def summarize(plan: str) -> dict:
    out = {}
    for name, pat in COUNTS:
        out[name] = len(re.findall(pat, plan, flags=re.M))
    scans = re.findall(r"FileScan parquet [^\[]*\[([^\]]*)\][^\n]*?PushedFilters: \[([^\]]*)\]", plan)
    out["scans"] = "; ".join(f"cols=({c}) pushed=[{p}]" for c, p in scans)
    return out


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", 8, extra={"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    print("# Physical plans of the registered queries\n")
    print(f"Initial physical plans (before AQE re-planning) at `{sf_dir}`, produced by "
          "`scripts/plan_report.py`. Broadcasts here are the explicit, size-checked spec-table hints; "
          "AQE may add more at run time from measured shuffle sizes. Flows that train the LM or "
          "materialize labelled pairs read checkpointed data (`Scan ExistingRDD`).\n")
    print("| query | shuffles | single | broadcasts | BHJ | SMJ | nested loop | aggs | windows | group limits | "
          "generators | python |")
    print("|---|" + "---|" * 11)
    scans = {}
    for name in sys.argv[2:] or catalog.QUERIES:
        fn = catalog.QUERIES[name]
        plan = fn(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        s = summarize(plan)
        scans[name] = s["scans"]
        print(f"| {name} | {s['shuffles']} | {s['single-partition']} | {s['broadcasts']} | {s['BHJ']} | {s['SMJ']} | "
              f"{s['BNLJ']} | {s['hash aggs']} | {s['windows']} | {s['group limits']} | {s['generators']} | "
              f"{s['python']} |")
    print("\n## Parquet scans (column pruning and pushed filters)\n")
    for name, sc in scans.items():
        for part in sorted(set(sc.split("; "))) if sc else []:
            print(f"- `{name}`: {part}")


if __name__ == "__main__":
    main()
