"""Summarize every question's physical plan: shuffles, broadcasts, scans with pushed filters, windows.

Run: python scripts/plan_audit.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from grainline.catalog import all_questions  # noqa: E402
from grainline.session import local_session  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session()
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the static plan, before runtime re-planning
    print("| question | shuffles | broadcasts | scans | scans with pushed filters | windows | WindowGroupLimit | sorts |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- |")
    for name, q in all_questions().items():
        plan = q.build(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        shuffles = len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan))
        bcast = plan.count("BroadcastExchange")
        scans = re.findall(r"FileScan parquet[^\n]*", plan)
        pushed = sum(1 for s in scans if "PushedFilters: [" in s and "PushedFilters: []" not in s)
        windows = len(re.findall(r"\bWindow \[", plan))
        wgl = plan.count("WindowGroupLimit")
        sorts = len(re.findall(r"\bSort \[", plan))
        print(f"| {name} | {shuffles} | {bcast} | {len(scans)} | {pushed} | {windows} | {wgl} | {sorts} |")
    spark.stop()


if __name__ == "__main__":
    main()
