"""Truth snapshots of every registered question.

  python scripts/snapshots.py write <folder> [sf_dir]   # one snapshot folder per question (stale ones removed)
  python scripts/snapshots.py check <folder> [sf_dir]   # recompute and report drift per question
"""

from __future__ import annotations

import sys
from functools import reduce
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from grainline.catalog import all_questions  # noqa: E402
from grainline.operators.recon import canonical_rows, snapshot_drift  # noqa: E402
from grainline.session import local_session  # noqa: E402
from grainline.sources.files import write_snapshots  # noqa: E402


def current(spark, sf_dir):
    parts = [canonical_rows(q.build(spark, sf_dir), name) for name, q in all_questions().items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def main() -> int:
    mode, folder = sys.argv[1], sys.argv[2]
    sf_dir = sys.argv[3] if len(sys.argv) > 3 else "/root/testdata/sf0.01"
    spark = local_session()
    if mode == "write":
        write_snapshots(current(spark, sf_dir), folder)
        return 0
    snap = spark.read.schema("row string, task_id string").json(folder)
    drift = snapshot_drift(snap, current(spark, sf_dir)).collect()  # one row per drifting question
    for r in drift:
        print(f"{r.task_id}: {r.status}")
    print(f"{len(drift)} questions drifted")
    return 1 if drift else 0


if __name__ == "__main__":
    raise SystemExit(main())
