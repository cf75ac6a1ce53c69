"""Per-question input and shuffle volume, from Spark's event log (written to a scratch folder).

  python scripts/shuffle_report.py [sf_dir] > SHUFFLE.md

Each question runs through the ``noop`` sink under its own job group; task-end events give the rows
read from files and the rows and bytes written to shuffles, summed per question. A plan that
aggregates before it shuffles moves far fewer rows than it reads.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
from collections import defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402

from grainline.catalog import all_questions  # noqa: E402
from grainline.session import DEFAULTS  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="grainline-events-")
    builder = (
        SparkSession.builder.master("local[8]")
        .appName("grainline-shuffle-report")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.eventLog.enabled", "true")
        .config("spark.eventLog.dir", log_dir)
        .config("spark.eventLog.compress", "false")
    )
    for k, v in DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    names = list(all_questions())
    for name, q in all_questions().items():
        spark.sparkContext.setJobGroup(name, name)
        q.build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.stop()

    stage_group: dict[int, str] = {}
    read: dict[str, int] = defaultdict(int)
    shuffled: dict[str, int] = defaultdict(int)
    tasks: dict[str, int] = defaultdict(int)
    shuffled_bytes: dict[str, int] = defaultdict(int)
    for path in sorted(glob.glob(os.path.join(log_dir, "**", "*"), recursive=True)):
        if os.path.isdir(path) or os.path.basename(path).startswith("appstatus"):
            continue
        with open(path) as fh:
            for line in fh:
                e = json.loads(line)
                kind = e.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (e.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in e.get("Stage IDs", []):
                        if group:
                            stage_group[sid] = group
                elif kind == "SparkListenerTaskEnd":
                    group = stage_group.get(e.get("Stage ID"))
                    m = e.get("Task Metrics") or {}
                    if group is None:
                        continue
                    tasks[group] += 1
                    read[group] += (m.get("Input Metrics") or {}).get("Records Read", 0)
                    shuffled[group] += (m.get("Shuffle Write Metrics") or {}).get("Shuffle Records Written", 0)
                    shuffled_bytes[group] += (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)

    print(f"Input and shuffle volume per question at `{sf_dir}` (local[8]; from the event log).\n")
    print("| question | tasks | rows read | rows shuffled | shuffled / read | shuffle bytes |")
    print("| --- | --- | --- | --- | --- | --- |")
    for n in names:
        r, w = read.get(n, 0), shuffled.get(n, 0)
        ratio = f"{w / r:.3f}" if r else "-"
        print(f"| {n} | {tasks.get(n, 0)} | {r:,} | {w:,} | {ratio} | {shuffled_bytes.get(n, 0):,} |")


if __name__ == "__main__":
    main()
