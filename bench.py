"""Benchmark: run every registered question at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Each question is executed in full through the ``noop`` sink (the whole plan runs, nothing is collected to
the driver). A warm-up on sf0.001 (not timed) compiles the JVM paths first. Prints one JSON line:
``{"metric": ..., "value": total seconds, "unit": "sec", "queries": {name: sec}, "sf": ...}``.
Set ``BENCH_ONLY`` to a comma-separated list of name fragments to run a subset while iterating.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from grainline.catalog import all_questions  # noqa: E402
from grainline.session import local_session  # noqa: E402

WARMUP_DIR = "/root/testdata/sf0.001"


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [x for x in os.environ.get("BENCH_ONLY", "").split(",") if x]
    spark = local_session(cpus=cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus)), app="grainline-bench")
    questions = {n: q for n, q in all_questions().items() if not only or any(o in n for o in only)}

    for name in ("q1_region_total", "j_c03_basket_mix", "t_chasm"):  # warm-up, not timed
        if name in questions:
            questions[name].build(spark, WARMUP_DIR).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name, q in questions.items():
        t0 = time.perf_counter()
        q.build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"{name}: {times[name]:.3f}s", file=sys.stderr, flush=True)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_question_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(m.group(1)) if m else sf_dir,
                "n_queries": len(times),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
