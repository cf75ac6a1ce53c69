"""Run registered questions on Spark and their oracle SQL on DuckDB; print one line per question."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tests"))

from oracle import compare, duck  # noqa: E402

from grainline.catalog import all_questions  # noqa: E402
from grainline.session import local_session  # noqa: E402


def main() -> int:
    sf_dir = "/root/testdata/sf0.01"
    args = [a for a in sys.argv[1:] if not a.startswith("--")]
    for a in sys.argv[1:]:
        if a.startswith("--sf="):
            sf_dir = a.split("=", 1)[1]
    spark = local_session()
    con = duck(sf_dir)
    bad = 0
    for name, q in all_questions().items():
        if args and not any(a in name for a in args):
            continue
        t = time.time()
        try:
            df = q.build(spark, sf_dir)
            if q.oracle is None:
                n = df.count()
                print(f"{name:40s} rows-only {n} rows {time.time() - t:.1f}s")
                continue
            why = compare(df, con, q.oracle)
        except Exception as e:  # noqa: BLE001
            why = f"ERROR {type(e).__name__}: {str(e)[:300]}"
        bad += why is not None
        print(f"{name:40s} {'OK' if why is None else why} {time.time() - t:.1f}s", flush=True)
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
