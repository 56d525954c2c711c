"""Run registered keys in Spark and DuckDB and report differences.

    python scripts/check_oracle.py [sf_dir] [key ...]
"""

from __future__ import annotations

import sys
import time

sys.path.insert(0, __file__.rsplit("/scripts/", 1)[0])

from ledgerframe.plans.registry import ORACLE, QUERIES, load_all  # noqa: E402
from ledgerframe.session import build_session  # noqa: E402
from ledgerframe.verify import compare, duck_connect  # noqa: E402


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    load_all()
    wanted = argv[1:] or sorted(QUERIES)
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck_connect(sf_dir)
    bad = 0
    for key in wanted:
        t0 = time.time()
        df = QUERIES[key](spark, sf_dir)
        if key not in ORACLE:
            print(f"{key}: rows-only {df.count()} ({time.time() - t0:.1f}s)")
            continue
        try:
            res = compare(key, df, ORACLE[key], con)
        except Exception as exc:  # report and continue with the next key
            bad += 1
            print(f"{key}: ERROR {type(exc).__name__}: {str(exc)[:400]}")
            continue
        bad += 0 if res.ok else 1
        print(res.summary() + f" ({time.time() - t0:.1f}s)")
    print(f"{len(wanted) - bad}/{len(wanted)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
