"""Benchmark: the nine reports and the fan-out check at one scale factor.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Setup (timed separately, not in ``value``): Spark derives the 30 ERP tables from the driver's
tables and stores them as Parquet (large tables as 2 x cores files, headers range-clustered by
document date, lines hash-clustered by document number) in a work folder:
``BENCH_WORK_DIR`` if set, else a fresh scratch folder. Reports then read the stored tables,
as they would read the ERP lake in production.

Each query runs in full through the ``noop`` writer (every row produced, nothing collected to
the driver). One untimed warm-up pass, then ``BENCH_RUNS`` timed runs per query; the median
is reported. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerframe.plans.checks import fanout_report  # noqa: E402
from ledgerframe.plans.keys_reports import MONTH_RUNNERS, REPORT_RUNNERS  # noqa: E402
from ledgerframe.session import build_session  # noqa: E402
from ledgerframe.sources.demo import erp_tables  # noqa: E402
from ledgerframe.sources.loaders import read_erp_lake, write_erp_lake  # noqa: E402

RUNNERS = REPORT_RUNNERS | MONTH_RUNNERS
RUNNERS["fanout_check"] = fanout_report


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = [q for q in os.environ.get("BENCH_QUERIES", ",".join(RUNNERS)).split(",") if q]
    work = os.environ.get("BENCH_WORK_DIR") or tempfile.mkdtemp(prefix="ledgerframe-bench-")
    spark = build_session(f"local[{cpus}]", app_name="ledgerframe-bench", shuffle_partitions=2 * cpus)

    lake_root = f"{work}/erp_lake"
    t0 = time.perf_counter()
    write_erp_lake(erp_tables(spark, sf_dir), lake_root, files=2 * cpus)
    setup = time.perf_counter() - t0
    lake = read_erp_lake(spark, lake_root)

    def run(key: str) -> float:
        t = time.perf_counter()
        RUNNERS[key](lake).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t

    for key in wanted:  # warm-up: JIT, file listing, Python imports
        run(key)
    timings = {key: round(statistics.median(run(key) for _ in range(runs)), 3) for key in wanted}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_median_sec",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "runs": runs,
        "setup_sec": round(setup, 3),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
