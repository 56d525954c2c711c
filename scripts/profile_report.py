"""Per-stage profile of one report over a stored ERP lake, from Spark's event log.

    python scripts/profile_report.py <lake_root> <report_key> [scratch_dir]

The event log goes to a fresh folder under ``scratch_dir`` (default: a new temp folder).
"""

from __future__ import annotations

import glob
import io
import json
import sys
import tempfile
import time

sys.path.insert(0, __file__.rsplit("/scripts/", 1)[0])

from ledgerframe.plans.keys_reports import REPORT_RUNNERS  # noqa: E402
from ledgerframe.session import build_session  # noqa: E402
from ledgerframe.sources.loaders import read_erp_lake  # noqa: E402


def _events(folder: str):
    import zstandard

    for f in sorted(glob.glob(f"{folder}/*/events*")):
        raw = open(f, "rb")
        stream = zstandard.ZstdDecompressor().stream_reader(raw) if f.endswith(".zstd") else raw
        for line in io.TextIOWrapper(stream, encoding="utf-8"):
            yield json.loads(line)


def main(lake_root: str, key: str, scratch: str | None = None) -> None:
    ev_dir = tempfile.mkdtemp(prefix="ev-", dir=scratch)
    spark = build_session("local[8]", shuffle_partitions=16,
                          extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": ev_dir})
    t = read_erp_lake(spark, lake_root)
    REPORT_RUNNERS[key](t).write.format("noop").mode("overwrite").save()
    spark.sparkContext.setJobGroup("measured", "measured")
    t0 = time.time()
    REPORT_RUNNERS[key](t).write.format("noop").mode("overwrite").save()
    print(f"{key}: {time.time() - t0:.2f}s")
    spark.stop()
    measured_jobs, stage_job, stages, tasks = set(), {}, {}, {}
    for e in _events(ev_dir):
        ev = e["Event"]
        if ev == "SparkListenerJobStart" and e.get("Properties", {}).get("spark.jobGroup.id") == "measured":
            measured_jobs.add(e["Job ID"])
            for s in e["Stage IDs"]:
                stage_job[s] = e["Job ID"]
        elif ev == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            stages[si["Stage ID"]] = si
        elif ev == "SparkListenerTaskEnd" and e.get("Task Metrics"):
            m = e["Task Metrics"]
            agg = tasks.setdefault(e["Stage ID"], [0, 0, 0, 0, 0])
            agg[0] += m.get("Executor Run Time", 0)
            agg[1] += m.get("JVM GC Time", 0)
            agg[2] += m.get("Shuffle Write Metrics", {}).get("Shuffle Bytes Written", 0)
            agg[3] += m.get("Shuffle Write Metrics", {}).get("Shuffle Records Written", 0)
            agg[4] += m.get("Shuffle Read Metrics", {}).get("Total Records Read", 0)
    print("stage  wall_ms tasks run_ms gc_ms shuf_MB shuf_rows read_rows  rdds")
    for sid, si in sorted(stages.items()):
        if stage_job.get(sid) not in measured_jobs:
            continue
        wall = si.get("Completion Time", 0) - si.get("Submission Time", 0)
        run, gc, wb, wr, rr = tasks.get(sid, [0] * 5)
        names = ",".join(sorted({r["Name"] for r in si.get("RDD Info", []) if "Scan" in r["Name"]}))[:60]
        print(f"{sid:5d} {wall:8d} {si['Number of Tasks']:5d} {run:6d} {gc:5d} {wb / 1e6:7.1f} {wr:9d} {rr:9d}  {names}")


if __name__ == "__main__":
    main(*sys.argv[1:])
