"""Per-query totals from a Spark event log (no UI): jobs, stages, tasks,
executor run time and shuffle bytes, grouped by the job description that
bench.py sets to the query name.

    BENCH_EVENTLOG_DIR=/tmp/ev python bench.py && python tools/stage_report.py /tmp/ev
"""

from __future__ import annotations

import glob
import json
import os
import sys
from collections import defaultdict


def _lines(path: str):
    """Lines of one event log: a file, or a rolling-log folder of
    ``events_N_*`` parts (zstd-compressed by default in Spark 4)."""
    parts = (sorted(glob.glob(os.path.join(path, "events_*")),
                    key=lambda p: int(os.path.basename(p).split("_")[1]))
             if os.path.isdir(path) else [path])
    for part in parts:
        if part.endswith(".zstd"):
            import io

            import zstandard
            with open(part, "rb") as raw:
                text = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(raw), encoding="utf-8")
                yield from text
        else:
            with open(part) as f:
                yield from f


def main(argv):
    folder = argv[1]
    logs = sorted(glob.glob(os.path.join(folder, "*")), key=os.path.getmtime)
    if not logs:
        sys.exit(f"no event log in {folder}")
    stage_query: dict[int, str] = {}
    tot = defaultdict(lambda: defaultdict(float))
    for line in _lines(logs[-1]):
        ev = json.loads(line)
        kind = ev.get("Event")
        if kind == "SparkListenerJobStart":
            q = (ev.get("Properties") or {}).get("spark.job.description", "?")
            tot[q]["jobs"] += 1
            for sid in ev.get("Stage IDs", []):
                stage_query[sid] = q
        elif kind == "SparkListenerStageCompleted":
            q = stage_query.get(ev["Stage Info"]["Stage ID"], "?")
            tot[q]["stages"] += 1
        elif kind == "SparkListenerTaskEnd":
            q = stage_query.get(ev.get("Stage ID"), "?")
            m = ev.get("Task Metrics") or {}
            tot[q]["tasks"] += 1
            tot[q]["run_ms"] += m.get("Executor Run Time", 0)
            tot[q]["shuffle_write_mb"] += (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0) / 1e6
            sr = m.get("Shuffle Read Metrics") or {}
            tot[q]["shuffle_read_mb"] += (sr.get("Remote Bytes Read", 0) + sr.get("Local Bytes Read", 0)) / 1e6
    print("| query | jobs | stages | tasks | executor run s | shuffle write MB | shuffle read MB |")
    print("|---|---|---|---|---|---|---|")
    for q, t in tot.items():
        print(f"| {q} | {int(t['jobs'])} | {int(t['stages'])} | {int(t['tasks'])} | {t['run_ms'] / 1000:.1f} "
              f"| {t['shuffle_write_mb']:.1f} | {t['shuffle_read_mb']:.1f} |")


if __name__ == "__main__":
    main(sys.argv)
