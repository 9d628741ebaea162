"""What every registered query of the library runs, from a cold start.

    python tools/plan_report.py [sf_dir] > report.md

Shared tables are forgotten before each query, so its figures include every table that it
has to build.  Counts come from the final (post-AQE) plans of all executions of the query,
and tasks and shuffled bytes from its tasks, as Spark's event log has them; the log goes
to a scratch folder and the Spark UI stays off.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time
from collections import Counter, defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

COLUMNS = {
    "scans": r"^Scan parquet", "shuffles": r"^Exchange$", "range": r"range", "single": r"single",
    "broadcasts": r"^BroadcastExchange$", "windows": r"^Window", "generate": r"^Generate$",
    "SMJ": r"^SortMergeJoin", "BHJ": r"^BroadcastHashJoin$", "Python": r"Python|Pandas|Arrow",
}


def _walk(node: dict, out: Counter) -> None:
    name, text = node["nodeName"].strip(), node.get("simpleString", "")
    kinds = [name]
    if name == "Exchange":
        kinds += ["range"] * ("rangepartitioning" in text) + ["single"] * ("SinglePartition" in text)
    if name == "ReusedExchange":
        return
    for column, pattern in COLUMNS.items():
        out[column] += any(re.search(pattern, k) for k in kinds)
    for child in node.get("children", []):
        _walk(child, out)


def _read(folder: str) -> dict[str, Counter]:
    from stage_report import _lines
    log = max((os.path.join(folder, f) for f in os.listdir(folder)), key=os.path.getmtime)
    query_of, plan_of, stage_of = {}, {}, {}
    out: dict[str, Counter] = defaultdict(Counter)
    for line in _lines(log):
        e = json.loads(line)
        kind = e["Event"].rpartition(".")[2]
        if kind == "SparkListenerSQLExecutionStart":
            query_of[e["executionId"]] = e["description"]
        if "sparkPlanInfo" in e:
            plan_of[e["executionId"]] = e["sparkPlanInfo"]
        elif kind == "SparkListenerJobStart":
            name = (e.get("Properties") or {}).get("spark.job.description", "?")
            out[name]["jobs"] += 1
            stage_of |= {s: name for s in e["Stage IDs"]}
        elif kind == "SparkListenerTaskEnd":
            m = e.get("Task Metrics") or {}
            name = stage_of.get(e["Stage ID"], "?")
            out[name]["tasks"] += 1
            out[name]["kb"] += (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0) / 1e3
    for execution, plan in plan_of.items():
        _walk(plan, out[query_of.get(execution, "?")])
    return out


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    from churnlens.plans import catalog
    from churnlens.session import local_session
    folder = tempfile.mkdtemp(prefix="plan-report-", dir="/tmp")
    spark = local_session(8, 16, extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": folder,
                                        "spark.eventLog.rolling.enabled": "false",
                                        "spark.eventLog.compress": "false"})
    seconds = {}
    for name, q in catalog.queries().items():
        catalog._MEMO.clear()
        spark.sparkContext.setJobDescription(name)
        t = time.perf_counter()
        q(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = time.perf_counter() - t
    spark.stop()
    found = _read(folder)
    print("| query | s | jobs | tasks | shuffled MB | " + " | ".join(COLUMNS) + " |")
    print("|---" * (5 + len(COLUMNS)) + "|")
    for name in catalog.queries():
        c = found[name]
        print(f"| {name} | {seconds[name]:.1f} | {c['jobs']} | {c['tasks']} | {c['kb'] / 1e3:.1f} | "
              + " | ".join(str(c[k]) for k in COLUMNS) + " |")


if __name__ == "__main__":
    main(sys.argv)
