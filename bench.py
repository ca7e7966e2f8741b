"""Benchmark the headline queries; prints ONE JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is run to completion with the ``noop`` sink (full execution, no
collect to the driver).  A warm-up pass over the same queries runs first so
that JVM start-up and code generation are not billed to the first query; the
reported time per query is the best of ``BENCH_REPEAT`` timed runs.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = {
    "R11_latest_interview_answer": "latest_interview_answer",
    "R17_interviews_report": "interviews_report",
    "R19_project_summary": "project_summary",
    "P02_keyword_topk": "keyword_topk",
    "P04_item_connections": "item_connections",
    "P05_item_groups": "item_groups",
    "D02_anonymise": "anonymise",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    from fieldwork.session import get_session
    from fieldwork.plans.queries import queries

    spark = get_session(f"local[{cpus}]", shuffle_partitions=max(2 * cpus, 8), app_name="fieldwork-bench")
    qs = queries()

    def run(key: str) -> float:
        t0 = time.perf_counter()
        qs[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    failed = {}
    for name, key in HEADLINE.items():  # warm-up
        try:
            run(key)
        except Exception as e:  # reported in the JSON line, the other queries still run
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
    times = {}
    for name, key in HEADLINE.items():
        if name in failed:
            times[name] = None
            continue
        times[name] = round(min(run(key) for _ in range(max(repeat, 1))), 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    out = {"metric": "headline_total", "value": round(sum(t for t in times.values() if t is not None), 3),
           "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
           "cpus": cpus}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
