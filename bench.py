"""Headline timings: prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is run to completion (written to Spark's ``noop`` sink, so every
row is computed and nothing is collected); forest programs include fitting
the preparation and the forest, scoring, and their reports.

With ``BENCH_EVENT_LOG=1`` Spark's event log is written to a fresh folder
under /tmp and a per-query summary (jobs, summed job time, span) goes to
stderr; stdout stays one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from flowdetect.plans import programs, registry  # noqa: E402
from flowdetect.session import local_session  # noqa: E402
from flowdetect.sources.events import read_event_flows  # noqa: E402


def run_all(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    log_dir, extra = None, {}
    if os.environ.get("BENCH_EVENT_LOG"):
        import tempfile

        log_dir = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        extra = {
            "spark.eventLog.enabled": "true",
            "spark.eventLog.dir": f"file://{log_dir}",
            "spark.eventLog.compress": "false",
        }
    spark = local_session(
        cpus, shuffle_partitions=max(8, int(cpus) if cpus.isdigit() else 8), app="flowdetect-bench", extra_conf=extra
    )
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    sf = float(m.group(1)) if m else None

    # warm the JVM (class loading, code generation of the ML stages) once,
    # untimed, on the smallest table set, so timings are steady-state
    run_all(read_event_flows(spark, sf_dir))
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        warm = programs.train_day(read_event_flows(spark, warm_dir), registry.ONE_DAY, num_trees=2)
        run_all(warm.importances())
        warm.release()

    timings: dict[str, float] = {}

    def timed(name, fn):
        spark.sparkContext.setJobGroup(name, name)
        t0 = time.perf_counter()
        fn()
        timings[name] = round(time.perf_counter() - t0, 3)

    q = registry.queries()
    for name in [
        "flow_stats",
        "coarsen_flows",
        "min_max",
        "split_by_key",
        "union_days",
        "xml_days",
        "csv_roundtrip",
    ]:
        timed(name, lambda name=name: run_all(q[name](spark, sf_dir)))

    # preparation: fit both indexers and report (no memo: fresh each time)
    def preparation():
        from flowdetect.operators.coarsen import prepare_flows
        from flowdetect.operators.prepare import feature_index_report, fit_preparation, vector_slots

        coarse = prepare_flows(read_event_flows(spark, sf_dir))
        prep = fit_preparation(coarse)
        prepared = prep.transform(coarse)
        run_all(feature_index_report(prepared, prep.text_cols))
        run_all(vector_slots(prepared))

    timed("preparation", preparation)

    flows = read_event_flows(spark, sf_dir)

    def one_day(**bins):
        run = programs.train_day(flows, registry.ONE_DAY, **bins)
        try:
            run_all(run.scored())
            run_all(run.test_error())
            run_all(run.importances())
        finally:
            run.release()

    def each_day(**bins):
        res = programs.train_each_day(flows, **bins)
        run_all(res.test_error())
        run_all(res.importances())

    def all_days(**bins):
        run = programs.train_all_days(flows, **bins)
        try:
            run_all(run.scored())
            run_all(run.test_error())
            run_all(run.importances())
        finally:
            run.release()

    for name, fn in (("train_day", one_day), ("train_each_day", each_day), ("train_all_days", all_days)):
        timed(name, fn)  # the original's bins
        timed(f"{name}_auto_bins", lambda fn=fn: fn(max_bins="auto"))

    total = round(sum(timings.values()), 3)
    print(json.dumps({"metric": "total_sec", "value": total, "unit": "sec", "queries": timings, "sf": sf}))
    spark.stop()
    if log_dir:
        summarize_event_log(log_dir)


def summarize_event_log(log_dir: str) -> None:
    """Per job group: number of jobs, summed job time, first start to last end."""
    import collections
    import glob

    jobs = {}
    for path in glob.glob(f"{log_dir}/**", recursive=True):
        if not os.path.isfile(path):
            continue
        with open(path) as fh:
            for line in fh:
                e = json.loads(line)
                if e["Event"] == "SparkListenerJobStart":
                    group = e.get("Properties", {}).get("spark.jobGroup.id")
                    jobs[e["Job ID"]] = [group, e["Submission Time"], None]
                elif e["Event"] == "SparkListenerJobEnd" and e["Job ID"] in jobs:
                    jobs[e["Job ID"]][2] = e["Completion Time"]
    agg = collections.defaultdict(lambda: [0, 0.0, None, None])
    for group, start, end in jobs.values():
        if group is None or end is None:
            continue
        a = agg[group]
        a[0] += 1
        a[1] += (end - start) / 1000
        a[2] = start if a[2] is None else min(a[2], start)
        a[3] = end if a[3] is None else max(a[3], end)
    print(f"event log: {log_dir}", file=sys.stderr)
    for group, (n, busy, start, end) in agg.items():
        print(f"{group:16s} jobs={n:4d} job_sec={busy:7.2f} span={(end - start) / 1000:7.2f}", file=sys.stderr)


if __name__ == "__main__":
    main()
