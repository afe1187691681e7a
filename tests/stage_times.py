"""Stage times of registered queries from Spark's event log (no UI, no server).

    python tests/stage_times.py /root/testdata/sf0.1 imp3_impute_cart [query ...]

Runs each query once to warm up and once measured, with the event log written
to a fresh scratch folder, then prints jobs, stages and the slowest stages of
the measured run.
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def read_events(folder: str) -> list[dict]:
    import zstandard
    events = []
    for path in sorted(glob.glob(f"{folder}/**/events_*", recursive=True)):
        raw = open(path, "rb")
        stream = zstandard.ZstdDecompressor().stream_reader(raw) if path.endswith(".zstd") else raw
        events += [json.loads(line) for line in io.TextIOWrapper(stream, encoding="utf-8")]
    return events


def main(argv: list[str]) -> None:
    from pyspark.sql import SparkSession
    sf_dir, names = argv[0], argv[1:]
    folder = tempfile.mkdtemp(prefix="run-")
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "16")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", folder).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from sparkrisk.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    import __spark_entry__ as entry
    queries = entry.queries()
    marks = []
    for name in names:
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        start = time.time() * 1000
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        marks.append((name, start, time.time() * 1000))
    spark.stop()
    events = read_events(folder)
    for name, start, end in marks:
        jobs = [e for e in events if e["Event"] == "SparkListenerJobStart" and start <= e["Submission Time"] <= end]
        stages = [e["Stage Info"] for e in events if e["Event"] == "SparkListenerStageCompleted"
                  and start <= e["Stage Info"]["Submission Time"] <= end]
        busy = sum(s["Completion Time"] - s["Submission Time"] for s in stages) / 1000
        print(f"{name}: {(end - start) / 1000:.2f} s wall, {len(jobs)} jobs, {len(stages)} stages, "
              f"{busy:.2f} s summed stage time")
        for s in sorted(stages, key=lambda s: s["Submission Time"] - s["Completion Time"])[:5]:
            print(f"    {(s['Completion Time'] - s['Submission Time']) / 1000:6.2f} s  "
                  f"{s['Number of Tasks']:4d} tasks  {s['Stage Name'][:70]}")
    print(f"(event log in {folder})")


if __name__ == "__main__":
    main(sys.argv[1:])
