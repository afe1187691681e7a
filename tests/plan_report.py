"""Physical-plan summary of every registered query: ``python tests/plan_report.py [sf_dir] > PLANS.md``.

For each query: shuffles (Exchange), broadcasts, joins, windows, sorts,
whole-stage-codegen spans, Python UDF nodes, and per scan the columns read and
filters pushed to Parquet. Model queries are left out: building them runs the
fits (their plans are those of the operators they use).
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summarise(plan: str) -> dict:
    physical = plan.split("== Physical Plan ==")[-1]
    head = physical.split("\n\n")[0]
    def count(pat):
        return len(re.findall(pat, head))
    scans = re.findall(r"FileScan parquet [^\[]*\[([^\]]*)\][^\n]*?PushedFilters: \[([^\]]*)\]", head)
    return {
        "exchanges": count(r"\bExchange (?:hashpartitioning|rangepartitioning|SinglePartition|RoundRobinPartitioning)"),
        "broadcasts": count(r"BroadcastExchange"),
        "joins": count(r"(?:BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin)"),
        "windows": count(r"\bWindow\b"),
        "group_limits": count(r"WindowGroupLimit"),
        "python_udf": count(r"(?:ArrowEvalPython|BatchEvalPython)"),
        "codegen": count(r"WholeStageCodegen"),
        "scans": [re.sub(r"#\d+L?", "", cols) + (f" (pushed: {re.sub(r'#[0-9]+L?', '', f)})" if f else "")
                  for cols, f in scans],
    }


def main(argv):
    from sparkrisk.plans import model_queries  # noqa: F401
    from sparkrisk.plans.registry import ORACLE_SQL, QUERIES
    from sparkrisk.session import local_session
    sf_dir = argv[0] if argv else "/root/testdata/sf0.1"
    spark = local_session(8, shuffle_partitions=16)
    spark.conf.set("spark.sql.adaptive.enabled", "false")   # show the static plan Catalyst chose
    print(f"# Physical plans ({sf_dir}, AQE off to show the static plan, 16 shuffle partitions)\n")
    print("Generated by `python tests/plan_report.py`. Exchanges count shuffles (broadcasts apart).\n")
    print("Queries whose result is built from aggregates collected while the query is built (exact quantiles,")
    print("fitted models) show the plan of the final projection only; their passes are single aggregates.\n")
    print("\"At scale\" repeats the count with automatic broadcasts off (`autoBroadcastJoinThreshold=-1`), the")
    print("plan Catalyst picks when every table is large; explicit broadcasts of proven-small tables remain.\n")
    print("| Query | Shuffles | Shuffles at scale | Broadcasts | Joins | Windows | Group limits | Python UDF "
          "| Columns read per scan |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- | --- |")
    for name in QUERIES:
        if name not in ORACLE_SQL:
            continue
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        df = QUERIES[name](spark, sf_dir)
        s = summarise(df._jdf.queryExecution().toString())
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        big = summarise(QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString())
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        scans = "; ".join(s["scans"])
        print(f"| {name} | {s['exchanges']} | {big['exchanges']} | {s['broadcasts']} | {s['joins']} | "
              f"{s['windows']} | {s['group_limits']} | {s['python_udf']} | {scans} |")


if __name__ == "__main__":
    main(sys.argv[1:])
