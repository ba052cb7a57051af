"""Write PLANS.md: the physical shape of every registered query's final
(adaptive) plan at a scale factor -- shuffles, broadcasts, joins, windows,
aggregates, pushed scan filters.

    python tests/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def shape(plan: str) -> dict:
    return {
        "shuffles": len(re.findall(r"Exchange (?:hashpartitioning|rangepartitioning|RoundRobinPartitioning|SinglePartition)", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "smj": plan.count("SortMergeJoin"),
        "bhj": plan.count("BroadcastHashJoin"),
        "windows": len(re.findall(r"\bWindow \[", plan)),
        "aggs": len(re.findall(r"(?:HashAggregate|SortAggregate|ObjectHashAggregate)\(keys?=", plan)),
        "scans": plan.count("FileScan parquet"),
        "pushed": sorted(set(re.findall(r"PushedFilters: \[([^\]]*)\]", plan)) - {""}),
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from roverlake.session import get_session

    spark = get_session("local[8]", app="roverlake-plans", shuffle_partitions=16)
    import __spark_entry__ as E

    print(f"# Physical plans at `{os.path.basename(sf_dir)}`\n")
    print("Final adaptive plans after execution (`tests/plan_report.py`). Shuffles include the small")
    print("ones that move per-chunk or per-key partial aggregates; broadcasts are AQE's runtime choices")
    print("(no query uses a broadcast hint). `scans` counts scan nodes as printed, including the plans of")
    print("scalar subqueries (bounds, `as_of`), which Spark runs once and reuses. Stream queries show the plan")
    print("of their read-back.\n")
    print("| query | shuffles | broadcasts | SMJ | BHJ | windows | aggregates | scans | pushed scan filters |")
    print("|---|---|---|---|---|---|---|---|---|")
    for name, fn in sorted(E.queries().items()):
        df = fn(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        s = shape(df._jdf.queryExecution().executedPlan().toString())
        pushed = "; ".join(p[:80] for p in s["pushed"][:2])
        print(f"| {name} | {s['shuffles']} | {s['broadcasts']} | {s['smj']} | {s['bhj']} | {s['windows']} | "
              f"{s['aggs']} | {s['scans']} | {pushed} |")
    spark.stop()


if __name__ == "__main__":
    main()
