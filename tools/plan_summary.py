"""Summarise the physical plans of the headline queries (writes PLANS.md).

Counts, per query, the shuffle exchanges (with their partitioning), the
broadcast exchanges, windows and inputs of the static physical plan, down to
the Parquet scans with the columns they read and the filters they push.  The raw
table is not cached for this; tables that a query writes or checkpoints are leaves.

Usage: python tools/plan_summary.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import re
import sys

sys.path.insert(0, ".")

from churnkit.plans.context import Fixture  # noqa: E402
from churnkit.plans.registry import QUERIES  # noqa: E402
from churnkit.session import get_session  # noqa: E402
from churnkit.sources import fixtures  # noqa: E402

KEYS = ["scan_subscriber", "treat_all", "derive_features", "segment_assign", "profile_describe",
        "score_counts", "sweep_recall", "roc_200", "risk_ranking", "offer_log", "policy_counts",
        "learning_curve", "recommend", "next_best_offer", "client_detail", "campaign_by_segment"]


def nodes(plan):
    """All operators of a physical plan (JVM tree walk)."""
    stack = [plan]
    while stack:
        p = stack.pop()
        yield p
        ch = p.children()
        stack.extend(ch.apply(i) for i in range(ch.size()))


def scan_of(name: str, p) -> str:
    """A leaf: table, columns read and filters pushed of a Parquet scan, else its kind."""
    if not name.startswith("Scan parquet"):
        return {"Scan ExistingRDD": "checkpoint", "LocalTableScan": "local"}.get(name, name)
    text = p.verboseString(1000)
    table = re.search(r"Location: [^\[]*\[([^\]]*)\]", text)
    filters = re.search(r"PushedFilters: \[([^\]]*)\]", text)
    file = table[1].split("/")[-1].removesuffix(".parquet") if table else "parquet"
    where = f" where {filters[1]}" if filters and filters[1] else ""
    return f"{file if len(file) < 20 else 'written table'}({p.output().size()} columns{where})"


def summarise(name: str, df) -> str:
    plan = df._jdf.queryExecution().executedPlan()
    shuffles, bcast, windows, scans = [], 0, 0, set()
    for p in nodes(plan):
        n = p.nodeName()
        if n == "Exchange":
            part = p.outputPartitioning().toString()
            shuffles.append(re.sub(r"#\d+L?", "", part.split("(")[0] + ("(" + part.split("(", 1)[1] if "(" in part else "")))
        elif n == "BroadcastExchange":
            bcast += 1
        elif n == "Window":
            windows += 1
        elif n.startswith("Scan") or n == "LocalTableScan":
            scans.add(scan_of(n, p))
    kinds = sorted(set(re.sub(r", \d+\)$", ")", s) for s in shuffles))
    return (f"| `{name}` | {len(shuffles)} | {'; '.join(kinds) or '-'} | {bcast} | {windows} | "
            f"{', '.join(sorted(scans))} |")


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session("local[8]")
    # static physical plans: every planned exchange is a node of the tree
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    Fixture.raw = property(lambda f: fixtures.subscriber(f.spark, f.sf_dir))
    print("# Physical plans of the headline queries\n")
    print(f"Generated by `tools/plan_summary.py` at `{sf}` (static physical plans with AQE off, "
          "as planned before runtime re-optimisation), from the Parquet scans on: the table, how many of its columns "
          "are read, and the filters that reach the scan. `checkpoint` and local tables are leaves.\n")
    print("| query | shuffles | partitioning | broadcasts | windows | inputs |")
    print("|---|---|---|---|---|---|")
    for k in KEYS:
        print(summarise(k, QUERIES[k](spark, sf)))


if __name__ == "__main__":
    main()
