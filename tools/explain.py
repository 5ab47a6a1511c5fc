"""Print the final (post-AQE) physical plan of registered queries.

    python tools/explain.py [--sf DIR] name ...

Each query is executed inside the JVM (``toRdd().count()``, nothing is
collected) so the adaptive plan shows the join strategies and partition
counts chosen at runtime.
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("names", nargs="+")
    a = ap.parse_args()
    from loupe.plans.registry import all_queries
    from loupe.session import build_session
    spark = build_session()
    spark.sparkContext.setLogLevel("OFF")
    qs = all_queries()
    for n in a.names:
        qe = qs[n](spark, a.sf)._jdf.queryExecution()
        rows = qe.toRdd().count()
        print(f"### {n}  ({rows} rows at {os.path.basename(a.sf)})\n")
        print("```")
        print(qe.executedPlan().toString().rstrip())
        print("```\n")
    spark.stop()


if __name__ == "__main__":
    main()
