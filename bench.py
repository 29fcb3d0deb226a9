"""Time headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
``program_regressions`` is timed from the table to the result (parsing, tapes, fixpoint); the program
queries right after it build on its materialised analysis, as they would in use. All others start from
the tables.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from deflow.plans import QUERIES, programs  # noqa: E402
from deflow.session import build_session  # noqa: E402

HEADLINE = [
    "program_regressions", "program_witnesses", "program_findings", "program_call_edges", "program_def_use",
    "reaching_defs", "value_flow_both", "stream_diff", "regressions_by_function", "lattice_return_join",
    "audit_signals", "coverage_lift", "paired_arm_metrics", "corpus_gate", "expected_matches",
    "patch_coverage", "hunk_merge", "annotation_nullability", "latest_upsert", "content_hashes",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session("bench", f"local[{cpus}]", cpus * 2)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in names:
        if name == "program_regressions":
            programs.forget()
        t = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - t, 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
