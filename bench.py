"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default sf0.1) names the tables, BENCH_CPUS the local cores, BENCH_QUERIES a comma list of names.
Each query runs alone on a warm session; results are written to the no-op sink, so all columns are computed.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "care_transitions", "transition_volume", "patient_cohort", "active_conditions", "transition_profile_counts",
    "transition_profiles", "prior_readmissions", "drug_interactions", "term_hallucination", "approval_state",
    "infer_payment_status", "denial_risk", "missed_codes", "note_gaps", "optimal_daily_rate", "claim_anomalies",
    "summarize_history", "search_docs", "similar_vectors", "survey_readiness",
]


def main() -> None:
    from transitus.plans import QUERIES
    from transitus.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, "bench", {"spark.sql.shuffle.partitions": cpus})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["transition_volume"](spark, "/root/testdata/sf0.001").collect()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    sf = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(sf.group(1)) if sf else None,
    }))


if __name__ == "__main__":
    main()
