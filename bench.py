"""Time the headline queries and print one JSON line.

One query is run untimed first, so that the times do not include JVM start-up.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_QUERIES
(comma-separated names, ``all`` for every registered query).
"""

from __future__ import annotations

import json
import os
import sys
import time

from notewright.plans.catalog import CATALOG
from notewright.session import local_session

HEADLINE = (
    "comparison_report",
    "route_on_fixture_scores",
    "expanded_set_on_fixture_scores",
    "similarity_search",
    "retrieve_classify_decide",
    "keyword_flags",
    "rule_vote_table",
    "cancer_label_model",
    "parsed_headers",
    "first_answers",
    "four_way_split",
    "split_by_fraction_per_label",
    "classification_metrics",
    "confidence_describe",
    "class_spread",
    "tfidf_vocabulary",
    "spread_labels_over_graph",
    "label_model_scores_balanced",
    "trained_routing_run",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(CATALOG) if chosen == "all" else chosen.split(",") if chosen else list(HEADLINE)
    spark = local_session(cpus, "notewright-bench")
    spark.sparkContext.setLogLevel("ERROR")
    CATALOG[HEADLINE[0]].run(spark, folder).collect()

    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        CATALOG[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total" if not chosen else "total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
