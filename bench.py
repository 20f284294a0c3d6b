"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is materialised in full. BENCH_RUNS sets how many timed runs follow one
warm-up run; the median is reported.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from sqlweave.plans.registry import all_queries
from sqlweave.session import build_session

HEADLINE = [
    "topk_columns", "approx_topk", "retrieve_schema", "embed_text", "sampled_negatives", "hard_negatives",
    "contrastive_score", "set_eq", "bag_eq", "ordered_eq", "colperm_eq", "schema_augment", "prompt_render",
    "pair_mining", "revision_history", "accuracy_by_level", "turn_accuracy", "joint_accuracy", "component_match",
    "sample_values", "catalog_flatten", "fk_components", "link_columns", "dedup_rows", "dedup_lines",
    "normalise_sql", "strip_literals", "difficulty", "exact_match", "pair_losses", "sorted_losses",
    "sql_join_chain", "sql_aggregates",
]


def materialise(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    timings: dict[str, float] = {}
    for name in names:
        build = queries[name][0]
        samples = []
        for run in range(runs + 1):
            started = time.perf_counter()
            materialise(build(spark, sf_dir))
            samples.append(time.perf_counter() - started)
        timings[name] = round(statistics.median(samples[1:] or samples), 3)
        print(name, [round(s, 2) for s in samples], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
