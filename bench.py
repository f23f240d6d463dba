"""Time the headline queries and print one JSON line.

Every query runs once to warm up and once timed, from building its plan to the
last row (written to the no-op sink), in one session on local[$BENCH_CPUS].
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fiscalis.plans import all_queries  # noqa: E402
from fiscalis.session import local_session  # noqa: E402

HEADLINE = [
    "fea02_phase_pivot", "fea11_feature_table", "fea12_model_grain",
    "nrm02_header_dialect", "nrm05_sdmx_chapters", "val02_whole_file_acceptance", "val03_duplicate_blocks",
    "sel08_latest_snapshot", "cat06_relevant_first", "src04_number_tokens",
    "mod05_ridge", "mod16_winner", "mod24_prediction_table",
    "ana01_year_totals", "ana03_coverage", "ana13_correlations", "ana15_describe", "ana24_pipeline_state",
    "ana30_kpis", "ana32_region_comparison", "ana42_region_descriptives",
    "sta05_levene_pooled", "sta07_breusch_pagan", "sta10_spearman_budget", "sta11_kruskal_pooled",
    "snk02_write_by_year", "snk04_insert_or_ignore", "snk08_orphan_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    registered = all_queries()
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            registered[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, warm, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "config": {"master": f"local[{cpus}]", "shuffle_partitions": cpus, "adaptive": True, "runs": "1 warm-up, 1 timed"},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
