"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (tables, default sf0.1), BENCH_CPUS (cores, default 8).
Every query is run twice over its whole tables and written to a null sink; the
second run is reported, so that the figure holds no start-up or code generation.
The session has the settings that the package ships with.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "clean_pipeline",
    "agg_missing_profile",
    "agg_summary_numeric",
    "agg_top_customers",
    "agg_top_products",
    "agg_basket_collect",
    "agg_basket_summary",
    "row_index",
    "sample_n",
    "rfm_table",
    "rfm_segment_summary",
    "rfm_segment_medians",
    "join_cooccurrence",
    "mba_rules",
    "mba_prune_subsumed",
    "mba_business_score",
    "mba_basket_margin",
    "clu_drop_outliers",
    "clu_lloyd_fixed",
    "clu_hierarchical",
    "clv_event_log",
    "clv_cbs",
    "clv_bgnbd_loglik",
    "clv_pnbd_loglik",
    "clv_bgnbd_fit",
    "clv_pnbd_fit",
    "clv_gg_fit",
    "clv_freq_fit_pnbd",
    "clv_pipeline",
    "clv_pipeline_fitted",
    "clv_eval",
    "clu_choose_k",
    "join_containment",
]


def main() -> None:
    from tillscope.plans.catalogue import QUERIES
    from tillscope.session import build_session

    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "tillscope-bench",
        master=f"local[{cpus}]",
        input_bytes=sum(
            os.path.getsize(os.path.join(folder, name))
            for folder, _, names in os.walk(root)
            for name in names
        ),
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "10g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - began, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(root.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
