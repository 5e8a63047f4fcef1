"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR   folder with the tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma separated names (default: the list below)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "order_tiers", "filter_contains", "route_orders", "template_column", "expression_column", "normalize_steps",
    "merge_left", "merge_outer", "group_lineitem", "group_mode", "group_median", "pivot_sum", "deduplicate_first",
    "deduplicate_documents", "sample_percent", "row_index", "union_inputs", "text_trim", "date_rules", "text_strip_html",
    "lookup_exact", "lookup_contains", "match_area", "subject_headings", "bm25_search", "vector_search", "fuse_hits",
    "pack_requests", "parse_responses", "map_json_fields", "flatten_claims", "wide_records", "link_keys",
    "link_block_scores", "link_decisions", "payload_rows",
)


def main() -> None:
    from queries import all_queries
    from tabloom.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
