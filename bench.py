"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is run to the end into a sink that discards rows. ``shuffle_mb`` is what its stages
wrote to shuffles. One untimed pass over the smallest tables loads classes first.
"""

from __future__ import annotations

import json
import os
import time

HEADLINE = [
    "AGG01_dashboard_stats", "AGG02_session_stats", "JON01_sessions_with_counts", "FLT01_list_documents",
    "FLT07_clause_filter", "FLT10_saved_view", "SRT02_mixed_sort", "UPD01_review_decisions",
    "UPD06_apply_results", "WIN01_merge_consecutive_blocks", "WIN08_log_tail_500", "JON07_field_to_block_match",
    "AGG07_assemble_full_text", "STR18_markdown_blocks", "STR20_word_chunks", "ARR01_grid_fill",
    "ARR06_html_table_cells", "DTM01_to_iso_date", "JSN02_reply_parse", "AGG11_best_answer",
    "WIN03_page_context_fill", "JON05_section_as_of", "JON06_label_above_as_of", "WIN02_continuation_merge",
    "ARR05_parse_contract_rows", "SNK02_export_csv", "SNK03_export_contract_sheets", "STM03_enqueue_dedupe",
]


def shuffled(spark) -> int:
    sc = spark.sparkContext
    none, lists = sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, lists())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def main() -> None:
    import sys

    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from paperquay.plans.catalog import QUERIES
    from paperquay.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    conf = {
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.retainedStages": "100000", "spark.ui.showConsoleProgress": "false",
    }
    spark = build_session("bench", f"local[{cpus}]", **conf)
    spark.sparkContext.setLogLevel("OFF")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE

    def run(name: str, path: str) -> None:
        QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()

    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    if os.path.isdir(small) and not os.environ.get("BENCH_COLD"):
        for name in names:
            run(name, small)
    times, moved = {}, {}
    for name in names:
        before, start = shuffled(spark), time.perf_counter()
        run(name, folder)
        times[name] = round(time.perf_counter() - start, 3)
        moved[name] = round((shuffled(spark) - before) / 1e6, 2)
    print(
        json.dumps(
            {
                "metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": os.path.basename(folder.rstrip("/")), "shuffle_mb": moved, "cpus": int(cpus), "conf": conf,
            }
        )
    )


if __name__ == "__main__":
    main()
