"""Registered queries against their SQL on the smallest tables.

By default a part of them runs; PAPERQUAY_ALL=1 runs every one.
"""

import os

import pytest

from compare import check, connect
from paperquay.plans.catalog import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
PICKED = [
    "AGG01_dashboard_stats", "AGG02_session_stats", "AGG03_session_status_sync", "JON01_sessions_with_counts",
    "FLT01_list_documents", "FLT02_document_record", "FLT07_clause_filter", "FLT10_saved_view", "SRT02_mixed_sort",
    "WIN11_name_disambiguate", "JON04_cascade_delete", "UPD01_review_decisions", "UPD03_patch", "UPD06_apply_results",
    "MTH07_route_extractor", "WIN01_merge_consecutive_blocks", "JON07_field_to_block_match", "JON08_block_to_field",
    "SET04_text_union", "STR18_markdown_blocks", "ARR01_grid_fill", "ARR03_compact_document", "ARR06_html_table_cells",
    "DTM01_to_iso_date", "JSN02_reply_parse", "JSN03_sidecar_output_trim", "UDF02_qa_plugin", "AGG11_best_answer",
    "STR13_regex_fields", "WIN03_page_context_fill", "WIN06_section_boundaries", "ARR05_parse_contract_rows",
    "SNK02_export_csv", "SNK07_export_document_sheet_rows", "SRC03_watch_folder_stream", "STM03_enqueue_dedupe",
    "STM04_idle_watchdog",
]
NAMES = list(QUERIES) if os.environ.get("PAPERQUAY_ALL") else PICKED


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_agrees(spark, con, name):
    assert check(spark, con, FOLDER, name) == ""


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
