"""Plans: what reaches the scan, which joins and limits are chosen, and what is never there."""

import contextlib
import io
import os

import pytest
from pyspark.sql import functions as F

from paperquay.operators import documents as O
from paperquay.operators import filters as V
from paperquay.operators import logs as L
from paperquay.operators.ordered import Listing
from paperquay.plans.catalog import QUERIES
from paperquay.plans.fixtures import Lake
from paperquay.plans.text_queries import _answers

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables are not here")


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_filters_reach_the_scan(spark):
    d = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumnsRenamed({"source": "session_id", "lang": "status"})
    p = plan(O.with_status(d, "en").select("doc_id"))
    assert "EqualTo(lang,en)" in p and "ReadSchema: struct<doc_id:bigint,lang:string>" in p


def test_clauses_stay_native(spark):
    d = spark.read.parquet(f"{FOLDER}/part.parquet")
    view = {"clauses": [{"field": "p_name", "op": "contains", "value": "x"}, {"field": "p_size", "op": "gt", "value": "3"}]}
    p = plan(V.apply_view(d, view, ["p_name"], {}, ["p_partkey"]).select("p_partkey"))
    assert "Python" not in p and "p_retailprice" not in p and "Exchange" not in p


def test_listing_does_not_read_contents(spark, tmp_path):
    from paperquay.sources.files import scan_files

    (tmp_path / "a.PDF").write_bytes(b"x")
    (tmp_path / "b.txt").write_bytes(b"x")
    (tmp_path / "noext").write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.pdf").write_bytes(b"x")
    df = scan_files(spark, str(tmp_path))
    assert [r.filename for r in df.collect()] == ["a.PDF"]
    assert "content" not in plan(df)


def test_log_tail_is_limited_before_the_shuffle(spark):
    e = spark.read.parquet(f"{FOLDER}/events.parquet").withColumnRenamed("user_id", "doc_id")
    assert "WindowGroupLimit" in plan(L.log_tail(e, 500))


def test_latest_history_is_a_top_k(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["SNK10_export_history_top100"](spark, FOLDER))


@pytest.mark.parametrize("name", ["JON01_sessions_with_counts", "JON07_field_to_block_match", "WIN01_merge_consecutive_blocks", "ARR01_grid_fill", "AGG02_session_stats"])
def test_no_products_and_no_single_task_windows(spark, name):
    p = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p and "SinglePartition" not in p


def test_block_to_field_moves_a_text_once(spark):
    """JON08: what a block is compared with lies ahead of it, its text is shuffled once, and the table is read once for the answers' texts."""
    p = plan(QUERIES["JON08_block_to_field"](spark, FOLDER))
    frames = [line for line in p.splitlines() if "collect_list(" in line and "specifiedwindowframe" in line]
    assert frames and not any("RangeFrame, -" in f or "RowFrame, -" in f for f in frames)
    # A window that gathers an expression has it shuffled beside its columns.
    assert "collect_list(_w" not in p
    lake = Lake(spark, FOLDER)
    assert plan(_answers(lake).filter("key = 'body'")).count("split(") == plan(lake.blocks).count("split(")


def test_answers_of_documents_that_come_twice(spark, tmp_path):
    """Rows with one id count as one document, and each gives a block; null texts and ids give none."""
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(4, "a\nb\nc", "en"), (9, "d\ne", "de"), (9, "f\ng\nh\ni", "de"), (3, "k", "en"), (5, None, "en"), (None, "l", "en"), (6, "m\n\nn", "en")]
    docs = spark.createDataFrame([(*r, "src_1", 1) for r in rows], shape)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = _answers(Lake(spark, str(tmp_path))).filter("key = 'body'").select("doc_id", "answer").collect()
    # 9 % 6 = 3 is in the longer text alone, and nothing follows it.
    assert sorted(map(tuple, got)) == [(3, "  K !"), (4, "  B !"), (6, "  M -  !"), (9, "  I !")]


def test_deep_page_is_the_same(spark):
    d = spark.read.parquet(f"{FOLDER}/orders.parquet").select("o_orderkey", "o_totalprice")
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()]
    keys = ["o_orderkey", "o_totalprice"]
    got = sorted(map(tuple, O.page_of(d, order, 7, 25, keys, "o_orderkey").collect()))
    assert got == sorted(map(tuple, d.orderBy(*order).offset(150).limit(25).collect()))
    past = O.page_of(d, order, 10**6, 40, keys, "o_orderkey").collect()
    assert len(past) == (d.count() - 1) % 40 + 1


def test_pages_read_their_ranges_and_sort_nothing(spark):
    d = spark.read.parquet(f"{FOLDER}/orders.parquet").select("o_orderkey", "o_totalprice")
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()]
    listing = Listing(d, order, ["o_totalprice"], "o_orderkey")
    want = [r.o_orderkey for r in d.orderBy(*order).collect()]
    for page, size in ((1, 10), (2, 10), (3, 500), (10**6, 40)):
        skip = (min(page, -(-len(want) // size)) - 1) * size
        assert {r.o_orderkey for r in listing.page(d, page, size).collect()} == set(want[skip : skip + size])
    p = plan(listing.keys(2, 10))
    assert "Sort" not in p and "Exchange" not in p and "PartitionFilters: [" in p and "PartitionFilters: []" not in p
    assert Listing(d.limit(0), order, ["o_totalprice"], "o_orderkey").page(d, 1, 10).isEmpty()
