"""What steps leave on disk, and how wide the rows are that they shuffle."""

import os
import time

from pyspark.sql import functions as F

from paperquay.operators import blocks as B
from paperquay.operators import contract as C
from paperquay.session import CLEANUP_CONF, passing, shared_dir, stored
from paperquay.sinks import export as E


def _shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = disk.getAllFiles()
    return {files.apply(i).getName() for i in range(files.size())} - {None}


def _left(spark, before):
    """Shuffle files that came and stay."""
    for _ in range(50):
        new = {f for f in _shuffle_files(spark) - before if f.startswith("shuffle_")}
        if not new:
            return new
        time.sleep(0.1)
    return new


def _joins(plan):
    """Names of the columns that each side of each join has."""
    kids = plan.children()
    here = [{a.apply(i).name() for i in range(a.size())} for k in range(kids.size()) for a in [kids.apply(k).output()]]
    return ([here] if plan.nodeName() == "Join" else []) + [j for k in range(kids.size()) for j in _joins(kids.apply(k))]


def _rows(spark):
    rows = [(1, 1, 7, 200, 0, ["Destination", "Destination Via", "Cntry", "Cmdt", "Direct Call", "20'", "40'"])]
    rows += [(1, 1, 7, 200, i, [a, v, "CN", "HEA included", "Y", r, "9"]) for i, a, v, r in ((1, "Rome, IT", "", "5"), (2, "", "Oslo", "6"), (3, "Bonn", "", "7"))]
    return spark.createDataFrame(rows, "doc_id long, page long, table_id long, y int, row_no long, cells array<string>")


def test_written_steps_leave_no_shuffle_files(spark):
    shared_dir(spark)
    before = _shuffle_files(spark)
    kept = stored(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "grouped")
    assert not _left(spark, before) and spark.conf.get(CLEANUP_CONF) == "false"
    assert {r.k: r["count"] for r in kept.collect()} == {k: 100 for k in range(10)}
    assert kept.join(kept.groupBy("k").count(), "k").count() == 10


def test_passing_rows_go_with_their_step(spark):
    with passing(spark.range(10), "passing") as rows:
        (file,) = {os.path.dirname(f.removeprefix("file://").removeprefix("file:")) for f in rows.inputFiles()}
        assert rows.count() == 10 and os.path.exists(file)
    assert not os.path.exists(file)


def test_contract_rows_meet_continuations_as_output_columns(spark):
    pages = spark.createDataFrame([(1, 1, "6-1 GENERAL RATE\nCONTRACT ATL9\nvalid from 2024-01-01 to 2024-07-31")], "doc_id long, page long, text string")
    out = C.contract_rows(pages, _rows(spark), "X")["RATES"]
    rows = {r["row_no"]: r for r in out.collect()}
    assert set(rows) == {1, 3} and rows[1]["BaseRate 20"] == "5 6" and rows[1]["destination_via_city"] == "Oslo" and rows[3]["BaseRate 20"] == "7"
    assert {(r["Carrier"], r["Contract ID"], r["effective_date"], r["(HEA) Heavy Surcharge"]) for r in rows.values()} == {("X", "ATL9", "2024-01-01", "included")}
    joins = _joins(out._jdf.queryExecution().optimizedPlan())
    # Neither the whole row nor the header of the document is joined to the rows of a section.
    assert joins and not any("row" in side or side == {"doc_id", "carrier", "contract_id", "effective_date", "expiration_date"} for j in joins for side in j)


def test_sheet_rows_are_joined_once(spark):
    docs = spark.createDataFrame([(1, "a.pdf", "t", "REVIEW", 1.0)], "doc_id long, filename string, full_text string, status string, confidence double")
    grid = spark.createDataFrame([(1, 5, 0, ["x"]), (1, 5, 1, ["y"])], "doc_id long, table_id long, row long, cells array<string>")
    out = E.document_sheets(docs, grid, spark.createDataFrame([(1, 5, 2)], "doc_id long, table_id long, n long"))
    assert [r.cells for r in out.orderBy("row_no").collect()][-3:] == [[], ["x"], ["y"]]
    with_rows = [j for j in _joins(out._jdf.queryExecution().optimizedPlan()) if any({"row", "cells"} <= side for side in j)]
    assert len(with_rows) == 1


def test_merged_blocks_read_texts_without_a_join(spark):
    blocks = spark.createDataFrame([(1, i, 1, "paragraph", f"w{i}") for i in range(3)] + [(2, 8191, 1, "paragraph", "a"), (2, 8192, 1, "paragraph", "b")], "doc_id long, idx long, page long, block_type string, text string")
    out = B.merge_consecutive(blocks)
    assert {(r.doc_id, r.block_no, r.text) for r in out.collect()} == {(1, 1, "w0 w1 w2"), (2, 1, "a b")}
    assert not _joins(out._jdf.queryExecution().optimizedPlan())


def test_rate_rows_are_written_once(spark, tmp_path):
    from datetime import datetime

    from paperquay.plans.fixtures import Lake

    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    given = {
        "lineitem": ([(1, p, 4, n, 2.0, 9.5, 0.0, 0.0, "A", "F", datetime(2024, 1, 1)) for n, p in ((1, 3), (2, 2), (3, 9))], line),
        "part": ([(2, "two"), (3, "three")], "p_partkey long, p_name string"), "supplier": ([(4, 5)], "s_suppkey long, s_nationkey int"),
        "nation": ([(5, "N", 6)], "n_nationkey int, n_name string, n_regionkey int"), "region": ([(6, "R")], "r_regionkey int, r_name string"),
    }
    for name, (rows, kind) in given.items():
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    lake = Lake(spark, str(tmp_path))
    assert not _joins(lake.cells._jdf.queryExecution().optimizedPlan())
    got = {(r.row_no, r.commodity, r.destination_city, r.destination_via_city, r.cur, r.direct_call, r.rate20, r.rate40) for r in lake.rates.collect()}
    assert got == {(1, "two", "N", "", "EUR", "Y", "2", "9"), (2, "three", "N", "R", "EUR", "", "2", "9")}
