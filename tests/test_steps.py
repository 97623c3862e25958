"""Steps that run for every cell, page or event: same results as plain loops, and plans without detours."""

import random
import re

from pyspark.sql import functions as F

from paperquay.functions import text as X
from paperquay.operators import contract as C
from paperquay.operators import tables as T
from paperquay.operators.grams import _grams
from paperquay.plans.catalog import QUERIES

SMALL = "/root/testdata/sf0.001"
ROWS = [
    ["a", "b c", ""], ["", "", ""], [" a", "b"], ["a ", None], [None, None], ["a  b", " x "], ["　", "\t"], ["é x", "nä "], [],
    ["a\x01b", "\x01", " \x01"], ["Destination", "x"], ["  DESTINATION city"], ["  Point"], ["destinatio", "n"], None, ["a\nb", "a\n"], ["x", "\0"],
]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def of_cells(spark, f):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(ROWS)], "i int, cells array<string>")
    return [r[0] for r in df.orderBy("i").select(f(F.col("cells"))).collect()]


def clean(c):
    return re.sub(r"[\s\x1c-\x1f\x85  　]+", " ", c or "").strip(" ")


def test_cells_of_odd_rows(spark):
    assert of_cells(spark, X.clean_cells) == [r if r is None else [clean(c) for c in r] for r in ROWS]
    assert of_cells(spark, X.strip_cells) == [r if r is None else [c if c is None else c.strip(X.SPACES) for c in r] for r in ROWS]
    assert of_cells(spark, X.is_blank_row) == [None if r is None else not any(clean(c) for c in r) for r in ROWS]
    heads = [clean(r[0]).lower().startswith(("destination", "point")) if r else False for r in ROWS]
    assert of_cells(spark, X.is_header_row) == heads


def test_row_tests_walk_no_cells_one_by_one(spark):
    df = spark.createDataFrame([(["a"],)], "cells array<string>").filter(~X.is_blank_row(F.col("cells")) & ~X.is_header_row(F.col("cells")))
    assert "lambda" not in plan(df)


def test_row_maps(spark):
    odd = [(["a", "b"], ["1", "2"]), (["a", "b"], ["1"]), (["a", "b"], ["1", "2", "3"]), (["a", "b", "a"], ["1", "2", "3"]), (["a"], [None]), (["a"], ["\0"]), ([], ["1"]), (["a"], [])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(odd)], "i int, h array<string>, c array<string>")
    got = [r[0] for r in df.orderBy("i").select(T.row_map(F.col("h"), F.col("c"))).collect()]
    want = []
    for h, c in odd:
        want.append({n: ((c + [""] * len(h))[max(i for i, m in enumerate(h) if m == n)] or "") for n in h})
    assert got == want


def test_names_and_titles(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choices("abXY_ 1,-'éİ", k=rnd.randint(0, 9))) for _ in range(300)] + ["NATION_12 via", "o'neil", "a_b", "20'", "Trunk_Lane"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    runs = F.regexp_extract_all("t", F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    slow = F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")
    key = F.regexp_replace(F.replace(F.lower(X.clean_text(F.col("t"))), F.lit("_"), F.lit(" ")), X.WS, " ")
    d = df.select("t", X.title_case(F.col("t")).alias("a"), slow.alias("b"), X.normalize_header(F.col("t")).alias("c"), F.coalesce(X.lookup(X.HEADER_FIELDS, key), key).alias("d"))
    assert [tuple(r) for r in d.filter("a <> b or c <> d").collect()] == []


def test_field_names_come_with_the_tables(spark):
    rows = spark.createDataFrame([(1, 1, 1, 0, 0, ["Destination", "20'", "20'"]), (1, 1, 1, 0, 1, ["x", "1", "2"]), (1, 2, 2, 0, 1, ["y", "1", "2"])], "doc_id int, page int, table_id int, y int, row_no int, cells array<string>")
    got = {r["table_id"]: r["own_headers"] for r in C.tables_of_rows(rows).collect()}
    assert got == {1: ["destination_city", "rate20", "rate20_2"], 2: None}


def test_grams_in_one_pass(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choices("ab\né\U0001f600", k=rnd.randint(0, 40))) for _ in range(200)] + ["", "ab", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(_grams(F.col("t")))
    assert "lambda" not in plan(df)
    assert [r[0] for r in df.collect()] == [t if t is None else list(dict.fromkeys(t[i : i + 3] for i in range(len(t) - 2))) for t in texts]


def test_sparse_cells_read_the_rates_once(spark):
    # Once for the cells and once for the dimensions.
    assert plan(QUERIES["ARR01_grid_fill"](spark, SMALL)).count("Window [") <= 2


def test_cells_of_sheets_are_written_as_columns(spark):
    scans = [x for x in plan(QUERIES["SNK07_export_document_sheet_rows"](spark, SMALL)).splitlines() if "LogicalRDD" in x or "ExistingRDD" in x]
    assert not [x for x in scans if "text#" in x]


def test_compact_tables_move_by_table_alone(spark):
    spark_plan = QUERIES["ARR03_compact_document"](spark, SMALL)._jdf.queryExecution().sparkPlan().toString()
    joins = [x for x in spark_plan.splitlines() if "Join" in x and "table_id#" in x]
    assert joins and not [x for x in joins if "doc_id#" in x]
