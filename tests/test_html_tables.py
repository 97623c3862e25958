"""HTML tables and parser warnings: nesting, what is left open, references, edge values."""

import re

import pytest

from paperquay.operators import contract as C
from paperquay.operators import tables as T

CASES = {
    "<table><tr><td>a<td>b<tr><th> c </table>": [(0, 0, None, None, ["a", "b"]), (1, 0, None, None, ["c"])],
    "<TABLE><TR class='x'><TD>a &amp;lt; &eacute;&#x2019;&nope; &#0;&#xD800;</TD></TR></TABLE>": [(0, 0, None, None, ["a &lt; é’&nope; ��"])],
    "<table><tr><td>x<table><tr><td>in<td>ner</table>y</td><td>z</table>": [(0, 0, None, None, ["xy", "z"]), (1, 1, 0, 0, ["in", "ner"])],
    "<table><tr><td>1</td><td><table><tr><td><table><tr><td>deep</table>mid</table>": [
        (0, 0, None, None, ["1", ""]), (1, 1, 0, 1, ["mid"]), (2, 2, 1, 0, ["deep"]),
    ],
    "<tr><td>no table</tr> text <td>no row</td></table></tr>": [(0, None, None, None, ["no table"])],
    "<table><thead><tr><th>h</thead><!-- <tr><td>no --><tr></tr></table><table><tr><td>b": [
        (0, 0, None, None, ["h"]), (1, 0, None, None, []), (2, 1, None, None, ["b"]),
    ],
    "plain": [], "": [], None: [], "<table": [],
}


def test_rows_of_tables(spark):
    frame = spark.createDataFrame(list(enumerate(CASES)), "id int, html string")
    got = {}
    for r in T.html_rows(frame, "html").collect():
        got.setdefault(r.id, []).append((r.row, r.table, r.parent_row, r.parent_cell, r.cells))
    for i, want in enumerate(CASES.values()):
        assert sorted(got.get(i, [])) == want, list(CASES)[i]
    assert T.html_rows(frame.limit(0), "html").columns == ["id", "row", "table", "parent_row", "parent_cell", "cells"]


def test_lists_nest(spark):
    frame = spark.createDataFrame([("<ul><li>a<ul><li>b</li></ul>c</li><li>d</ul>",)], "html string")
    got = sorted((r.row, r.parent_row, r.parent_cell, r.cells) for r in T.html_rows(frame, "html", "ul", "li", None).collect())
    assert got == [(0, None, None, ["ac", "d"]), (1, 0, 0, ["b"])]


@pytest.mark.parametrize("depth", [1, 400])
def test_deep_nesting(depth):
    events = re.compile(r"(?is)<(?P<end>/?)(?:(?P<cell>td)|(?P<row>tr)|(?P<table>table))>")
    rows = T.read_tables("<table><tr><td>" * depth + "x" + "</td></tr></table>" * depth, events)
    assert len(rows) == depth and rows[-1][3] == ["x"] and [r[1] for r in rows] == [None, *range(depth - 1)]


def test_warnings_of_documents_and_tables(spark):
    facts = spark.createDataFrame(
        [(1, 1, [(5, ["RATES"])]), (1, 2, []), (2, 1, []), (3, 1, None)], "doc_id long, page long, marks array<struct<y:long,hits:array<string>>>"
    )
    tables = spark.createDataFrame([(1, 2, 7, "RATES", None), (1, 2, 8, "RATES", ["a"])], "doc_id long, page long, table_id long, section string, headers array<string>")
    got = sorted(map(tuple, C.parser_warnings(facts, tables).collect()))
    skipped = "Page 2: skipped continuation table in RATES with no prior headers"
    assert got == [(1, 2, 7, skipped), (2, None, None, C.NO_BOUNDARIES), (3, None, None, C.NO_BOUNDARIES)]
    assert C.parser_warnings(facts.limit(0), tables.limit(0)).count() == 0
