"""HTML tables are read without a pattern search over the white space of every cell."""

from __future__ import annotations

import re
import time

from paperquay.functions.text import SPACES
from paperquay.operators.tables import read_tables

EVENTS = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(?P<end>/?)(?:(?P<cell>t(d|h))|(?P<row>tr)|(?P<table>table))(?:[\s/][^>]*)?>")


def test_long_runs_of_spaces_inside_a_cell_take_linear_time():
    wide = "a" + " " * 30_000 + "b"
    began = time.process_time()
    assert read_tables(f"<table><tr><td> {wide}　<th><!-- <td> -->&nbsp;<b>x</b> 1 < 2{SPACES}</table>", EVENTS) == [
        [0, None, None, [wide, "x 1 < 2"]]
    ]
    assert time.process_time() - began < 1
