"""Extracted tables: dimensions, dense grids, header names, HTML rows.

A cell relation has table_id, row, col, text (and optionally cell_idx, the order of arrival).
A row relation has table_id, row and cells, an array of text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from paperquay.functions.text import SPACES, dedupe_headers, let, strip_cells
from paperquay.operators.ordered import block, join_in_order


def table_dims(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.groupBy(*keys).agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))


def rows_of_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of each row as an array of (col, text), in column order."""
    return cells.groupBy(*keys, "row").agg(
        F.sort_array(F.collect_list(F.struct("col", "text"))).alias("cells")
    )


def grid_fill(cells: DataFrame, dims: DataFrame, keys: list[str], chunk: int = 4096) -> DataFrame:
    """Dense rows of each table: every row 0..rows-1 with ``cols`` texts, '' where no cell is.

    Cells outside the dimensions are ignored; of two cells at one place the later one wins.
    Row numbers are made in chunks that are spread over tasks before they are expanded.
    """
    # One shuffle: the cells of a row in order of place and arrival; of a place the last one counts.
    order = [c for c in ("col", "cell_idx", "text") if c in cells.columns]
    rows = cells.groupBy(*keys, "row").agg(F.sort_array(F.collect_list(F.struct(*order))).alias("__cells"))
    last = F.filter("__cells", lambda x, i: ~F.coalesce(F.get(F.col("__cells"), i + 1)["col"] == x["col"], F.lit(False)))
    by_col = F.map_from_entries(F.transform(last, lambda x: F.struct(x["col"], x["text"])))
    filled = rows.select(*keys, "row", by_col.alias("__by_col"))
    chunks = dims.filter((F.col("rows") > 0) & (F.col("cols") > 0)).withColumn(
        "__first", F.explode(F.expr(f"sequence(0, rows - 1, {chunk})"))
    )
    every = chunks.repartition(*keys, "__first").withColumn(
        "row", F.explode(F.expr(f"sequence(__first, least(__first + {chunk} - 1, rows - 1))"))
    )
    dense = every.join(filled, [*keys, "row"], "left")
    texts = F.transform(
        F.expr("sequence(0, cols - 1)"),
        lambda c: F.coalesce(F.try_element_at("__by_col", c), F.lit("")),
    )
    return dense.select(*keys, "row", texts.alias("cells"))


def compact_rows(rows: DataFrame) -> DataFrame:
    """Header row and non-blank data rows, trimmed."""
    trimmed = rows.withColumn("cells", strip_cells(F.col("cells")))
    return trimmed.filter((F.col("row") == 0) | (F.array_join("cells", "") != ""))


def compact_tables(rows: DataFrame, keys: list[str]) -> DataFrame:
    """JSON {headers, rows} per table."""
    kept = compact_rows(rows)
    parts = kept.withColumn("json", F.to_json("cells"))
    body = join_in_order(
        parts.filter(F.col("row") > 0), keys, ["row"], F.col("json"), ",", block("row", 4096), "body"
    )
    head = parts.filter(F.col("row") == 0).select(*keys, F.col("json").alias("head"))
    return head.join(body, keys, "left").select(
        *keys,
        F.concat(
            F.lit('{"headers":'), F.col("head"), F.lit(',"rows":['), F.coalesce("body", F.lit("")), F.lit("]}")
        ).alias("compact"),
    )


def compact_document(merged_blocks: DataFrame, tables: DataFrame, pages: DataFrame) -> DataFrame:
    """Compact JSON per document: pageCount, merged blocks, tables.

    ``merged_blocks``: doc_id, block_no, page, block_type, text. ``tables``: doc_id, table_id,
    compact. ``pages``: doc_id, page_count.
    """
    b = merged_blocks.withColumn(
        "json", F.to_json(F.struct("text", F.col("block_type").alias("type"), "page"))
    )
    blocks = join_in_order(b, ["doc_id"], ["block_no"], F.col("json"), ",", block("block_no", 4096), "b")
    tabs = join_in_order(tables, ["doc_id"], ["table_id"], F.col("compact"), ",", block("table_id", 4096), "t")
    return pages.join(blocks, "doc_id", "left").join(tabs, "doc_id", "left").select(
        "doc_id",
        F.concat(
            F.lit('{"pageCount":'), F.col("page_count").cast("string"),
            F.lit(',"blocks":['), F.coalesce("b", F.lit("")),
            F.lit('],"tables":['), F.coalesce("t", F.lit("")), F.lit("]}"),
        ).alias("compact"),
    )


def named_headers(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Field names of row 0 of each table."""
    return rows.filter(F.col("row") == 0).select(*keys, dedupe_headers(F.col("cells")).alias("headers"))


def row_map(headers: Column, cells: Column) -> Column:
    """Map header -> cell text; a missing cell is '', of a repeated header the last cell counts."""

    def body(x: Column) -> Column:
        def value(name: Column) -> Column:
            last = F.size(x["h"]) - F.array_position(F.reverse(x["h"]), name) + 1
            return F.coalesce(F.try_element_at(x["c"], last.cast("int")), F.lit(""))

        return F.map_from_arrays(x["n"], F.transform(x["n"], value))

    # Names that differ take the cells in order; whether an array holds a zero character is null if it holds a null.
    alone = (F.size(F.array_distinct(headers)) == F.size(headers)) & ~F.array_contains(cells, F.lit("\0"))
    padded = F.slice(F.concat(cells, F.array_repeat(F.lit(""), F.size(headers))), F.lit(1), F.size(headers))
    in_order = F.map_from_arrays(headers, F.when(F.size(cells) == F.size(headers), cells).otherwise(padded))
    any_names = let(F.struct(headers.alias("h"), F.array_distinct(headers).alias("n"), cells.alias("c")), body)
    return F.when(alone, in_order).otherwise(any_names)


REFERENCE = "&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
_REFERENCE, _TAG = re.compile(REFERENCE), re.compile("(?s)<[^>]*>")


def _character(ref: re.Match) -> str:
    """What a named or numeric character reference stands for; unknown ones stay."""
    name = ref[0][1:-1]
    if not name.startswith("#"):
        return html5.get(name + ";", ref[0])
    code = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code <= 0xDFFF else "\ufffd"


def read_tables(text: str, events: re.Pattern) -> list[list]:
    """Rows of an HTML text in order of their starts: [table, parent row, parent cell, cells].

    One pass over the tags. Every open table is a frame with its number, its open row and the text of its
    open cell; the next row or cell, or the end of the table, closes what was left open. Text belongs
    to the innermost open cell. Where no tag stands for tables, every row opens a frame of its own.
    """
    rows: list[list] = []
    frames: list[list] = [[None, None, None]]
    tables, last, lists = 0, 0, "table" not in events.groupindex

    def end_cell() -> None:
        _, row, held = frames[-1]
        if held is not None:
            plain = "".join(held)
            if "<" in plain:
                plain = _TAG.sub("", plain)
            if "&" in plain:
                plain = _REFERENCE.sub(_character, plain)
            rows[row][3].append(plain.strip(SPACES))
            frames[-1][2] = None

    def end_row() -> None:
        end_cell()
        frames[-1][1] = None

    for m in events.finditer(text):
        start, stop = m.span()
        if frames[-1][2] is not None and last < start:
            frames[-1][2].append(text[last:start])
        last = stop
        kind, starts = m.lastgroup, not m["end"]
        if kind == "cell":
            end_cell()
            if starts and frames[-1][1] is not None:
                frames[-1][2] = []
        elif kind == "row":
            if lists and starts:
                frames.append([None, None, None])
            end_row()
            if starts:
                around = next((f for f in reversed(frames[:-1]) if f[2] is not None), None)
                rows.append([frames[-1][0], around and around[1], around and len(rows[around[1]][3]), []])
                frames[-1][1] = len(rows) - 1
            elif lists and len(frames) > 1:
                frames.pop()
        elif kind == "table":
            if starts:
                frames.append([tables, None, None])
                tables += 1
            elif len(frames) > 1:
                end_row()
                frames.pop()
    if frames[-1][2] is not None:
        frames[-1][2].append(text[last:])
    while frames:
        end_row()
        frames.pop()
    return rows


def html_rows(html: DataFrame, source: str, row_tag: str = "tr", cell_tags: str = "td|th", table_tag: str | None = "table") -> DataFrame:
    """Rows of the tables in an HTML column: adds row, table, parent_row, parent_cell and cells.

    ``row`` numbers the rows of one HTML text in order of their starts, ``table`` its tables (null outside
    any). A table in a cell is a table of its own; its rows name the row and cell they stand in, and
    the cell keeps only its own text. Without ``table_tag`` (lists) a row in a cell nests by itself.
    Tags of a cell's text go, character references are decoded, white space at the ends goes. A null text has no rows.
    """
    kinds = {"cell": cell_tags, "row": row_tag} | ({"table": table_tag} if table_tag else {})
    tags = "|".join(f"(?P<{k}>{v})" for k, v in kinds.items())
    pattern = rf"(?is)<!--.*?(?:-->|\Z)|<(?P<end>/?)(?:{tags})(?:[\s/][^>]*)?>"
    others = [c for c in html.columns if c != source]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        events = re.compile(pattern)
        for batch in batches:
            found: list[list] = [[], [], [], [], []]
            owner = []
            for i, text in enumerate(batch.column(len(others)).to_pylist()):
                for n, row in enumerate(read_tables(text, events) if text else ()):
                    owner.append(i)
                    for column, value in zip(found, (n, *row), strict=True):
                        column.append(value)
            kept = batch.select(range(len(others))).take(pa.array(owner, pa.int64()))
            ints = [pa.array(x, pa.int32()) for x in found[:4]]
            yield pa.RecordBatch.from_arrays([*kept.columns, *ints, pa.array(found[4], pa.list_(pa.string()))], schema=schema)

    new = T.StructType([*(T.StructField(c, T.IntegerType()) for c in ("row", "table", "parent_row", "parent_cell")), T.StructField("cells", T.ArrayType(T.StringType()))])
    slim = html.select(*others, source)
    kind = T.StructType([*slim.schema.fields[:-1], *new.fields])
    schema = to_arrow_schema(kind)
    return slim.mapInArrow(read, kind)
