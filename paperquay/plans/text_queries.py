"""Queries over text blocks, tables, answers and plain columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperquay.functions import dates as D
from paperquay.functions import json_cols as J
from paperquay.functions import numbers as N
from paperquay.functions import text as X
from paperquay.operators import answers as A
from paperquay.operators import blocks as B
from paperquay.operators import tables as T
from paperquay.operators.ordered import block, join_in_order
from paperquay.plans.registry import query

# -- blocks ------------------------------------------------------------------------------------


@query(
    "AGG06_block_confidence_mean", "v2",
    "select doc_id, coalesce(cast(printf('%.2f', avg(confidence) filter (where confidence > 0)) as double), 0.0) as avg_confidence from v2 group by doc_id",
)
def _(lake):
    return B.confidence_mean(lake.blocks)


@query("AGG08_page_count", "v2", "select doc_id, max(page) as page_count from v2 group by doc_id")
def _(lake):
    return B.page_count(lake.blocks)


@query(
    "AGG09_bbox_union", "v2",
    """select doc_id, page, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2, max(cast(floor(x2 + 0.5) as bigint)) as quad_x2
from v2 where has_box group by doc_id, page""",
)
def _(lake):
    """Boxes of blocks per page, and the same from corner points with fractions cut off."""
    b = F.col("bbox")
    corner = F.array(
        *[F.array(x + 0.75, y + 0.5) for x, y in [(b["x1"], b["y1"]), (b["x2"], b["y1"]), (b["x2"], b["y2"]), (b["x1"], b["y2"])]]
    )
    d = lake.blocks.withColumn("quad", F.when(b.isNotNull(), B.quad_box(corner)))
    quads = d.groupBy("doc_id", "page").agg(F.max("quad.x2").alias("quad_x2"))
    return B.bbox_union(d, ["doc_id", "page"]).join(quads, ["doc_id", "page"])


@query(
    "STR01_clean_text", "v2",
    "select doc_id, idx, trim(regexp_replace(concat(' ', text, '  x ', chr(9)), '\\s+', ' ', 'g')) as clean from v2",
)
def _(lake):
    messy = F.concat(F.lit(" "), F.col("text"), F.lit("  x \t"))
    return lake.blocks.select("doc_id", "idx", X.clean_text(messy).alias("clean"))


@query(
    "STR06_normalize_text", "v2",
    "select doc_id, idx, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) as normal, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') as loose from v2",
)
def _(lake):
    t = F.col("text")
    return lake.blocks.select("doc_id", "idx", X.normalize_text(t).alias("normal"), X.normalize_loose(t).alias("loose"))


@query(
    "STR22_block_type_classify", "v2",
    """select doc_id, idx, case when idx % 6 = 5 then 'heading' when idx % 6 = 0 then 'heading' when idx % 6 = 1 then 'list'
  when idx % 6 = 2 then 'header' when idx % 6 = 3 then 'footer' else 'paragraph' end as block_type from v2""",
)
def _(lake):
    names = F.array(*[F.lit(n) for n in ["SectionTitle", "ListItem", "PageHeader", "Footer", "NarrativeText", "NarrativeText"]])
    k = (F.col("idx") % 6).cast("int")
    text = F.when(k == 5, F.concat(F.lit("# "), F.col("text"))).otherwise(F.concat(F.lit("."), F.col("text")))
    return lake.blocks.select("doc_id", "idx", X.block_type(F.try_element_at(names, k + 1), text).alias("block_type"))


@query(
    "WIN01_merge_consecutive_blocks", "v2",
    """select doc_id, block_no, any_value(page) as page, any_value(block_type) as block_type, string_agg(text, ' ' order by idx) as text
from (select *, sum(case when block_type = 'paragraph' and pt = 'paragraph' and pp = page then 0 else 1 end) over (partition by doc_id order by idx) as block_no
  from (select *, lag(block_type) over w as pt, lag(page) over w as pp from (select * exclude (text), trim(text) as text from v2) k where text <> ''
    window w as (partition by doc_id order by idx)) a) b group by doc_id, block_no""",
)
def _(lake):
    return B.merge_consecutive(lake.blocks).select("doc_id", "block_no", "page", "block_type", "text")


@query(
    "WIN07_block_runs", "v2",
    """select doc_id, start, len, md5(string_agg(text, chr(10) order by j)) as texts_md5, min(j) as first_idx, max(j) as last_idx, min(page) as page from (
  select a.doc_id, a.idx as start, unnest(range(1, count(b.idx) + 1)) as len from v2 a join v2 b on a.doc_id = b.doc_id and b.idx between a.idx and a.idx + 5 and b.page = a.page group by a.doc_id, a.idx) r
join (select doc_id as d, idx as j, text, page from v2) b on b.d = r.doc_id and b.j between r.start and r.start + r.len - 1 group by doc_id, start, len""",
)
def _(lake):
    runs = B.block_runs(lake.blocks)
    texts = F.array_join(F.transform("run", lambda b: b["text"]), "\n")
    return runs.select(
        "doc_id", "start", F.col("len").cast("long").alias("len"), F.md5(texts).alias("texts_md5"),
        F.array_min(F.transform("run", lambda b: b["idx"])).alias("first_idx"), F.array_max(F.transform("run", lambda b: b["idx"])).alias("last_idx"), "page",
    )


LOW = "abcdefghijklmnopqrstuvwxyz"


# A long answer: the text of one block (two for every third document), shouted and punctuated.
def _answers(lake):
    lines = lake.texts.filter(F.col("text").isNotNull()).select("doc_id", F.split("text", "\n").alias("lines"))
    # Rows of one document count together.
    n = F.sum(F.size("lines")).over(W.partitionBy("doc_id"))
    at = lines.withColumn("at", (F.col("doc_id") % n).cast("int"))
    texts = [F.collect_list(F.get("lines", F.col("at") + k)).alias(c) for k, c in enumerate(["text", "more"])]
    picked = at.groupBy("doc_id").agg(*texts)
    two = picked.select("doc_id", F.explode("text").alias("text"), "more").select("doc_id", "text", F.explode_outer("more").alias("more"))
    text = F.when((F.col("doc_id") % 3 == 0) & F.col("more").isNotNull(), F.concat_ws(" - ", "text", "more")).otherwise(F.col("text"))
    long = two.select("doc_id", F.lit("body").alias("key"), F.lit(0).alias("ord"), F.concat(F.lit("  "), F.translate(text, LOW, LOW.upper()), F.lit(" !")).alias("answer"))
    short = lake.docs.select("doc_id", F.lit("lang").alias("key"), F.lit(1).alias("ord"), F.col("notes").alias("answer"))
    blank = lake.docs.select("doc_id", F.lit("none").alias("key"), F.lit(2).alias("ord"), F.lit(" .. ").alias("answer"))
    return long.unionByName(short).unionByName(blank)


MATCH_SQL = """
ans as (
  select doc_id, 'body' as key, 0 as ord, concat(translate(case when doc_id % 3 = 0 and more is not null then concat(text, ' - ', more) else text end, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), ' !') as answer
  from (select v.doc_id, v.text, w.text as more from (select doc_id, count(*) as n from v2 group by doc_id) c join v2 v on v.doc_id = c.doc_id and v.idx = c.doc_id % c.n
    left join v2 w on w.doc_id = v.doc_id and w.idx = v.idx + 1) t
  union all select doc_id, 'lang', 1, lang from documents),
runs as (
  select a.doc_id, a.idx as start, b.idx - a.idx + 1 as len, string_agg(m.text, ' ' order by m.idx) as text,
    min(m.x1) filter (where m.has_box) as x1, min(m.y1) filter (where m.has_box) as y1, max(m.x2) filter (where m.has_box) as x2, max(m.y2) filter (where m.has_box) as y2
  from v2 a join v2 b on a.doc_id = b.doc_id and b.idx between a.idx and a.idx + 5 and a.page = b.page
    join v2 m on m.doc_id = a.doc_id and m.idx between a.idx and b.idx
  where a.has_box group by a.doc_id, a.idx, b.idx),
norm as (
  select r.*, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) as n, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') as l from runs r),
target as (
  select *, trim(regexp_replace(lower(answer), '\\s+', ' ', 'g')) as n, regexp_replace(lower(answer), '[^a-z0-9]+', '', 'g') as l from ans),
hits as (
  select t.doc_id, t.key, t.ord, r.start, r.len, r.x1, r.y1, r.x2, r.y2,
    case when r.l = t.l or r.n = t.n then 1000 - r.len when contains(r.l, t.l) or contains(r.n, t.n) then 850 - r.len
      when contains(t.l, r.l) and length(r.l) >= least(10, length(t.l)) then 700 - r.len end as score
  from target t join norm r on r.doc_id = t.doc_id where t.l <> ''),
best as (
  select doc_id, key, ord, score, start, len, x1, y1, x2, y2 from hits where score is not null
  qualify row_number() over (partition by doc_id, key order by score desc, start, len) = 1)
"""


@query("JON07_field_to_block_match", "v2", "select * from best", tail=MATCH_SQL)
def _(lake):
    return B.match_fields(lake.blocks, _answers(lake)).select("doc_id", "key", "ord", "score", "start", "len", "x1", "y1", "x2", "y2")


@query(
    "JON08_block_to_field", "v2",
    "select doc_id, idx, arg_min(key, ord) as key from (select doc_id, key, ord, unnest(range(start, start + len)) as idx from best) t group by doc_id, idx",
    tail=MATCH_SQL,
)
def _(lake):
    return B.block_fields(B.match_fields(lake.blocks, _answers(lake))).select("doc_id", "idx", "key")


# -- documents as text -------------------------------------------------------------------------

# All tables are dealt over the documents, and stand on page 1 or 2.
def _doc_rows(lake):
    return lake.table_rows.withColumns({"page": F.col("table_id") % 2 + 1, "doc_id": lake.document_of("table_id")})


OWNER = "table_id % (select count(*) from documents)"


PART_SQL = f"""select {OWNER} as doc_id, t.table_id, string_agg(trim(cell), ' | ' order by "row", j) as part
from v3r t, lateral (select unnest(range(1, len(t.cells) + 1)) as j) u, lateral (select t.cells[u.j] as cell) c
where trim(cell) <> '' group by t.table_id"""
PARTS_SQL = f"""select doc_id, page, 0 as kind, idx, text as part from v2
union all select doc_id, table_id % 2 + 1, 1, table_id, part from ({PART_SQL}) p"""


@query("SET04_text_union", "v2 v3r", PARTS_SQL)
def _(lake):
    return B.text_parts(lake.blocks, _doc_rows(lake))


@query(
    "AGG07_assemble_full_text", "v2 v3r",
    f"select doc_id, string_agg(part, chr(10) order by page, kind, idx) as full_text from ({PARTS_SQL}) p group by doc_id",
)
def _(lake):
    return B.assemble_text(B.text_parts(lake.blocks, _doc_rows(lake)))


@query(
    "STR18_markdown_blocks", "v2 v3r",
    f"""select doc_id, string_agg(part, chr(10) || chr(10) order by kind, idx) as markdown from (
  select doc_id, 0 as kind, idx, case when block_type = 'heading' then concat('## ', trim(text)) else trim(text) end as part from v2 where trim(text) <> ''
  union all select {OWNER}, 1, table_id, string_agg(concat('| ', array_to_string(cells, ' | '), ' |',
      case when "row" = 0 then concat(chr(10), '|', repeat(' --- |', len(cells))) else '' end), chr(10) order by "row")
    from v3r group by table_id) p group by doc_id""",
)
def _(lake):
    return B.markdown(lake.blocks, _doc_rows(lake))


@query(
    "STR19_paragraph_split", "",
    """select doc_id, row_number() over (partition by doc_id order by i) - 1 as idx, part from (
  select doc_id, i, trim(parts[i]) as part from (select doc_id, string_split(text, chr(10)) as parts from documents) d, unnest(range(1, len(parts) + 1)) as u(i)) t
where part <> ''""",
)
def _(lake):
    d = lake.texts.select("doc_id", F.posexplode(X.paragraphs(F.col("text"), "\n")).alias("idx", "part"))
    return d.withColumn("idx", F.col("idx").cast("long"))


@query(
    "STR20_word_chunks", "",
    """select doc_id, k as chunk_no, case when n <= 850 then text else array_to_string(words[k * 730 + 1 : k * 730 + 850], ' ') end as chunk
from (select *, unnest(case when n <= 850 then range(0, 1) else range(0, (n - 1) // 730 + 1) end) as k
  from (select doc_id, text, regexp_extract_all(text, '[^ \\n]+') as words, len(regexp_extract_all(text, '[^ \\n]+')) as n from documents) a) b""",
)
def _(lake):
    d = lake.texts.select("doc_id", F.posexplode(X.word_chunks(F.col("text"))).alias("chunk_no", "chunk"))
    return d.withColumn("chunk_no", F.col("chunk_no").cast("long"))


# -- tables ------------------------------------------------------------------------------------


@query("AGG10_table_dims", "v3", 'select table_id, max("row") + 1 as rows, max(col) + 1 as cols from v3 group by table_id')
def _(lake):
    return T.table_dims(lake.cells, ["table_id"])


@query(
    "SRT04_table_cell_order", "v3",
    """select table_id, "row", string_agg(text, '|' order by col) as cells from v3 group by table_id, "row" """,
)
def _(lake):
    d = T.rows_of_cells(lake.cells, ["table_id"])
    return d.select("table_id", "row", F.array_join(F.transform("cells", lambda c: c["text"]), "|").alias("cells"))


# Some cells missing, some given twice, some out of range.
def _sparse(lake):
    c = lake.cells.filter((F.col("row") * 7 + F.col("col")) % 5 != 4)

    def cell(col: Column, text: Column, idx: int) -> Column:
        return F.struct(col.alias("col"), text.alias("text"), F.lit(idx).alias("cell_idx"))

    col, text = F.col("col"), F.col("text")
    own, twice, far = cell(col, text, 0), cell(col, F.concat(F.lit("new "), text), 1), cell(col + 50, text, 2)
    given = F.when(col == 2, F.array(own, twice)).when(col == 1, F.array(own, far)).otherwise(F.array(own))
    return c.select("table_id", "row", F.inline(given))


GRID_SQL = """select table_id, "row", string_agg(case when ("row" * 7 + col) % 5 = 4 then '' when col = 2 then concat('new ', text) else text end, '|' order by col) as cells
from v3 group by table_id, "row" """


@query("ARR01_grid_fill", "v3", GRID_SQL)
def _(lake):
    grid = T.grid_fill(_sparse(lake), T.table_dims(lake.cells, ["table_id"]), ["table_id"])
    return grid.select("table_id", "row", F.array_join("cells", "|").alias("cells"))


# Rows whose number is 2 modulo 5 are emptied.
def _with_blank_rows(lake):
    blank = F.transform("cells", lambda c: F.lit(" "))
    return lake.table_rows.withColumn("cells", F.when(F.col("row") % 5 == 2, blank).otherwise(F.col("cells")))


@query(
    "ARR02_compact_table", "v3r",
    """select table_id, "row", array_to_string(cells, '|') as cells from v3r where "row" % 5 <> 2""",
)
def _(lake):
    d = T.compact_rows(_with_blank_rows(lake))
    return d.select("table_id", "row", F.array_join("cells", "|").alias("cells"))


JSTR = """concat('"', replace(replace({0}, '\\', '\\\\'), '"', '\\"'), '"')"""
CELLS_JSON = "concat('[', array_to_string(list_transform(cells, lambda c: " + JSTR.format("c") + "), ','), ']')"


@query(
    "ARR03_compact_document", "v2 v3r",
    f"""select p.doc_id, concat('{{"pageCount":', cast(p.page_count as varchar), ',"blocks":[', b.blocks, '],"tables":[', coalesce(t.tables, ''), ']}}') as compact
from (select doc_id, max(page) as page_count from v2 group by doc_id) p
join (select doc_id, string_agg(concat('{{"text":', {JSTR.format('text')}, ',"type":"', block_type, '","page":', cast(page as varchar), '}}'), ',' order by block_no) as blocks from (
    select doc_id, block_no, any_value(page) as page, any_value(block_type) as block_type, string_agg(text, ' ' order by idx) as text
    from (select *, sum(case when block_type = 'paragraph' and pt = 'paragraph' and pp = page then 0 else 1 end) over (partition by doc_id order by idx) as block_no
      from (select *, lag(block_type) over w as pt, lag(page) over w as pp from (select * exclude (text), trim(text) as text from v2) k where text <> ''
        window w as (partition by doc_id order by idx)) a) m group by doc_id, block_no) n group by doc_id) b on b.doc_id = p.doc_id
left join (select doc_id, string_agg(tables, ',' order by table_id) as tables from (select {OWNER} as doc_id, table_id, concat('{{"headers":', min(case when "row" = 0 then {CELLS_JSON} end), ',"rows":[',
    string_agg(case when "row" > 0 then {CELLS_JSON} end, ',' order by "row"), ']}}') as tables from v3r group by table_id) s group by doc_id) t on t.doc_id = p.doc_id""",
)
def _(lake):
    merged = B.merge_consecutive(lake.blocks)
    # A table has one document, so tables are put together by their own key, by which their rows lie already.
    tables = T.compact_tables(lake.table_rows, ["table_id"]).withColumn("doc_id", lake.document_of("table_id"))
    return T.compact_document(merged, tables, B.page_count(lake.blocks))


HEADER_SQL = "'destination_city|destination_via_city|cmdt|cur|direct_call|rate20|rate20_2'"


@query("WIN05_dedupe_headers", "v3r", f"""select table_id, {HEADER_SQL} as headers from v3r where "row" = 0""")
def _(lake):
    d = T.named_headers(lake.table_rows, ["table_id"])
    return d.select("table_id", F.array_join("headers", "|").alias("headers"))


@query(
    "STR05_normalize_header", "v3",
    """select table_id, col, case col when 0 then 'destination_city' when 1 then 'destination_via_city' when 2 then 'cmdt' when 3 then 'cur' when 4 then 'direct_call' else 'rate20' end as field,
  case col when 0 then 'extra destination' when 1 then 'extra destination via' when 2 then 'extra cmdt' when 3 then 'extra cur' when 4 then 'extra direct call' else 'extra 20''' end as unknown
from v3 where "row" = 0""",
)
def _(lake):
    odd = F.concat(F.lit("  "), F.replace(F.upper("text"), F.lit(" "), F.lit("_")), F.lit("\n"))
    return lake.cells.filter(F.col("row") == 0).select(
        "table_id", "col", X.normalize_header(odd).alias("field"), X.normalize_header(F.concat(F.lit("EXTRA "), F.col("text"))).alias("unknown")
    )


@query(
    "STR12_row_predicates", "v3r",
    """select table_id, "row", "row" % 5 = 2 as blank, "row" = 0 as header, "row" % 5 <> 2 and regexp_matches(cells[6], '[0-9]') as digits from v3r""",
)
def _(lake):
    d = _with_blank_rows(lake)
    return d.select(
        "table_id", "row", X.is_blank_row(F.col("cells")).alias("blank"), X.is_header_row(F.col("cells")).alias("header"),
        X.has_digit(F.try_element_at("cells", F.lit(6))).alias("digits"),
    )


@query(
    "ARR04_row_dict", "v2r",
    """select l_orderkey as table_id, row_no as "row", destination_city, direct_call, rate20, case when row_no % 4 = 1 then '' else rate40 end as rate20_2, 7 as n from v2r""",
)
def _(lake):
    """Every fourth row is one cell short."""
    heads = T.named_headers(lake.table_rows, ["table_id"])
    cells = F.when(F.col("row") % 4 == 1, F.slice("cells", 1, 6)).otherwise(F.col("cells"))
    d = lake.table_rows.filter(F.col("row") > 0).join(heads, "table_id").withColumn("m", T.row_map(F.col("headers"), cells))
    names = ["destination_city", "direct_call", "rate20", "rate20_2"]
    return d.select("table_id", "row", *[F.col("m")[n].alias(n) for n in names], F.size("m").cast("long").alias("n"))


@query(
    "ARR06_html_table_cells", "v3r",
    """select 'table' as kind, table_id as id, "row", array_to_string(list_transform(cells, lambda c: trim(concat(c, ' é’&lt;'))), '|') as cells from v3r
union all select 'list', page_id, i - 1, array_to_string(list_transform(regexp_extract_all(uls[i], '(?s)<li>(.*?)</li>', 1), lambda c: trim(replace(regexp_replace(c, '<[^>]*>', '', 'g'), '&amp;', '&'))), '|')
from (select page_id, regexp_extract_all(html, '(?s)<ul>(.*?)</ul>', 1) as uls from pages) p, unnest(range(1, len(uls) + 1)) as u(i)""",
)
def _(lake):
    """Tables printed as HTML and read back; lists of the given pages read the same way."""
    td = F.transform("cells", lambda c: F.concat(F.lit('<td class="x">'), F.replace(c, F.lit("'"), F.lit("&#39;")), F.lit(" &eacute;&#x2019;&amp;lt;</td>")))
    tr = F.concat(F.lit("<tr>"), F.array_join(td, "\n"), F.lit("</TR>"))
    body = join_in_order(lake.table_rows, ["table_id"], ["row"], tr, "\n", block("row", 4096), "rows")
    html = body.select(F.lit("table").alias("kind"), F.col("table_id").alias("id"), F.concat(F.lit("<table>"), F.col("rows"), F.lit("</table>")).alias("html"))
    lists = lake.table("pages").select(F.lit("list").alias("kind"), F.col("page_id").alias("id"), "html")
    found = T.html_rows(html, "html").unionByName(T.html_rows(lists, "html", "ul", "li", None))
    return found.select("kind", "id", F.col("row").cast("long").alias("row"), F.array_join("cells", "|").alias("cells"))


@query(
    "ARR06_nested_tables", "v3r",
    """select doc_id, inner_no, tag, "row", parent_cell, cells from (
  select table_id as doc_id, 0 as inner_no, 'outer' as tag, (select count(*) from v3r x where x.table_id = t.table_id and x."row" < t."row") * 2 as "row", null as parent_cell, array_to_string(list_transform(cells, lambda c: trim(c)), '|') as cells from v3r t
  union all select table_id, 1 + "row", 'inner', (select count(*) from v3r x where x.table_id = t.table_id and x."row" < t."row") * 2 + 1, 1, concat('in ', "row", '|', trim(cells[1])) from v3r t) u""",
)
def _(lake):
    """Each row's second cell holds a table that says the row's number and repeats its first cell."""
    inside = F.concat(F.lit("<table><tr><td>in "), F.col("row").cast("string"), F.lit("<td>"), F.element_at("cells", 1), F.lit("</table>"))
    td = F.transform("cells", lambda c, i: F.concat(F.lit("<td>"), c, F.when(i == 1, inside).otherwise(""), F.when(i != 1, "</td>").otherwise("")))
    tr = F.concat(F.lit("<tr>"), F.array_join(td, ""), F.lit("</tr>"))
    body = join_in_order(lake.table_rows, ["table_id"], ["row"], tr, "\n", block("row", 4096), "rows")
    html = body.select(F.col("table_id").alias("doc_id"), F.concat(F.lit("<table>"), F.col("rows"), F.lit("</table>")).alias("html"))
    found = T.html_rows(html, "html")
    number = F.regexp_extract(F.element_at("cells", 1), "^in ([0-9]+)$", 1)
    inner = F.col("parent_row").isNotNull()
    return found.select(
        "doc_id", F.when(inner, number.try_cast("long") + 1).otherwise(0).cast("long").alias("inner_no"), F.when(inner, "inner").otherwise("outer").alias("tag"),
        F.col("row").cast("long").alias("row"), "parent_cell", F.array_join("cells", "|").alias("cells"),
    )


# -- names, cities, dates ----------------------------------------------------------------------

TITLE = "array_to_string(list_transform(regexp_extract_all(lower({0}), '[a-z]+|[^a-z]+'), lambda s: concat(upper(s[1]), s[2:])), '')"


@query(
    "STR02_city_only", "",
    f"select p_partkey, {TITLE.format('concat(p_name, chr(39), p_brand)')} as city from part",
)
def _(lake):
    raw = F.concat(F.lit("  "), F.upper("p_name"), F.lit("'"), F.col("p_brand"), F.lit("  , "), F.col("p_type"), F.lit(", XX"))
    return lake.table("part").select("p_partkey", X.city_only(raw).alias("city"))


@query("STR03_preserve_city", "", f"select p_partkey, {TITLE.format('''concat(p_name, ', ', p_type)''')} as city from part")
def _(lake):
    raw = F.concat(F.upper("p_name"), F.lit(",\n "), F.col("p_type"))
    return lake.table("part").select("p_partkey", X.preserve_city(raw).alias("city"))


@query(
    "STR04_short_commodity", "",
    """select p_partkey, case p_partkey % 4 when 3 then concat(p_name, ' and/or ', p_type) else p_name end as short from part""",
)
def _(lake):
    name, kind = F.col("p_name"), F.col("p_type")
    raw = (
        F.when(F.col("p_partkey") % 4 == 0, F.concat(name, F.lit(" :, excluding "), kind))
        .when(F.col("p_partkey") % 4 == 1, F.concat(name, F.lit(". (bulk) "), kind))
        .when(F.col("p_partkey") % 4 == 2, F.concat(name, F.lit(" -  AND/OR "), kind))
        .otherwise(F.concat(name, F.lit("  and/or "), kind))
    )
    return lake.table("part").select("p_partkey", X.short_commodity(raw).alias("short"))


@query(
    "STR07_slug_key", "",
    "select p_partkey, concat(replace(p_name, ' ', '_'), '_', lower(replace(p_brand, '#', '_'))) as slug from part",
)
def _(lake):
    return lake.table("part").select("p_partkey", X.slug_key(F.concat(F.lit("#"), F.col("p_name"), F.lit(" - "), F.col("p_brand"), F.lit("?!"))).alias("slug"))


@query(
    "STR10_humanise_key", "",
    f"select p_partkey, case when p_partkey % 10 = 0 then 'Via City' else {TITLE.format('p_name')} end as label from part",
)
def _(lake):
    """Keys in camel case made of part names; every tenth part asks for a known key."""
    camel = F.when(F.col("p_partkey") % 10 == 0, "originViaCity").otherwise(F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")))
    return lake.table("part").select("p_partkey", X.humanise_key(camel).alias("label"))


SPELL = """case o_orderkey % 11 when 0 then strftime(o_orderdate, '%d/%m/%Y') when 1 then strftime(o_orderdate, '%d-%m-%Y') when 2 then strftime(o_orderdate, '%-d %b, %Y')
 when 3 then strftime(o_orderdate, '%d %B, %Y') when 4 then strftime(o_orderdate, '%d %b %Y') when 5 then strftime(o_orderdate, '%-d %B %Y')
 when 6 then strftime(o_orderdate, '%Y-%m-%d') when 7 then strftime(o_orderdate, '%Y%m%d') when 8 then strftime(o_orderdate, '%m/%d/%Y')
 when 9 then strftime(o_orderdate, '%d/%m/%y') else concat('on ', o_orderpriority) end"""


def _spelled(d):
    day = F.col("o_orderdate")
    forms = ["dd/MM/yyyy", "dd-MM-yyyy", "d MMM, yyyy", "dd MMMM, yyyy", "dd MMM yyyy", "d MMMM yyyy", "yyyy-MM-dd", "yyyyMMdd", "MM/dd/yyyy", "dd/MM/yy"]
    out = F.concat(F.lit("on "), F.col("o_orderpriority"))
    for i, f in enumerate(forms):
        out = F.when(F.col("o_orderkey") % 11 == i, F.date_format(day, f)).otherwise(out)
    return d.withColumn("spelled", out)


@query(
    "DTM01_to_iso_date", "",
    f"""select o_orderkey, {SPELL} as spelled, case when o_orderkey % 11 < 8 then strftime(o_orderdate, '%Y-%m-%d')
  when o_orderkey % 11 = 8 then case when day(o_orderdate) <= 12 then printf('%04d-%02d-%02d', year(o_orderdate), day(o_orderdate), month(o_orderdate)) else strftime(o_orderdate, '%Y-%m-%d') end
  when o_orderkey % 11 = 9 then strftime(o_orderdate, '%d/%m/%y') else concat('on ', o_orderpriority) end as iso from orders""",
)
def _(lake):
    return _spelled(lake.table("orders")).select("o_orderkey", "spelled", D.to_iso_date(F.col("spelled")).alias("iso"))


@query(
    "DTM02_date_ranges", "",
    """select o_orderkey, concat(strftime(o_orderdate, '%Y-%m-%d'), '/', strftime(o_orderdate + interval 30 day, '%Y-%m-%d')) as pairs, 3 as tokens from orders""",
)
def _(lake):
    day, end = F.col("o_orderdate"), F.date_add("o_orderdate", 30)
    text = F.concat(
        F.lit("VALID from "), F.date_format(day, "yyyyMMdd"), F.lit(" thru "), F.date_format(end, "d MMM, yyyy"), F.lit(" or 1/2/24")
    )
    d = lake.table("orders").select("o_orderkey", D.date_pairs(text).alias("p"), D.date_tokens(text).alias("t"))
    return d.select("o_orderkey", F.array_join(F.transform("p", lambda x: F.concat_ws("/", x["start"], x["end"])), " ").alias("pairs"), F.size("t").cast("long").alias("tokens"))


@query(
    "SET02_distinct_date_pairs", "",
    """select o_orderkey, case when o_orderkey % 2 = 0 then concat(strftime(o_orderdate, '%Y-%m-%d'), '/2030-01-01 2029-01-01/2030-01-01')
  else concat('2029-01-01/2030-01-01 ', strftime(o_orderdate, '%Y-%m-%d'), '/2030-01-01') end as pairs from orders""",
)
def _(lake):
    day = F.col("o_orderdate")
    own, fixed = F.concat(F.lit("valid "), F.date_format(day, "yyyy-MM-dd"), F.lit(" through 20300101\n")), F.lit("valid from 1 Jan 2029 to 2030-01-01, ")
    own2 = F.concat(F.lit("valid from "), F.date_format(day, "yyyyMMdd"), F.lit(" to 2030-01-01 "))
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(own, fixed, own2)).otherwise(F.concat(fixed, own, own2, fixed))
    d = lake.table("orders").select("o_orderkey", D.date_pairs(text).alias("p"))
    return d.select("o_orderkey", F.array_join(F.transform("p", lambda x: F.concat_ws("/", x["start"], x["end"])), " ").alias("pairs"))


def _stamped(lake):
    """Order times with hours and minutes; every ninth is missing."""
    ts = F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") * 61) % 86400)
    return lake.table("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, ts).alias("t"))


STAMP = "o_orderdate + to_seconds((o_orderkey * 61) % 86400)"


@query("DTM03_short_datetime", "", f"select o_orderkey, case when o_orderkey % 9 = 0 then '—' else strftime({STAMP}, '%d/%m/%y %H:%M') end as shown from orders")
def _(lake):
    return _stamped(lake).select("o_orderkey", D.short_datetime(F.col("t")).alias("shown"))


@query("DTM04_long_date", "", f"select o_orderkey, case when o_orderkey % 9 = 0 then '—' else strftime({STAMP}, '%b %-d, %Y, %I:%M %p') end as shown from orders")
def _(lake):
    return _stamped(lake).select("o_orderkey", D.long_date(F.col("t")).alias("shown"))


# -- answers -----------------------------------------------------------------------------------

COLUMNS = [
    {"key": "doc_source", "label": "Source", "question": "Which source?"},
    {"key": "lang", "label": "Language", "question": "Which language?"},
    {"key": "size", "label": "Size", "question": " "},
    {"key": "missing", "label": "", "question": "Anything else?"},
]
REPLY = {
    "doc_source": "case when doc_id % 4 = 2 then '' else coalesce(session_id, '') end",
    "lang": "case when doc_id % 4 = 2 then '' else notes end",
    "size": "case when doc_id % 4 >= 2 then '' else cast(page_count as varchar) end",
    "missing": "''",
}


@query(
    "FLT13_pivot_extracted_row", "v1",
    """select doc_id, status, case when status in ('QUEUED','SCANNING','PROCESSING') then 'pending…' when doc_id % 4 >= 2 then notes else '—' end as lang,
  case when status in ('QUEUED','SCANNING','PROCESSING') then null when doc_id % 4 >= 2 then 100 end as lang_pct,
  case when status in ('QUEUED','SCANNING','PROCESSING') then 'pending…' else '—' end as size,
  case when status in ('QUEUED','SCANNING','PROCESSING') then null when doc_id % 4 >= 2 then 25 end as size_pct from v1""",
)
def _(lake):
    return A.pivot_answers(lake.docs, J.answer_map(F.col("extracted_row")), ["lang", "size"])


@query(
    "JSN01_tolerant_json", "",
    """select event_id, case when event_id % 3 = 0 then -1 else cast(regexp_extract(props, '[0-9]+') as bigint) end as k from events""",
)
def _(lake):
    """A third of the property texts is broken; those read as the fallback."""
    text = F.when(F.col("event_id") % 3 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    v = J.json_or(text, '{"k": -1}')
    return lake.events.join(lake.table("events").select("event_id", "props"), "event_id").select(
        "event_id", J.field(v, "k").cast("long").alias("k")
    )


@query(
    "JSN02_reply_parse", "v5",
    " union all ".join(
        f"select doc_id, '{k}' as key, {v} as answer, cast(case when {v} = '' then 0 else 1 end as double) as score from v5" for k, v in REPLY.items()
    ),
)
def _(lake):
    m = J.reply_answers(F.col("reply"), [c["key"] for c in COLUMNS])
    return lake.replies.select("doc_id", F.explode(m).alias("key", "a")).select("doc_id", "key", "a.answer", "a.score")


@query(
    "JSN03_sidecar_output_trim", "v5",
    """select doc_id, case when doc_id % 4 in (0, 3) then md5(reply) end as payload,
  case when doc_id % 4 = 1 then 'Output is not valid JSON' when doc_id % 4 = 2 then 'Output is not valid JSON' end as error from v5 where doc_id % 5 <> 0
union all select doc_id, null, case when doc_id % 2 = 0 then 'no text' else 'No JSON object found in output' end from v5 where doc_id % 5 = 0""",
)
def _(lake):
    out = (
        F.when((F.col("doc_id") % 5 == 0) & (F.col("doc_id") % 2 == 0), 'note\n{"error": "no text"}')
        .when(F.col("doc_id") % 5 == 0, "crashed").otherwise(F.concat(F.lit("loading...\n"), F.col("reply")))
    )
    d = lake.replies.select("doc_id", J.sidecar_payload(out).alias("r"))
    return d.select("doc_id", F.md5("r.payload").alias("payload"), "r.error")


@query(
    "JSN04_field_override", "v5",
    """select doc_id, 'lang' as key, concat(notes, case when doc_id % 2 = 0 then '!' else '' end) as answer, cast(case when doc_id % 2 = 0 then 1.0 else 0.5 end as double) as score from v5
union all select doc_id, 'size', cast(page_count as varchar), cast(0.25 as double) from v5
union all select doc_id, 'fresh', 'x', cast(1 as double) from v5 union all select doc_id, 'empty', '', cast(0 as double) from v5""",
)
def _(lake):
    def got(text, score):
        return F.struct(text.alias("answer"), F.lit(score).alias("score"))

    old = F.create_map(F.lit("lang"), got(F.col("notes"), 0.5), F.lit("size"), got(F.col("page_count").cast("string"), 0.25))
    edit = F.when(F.col("doc_id") % 2 == 0, F.concat("notes", F.lit("!"))).otherwise(F.col("notes"))
    edits = F.create_map(F.lit("lang"), edit, F.lit("fresh"), F.lit("x"), F.lit("empty"), F.lit(""))
    return lake.replies.select("doc_id", F.explode(J.override_answers(old, edits)).alias("key", "a")).select("doc_id", "key", "a.*")


@query(
    "STR21_qa_prompt", "",
    """select doc_id, md5(concat('You are a precise data extraction assistant. Given the following document text, answer each question with ONLY the extracted value. ',
  'If a value cannot be found, respond with an empty string.', chr(10), chr(10), 'DOCUMENT TEXT:', chr(10), text, chr(10), chr(10), 'QUESTIONS:', chr(10),
  '- "doc_source": Which source?', chr(10), '- "lang": Which language?', chr(10), '- "missing": Anything else?', chr(10), chr(10),
  'Respond ONLY with a valid JSON object mapping each key to its extracted answer. Example: {"invoice_no": "12345", "date": "2024-01-15"}', chr(10), 'JSON:')) as prompt from documents""",
)
def _(lake):
    cols = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in c.items()]) for c in COLUMNS])
    return lake.texts.select("doc_id", F.md5(X.question_prompt(F.col("text"), cols)).alias("prompt"))


@query(
    "UDF02_qa_plugin", "v1",
    """select doc_id, 'lang' as key, notes as answer, cast(1 as double) as score from v1 union all select doc_id, 'size', cast(page_count as varchar), cast(1 as double) from v1
union all select doc_id, 'other', '', cast(0 as double) from v1""",
)
def _(lake):
    context = F.concat(F.lit("x\nLanguage: "), F.col("notes"), F.lit("\nsize :  "), F.col("page_count").cast("string"), F.lit("\nother:\n"))
    cols = [{"key": "lang", "label": "language"}, {"key": "size", "label": "Dims"}, {"key": "other", "label": "Other"}]
    d = A.ask(lake.docs.select("doc_id", context.alias("context")), cols)
    m = F.from_json("answers", J.ANSWERS)
    return d.select("doc_id", F.explode(m).alias("key", "a")).select("doc_id", "key", "a.answer", "a.score")


def _longest(context, columns):
    """An answerer for whole texts: the length of the longest run of what each column's label is a class of."""
    import re

    found = {c["key"]: max(map(len, re.findall(f"[{c['label']}]+", context)), default=0) for c in columns}
    return {k: {"answer": str(n), "score": n / 1000} for k, n in found.items()}


RUNS = {"letters": "a-z", "digits": "0-9", "dashes": "="}


@query(
    "UDF02_answers_over_texts", "v1",
    " union all ".join(
        f"""select doc_id, '{key}' as key, case when n > 0 then cast(n as varchar) else '' end as answer, round(n / 1000.0, 6) as score, null as error
from (select doc_id, coalesce(list_max(list_transform(regexp_extract_all(full_text, '[{chars}]+'), lambda x: length(x))), 0) as n from v1) t"""
        for key, chars in RUNS.items()
    ),
)
def _(lake):
    return A.ask_texts(lake.docs, [{"key": k, "label": v} for k, v in RUNS.items()], _longest, words=200, overlap=20)


SPAN_SQL = """select doc_id, chunk_no, s as start_idx, e as end_idx,
  1.0 / list_sum(list_transform(emb, lambda x: exp(x - mx))) * exp(rev[e + 1] - mx) / list_sum(list_transform(emb, lambda x: exp(x - mx))) as score
from (select *, least(greatest(list_position(rev, mx) - 1, s), s + 24) as e
  from (select *, list_position(emb, mx) - 1 as s from (select doc_id, chunk_no, emb, list_reverse(emb) as rev, list_max(emb) as mx
    from (select doc_id, chunk_no, cast(embedding as double[]) as emb from v7) a) b) c) d"""


def _spans(lake):
    d = lake.logits.withColumn("s", N.best_span(F.col("start"), F.col("end")))
    return d.select("doc_id", "chunk_no", "s.start_idx", "s.end_idx", "s.score")


@query("MTH04_span_decode", "v7", f"select doc_id, chunk_no, start_idx, end_idx, round(score, 8) as score from ({SPAN_SQL}) t")
def _(lake):
    return _spans(lake).withColumn("score", F.round("score", 8))


@query(
    "AGG11_best_answer", "v7",
    f"""select doc_id, key, case when score > 0 then answer else '' end as answer, case when score > 0 then round(score, 6) else 0.0 end as score
from (select doc_id, key, arg_max(answer, (score, -chunk_no)) as answer, max(score) as score from (
  select doc_id, chunk_no, 'span' as key, concat(cast(start_idx as varchar), ':', cast(end_idx as varchar)) as answer, score from ({SPAN_SQL}) t
  union all select doc_id, chunk_no, 'tie', cast(chunk_no as varchar), 0.5 from v7
  union all select doc_id, chunk_no, 'none', 'x', 0.0 from v7) u group by doc_id, key) b""",
)
def _(lake):
    s = _spans(lake)
    span = s.select("doc_id", "chunk_no", F.lit("span").alias("key"), F.concat_ws(":", F.col("start_idx").cast("string"), F.col("end_idx").cast("string")).alias("answer"), "score")
    tie = s.select("doc_id", "chunk_no", F.lit("tie").alias("key"), F.col("chunk_no").cast("string").alias("answer"), F.lit(0.5).alias("score"))
    none = s.select("doc_id", "chunk_no", F.lit("none").alias("key"), F.lit("x").alias("answer"), F.lit(0.0).alias("score"))
    return A.best_answer(span.unionByName(tie).unionByName(none))
