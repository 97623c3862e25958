"""Queries over contract pages and tables.

The checking SQL derives what must come out from the source columns, not from the printed text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from paperquay.operators import contract as C
from paperquay.plans.registry import query
from paperquay.session import stored
from paperquay.sinks import export as E

ASIA, AFRICA = C.AMS_SCOPE, C.RED_SEA_SCOPE
CARRIER = "BLUEWAVE"

CTES = [
    (
        "pg",
        f"""select doc_id, page, o_orderkey as k, concat('Nation_', split_part(n_name, '_', 2)) as city, concat('Second_', split_part(n_name, '_', 2)) as city2, o_orderpriority as pr,
  case when o_orderkey % 9 = 0 then '{ASIA}' when o_orderkey % 9 = 4 then '{AFRICA}' end as sc from v4b""",
    ),
    (
        "hd",
        """select doc_id, case when max(page) >= case when doc_id % 8 = 6 then 13 else 2 end then concat('ATL', cast(doc_id as varchar)) else '' end as contract_id,
  case when bool_or(k % 7 = 0) then '2024-01-01' when max(page) >= 4 then '2023-03-01' else '' end as effective_date,
  case when bool_or(k % 7 = 0) then '2024-07-31' when max(page) >= 4 then '2023-12-31' else '' end as expiration_date from pg group by doc_id""",
    ),
    (
        "ctx",
        """select p.doc_id, page, k, city, city2, coalesce(last_value(case when k % 4 = 0 then pr end ignore nulls) over w, '') as commodity,
  coalesce(last_value(case when k % 3 = 0 then city end ignore nulls) over w, '') as origin,
  coalesce(last_value(case when k % 6 = 1 then concat(city, ' Via') end ignore nulls) over w, '') as origin_via,
  coalesce(last_value(case when k % 5 = 0 then city end ignore nulls) over w, '') as rate_over,
  coalesce(last_value(sc ignore nulls) over w, '') as scope,
  coalesce(case last_value(case when k % 14 = 0 then 2 when k % 7 = 0 then 1 end ignore nulls) over w when 1 then '2024-01-01' when 2 then '2025-01-01' end, effective_date) as eff,
  coalesce(case last_value(case when k % 14 = 0 then 2 when k % 7 = 0 then 1 end ignore nulls) over w when 1 then '2024-07-31' when 2 then '2025-02-02' end, expiration_date) as exp
from pg p join hd on hd.doc_id = p.doc_id window w as (partition by p.doc_id order by page)""",
    ),
    (
        "tb",
        """select doc_id, page, k as table_id, case when k % 8 = 0 then 25 else 200 end as y, k % 10 <> 3 as has_header,
  case when doc_id % 10 = 7 then 'RATES' when page >= 13 and doc_id % 5 = 0 then 'STOP' when page >= 9 then 'DEST_ARB'
    when page >= 5 or (page >= 3 and doc_id % 10 = 3) then 'ORIGIN_ARB' else 'RATES' end as section,
  n + case when k % 10 <> 3 then 1 else 0 end as n_rows
from pg join (select l_orderkey, count(*) as n from lineitem group by l_orderkey) c on c.l_orderkey = pg.k""",
    ),
    (
        "th",
        """select *, last_value(case when has_header then case when page < 5 then 'D' else 'P' end end ignore nulls) over (partition by doc_id, section order by page) as kind
from tb where n_rows >= 2 and section <> 'STOP'""",
    ),
    (
        "tl",
        """select t.*, c.commodity, c.scope, c.eff, c.exp,
  case when t.y = 200 and c.k % 12 = 0 then c.city2 else c.origin end as origin, c.origin_via, c.rate_over
from th t join ctx c on c.doc_id = t.doc_id and c.page = t.page""",
    ),
    (
        "rw",
        """select t.*, r.row_no, case when row_no % 4 = 3 then '' else concat('Nation_', split_part(destination_city, '_', 2)) end as anchor,
  destination_via_city as via, case row_no % 3 when 0 then 'CN' when 1 then 'JP' else 'US' end as cntry,
  case row_no % 7 when 2 then 'HEA included' when 4 then 'AGW included' else commodity_1 end as cmdt, direct_call, rate20,
  case when row_no % 5 = 1 then 'n/a' else rate40 end as rate40
from tl t join (select * rename (commodity as commodity_1) from v2r) r on r.l_orderkey = t.table_id where t.kind is not null""",
    ),
    (
        "fl",
        """select *, case when kind = 'D' then anchor else '' end as dest, case when kind = 'P' then anchor else '' end as point,
  case when kind = 'D' then via else '' end as dvia from rw""",
    ),
    (
        "st",
        """select *, (case when section = 'RATES' then dest else point end) = '' as cont,
  case when section = 'RATES' then regexp_matches(rate20, '[0-9]') or regexp_matches(rate40, '[0-9]') else point <> '' end as fits from fl""",
    ),
    (
        "nm",
        """select *, sum(case when fits and not cont then 1 else 0 end) over w as g, sum(case when fits then 1 else 0 end) over w as f
from st window w as (partition by doc_id, section order by page, table_id, row_no rows unbounded preceding)""",
    ),
    (
        "ex",
        """select doc_id, section, g, list(dvia order by page, table_id, row_no) filter (where dvia <> '') as x_via,
  list(rate20 order by page, table_id, row_no) filter (where rate20 <> '') as x20, list(rate40 order by page, table_id, row_no) filter (where rate40 <> '') as x40
from nm where cont and f >= 1 and not (fits and f = 1) group by doc_id, section, g""",
    ),
    (
        "mg",
        """select n.*, {via} as m_via, {r20} as m20, {r40} as m40
from nm n left join ex e on e.doc_id = n.doc_id and e.section = n.section and e.g = n.g where fits and (not cont or f = 1)""",
    ),
]


def _fold(base: str, texts: str) -> str:
    return (
        f"list_reduce(list_prepend({base}, coalesce({texts}, [])), "
        "lambda a, x: case when a = '' then x when contains(a, x) then a else concat(a, ' ', x) end)"
    )


_CITY_VIA = "case when section = 'RATES' then array_to_string(list_transform(regexp_extract_all(lower(dvia), '[a-z]+|[^a-z]+'), lambda s: concat(upper(s[1]), s[2:])), '') when section = 'DEST_ARB' then rate_over else '' end"
TAIL = ",\n".join(
    f"{n} as ({t})" for n, t in CTES
).replace("{via}", _fold(_CITY_VIA.replace("section", "n.section"), "x_via")).replace("{r20}", _fold("rate20", "x20")).replace("{r40}", _fold("rate40", "x40"))


def _tail(last: str) -> str:
    """The chain of common table expressions up to one of them."""
    names = [n for n, _ in CTES]
    parts = TAIL.split(",\n" + names[names.index(last) + 1] + " as (")[0] if last != names[-1] else TAIL
    return parts


def _contract(lake):
    """Pages and table rows, stored once as an extraction run would leave them."""
    return stored(lake.contract_pages, "pages"), stored(lake.contract_tables, "tables")


def _facts(lake):
    return C.page_facts(lake.contract_pages)


@query(
    "STR13_regex_fields", "v4b",
    """select doc_id, page, case when page = case when doc_id % 8 = 6 then 13 else 2 end then concat('ATL', cast(doc_id as varchar)) end as contract_id, case when k % 4 = 0 then pr end as commodity,
  case when k % 3 = 0 then city end as origin, case when k % 6 = 1 then concat(city, ' Via') end as origin_via, case when k % 5 = 0 then city end as rate_over,
  sc as scope from pg""",
    tail=_tail("pg"),
)
def _(lake):
    return C.page_facts(lake.contract_pages).select("doc_id", "page", "contract_id", *C.CONTEXT)


@query(
    "STR14_line_labels", "v4b",
    """select doc_id, page, y, kind, label as city from (
  select doc_id, page, 10 * (1 + p2) as y, 'origin' as kind, city as label from b where k % 3 = 0
  union all select doc_id, page, 10 * (1 + p2 + o), 'origin_via', concat(city, ' Via') from b where k % 6 = 1
  union all select doc_id, page, 10 * (1 + p2 + o + v), 'rate_over', city from b where k % 5 = 0
  union all select doc_id, page, 10 * (1 + p2 + o + v + r + c + d + d2 + s + e), 'origin', city2 from b where k % 12 = 0) t""",
    tail=_tail("pg") + """,
b as (select *, case when page = case when doc_id % 8 = 6 then 13 else 2 end then 1 else 0 end as p2, case when k % 3 = 0 then 1 else 0 end as o, case when k % 6 = 1 then 1 else 0 end as v,
  case when k % 5 = 0 then 1 else 0 end as r, case when k % 4 = 0 then 1 else 0 end as c, case when k % 7 = 0 then 1 else 0 end as d,
  case when k % 14 = 0 then 1 else 0 end as d2, case when sc is not null then 1 else 0 end as s, case when page in (3, 4) then 1 else 0 end as e from pg)""",
)
def _(lake):
    return lake.contract_pages.select("doc_id", "page", F.explode(C.line_labels(F.col("text"))).alias("x")).select(
        "doc_id", "page", F.col("x.y").cast("long").alias("y"), "x.kind", "x.city"
    )


@query("AGG14_header_resolve", "v4b", "select doc_id, 'BLUEWAVE' as carrier, contract_id, effective_date, expiration_date from hd", tail=_tail("hd"))
def _(lake):
    return C.document_header(_facts(lake), CARRIER)


@query(
    "WIN03_page_context_fill", "v4b",
    "select doc_id, page, commodity, origin, origin_via, rate_over, scope, eff as effective_date, exp as expiration_date from ctx",
    tail=_tail("ctx"),
)
def _(lake):
    facts = stored(_facts(lake), "facts")
    ctx = C.page_context(facts).join(C.document_header(facts, CARRIER), "doc_id")
    return ctx.select(
        "doc_id", "page", *C.CONTEXT, F.coalesce("start", "effective_date").alias("effective_date"), F.coalesce("end", "expiration_date").alias("expiration_date")
    )


@query(
    "WIN06_section_boundaries", "v4b",
    """select doc_id, min(page) as page, 0 as y, section from (select doc_id, page, case when doc_id % 10 = 7 then null when page = 1 then 'RATES' when page = 5 and doc_id % 10 <> 3 then 'ORIGIN_ARB'
  when page = 3 and doc_id % 10 = 3 then 'ORIGIN_ARB' when page = 9 then 'DEST_ARB' when page = 13 and doc_id % 5 = 0 then 'STOP' end as section from v4b) t where section is not null group by doc_id, section""",
)
def _(lake):
    b = C.section_boundaries(_facts(lake))
    return b.select("doc_id", F.explode("boundaries").alias("b")).select("doc_id", "b.page", "b.y", "b.section")


@query("JON05_section_as_of", "v4b", "select doc_id, page, table_id, section from tb", tail=_tail("tb"))
def _(lake):
    tables = C.tables_of_rows(lake.contract_tables)
    return C.with_section(tables, C.section_boundaries(_facts(lake))).select("doc_id", "page", "table_id", "section")


@query(
    "JON06_label_above_as_of", "v4b",
    """select t.doc_id, t.page, t.table_id, case when t.y = 200 and c.k % 12 = 0 then c.city2 else c.origin end as origin, c.origin_via, c.rate_over
from tb t join ctx c on c.doc_id = t.doc_id and c.page = t.page""",
    tail=_tail("tb"),
)
def _(lake):
    d = C.with_labels(C.tables_of_rows(lake.contract_tables), stored(_facts(lake), "facts"))
    return d.select("doc_id", "page", "table_id", "origin", "origin_via", "rate_over")


@query(
    "WIN04_header_carry_forward", "v4b",
    "select doc_id, page, table_id, section, case kind when 'D' then 'destination_city|destination_via_city' when 'P' then 'point|via' end || '|cntry|cmdt|direct_call|rate20|rate40' as headers from th",
    tail=_tail("th"),
)
def _(lake):
    tables = C.tables_of_rows(lake.contract_tables).filter("n_rows >= 2 and first_cells is not null")
    placed = C.with_section(tables, C.section_boundaries(_facts(lake))).filter("section not in ('UNKNOWN', 'STOP')")
    return C.with_headers(stored(placed.drop("first_cells"), "placed")).select(
        "doc_id", "page", "table_id", "section", F.array_join("headers", "|").alias("headers")
    )


def _merged(lake):
    return C.merged_rows(*_contract(lake))[1]


@query(
    "WIN02_continuation_merge", "v2r v4b",
    "select doc_id, section, page, table_id, row_no, m_via as via, m20 as rate20, m40 as rate40 from mg", tail=_tail("mg"),
)
def _(lake):
    from paperquay.functions.text import city_only

    m = _merged(lake)
    via = F.when(F.col("section") == "RATES", city_only(C.of_row("destination_via_city"))).when(F.col("section") == "DEST_ARB", F.col("rate_over")).otherwise("")
    return m.select(
        "doc_id", "section", *C.ORDER, C.folded(via, "destination_via_city").alias("via"),
        C.folded(C.of_row("rate20"), "rate20").alias("rate20"), C.folded(C.of_row("rate40"), "rate40").alias("rate40"),
    )


AGW_SQL = "case when origin_city is null then '' else '230' end"
ROWS_SQL = f"""select doc_id, section, page, table_id, row_no, 'BLUEWAVE' as carrier, contract_id, eff as effective_date, exp as expiration_date,
  case when section = 'RATES' then commodity else '' end as commodity,
  case section when 'RATES' then origin when 'ORIGIN_ARB' then point else '' end as origin_city,
  case section when 'RATES' then origin_via when 'ORIGIN_ARB' then rate_over else '' end as origin_via_city,
  case section when 'RATES' then dest when 'DEST_ARB' then concat(point, ', Xx') else '' end as destination_city,
  m_via as destination_via_city, case when section = 'RATES' then 'CY/CY' else 'CY' end as service,
  case when section = 'RATES' and direct_call <> '' then '!must be direct call at destination' else '' end as remarks,
  case when section = 'RATES' or scope = '' then scope else concat('[', scope, ']') end as scope, m20 as rate20, m40 as rate40,
  case when section = 'RATES' and scope = '{ASIA}' and cntry in ('CN', 'JP') then '35' else '' end as ams,
  case when section = 'RATES' and cmdt = 'HEA included' then 'included' else '' end as hea,
  case when section = 'RATES' and cmdt = 'AGW included' then 'included' else '' end as agw,
  case when section = 'RATES' and scope = '{AFRICA}' then 'included' else '' end as red_sea,
  case when section = 'ORIGIN_ARB' then '230' else '' end as agw20
from mg join (select doc_id as hid, contract_id from hd) h on h.hid = mg.doc_id"""


def _unified(sections):
    """The three relations under common column names."""
    out = None
    for name, df in sections.items():
        cols = {
            "carrier": "Carrier", "contract_id": "Contract ID", "effective_date": "effective_date", "expiration_date": "expiration_date",
            "commodity": "commodity", "origin_city": "origin_city", "origin_via_city": "origin_via_city", "destination_city": "destination_city",
            "destination_via_city": "destination_via_city", "service": "service", "remarks": "Remarks", "scope": "Scope", "rate20": "BaseRate 20",
            "rate40": "BaseRate 40", "ams": "AMS(CHINA & JAPAN)", "hea": "(HEA) Heavy Surcharge", "agw": "AGW",
            "red_sea": "RED SEA DIVERSION CHARGE(RDS).", "agw20": "20' AGW",
        }
        have = {c.lower() for c in df.columns}
        keep = [c for c in ("doc_id", *C.ORDER, "is_end") if c in df.columns]
        one = df.select(
            *keep, F.lit(name).alias("section"),
            *[(F.col(f"`{c}`") if c.lower() in have else F.lit("")).alias(a) for a, c in cols.items()],
        )
        out = one if out is None else out.unionByName(one)
    return out


@query("ARR05_parse_contract_rows", "v2r v4b", ROWS_SQL, tail=_tail("mg"))
def _(lake):
    return _unified(C.contract_rows(*_contract(lake), CARRIER))


@query(
    "ARR05_parser_warnings", "v4b",
    f"""select distinct doc_id, null as page, null as table_id, '{C.NO_BOUNDARIES}' as warning from v4b where doc_id % 10 = 7
union all select doc_id, page, table_id, 'Page ' || page || ': skipped continuation table in ' || section || ' with no prior headers' from th where kind is null""",
    tail=_tail("th"),
)
def _(lake):
    return C.contract_rows(*_contract(lake), CARRIER, warnings=True)["WARNINGS"]


@query(
    "SET01_append_sentinel", "v2r v4b",
    """select doc_id, section, row_no, 'BLUEWAVE' as carrier, false as is_end from mg
union all select doc_id, section, null, 'DOC END', true from hd, (values ('RATES'), ('ORIGIN_ARB'), ('DEST_ARB')) as s(section)""",
    tail=_tail("mg"),
)
def _(lake):
    d = _unified(C.contract_rows(*_contract(lake), CARRIER, sentinel=True))
    return d.select("doc_id", "section", "row_no", "carrier", "is_end")


@query(
    "MTH03_surcharge_rules", "v2r v4b",
    f"""select l_orderkey, row_no, case when l_orderkey % 3 = 0 and row_no % 3 < 2 then '35' else '' end as ams,
  case when row_no % 7 = 2 and rate20 = 'included' then 'included' else '' end as hea, case when row_no % 7 = 4 and rate20 = 'included' then 'included' else '' end as agw,
  case when l_orderkey % 3 = 1 then 'included' else '' end as red_sea,
  case l_orderkey % 5 when 0 then '525/500/500' when 1 then '200/400/400' when 2 then '//' else '230/230/230' end as agw_triple from v2r""",
)
def _(lake):
    key, row = F.col("l_orderkey"), F.col("row_no")
    scope = F.when(key % 3 == 0, ASIA).when(key % 3 == 1, AFRICA).otherwise("")
    country = F.when(row % 3 == 0, "cn").when(row % 3 == 1, "JP").otherwise("US")
    blob = F.lower(F.concat_ws(" ", F.when(row % 7 == 2, "HEAvy").when(row % 7 == 4, "AGW:").otherwise("agwx"), F.col("rate20")))
    city = F.when(key % 5 == 0, "Halifax").when(key % 5 == 1, " CHICAGO").when(key % 5 == 2, "richmond").otherwise(F.col("destination_city"))
    s = C.surcharges(scope, country, blob)
    return lake.rates.select(
        "l_orderkey", "row_no", s["AMS(CHINA & JAPAN)"].alias("ams"), s["(HEA) Heavy Surcharge"].alias("hea"), s["AGW"].alias("agw"),
        s["RED SEA DIVERSION CHARGE(RDS)."].alias("red_sea"), F.array_join(F.array(*C.agw_values(city)), "/").alias("agw_triple"),
    )


# -- stored contract JSON ----------------------------------------------------------------------


def stored_contracts(lake):
    """Documents whose stored JSON has pages of 20 text lines and one rate row per line; a third are no contracts."""
    lines = F.split("text", "\n")
    pages = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 20).cast("int")),
        lambda p: F.struct((p + 1).alias("page"), F.array_join(F.slice(lines, p * 20 + 1, F.lit(20)), "\n").alias("text")),
    )
    date = F.when(F.col("doc_id") % 4 == 0, "2024-02-30").when(F.col("doc_id") % 4 == 1, "soon").otherwise("2024-02-29")
    rates = F.transform(
        lines, lambda t, i: F.struct(F.col("source").alias("Carrier"), date.alias("effective_date"), i.cast("string").alias("BaseRate 20"), t.alias("commodity"))
    )
    arbs = F.transform(lines, lambda t: F.struct(F.col("lang").alias("Carrier"), t.alias("origin_city")))
    body = F.struct(
        F.when(F.col("doc_id") % 3 != 0, "CONTRACT").otherwise("OTHER").alias("type"), F.struct(F.lit("C1").alias("contractId"), F.col("source").alias("carrier")).alias("header"),
        rates.alias("rates"), arbs.alias("originArbs"), F.array().cast("array<struct<Carrier:string>>").alias("destArbs"), pages.alias("rawPages"),
    )
    return lake.texts.select("doc_id", F.to_json(body).alias("extracted_json"))


@query(
    "SRC04_read_page_text", "v2",
    "select doc_id, page, string_agg(text, chr(10) order by idx) as text from v2 group by doc_id, page",
)
def _(lake):
    from paperquay.sources.files import read_page_text

    return read_page_text(stored_contracts(lake))


MERGED_SQL = """select v.doc_id, idx as row_no, source as carrier, v.text as commodity, cast(idx as varchar) as rate20,
  case v.doc_id % 4 when 0 then '2024-02-30' when 1 then 'soon' else '2024-02-29' end as effective_date from v2 v join documents d on d.doc_id = v.doc_id where v.doc_id % 3 <> 0"""


@query("AGG13_merge_documents_union", "v2", MERGED_SQL)
def _(lake):
    d = E.merged_rows(stored_contracts(lake), "rates", C.RATES_COLS)
    return d.select(
        "doc_id", F.col("row_no").cast("long").alias("row_no"), F.col("Carrier").alias("carrier"), "commodity", F.col("`BaseRate 20`").alias("rate20"), "effective_date"
    )


@query(
    "SNK03_export_contract_sheets", "v2",
    f"""select 'rates' as sheet, 22 as columns, doc_id, row_no, carrier, effective_date, case when effective_date = '2024-02-29' then effective_date end as parsed from ({MERGED_SQL}) t
union all select 'originArbs', 19, v.doc_id, idx, lang, '', null from v2 v join documents d on d.doc_id = v.doc_id where v.doc_id % 3 <> 0""",
)
def _(lake):
    """Three sheets written and read back; the empty one is not written."""
    from paperquay.session import run_dir

    docs, path = stored_contracts(lake), run_dir(lake.spark, "sheets")
    written = E.write_contract_sheets({k: E.contract_sheet(docs, k) for k in E.SHEETS}, path)
    out = None
    for name in written:
        d = lake.spark.read.parquet(f"{path}/{name}")
        one = d.select(
            F.lit(name).alias("sheet"), F.lit(len(d.columns) - 2).cast("long").alias("columns"), "doc_id", F.col("row_no").cast("long").alias("row_no"),
            F.col("Carrier").alias("carrier"), "effective_date", F.date_format("effective_date_parsed", "yyyy-MM-dd").alias("parsed"),
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "UDF03_doc_type_registry", "v2",
    """select 'CONTRACT' as type, s.label, sum(case s.key when 'rates' then n when 'originArbs' then n else 0 end) as rows, count(*) as docs
from (select doc_id, count(*) as n from v2 where doc_id % 3 <> 0 group by doc_id) d, (values ('rates', 'Rates'), ('originArbs', 'Origin Arbitraries'), ('destArbs', 'Destination Arbitraries')) as s(key, label) group by s.label""",
)
def _(lake):
    from paperquay.operators.doctypes import section_counts

    return section_counts(stored_contracts(lake))
