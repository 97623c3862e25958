"""The shapes the operators work on, as views over the given tables.

``Lake`` builds them as DataFrames. ``DUCK`` holds the same views as SQL text for the checking
engine. ``SHARED`` texts are read by both.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperquay.operators.ordered import block, ranked
from paperquay.session import passing, stored

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

SHARED = {
    "v0": """
select source as session_id, concat('Session ', source) as name,
  case cast(substr(source, 4) as int) % 4 when 0 then 'TABLE_EXTRACT' when 1 then 'OCR_EXTRACT'
    when 2 then 'PDF_EXTRACT' else 'JSON_EXTRACT' end as mode,
  'pdfplumber' as extraction_model, 'PENDING' as status, min(doc_id) as first_doc_id
from documents group by source""",
    "v1": """
select d.doc_id, d.text as full_text, d.lang as notes, d.n_chars,
  case when d.doc_id % 17 = 0 then null else d.source end as session_id,
  concat(d.source, '_', cast(d.doc_id as varchar(20)),
    case d.doc_id % 7 when 0 then '.pdf' when 1 then '.JPG' when 2 then '.png' when 3 then '.tiff'
      when 4 then '.xlsx' when 5 then '.pdf' else '.txt' end) as filename,
  case when l.doc_id is null then
      case d.doc_id % 4 when 0 then 'QUEUED' when 1 then 'SCANNING' when 2 then 'PROCESSING' else 'ERROR' end
    when l.toxic = 1 then 'REJECTED' when l.quality = 0 then 'REVIEW'
    when d.doc_id % 5 = 0 then 'EXPORTED' else 'APPROVED' end as status,
  case when d.n_chars % 10 = 0 then cast(0 as double) else cast((d.n_chars % 1000) as double) / 10 end as confidence,
  cast((d.n_chars % 1200) as double) / 10 as processing_time,
  cast(floor(d.n_chars / 3000) as int) + 1 as page_count,
  1704067200 + (d.doc_id * 3607) % 2592000 as created_epoch,
  1704067200 + (d.doc_id * 3607) % 2592000 + d.n_chars % 172800 as processed_epoch,
  concat('# ', d.lang) as markdown, concat('[{"text":"', d.lang, '"}]') as text_blocks,
  case when l.doc_id is null then '' else 'ops' end as verified_by,
  coalesce(l.quality = 1 and l.toxic = 0 and d.doc_id % 5 = 0, false) as exported,
  case when coalesce(l.quality = 1 and l.toxic = 0 and d.doc_id % 5 = 0, false) then 'exports/run0' else '' end as export_path,
  case d.doc_id % 3 when 0 then '[]' when 1 then '[{"tableId":"a"}]' else '[{"tableId":"a"},{"tableId":"b"}]' end as ocr_tables,
  case when d.doc_id % 5 = 0 then '["Low DPI: 90"]' else '[]' end as quality_issues,
  d.doc_id % 5 <> 0 as quality_valid,
  case d.doc_id % 4 when 0 then '{}' when 1 then 'oops'
    else concat('{"lang":{"answer":"', d.lang, '","score":1.0},"size":{"answer":"","score":0.25}}') end as extracted_row,
  case when d.doc_id % 6 = 0 then 'oops' when d.doc_id % 6 = 1 then '["slow"]' else '[]' end as warnings,
  case d.doc_id % 7 when 0 then 'PDF_TEXT' when 4 then 'EXCEL' when 5 then 'PDF_IMAGE' when 6 then 'AUTO' else 'IMAGE' end as extraction_type,
  case when d.doc_id % 3 = 1 then '{"type":"CONTRACT"}' else '{}' end as extracted_json,
  d.n_chars % 400 as dpi, 300 + d.n_chars % 1500 as width, 300 + (d.n_chars * 7) % 1500 as height
from documents d left join labels l on d.doc_id = l.doc_id""",
    "v6": """
select event_id, ts, user_id as doc_id, value,
  case event_type when 'view' then 'QUEUED' when 'click' then 'PROCESSING' when 'signup' then 'REVIEW'
    when 'purchase' then 'APPROVED' else 'ERROR' end as status,
  concat('[progress] ', event_type, ' ', cast(event_id % 101 as varchar(20)), '%') as line
from events""",
    "v5": """
select doc_id, status, session_id, notes, page_count,
  case doc_id % 4
    when 0 then concat('{"doc_source":"', coalesce(session_id, ''), '","lang":"', notes, '","size":', cast(page_count as varchar(20)), '}')
    when 1 then concat('Here you are: ```json', chr(10), '{"doc_source":"', coalesce(session_id, ''), '","lang":"', notes, '","size":', cast(page_count as varchar(20)), '}', chr(10), '```')
    when 2 then concat('{"doc_source":"', coalesce(session_id, ''), '","lang":"', notes, '","size":', cast(page_count as varchar(20)))
    else concat('{"doc_source":"', coalesce(session_id, ''), '","lang":"', notes, '"}') end as reply
from v1""",
}

_ORDER_ALL = (
    "l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
)

DUCK = {
    "v0": SHARED["v0"],
    "v1": SHARED["v1"],
    "v5": SHARED["v5"],
    "v6": SHARED["v6"],
    "v2": """
select doc_id, cast(i - 1 as bigint) as idx, cast((i - 1) // 20 + 1 as bigint) as page,
  case when i = 1 then 'heading' else 'paragraph' end as block_type,
  cast((length(parts[i]) * 13) % 801 as double) / 8 as confidence,
  (i - 1) % 13 <> 12 as has_box, 0 as x1, 12 * (i - 1) as y1, 6 * length(parts[i]) as x2, 12 * (i - 1) + 10 as y2,
  parts[i] as text
from (select doc_id, string_split(text, chr(10)) as parts from documents) d, unnest(range(1, len(parts) + 1)) as u(i)""",
    "v2r": f"""
select l_orderkey, cast(row_number() over (partition by l_orderkey order by {_ORDER_ALL}) as bigint) as row_no,
  n_name as destination_city, case when l_partkey % 3 = 0 then r_name else '' end as destination_via_city,
  p_name as commodity, case when l_suppkey % 4 = 0 then 'EUR' else 'USD' end as cur,
  case when l_linenumber % 2 = 0 then 'Y' else '' end as direct_call,
  case when l_orderkey % 11 = 0 then '' when l_orderkey % 13 = 0 then 'included' else cast(cast(l_quantity as int) as varchar) end as rate20,
  cast(cast(floor(l_extendedprice) as bigint) as varchar) as rate40
from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
  join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "v3r": """
select l_orderkey as table_id, cast(0 as bigint) as "row", ['Destination', 'Destination Via', 'Cmdt', 'Cur', 'Direct Call', '20''', '20'''] as cells
from (select distinct l_orderkey from v2r) t
union all
select l_orderkey, row_no, [destination_city, destination_via_city, commodity, cur, direct_call, rate20, rate40] from v2r""",
    "v3": """
select table_id, "row", cast(j - 1 as bigint) as col, cells[j] as text from v3r, unnest(range(1, 8)) as u(j)""",
    "v4b": """
select o_custkey as doc_id, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as page, n_name, o_orderpriority
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey""",
    "v7": """
select cast(floor(vec_id / 5) as bigint) as doc_id, cast(vec_id % 5 as bigint) as chunk_no, embedding from embeddings""",
}

NEEDS = {"v5": ["v1"], "v3r": ["v2r"], "v3": ["v3r", "v2r"]}


def with_views(names: list[str], body: str, tail: str = "") -> str:
    """Checking SQL: ``body`` after the views it needs."""
    order = ["v0", "v1", "v2", "v2r", "v3r", "v3", "v4b", "v5", "v6", "v7"]
    wanted = set(names)
    for n in names:
        wanted |= set(NEEDS.get(n, []))
    ctes = [f"{n} as ({DUCK[n]})" for n in order if n in wanted]
    ctes += [tail] if tail else []
    return ("with " + ",\n".join(ctes) + "\n" if ctes else "") + body


class Lake:
    """The given tables of one folder, and the views over them."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def texts(self) -> DataFrame:
        return self.table("documents")

    @cached_property
    def n_documents(self) -> int:
        return self.table("documents").count()

    def document_of(self, table_id: str) -> Column:
        """The document that a table belongs to: every table has one."""
        return F.pmod(F.col(table_id), F.lit(self.n_documents)).cast("long")

    def _sql(self, text: str, **frames: DataFrame) -> DataFrame:
        for name, df in frames.items():
            df.createOrReplaceTempView(name)
        return self.spark.sql(text)

    @cached_property
    def sessions(self) -> DataFrame:
        return self._sql(SHARED["v0"], documents=self.table("documents"))

    @cached_property
    def docs(self) -> DataFrame:
        d = self._sql(SHARED["v1"], documents=self.table("documents"), labels=self.table("labels"))
        times = {f"{x}_at": F.timestamp_seconds(f"{x}_epoch") for x in ("created", "processed")}
        return d.withColumns(times)

    @cached_property
    def replies(self) -> DataFrame:
        return self._sql(SHARED["v5"], v1=self.docs)

    @cached_property
    def events(self) -> DataFrame:
        return self._sql(SHARED["v6"], events=self.table("events")).withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def blocks(self) -> DataFrame:
        d = self.texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "text"))
        idx, n = F.col("idx").cast("long"), F.length("text")
        box = F.struct(F.lit(0).alias("x1"), (idx * 12).cast("int").alias("y1"), (n * 6).alias("x2"), (idx * 12 + 10).cast("int").alias("y2"))
        return d.select(
            "doc_id", idx.alias("idx"), (F.floor(idx / 20) + 1).alias("page"),
            F.when(idx == 0, "heading").otherwise("paragraph").alias("block_type"),
            ((n * 13 % 801) / 8).alias("confidence"), F.when(idx % 13 != 12, box).alias("bbox"), "text",
        )

    @cached_property
    def rates(self) -> DataFrame:
        """Written in two steps, so that the shuffles of one don't stay beside those of the next or of what reads them."""
        order = _ORDER_ALL.split(", ")
        lines = self.table("lineitem").join(self.table("part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", *order, "p_name")
        places = (
            self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name")
        )
        # An order has a handful of lines, so a plain window numbers them.
        numbered = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order)).cast("long")
        key = F.col("l_orderkey")
        with passing(lines, "lines") as named:
            d = named.join(places, F.col("l_suppkey") == F.col("s_suppkey")).withColumn("row_no", numbered)
            d = d.select(
                "l_orderkey", "row_no", F.col("n_name").alias("destination_city"),
                F.when(F.col("l_partkey") % 3 == 0, F.col("r_name")).otherwise("").alias("destination_via_city"),
                F.col("p_name").alias("commodity"), F.when(F.col("l_suppkey") % 4 == 0, "EUR").otherwise("USD").alias("cur"),
                F.when(F.col("l_linenumber") % 2 == 0, "Y").otherwise("").alias("direct_call"),
                F.when(key % 11 == 0, "").when(key % 13 == 0, "included").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("rate20"),
                F.floor("l_extendedprice").cast("string").alias("rate40"),
            )
            return stored(d, "rates")

    HEADER = ["Destination", "Destination Via", "Cmdt", "Cur", "Direct Call", "20'", "20'"]

    @cached_property
    def table_rows(self) -> DataFrame:
        names = ["destination_city", "destination_via_city", "commodity", "cur", "direct_call", "rate20", "rate40"]
        body = self.rates.select(F.col("l_orderkey").alias("table_id"), F.col("row_no").alias("row"), F.array(*names).alias("cells"))
        keys = self.table("lineitem").select(F.col("l_orderkey").alias("table_id")).distinct()
        head = keys.select("table_id", F.lit(0).cast("long").alias("row"), F.array(*[F.lit(h) for h in self.HEADER]).alias("cells"))
        return head.unionByName(body)

    @cached_property
    def cells(self) -> DataFrame:
        return self.table_rows.select("table_id", "row", F.posexplode("cells").alias("c", "text")).select(
            "table_id", "row", F.col("c").cast("long").alias("col"), "text"
        )

    @cached_property
    def contract_base(self) -> DataFrame:
        d = (
            self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.col("o_custkey").alias("doc_id"), "o_orderkey", "n_name", "o_orderpriority")
        )
        # Pages and tables both start from it.
        return stored(ranked(d, ["doc_id"], ["o_orderkey"], [block("o_orderkey")], "page"), "contract-base")

    @cached_property
    def contract_pages(self) -> DataFrame:
        """Printed pages with section titles, sparse labels, scopes and validity ranges.

        Some documents have no titles, some end in a section that is not read, and in some a title
        names two sections.
        """
        key, page, doc, nation = F.col("o_orderkey"), F.col("page"), F.col("doc_id"), F.col("n_name")
        title = (
            F.when(doc % 10 == 7, "NO TITLES HERE").when(page == 1, "6-1 GENERAL RATE")
            .when((page == 3) & (doc % 10 == 3), "origin  arbitrary and general rate").when(page == 5, "6 . 3 ORIGIN ARBITRARY")
            .when(page == 9, "6-4 DESTINATION ARBITRARY").when((page == 13) & (doc % 5 == 0), "6-5 G.O.H").otherwise("CONTINUED")
        )
        lines = F.array(
            title,
            F.when(page == F.when(doc % 8 == 6, 13).otherwise(2), F.concat(F.lit("CONTRACT NO atl"), doc.cast("string"))),
            F.when(key % 3 == 0, F.concat(F.lit("ORIGIN : "), nation, F.lit(", XX"))),
            F.when(key % 6 == 1, F.concat(F.lit("ORIGIN VIA : "), nation, F.lit(" via, YY"))),
            F.when(key % 5 == 0, F.concat(F.lit("RATE  APPLICABLE OVER : "), nation)),
            F.when(key % 4 == 0, F.concat(F.lit("COMMODITY : "), F.col("o_orderpriority"), F.lit(" (BULK)"))),
            F.when(key % 7 == 0, "valid from 2024-01-01 to 2024-07-31"),
            F.when(key % 14 == 0, "valid 20250101 through 2 Feb, 2025"),
            F.when(key % 9 == 0, "[NORTH AMERICA - ASIA (WB)]").when(key % 9 == 4, "[ NORTH AMERICA - WEST ASIA AND AFRICA  (WB) ]"),
            F.when(page == 3, "Effective Date: 1 Mar, 2023").when(page == 4, "expiry date - 20231231"),
            F.when(key % 12 == 0, F.concat(F.lit("ORIGIN : "), F.replace(nation, F.lit("NATION"), F.lit("SECOND")), F.lit(", XX"))),
        )
        return self.contract_base.select("doc_id", "page", F.array_join(lines, "\n").alias("text"))

    @cached_property
    def contract_tables(self) -> DataFrame:
        """Rows of the table on each page; some tables have no header, some stand above labels."""
        at = self.contract_base.select("doc_id", "page", F.col("o_orderkey").alias("table_id"))
        at = at.withColumn("y", F.when(F.col("table_id") % 8 == 0, 25).otherwise(200))
        row, name = F.col("row_no"), F.col("destination_city")
        data = self.rates.select(
            F.col("l_orderkey").alias("table_id"), "row_no",
            F.array(
                F.when(row % 4 == 3, "").otherwise(F.concat(name, F.lit(", XX"))), F.col("destination_via_city"),
                F.when(row % 3 == 0, "CN").when(row % 3 == 1, "jp").otherwise("US"),
                F.when(row % 7 == 2, "HEA included").when(row % 7 == 4, "AGW included").otherwise(F.col("commodity")),
                F.col("direct_call"), F.col("rate20"), F.when(row % 5 == 1, "n/a").otherwise(F.col("rate40")),
            ).alias("cells"),
        ).join(at, "table_id")
        tail = [F.lit(h) for h in ["Cntry", "Cmdt", "Direct Call", "20'", "40'"]]
        first = F.when(F.col("page") < 5, F.array(F.lit("Destination"), F.lit("Destination Via"))).otherwise(F.array(F.lit("Point"), F.lit("Via")))
        printed = self.table("lineitem").select(F.col("l_orderkey").alias("table_id")).distinct()
        head = at.filter(F.col("table_id") % 10 != 3).join(printed, "table_id", "left_semi").select(
            "table_id", F.lit(0).cast("long").alias("row_no"), F.concat(first, F.array(*tail)).alias("cells"), "doc_id", "page", "y"
        )
        return data.unionByName(head).select("doc_id", "page", "table_id", "y", "row_no", "cells")

    @cached_property
    def logits(self) -> DataFrame:
        e = self.table("embeddings")
        return e.select(
            F.floor(F.col("vec_id") / 5).alias("doc_id"), (F.col("vec_id") % 5).alias("chunk_no"),
            F.col("embedding").alias("start"), F.reverse("embedding").alias("end"),
        )
