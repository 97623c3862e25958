"""Export relations and writers. A sheet of a workbook is one dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperquay.functions import json_cols as J
from paperquay.functions import numbers as N
from paperquay.functions.dates import short_datetime
from paperquay.functions.text import sheet_name, status_label, type_label
from paperquay.operators.contract import SECTION_COLS
from paperquay.operators.ordered import block, running_sums
from paperquay.session import cut_lineage

# Sheet key in the stored document -> section.
SHEETS = {"rates": "RATES", "originArbs": "ORIGIN_ARB", "destArbs": "DEST_ARB"}


def json_rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").alias("id"), "filename", "status", F.col("created_at").alias("createdAt"),
        F.col("full_text").alias("ocrText"), F.col("markdown").alias("ocrMarkdown"),
        J.json_or(F.col("ocr_tables"), "[]").alias("tables"), "confidence", "notes",
        J.json_or(F.col("extracted_json"), "{}").alias("extractedJson"),
    )


def csv_rows(docs: DataFrame, text_chars: int | None = None) -> DataFrame:
    """Rows of the CSV export; ``text_chars`` cuts the texts, None leaves them whole."""
    text = F.coalesce("full_text", F.lit(""))
    text = text.alias("Text") if text_chars is None else F.substring(text, 1, text_chars).alias("Text (truncated)")
    return docs.select(
        F.col("doc_id").cast("string").alias("ID"), F.col("filename").alias("Filename"), F.col("status").alias("Status"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("Created At"),
        N.fixed1(F.col("confidence")).alias("Confidence"), F.col("page_count").cast("string").alias("Pages"),
        text,
        F.coalesce("notes", F.lit("")).alias("Notes"),
    )


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Quoted values with doubled quotes, a header line per file."""
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.mode("overwrite").options(header=True, quoteAll=True, escape='"', **keep).csv(path)


def read_csv(spark, path: str, schema: str) -> DataFrame:
    return (
        spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    )


def merged_rows(docs: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows of one array of the stored contract JSON, over all documents: doc_id, row_no, columns."""
    kind = "struct<type:string,rows:array<map<string,string>>>"
    # The stored key is renamed in the schema by reading it beside the type.
    parsed = F.from_json("extracted_json", kind.replace("rows:", f"`{key}`:"))
    of_type = docs.filter(F.get_json_object("extracted_json", "$.type") == "CONTRACT")
    rows = of_type.select("doc_id", F.posexplode(parsed[key]).alias("row_no", "r"))
    return rows.select(
        "doc_id", "row_no", *[F.coalesce(F.try_element_at("r", F.lit(c)), F.lit("")).alias(c) for c in columns]
    )


def contract_sheet(docs: DataFrame, key: str) -> DataFrame:
    """Sheet rows in the fixed column order, with parsed dates beside the raw texts."""
    rows = merged_rows(docs, key, SECTION_COLS[SHEETS[key]])
    return rows.withColumns(
        {f"{c}_parsed": F.try_to_date(F.col(c), "yyyy-MM-dd") for c in ("effective_date", "expiration_date")}
    )


def write_contract_sheets(sheets: dict[str, DataFrame], path: str) -> list[str]:
    """One dataset per non-empty sheet; returns the names written."""
    written = []
    for name, rows in sheets.items():
        if not rows.isEmpty():
            rows.write.mode("overwrite").parquet(f"{path}/{name}")
            written.append(name)
    return written


def table_rows(docs: DataFrame, columns: Sequence[dict]) -> DataFrame:
    """Display row per document: eight fixed columns, then one per session column."""
    answers = J.answer_map(F.col("extracted_row"))
    dynamic = [
        F.coalesce(F.try_element_at(answers, F.lit(c["key"]))["answer"], F.lit("")).alias(c.get("label") or c["key"])
        for c in columns
    ]
    seconds, pages = F.col("processing_time"), F.col("page_count")
    return docs.select(
        F.coalesce("filename", F.lit("")).alias("Filename"), status_label(F.col("status")).alias("Status"),
        short_datetime(F.col("created_at")).alias("Scanned"), N.short_duration(seconds).alias("Time"),
        N.confidence_text(F.col("confidence")).alias("Confidence"),
        F.when(pages > 0, pages.cast("string")).otherwise("—").alias("Page"),
        N.readable_duration(seconds).alias("Total Time"), type_label(F.col("extraction_type")).alias("Ext. Type"),
        *dynamic,
    )


def metric_sheet(docs: DataFrame, session_name: str, generated: Column) -> DataFrame:
    """Ordered (ord, metric, value) rows: session, time, totals, and counts by status."""
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.coalesce("confidence", F.lit(0.0))), F.lit(0.0)).alias("c"))
    head = total.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("ord"), F.lit(m).alias("metric"), v.alias("value"))
                    for i, (m, v) in enumerate(
                        [
                            ("Session", F.lit(session_name or "Session")),
                            ("Generated At", short_datetime(generated)),
                            ("Documents", F.col("n").cast("string")),
                            ("Average Confidence", F.concat(N.fixed1(F.col("c")), F.lit("%"))),
                            ("", F.lit("")),
                        ]
                    )
                ]
            )
        ).alias("m")
    ).select("m.*")
    status = F.coalesce("status", F.lit("UNKNOWN"))
    counts = docs.groupBy(status.alias("s")).agg(F.count(F.lit(1)).alias("n"))
    # One row per status code, so the numbering window is small by the number of codes.
    from pyspark.sql import Window as W

    tail = counts.select(
        (F.row_number().over(W.orderBy("s")) + 4).alias("ord"),
        F.concat(F.lit("Status: "), status_label(F.col("s"))).alias("metric"), F.col("n").cast("string").alias("value"),
    )
    return head.unionByName(tail)


def summary_listing(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").alias("ID"), F.col("filename").alias("Filename"), F.col("status").alias("Status"),
        F.col("created_at").alias("Created"), F.col("confidence").alias("Confidence"), F.col("page_count").alias("Pages"),
        J.list_length(F.col("ocr_tables")).alias("Tables"), F.col("notes").alias("Notes"),
    )


def _plain_number(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def document_sheets(docs: DataFrame, grid: DataFrame, tables: DataFrame) -> DataFrame:
    """Rows of the per-document sheets: doc_id, sheet, row_no (from 0), cells.

    ``grid``: doc_id, table_id, row, cells (dense rows). ``tables``: doc_id, table_id, n (rows; an
    empty table has 0 and still counts), optionally caption.
    """
    def line(*cells: Column) -> Column:
        return F.array(*cells).cast("array<string>") if cells else F.array().cast("array<string>")

    text = F.when(F.coalesce("full_text", F.lit("")) == "", "(no text)").otherwise(F.col("full_text"))
    top = F.array(
        line(F.lit("Filename"), F.col("filename")), line(F.lit("Status"), F.col("status")),
        line(F.lit("Confidence"), F.concat(_plain_number(F.col("confidence")), F.lit("%"))), line(),
        line(F.lit("Extracted Text")), line(text),
    )
    sheet = sheet_name(F.col("filename"))
    head = docs.select("doc_id", sheet.alias("sheet"), F.posexplode(top).alias("row_no", "cells"))
    caption = F.col("caption") if "caption" in tables.columns else F.lit(None).cast("string").alias("caption")
    # Four small relations below read the tables.
    tables = cut_lineage(tables.select("doc_id", "table_id", F.col("n").cast("long").alias("n"), caption))
    lead = F.when(F.coalesce("caption", F.lit("")) != "", 2).otherwise(1)
    placed = running_sums(
        tables.withColumn("lead", lead), ["doc_id"], ["table_id"], {"end": F.col("n") + F.col("lead")}, [block("table_id")]
    ).withColumn("first", F.col("end") - F.col("n") - F.col("lead") + 8)
    placed = cut_lineage(placed)
    named = docs.select("doc_id", sheet.alias("sheet"))
    count = tables.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tables"))
    title = named.join(count, "doc_id").select(
        "doc_id", "sheet",
        F.posexplode(
            F.array(line(), line(F.concat(F.lit("Tables ("), F.col("n_tables").cast("string"), F.lit(")"))))
        ).alias("p", "cells"),
    ).select("doc_id", "sheet", (F.col("p") + 6).alias("row_no"), "cells")
    leads = placed.join(named, "doc_id").select(
        "doc_id", "sheet", "first",
        F.posexplode(F.when(F.col("lead") == 2, F.array(line(), line(F.col("caption")))).otherwise(F.array(line()))).alias("p", "cells"),
    ).select("doc_id", "sheet", (F.col("first") + F.col("p")).alias("row_no"), "cells")
    # Places and names of the tables come together first, so that the rows are shuffled once.
    at = placed.select("doc_id", "table_id", "first", "lead").join(named, "doc_id")
    body = grid.join(at, ["doc_id", "table_id"]).select(
        "doc_id", "sheet", (F.col("first") + F.col("lead") + F.col("row")).alias("row_no"), "cells"
    )
    out = head
    for part in (title, leads, body):
        out = out.unionByName(part)
    return out.withColumn("row_no", F.col("row_no").cast("long"))


def mode_select(docs: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row: which layout fits these documents (TABLE_ROWS, CONTRACT or GENERIC; null when none)."""
    kind = F.coalesce(J.field(F.try_parse_json("extracted_json"), "type").cast("string"), F.lit(""))
    one = docs.agg(
        F.count(F.lit(1)).alias("n"), F.min("session_id").alias("lo"), F.max("session_id").alias("hi"),
        F.count("session_id").alias("with_session"), F.bool_and(kind == "CONTRACT").alias("all_contract"),
    )
    single = (F.col("with_session") == F.col("n")) & (F.col("lo") == F.col("hi"))
    s = sessions.select(F.col("session_id").alias("lo"), "mode")
    return one.join(s, "lo", "left").select(
        "n", F.when(single, F.col("lo")).alias("session_id"),
        F.when(F.col("n") == 0, None)
        .when(F.coalesce(single, F.lit(False)) & (F.col("mode") == "TABLE_EXTRACT"), "TABLE_ROWS")
        .when(F.col("all_contract"), "CONTRACT").otherwise("GENERIC").alias("layout"),
    )


def history_rows(docs: DataFrame, fmt: str, path: str, now: Column) -> DataFrame:
    return docs.select(
        F.col("doc_id"), F.lit(fmt).alias("export_format"), F.lit(path).alias("export_path"), now.alias("exported_at")
    )


def mark_exported(docs: DataFrame, exported: DataFrame, path: str) -> DataFrame:
    """Registry after an export: approved documents of it become EXPORTED; others keep what they had."""
    hit = exported.select("doc_id").distinct().withColumn("__x", F.lit(True))
    done = F.col("__x").isNotNull() & (F.col("status") == "APPROVED")
    was = F.coalesce("exported", F.lit(False)) if "exported" in docs.columns else F.lit(False)
    had = F.coalesce("export_path", F.lit("")) if "export_path" in docs.columns else F.lit("")
    return docs.join(hit, "doc_id", "left").withColumns(
        {
            "exported": done | was,
            "export_path": F.when(done, F.lit(path)).otherwise(had),
            "status": F.when(done, "EXPORTED").otherwise(F.col("status")),
        }
    ).drop("__x")


def latest_history(history: DataFrame, n: int = 100) -> DataFrame:
    return history.orderBy(F.col("exported_at").desc(), F.col("doc_id").desc()).limit(n)


def approved(docs: DataFrame) -> DataFrame:
    """Approved documents; an error when there is none to export."""
    out = docs.filter(F.col("status") == "APPROVED")
    if out.isEmpty():
        raise ValueError("No approved documents to export")
    return out
