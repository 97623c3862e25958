"""Document registry: listing, search, statistics, and status changes as DataFrame rewrites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperquay.functions import json_cols as J
from paperquay.functions.numbers import percent_of
from paperquay.operators.ordered import Listing, block, carry_forward, global_rank

# Status groups.
PROCESSED = ["REVIEW", "APPROVED", "REJECTED", "EXPORTED"]
FINISHED = ["APPROVED", "REJECTED", "EXPORTED", "ERROR"]
TRANSIENT = ["CANCELLING", "SCANNING", "PROCESSING"]
CANCELLABLE = ["QUEUED", "SCANNING", "PROCESSING", "CANCELLING"]
BUCKETS = ["QUEUED", "PROCESSING", "REVIEW", "APPROVED", "REJECTED", "EXPORTED", "ERROR"]

# What can be done with a document in each status.
ACTIONS = {
    "QUEUED": ["play", "delete"],
    "SCANNING": ["stop", "delete"],
    "PROCESSING": ["stop", "delete"],
    "CANCELLING": ["delete"],
    "REVIEW": ["review", "approve", "reprocess", "export", "delete"],
    "APPROVED": ["reprocess", "export", "delete"],
    "REJECTED": ["reprocess", "delete"],
    "EXPORTED": ["reprocess", "export", "delete"],
    "ERROR": ["play", "reprocess", "delete"],
}
ANY_ACTIONS = ["review", "reprocess", "export", "delete"]


def _contains(c: str, text: str) -> Column:
    return F.lower(c).contains(text.lower())


def list_documents(
    docs: DataFrame, session_id: str | None = None, status: str | None = None, search: str | None = None
) -> DataFrame:
    """Listing projection of the documents that meet all given conditions, newest first."""
    out = docs
    if session_id:
        out = out.filter(F.col("session_id") == session_id)
    if status:
        out = out.filter(F.col("status") == status)
    if search:
        out = out.filter(_contains("filename", search) | _contains("notes", search))
    return out.select(
        "doc_id", "filename", "status", "created_at", "confidence", "processing_time", "page_count",
        J.list_length(F.col("ocr_tables")).alias("table_count"),
        "notes", "quality_valid",
        J.list_length(F.col("quality_issues")).alias("quality_issue_count"),
        "session_id", F.coalesce("extraction_type", F.lit("IMAGE")).alias("extraction_type"),
        J.answer_map(F.col("extracted_row")).alias("extracted_row"),
    ).orderBy(F.col("created_at").desc(), "doc_id")


def document_record(docs: DataFrame) -> DataFrame:
    """Nested record: quality and OCR structs, tags, the user's edits, parsed JSON columns.

    Columns that ``docs`` lacks are null; tags that are no list of texts are null, too.
    """
    strings = "array<string>"
    return docs.select(
        "doc_id", "filename", "status", "created_at", "notes", "session_id",
        F.coalesce("extraction_type", F.lit("AUTO")).alias("extraction_type"),
        F.struct(
            F.col("quality_valid").alias("valid"), "dpi", "width", "height",
            *(_or_null(docs, c, "double").alias(c) for c in ("blur_score", "skew_angle")),
            F.from_json("quality_issues", strings).alias("issues"),
        ).alias("quality"),
        F.when(
            F.col("full_text") != "",
            F.struct(
                "full_text", "markdown", F.from_json("text_blocks", "array<map<string,string>>").alias("blocks"),
                F.col("confidence").alias("avg_confidence"), "processing_time", "page_count",
                F.from_json("ocr_tables", "array<map<string,string>>").alias("tables"),
                F.from_json("warnings", strings).alias("warnings"),
            ),
        ).alias("ocr_result"),
        J.json_or(F.col("extracted_json"), "{}").alias("extracted_json"),
        _or_null(docs, "thumbnail_path", "string").alias("thumbnail_path"),
        F.from_json(_or_null(docs, "tags", "string"), strings).alias("tags"),
        F.from_json(_or_null(docs, "user_edits", "string"), "map<string,string>").alias("user_edits"),
        "verified_by", _or_null(docs, "verified_at", "timestamp").alias("verified_at"), "processed_at", "exported", "export_path",
    )


def with_status(docs: DataFrame, status: str | None) -> DataFrame:
    return docs if status in (None, "", "all") else docs.filter(F.col("status") == status)


def filename_contains(docs: DataFrame, text: str) -> DataFrame:
    return docs.filter(_contains("filename", text)) if text.strip() else docs


def ids_in(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.join(ids.select(key), key, "left_semi")


def sorted_by(docs: DataFrame, by: str = "created_at", desc: bool = True, tiebreak: str = "doc_id") -> DataFrame:
    """Documents with their position ``pos`` in the order of a checked column"""
    if by not in docs.columns:
        raise ValueError(f"cannot sort by {by!r}; columns are {docs.columns}")
    return global_rank(docs, [F.col(by).desc() if desc else F.col(by).asc(), F.col(tiebreak).asc()])


def page_of(docs: DataFrame, order: Sequence[Column], page: int, size: int, keys: Sequence[str], key: str = "doc_id") -> DataFrame:
    """One 1-based page; a page past the end gives the last page.

    ``keys`` are the columns that ``order`` reads, with the unique ``key`` among them. A reader of
    several pages makes one ``Listing`` and asks that.
    """
    return Listing(docs, order, keys, key).page(docs, page, size)


def page_after(docs: DataFrame, key: str, last_seen, size: int) -> DataFrame:
    """Next page after a seen key: reads no earlier pages, however deep the page is."""
    rest = docs if last_seen is None else docs.filter(F.col(key) > F.lit(last_seen))
    return rest.orderBy(key).limit(size)


def quality_assess(docs: DataFrame, min_dpi: int = 150, min_side: int = 500) -> DataFrame:
    """Quality issues from image metadata; absent metadata raises none."""
    dpi, w, h = F.col("dpi"), F.col("width"), F.col("height")
    found = F.array(
        F.when((dpi > 0) & (dpi < min_dpi), F.concat(F.lit("Low DPI: "), dpi.cast("string"))),
        F.when(
            (w < min_side) | (h < min_side),
            F.concat(F.lit("Small image: "), w.cast("string"), F.lit("x"), h.cast("string")),
        ),
    )
    issues = F.filter(found, lambda i: i.isNotNull())
    return docs.withColumn("issues", issues).withColumn("valid", F.size("issues") == 0)


# -- statistics --------------------------------------------------------------------------------


def _stats() -> list[Column]:
    counts = [F.count_if(F.col("status") == s).alias(s.lower()) for s in BUCKETS]
    confident = F.when(F.col("confidence") > 0, F.col("confidence"))
    return [
        F.count(F.lit(1)).alias("total"),
        *counts,
        F.coalesce(F.avg(confident), F.lit(0.0)).alias("avg_confidence"),
    ]


def dashboard_stats(docs: DataFrame) -> DataFrame:
    return docs.agg(*_stats())


def session_stats(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("session_id").isNotNull()).groupBy("session_id").agg(*_stats())


def daily_stats(docs: DataFrame, at: str = "processed_at") -> DataFrame:
    """Counts and means by the day of processing; documents without one are left out."""
    return docs.filter(F.col(at).isNotNull()).groupBy(F.to_date(at).alias("day")).agg(
        F.count_if(F.col("status").isin(PROCESSED)).alias("processed"),
        F.count_if(F.col("status") == "APPROVED").alias("approved"),
        F.count_if(F.col("status") == "REJECTED").alias("rejected"),
        F.coalesce(F.avg("processing_time"), F.lit(0.0)).alias("avg_time"),
        F.coalesce(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), F.lit(0.0)).alias("avg_confidence"),
    )


def processing_totals(docs: DataFrame, scan: Column, ask: Column, wall: Column) -> DataFrame:
    """Total seconds and engine labels; the wall clock counts when no part was measured."""
    none = (F.coalesce(scan, F.lit(0.0)) == 0) & (F.coalesce(ask, F.lit(0.0)) == 0)
    total = F.when(none, F.round(wall, 3)).otherwise(F.round(scan + ask, 3))
    label = F.concat(F.lit("models: scan="), F.col("scan_model"))
    label = F.when(F.col("llm_model").isNotNull(), F.concat(label, F.lit(", llm="), F.col("llm_model"))).otherwise(label)
    return docs.withColumn("total_time", total).withColumn("models_label", label)


# -- status changes ----------------------------------------------------------------------------


def _in_order(changes: DataFrame, order: str | None, *ties: str) -> tuple[DataFrame, Column]:
    """``changes`` of known documents with ``__at``, and what puts several changes of one document in order.

    ``order`` is an integer or a time. Changes of equal ``order``, and all if there is none, go by ``ties``, null first.
    """
    at = F.lit(0) if order is None else F.col(order)
    if order is not None and dict(changes.dtypes)[order].startswith("timestamp"):
        at = F.unix_micros(F.col(order).cast("timestamp"))
    rows = changes.withColumn("__at", F.coalesce(at.cast("long"), F.lit(-(1 << 62)))).filter(F.col("doc_id").isNotNull())
    return rows, F.struct("__at", *ties)


def review_decisions(docs: DataFrame, decisions: DataFrame, now: Column, guard: bool = False, order: str | None = None) -> DataFrame:
    """Apply (doc_id, decision, reason); ``guard`` also checks that the status allows each of them.

    A document may have several decisions. They are applied by ``order``, equal ones by decision and
    reason, and the document stays one row. What a sequence does to a status is settled before the
    documents are joined: after any decision on a reviewable document its status is that decision's, and a
    decision does something if it differs from the one before it, or, as the first, from the status. So a
    document's decisions shrink to their first, their last and the last reason that counts.
    """
    known = decisions.select("doc_id", "decision", F.coalesce("reason", F.lit("")).alias("reason"), *([order] if order else []))
    rows, at = _in_order(known.filter(F.col("decision").isin("APPROVE", "REJECT")), order, "decision", "reason")
    rows = rows.withColumn("__seq", at)
    if guard:
        # A scan in blocks of the order, so that a document with very many decisions is no single task.
        levels = [block("__at")] if order else [F.lit(0).cast("long")]
        rows = carry_forward(rows, ["doc_id"], ["__seq"], {"__before": F.col("decision")}, levels, inclusive=False)
        counts = F.col("__before").isNotNull() & (F.col("__before") != F.col("decision"))
    else:
        counts = F.lit(True)
    said = counts & (F.col("decision") == "REJECT") & (F.col("reason") != "")
    last = rows.groupBy("doc_id").agg(
        F.min_by(F.struct("decision", "reason"), "__seq").alias("__first"), F.max_by("decision", "__seq").alias("__last"),
        F.max(counts).alias("__later"), F.max_by("reason", F.when(said, F.col("__seq"))).alias("__reason"),
    )
    d = docs.join(last, "doc_id", "left")
    opens = F.lit(True)
    if guard:
        first = F.col("__first.decision")
        opens = F.col("status").isin("REVIEW", "APPROVED", "REJECTED")
        starts = (first == "APPROVE") & F.col("status").isin("REVIEW", "REJECTED") | (first == "REJECT") & F.col("status").isin("REVIEW", "APPROVED")
        early = F.when(starts & (first == "REJECT"), F.nullif("__first.reason", F.lit("")))
        done = starts | opens & F.col("__later")
    else:
        early, done = F.lit(None), F.col("__last").isNotNull()
    done = F.coalesce(done, F.lit(False))
    return d.select(
        *[c for c in docs.columns if c not in ("status", "notes", "verified_at")],
        F.when(done, F.when(F.col("__last") == "APPROVE", "APPROVED").otherwise("REJECTED")).otherwise(F.col("status")).alias("status"),
        F.coalesce(F.when(opens, F.col("__reason")), early, "notes").alias("notes"),
        F.when(done, now).otherwise(_or_null(docs, "verified_at", "timestamp")).alias("verified_at"),
    )


def _or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _marked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("doc_id").distinct().withColumn("__hit", F.lit(True)), "doc_id", "left").withColumn(
        "__hit", F.coalesce("__hit", F.lit(False))
    )


def reprocess(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Queue the given documents again: OCR results and verification are cleared, notes and answers stay."""
    cleared = {
        "status": F.lit("QUEUED"), "full_text": F.lit(""), "ocr_tables": F.lit("[]"), "confidence": F.lit(0.0),
        "processing_time": F.lit(0.0), "page_count": F.lit(0), "warnings": F.lit("[]"), "extracted_json": F.lit("{}"),
        "verified_at": F.lit(None), "verified_by": F.lit(""), "processed_at": F.lit(None), "markdown": F.lit(""),
        "text_blocks": F.lit("[]"),
    }
    hit = F.col("__hit")
    kinds = dict(docs.dtypes)
    changes = {
        c: F.when(hit, v.cast(kinds[c])).otherwise(F.col(c)) for c, v in cleared.items() if c in docs.columns
    }
    return _marked(docs, ids).withColumns(changes).drop("__hit")


def patch(docs: DataFrame, patches: DataFrame, fields: Sequence[str], order: str | None = None) -> DataFrame:
    """Overwrite the supplied fields: ``patches`` has doc_id, a ``set`` array of names, and values.

    Of several patches of a document the last by ``order`` that supplies a field sets it, equal ones by their values,
    null first; the document stays one row.
    """
    rows, at = _in_order(patches, order, *fields)
    last = rows.groupBy("doc_id").agg(
        *(F.max_by(F.struct(F.col(f).alias("v")), F.when(F.array_contains("set", f), at)).alias(f"__new_{f}") for f in fields)
    )
    new = {f: F.when(F.col(f"__new_{f}").isNotNull(), F.col(f"__new_{f}.v")).otherwise(F.col(f)) for f in fields}
    return docs.join(last, "doc_id", "left").withColumns(new).select(*docs.columns)


def recover_transient(docs: DataFrame) -> DataFrame:
    hit = F.col("status").isin(TRANSIENT)
    return docs.withColumn("recovered", hit).withColumn("status", F.when(hit, "QUEUED").otherwise(F.col("status")))


def cancel(docs: DataFrame, ids: DataFrame) -> DataFrame:
    hit = F.col("__hit") & F.col("status").isin(CANCELLABLE)
    return _marked(docs, ids).withColumn("status", F.when(hit, "QUEUED").otherwise(F.col("status"))).drop("__hit")


RESULT_COLS = [
    "full_text", "markdown", "text_blocks", "ocr_tables", "extracted_json", "confidence", "processing_time", "page_count", "processed_at",
    "warnings",
]


def apply_results(docs: DataFrame, results: DataFrame, order: str | None = None) -> DataFrame:
    """Store extraction results; an error gives status ERROR. Results of unknown documents are ignored.

    Every column of RESULT_COLS that ``results`` has is stored; a column that is none of these, or that
    the documents lack, is an error. Of several results of a document the last by ``order``, equal ones by
    error and values, gives the status; fields are those of the last result without an error, warnings those of
    the last result that has some or an error. The document stays one row.
    """
    stray = sorted(set(results.columns) - {"doc_id", "error", order or "error", *RESULT_COLS})
    lost = sorted(set(results.columns) & set(RESULT_COLS) - set(docs.columns))
    if stray or lost:
        raise ValueError(f"results have columns that can't be stored: {', '.join(stray + lost)}")
    cols = [c for c in RESULT_COLS if c in results.columns]
    rows, at = _in_order(results, order, "error", *cols)
    good = [c for c in cols if c != "warnings"]
    told = F.col("warnings") if "warnings" in cols else F.lit("[]")
    told = F.when(F.col("error").isNotNull(), F.to_json(F.array("error"))).otherwise(told)
    last = rows.groupBy("doc_id").agg(
        F.max_by(F.struct(F.col("error").alias("v")), at).alias("__last"),
        F.max_by(F.struct(*good, F.lit(True).alias("__ok")), F.when(F.col("error").isNull(), at)).alias("__new"),
        F.max_by(told, F.when(told.isNotNull(), at)).alias("__told"),
    )
    new = {c: F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)) for c in good}
    new["warnings"] = F.coalesce("__told", "warnings")
    new["status"] = F.when(F.col("__last.v").isNotNull(), "ERROR").when(F.col("__last").isNotNull(), "REVIEW").otherwise(F.col("status"))
    # Results hold whole texts, and what a plug-in makes is estimated far too small: they are never sent to the driver.
    return docs.join(last.hint("merge"), "doc_id", "left").withColumns(new).select(*docs.columns)


def status_actions(status: Column) -> Column:
    """Array of the actions a status allows."""
    table = F.create_map(
        *[x for s, acts in ACTIONS.items() for x in (F.lit(s), F.array(*[F.lit(a) for a in acts]))]
    )
    return F.coalesce(F.try_element_at(table, status), F.array(*[F.lit(a) for a in ANY_ACTIONS]))


# -- type detection and routing ----------------------------------------------------------------


def text_density(pages: DataFrame, sample_pages: int | None = None, min_chars: int = 120, min_words: int = 20) -> DataFrame:
    """PDF_TEXT or PDF_IMAGE per document from its pages, or from the first ``sample_pages`` of them.

    The non-blank page texts, joined by line breaks, need so many characters or words; their sums
    say as much, so texts are not put together.
    """
    from paperquay.functions.text import WS, strip

    text = strip(F.coalesce("text", F.lit("")))
    if sample_pages is not None:
        text = F.when(F.col("page") <= sample_pages, text).otherwise("")
    words = F.size(F.filter(F.split("__t", WS), lambda w: w != ""))
    sums = pages.select("doc_id", text.alias("__t")).groupBy("doc_id").agg(
        F.sum(F.length("__t")).alias("chars"), F.count_if(F.col("__t") != "").alias("n"), F.sum(words).alias("words")
    )
    enough = (F.col("chars") + F.greatest(F.col("n") - 1, F.lit(0)) >= min_chars) | (F.col("words") >= min_words)
    return sums.select("doc_id", F.when(enough, "PDF_TEXT").otherwise("PDF_IMAGE").alias("density"))


def extension(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"(\.[^./\\]+)$", 1))


def detect_type(docs: DataFrame, densities: DataFrame) -> DataFrame:
    """IMAGE, EXCEL, PDF_TEXT or PDF_IMAGE; a PDF without a verdict counts as scanned."""
    ext = extension(F.col("filename"))
    kind = (
        F.when(ext.isin(".xlsx", ".xls"), "EXCEL")
        .when(ext != ".pdf", "IMAGE")
        .otherwise(F.coalesce("density", F.lit("PDF_IMAGE")))
    )
    return docs.join(densities, "doc_id", "left").withColumn("detected_type", kind).drop("density")


PDF_ENGINES = ["docling", "pdfplumber", "pymupdf", "unstructured"]


def route_extractor(docs: DataFrame, default_engine: str = "pdfplumber") -> DataFrame:
    """Engine and fallback from (mode, detected_type, extraction_model)."""
    mode, kind = F.col("mode"), F.col("detected_type")
    chosen = F.when((mode == "PDF_EXTRACT") & (F.col("extraction_model") != ""), F.col("extraction_model"))
    model = F.coalesce(chosen, F.lit(default_engine))
    model = F.when(model.isin(PDF_ENGINES), model).otherwise("pdfplumber")
    pdf, table = kind.isin("PDF_TEXT", "PDF_IMAGE"), F.coalesce(mode == "TABLE_EXTRACT", F.lit(False))
    scanned = kind.isin("PDF_IMAGE", "IMAGE")
    return docs.withColumn(
        "engine",
        F.when(table & (kind == "PDF_TEXT"), "pdfplumber").when(table & scanned, "docling")
        .when(~table & pdf, model).otherwise("rapidocr"),
    ).withColumn("fallback", F.when(table & scanned, "rapidocr"))


def progress_percent(processed: Column, total: Column) -> Column:
    return percent_of(processed, total)
