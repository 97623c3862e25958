"""Queries over the document registry and its sessions."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from paperquay.functions import dates as D
from paperquay.functions import json_cols as J
from paperquay.functions import numbers as N
from paperquay.functions import text as X
from paperquay.operators import documents as O
from paperquay.operators import filters as V
from paperquay.operators import logs as L
from paperquay.operators import sessions as S
from paperquay.operators.grams import TextIndex
from paperquay.operators.ordered import global_rank
from paperquay.plans.registry import query

BUCKET_SQL = ", ".join(
    f"count(*) filter (where status = '{s}') as {s.lower()}" for s in O.BUCKETS
)
STATS_SQL = f"count(*) as total, {BUCKET_SQL}, round(coalesce(avg(confidence) filter (where confidence > 0), 0.0), 6) as avg_confidence"


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("AGG01_dashboard_stats", "v1", f"select {STATS_SQL} from v1")
def _(lake):
    return _rounded(O.dashboard_stats(lake.docs), "avg_confidence")


@query("AGG02_session_stats", "v1", f"select session_id, {STATS_SQL} from v1 where session_id is not null group by session_id")
def _(lake):
    return _rounded(O.session_stats(lake.docs), "avg_confidence")


@query(
    "AGG03_session_status_sync", "v0 v1",
    """select s.session_id, case when n is null then s.status when done = n then 'DONE' else 'PROCESSING' end as status
from v0 s left join (select session_id, count(*) as n,
  count(*) filter (where status in ('APPROVED','REJECTED','EXPORTED','ERROR')) as done from v1 group by session_id) c
  on s.session_id = c.session_id""",
)
def _(lake):
    return S.sync_status(lake.sessions, lake.docs).select("session_id", "status")


COUNTS_SQL = """select s.session_id, s.name, s.first_doc_id, coalesce(c.n, 0) as document_count, coalesce(c.p, 0) as processed_count
from v0 s left join (select session_id, count(*) as n,
  count(*) filter (where status in ('REVIEW','APPROVED','REJECTED','EXPORTED')) as p from v1 group by session_id) c
  on s.session_id = c.session_id"""


@query("JON01_sessions_with_counts", "v0 v1", COUNTS_SQL)
def _(lake):
    return S.with_counts(lake.sessions, lake.docs).select(
        "session_id", "name", "first_doc_id", "document_count", "processed_count"
    )


@query(
    "JON01_newest_first", "v0 v1",
    f"""select session_id, document_count, row_number() over (order by created desc, session_id) as pos
from (select session_id, document_count, first_doc_id % 7 as created from ({COUNTS_SQL}) c) t""",
)
def _(lake):
    made = lake.sessions.withColumn("created_at", F.timestamp_seconds(F.col("first_doc_id") % 7))
    listed = S.with_counts(made, lake.docs).withColumn("at", F.monotonically_increasing_id())  # follows the order of the rows
    return global_rank(listed, [F.col("at")]).select("session_id", "document_count", "pos")


@query(
    "AGG04_session_progress_pct", "v0 v1",
    f"select session_id, case when document_count > 0 then cast(floor(processed_count * 100.0 / document_count + 0.5) as bigint) else 0 end as pct from ({COUNTS_SQL}) t",
)
def _(lake):
    d = S.with_counts(lake.sessions, lake.docs)
    return d.select("session_id", O.progress_percent(F.col("processed_count"), F.col("document_count")).alias("pct"))


@query(
    "AGG12_daily_stats", "v1",
    """select strftime(to_timestamp(processed_epoch) at time zone 'UTC', '%Y-%m-%d') as day,
  count(*) filter (where status in ('REVIEW','APPROVED','REJECTED','EXPORTED')) as processed,
  count(*) filter (where status = 'APPROVED') as approved, count(*) filter (where status = 'REJECTED') as rejected,
  round(avg(processing_time), 6) as avg_time, round(coalesce(avg(confidence) filter (where confidence > 0), 0.0), 6) as avg_confidence
from v1 group by 1""",
)
def _(lake):
    d = _rounded(O.daily_stats(lake.docs), "avg_time", "avg_confidence")
    return d.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "AGG15_processing_totals", "v1",
    """select doc_id, case when t = 0 and a = 0 then round(w, 3) else round(t + a, 3) end as total_time,
  concat('models: scan=', case when doc_id % 2 = 0 then 'docling' else 'pdfplumber' end,
    case when doc_id % 3 = 0 then ', llm=m1' else '' end) as models_label
from (select doc_id, processing_time as t, cast((doc_id % 4) as double) / 8 as a, cast((n_chars % 7) as double) as w from v1) x""",
)
def _(lake):
    d = lake.docs.withColumns(
        {
            "scan_model": F.when(F.col("doc_id") % 2 == 0, "docling").otherwise("pdfplumber"),
            "llm_model": F.when(F.col("doc_id") % 3 == 0, "m1"),
        }
    )
    ask, wall = (F.col("doc_id") % 4) / 8, (F.col("n_chars") % 7).cast("double")
    return O.processing_totals(d, F.col("processing_time"), ask, wall).select("doc_id", "total_time", "models_label")


# -- listing and search ------------------------------------------------------------------------

SEARCH = "_1"


@query(
    "FLT01_list_documents", "v1",
    f"""select doc_id, filename, status, created_epoch, confidence, page_count, notes, quality_valid, session_id, extraction_type,
  json_array_length(ocr_tables) as table_count, json_array_length(quality_issues) as quality_issue_count,
  case when doc_id % 4 >= 2 then notes end as answer_lang
from v1 where contains(lower(filename), '{SEARCH}') or contains(lower(notes), '{SEARCH}')""",
)
def _(lake):
    d = O.list_documents(lake.docs, search=SEARCH)
    return d.select(
        "doc_id", "filename", "status", F.unix_timestamp("created_at").alias("created_epoch"), "confidence", "page_count",
        "notes", "quality_valid", "session_id", "extraction_type", "table_count", "quality_issue_count",
        F.try_element_at("extracted_row", F.lit("lang"))["answer"].alias("answer_lang"),
    )


@query(
    "FLT02_document_record", "v1",
    """select doc_id, session_id, extraction_type, quality_valid as valid, dpi, n_chars % 9 / 4.0 as blur_score, n_chars % 5 / 2.0 as skew_angle,
  case when doc_id % 5 = 0 then 'Low DPI: 90' else '' end as issues, concat('thumbs/', doc_id, '.png') as thumbnail_path,
  case when doc_id % 4 = 0 then 'new; ' || notes when doc_id % 4 = 1 then '' end as tags, case when doc_id % 3 = 0 then notes end as edited,
  case when full_text <> '' then md5(full_text) end as text_md5, case when full_text <> '' then markdown end as markdown,
  case when full_text <> '' then notes end as block, verified_by, case when doc_id % 2 = 0 then processed_epoch end as verified, processed_epoch as processed, exported, export_path,
  case when full_text <> '' then doc_id % 3 end as tables,
  case when full_text <> '' then case when doc_id % 6 = 1 then 'slow' end end as warnings,
  case when doc_id % 3 = 1 then 'CONTRACT' end as doc_type from v1""",
)
def _(lake):
    by = lambda n: F.col("doc_id") % n
    d = O.document_record(lake.docs.withColumns({
        "blur_score": F.col("n_chars") % 9 / 4.0, "skew_angle": F.col("n_chars") % 5 / 2.0, "thumbnail_path": F.concat(F.lit("thumbs/"), "doc_id", F.lit(".png")),
        "tags": F.when(by(4) == 0, F.to_json(F.array(F.lit("new"), "notes"))).when(by(4) == 1, "[]").otherwise("oops"),
        "user_edits": F.when(by(3) == 0, F.to_json(F.struct(F.col("notes").alias("lang")))).otherwise("{}"),
        "verified_at": F.when(by(2) == 0, F.col("processed_at")),
    }))
    r = F.col("ocr_result")
    return d.select(
        "doc_id", "session_id", "extraction_type", "quality.valid", "quality.dpi", "quality.blur_score", "quality.skew_angle", "thumbnail_path",
        F.array_join("quality.issues", "; ").alias("issues"), F.array_join("tags", "; ").alias("tags"), F.col("user_edits")["lang"].alias("edited"),
        F.md5(r["full_text"]).alias("text_md5"), r["markdown"].alias("markdown"),
        r["blocks"][0]["text"].alias("block"), "verified_by", F.unix_timestamp("verified_at").alias("verified"), F.unix_timestamp("processed_at").alias("processed"),
        "exported", "export_path", F.when(r.isNotNull(), F.size(r["tables"])).cast("long").alias("tables"),
        F.when(F.size(r["warnings"]) > 0, F.array_join(r["warnings"], "; ")).alias("warnings"),
        J.field(F.col("extracted_json"), "type").cast("string").alias("doc_type"),
    )


@query("FLT03_status_filter", "v1", "select doc_id, status from v1 where status = 'REVIEW'")
def _(lake):
    return O.with_status(lake.docs, "REVIEW").select("doc_id", "status")


@query("FLT04_filename_contains", "v1", "select doc_id, filename from v1 where contains(lower(filename), '.jpg')")
def _(lake):
    return O.filename_contains(lake.docs, ".JPG").select("doc_id", "filename")


@query("FLT05_session_search", "v0", "select session_id, name from v0 where contains(lower(name), 'src1') and mode = 'OCR_EXTRACT' and status = 'PENDING'")
def _(lake):
    return S.search(lake.sessions, "SRC1", "PENDING", "OCR_EXTRACT").select("session_id", "name")


@query("FLT14_ids_in", "v1", "select doc_id, status from v1 where doc_id in (select doc_id from labels where quality = 1)")
def _(lake):
    return O.ids_in(lake.docs, lake.table("labels").filter("quality = 1")).select("doc_id", "status")


@query(
    "FLT15_quality_assess", "v1",
    """select doc_id, dpi, width, height, not ((dpi > 0 and dpi < 150) or width < 500 or height < 500) as valid,
  concat_ws('; ', case when dpi > 0 and dpi < 150 then concat('Low DPI: ', cast(dpi as varchar)) end,
    case when width < 500 or height < 500 then concat('Small image: ', cast(width as varchar), 'x', cast(height as varchar)) end) as issues
from v1""",
)
def _(lake):
    d = O.quality_assess(lake.docs)
    return d.select("doc_id", "dpi", "width", "height", "valid", F.array_join("issues", "; ").alias("issues"))


@query(
    "SRT01_sort_by_any", "v1",
    "select doc_id, created_epoch, row_number() over (order by created_epoch desc, doc_id) as pos from v1",
)
def _(lake):
    d = lake.docs.select("doc_id", "created_epoch", "created_at")
    return O.sorted_by(d).select("doc_id", "created_epoch", "pos")


@query(
    "SRT03_starred_first", "v0",
    "select session_id, row_number() over (order by case when first_doc_id % 3 = 0 then 0 else 1 end, first_doc_id) as pos from v0",
)
def _(lake):
    starred = F.when(F.col("first_doc_id") % 3 == 0, 0).otherwise(1)
    d = lake.sessions.select("session_id", "first_doc_id")
    return global_rank(d, [starred.asc(), F.col("first_doc_id").asc()]).select("session_id", "pos")


@query(
    "WIN09_paginate", "v1",
    """select doc_id, created_epoch from v1 order by created_epoch desc, doc_id
limit 20 offset (least(3, greatest(1, cast(ceil((select count(*) from v1) / 20.0) as bigint))) - 1) * 20""",
)
def _(lake):
    order = [F.col("created_epoch").desc(), F.col("doc_id").asc()]
    return O.page_of(lake.docs, order, 3, 20, ["doc_id", "created_epoch"]).select("doc_id", "created_epoch")


@query(
    "WIN11_name_disambiguate", "v0 v1",
    """select doc_id, case when k = 0 then base when base = 'Unnamed' then concat('Unnamed ', cast(k + 1 as varchar)) else concat(base, ' (', cast(k as varchar), ')') end as name
from (select doc_id, base,
    case when base = 'Unnamed' then rn - 1 when base = 'Session new' then rn - 1
      else rn + case when rn >= 2 then 1 else 0 end end as k
  from (select doc_id, base, row_number() over (partition by base order by doc_id) as rn
    from (select doc_id, case when session_id is null then 'Unnamed' when doc_id % 3 = 0 then 'Session new' else concat('Session ', session_id) end as base from v1) a) b) c""",
)
def _(lake):
    wanted = F.when(F.col("session_id").isNull(), "  ").when(F.col("doc_id") % 3 == 0, " Session new").otherwise(
        F.concat(F.lit("Session "), F.col("session_id"))
    )
    new = lake.docs.select("doc_id", wanted.alias("wanted"))
    # Every session name is taken, and so is its second copy.
    taken = lake.sessions.select(F.explode(F.array("name", F.concat("name", F.lit(" (2)")))).alias("name"))
    return S.disambiguate(new, taken, order="doc_id").select("doc_id", "name")


# -- joins -------------------------------------------------------------------------------------


@query(
    "JON02_documents_with_session", "v0 v1",
    "select d.doc_id, d.session_id, coalesce(s.mode, 'OCR_EXTRACT') as mode, s.extraction_model from v1 d left join v0 s on d.session_id = s.session_id",
)
def _(lake):
    return S.documents_with_session(lake.docs, lake.sessions).select("doc_id", "session_id", "mode", "extraction_model")


ARRIVAL_SQL = "select doc_id, row_number() over (order by ts, doc_id) as place from (select doc_id, min(ts) as ts from v6 group by doc_id) t"


@query("SRT05_fifo_order", "v6", ARRIVAL_SQL)
def _(lake):
    return L.arrival_order(lake.events).select("doc_id", "place")


@query(
    "JON03_prune_deleted", "v6 v1",
    f"select doc_id, place from ({ARRIVAL_SQL}) q where doc_id in (select doc_id from v1 where status <> 'ERROR')",
)
def _(lake):
    alive = lake.docs.filter("status <> 'ERROR'")
    return L.prune_deleted(L.arrival_order(lake.events), alive).select("doc_id", "place")


@query(
    "SET03_queue_difference", "v6",
    f"select doc_id, place from ({ARRIVAL_SQL}) q where doc_id not in (select doc_id from labels where toxic = 1)",
)
def _(lake):
    gone = lake.table("labels").filter("toxic = 1")
    return L.queue_difference(L.arrival_order(lake.events), gone).select("doc_id", "place")


@query(
    "JON04_cascade_delete", "v0 v1 v6",
    """select 'session' as kind, session_id as id from v0 where mode <> 'OCR_EXTRACT'
union all select 'document', cast(doc_id as varchar) from v1 where session_id is null or session_id not in (select session_id from v0 where mode = 'OCR_EXTRACT')
union all select 'event', cast(event_id as varchar) from v6
  where doc_id not in (select doc_id from v1 where session_id in (select session_id from v0 where mode = 'OCR_EXTRACT'))""",
)
def _(lake):
    gone = lake.sessions.filter("mode = 'OCR_EXTRACT'")
    s, d, left = S.cascade_delete(gone, lake.sessions, lake.docs, {"events": lake.events})
    out = s.select(F.lit("session").alias("kind"), F.col("session_id").alias("id"))
    out = out.unionByName(d.select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("id")))
    return out.unionByName(
        left["events"].select(F.lit("event").alias("kind"), F.col("event_id").cast("string").alias("id"))
    )


# -- status changes ----------------------------------------------------------------------------


@query(
    "UPD01_review_decisions", "v1",
    """select d.doc_id, case when l.doc_id is null then d.status when l.quality = 1 then 'APPROVED' else 'REJECTED' end as status,
  case when l.quality = 0 and l.toxic = 1 then 'toxic' else d.notes end as notes, l.doc_id is not null as verified
from v1 d left join labels l on d.doc_id = l.doc_id""",
)
def _(lake):
    decisions = lake.table("labels").select(
        "doc_id", F.when(F.col("quality") == 1, "APPROVE").otherwise("REJECT").alias("decision"),
        F.when(F.col("toxic") == 1, "toxic").otherwise("").alias("reason"),
    )
    d = O.review_decisions(lake.docs, decisions, F.to_timestamp(F.lit("2024-02-01")))
    return d.select("doc_id", "status", "notes", F.col("verified_at").isNotNull().alias("verified"))


HIT = "doc_id in (select doc_id from labels where quality = 1)"


#: Events as decisions on documents, several for most of them; some decide nothing.
DECISIONS = """select event_id, user_id as doc_id, case event_type when 'click' then 'APPROVE' when 'purchase' then 'APPROVE' when 'view' then 'REJECT'
  when 'signup' then 'REJECT' else 'NOTE' end as decision, case when event_id % 3 = 0 then '' else concat('r', event_id) end as reason from events"""


def _decided(guard: bool) -> str:
    """Decisions folded one by one, in order, over the status of each document."""
    approve = "x.decision = 'APPROVE'" + (" and a.status in ('REVIEW', 'REJECTED')" if guard else "")
    reject = "x.decision = 'REJECT'" + (" and a.status in ('REVIEW', 'APPROVED')" if guard else "")
    step = f"""{{decision: '', reason: '', status: case when {approve} then 'APPROVED' when {reject} then 'REJECTED' else a.status end,
    notes: case when {reject} and x.reason <> '' then x.reason else a.notes end, verified: a.verified or ({approve}) or ({reject})}}"""
    return f"""select d.doc_id, r.status, r.notes, r.verified from (
  select d.doc_id, list_reduce(list_prepend({{decision: '', reason: '', status: d.status, notes: d.notes, verified: false}}, coalesce(e.made, [])), lambda a, x: {step}) as r
  from v1 d left join (
    select doc_id, list({{decision: decision, reason: reason, status: '', notes: '', verified: false}} order by event_id) as made from ({DECISIONS}) t group by doc_id) e
  on e.doc_id = d.doc_id) d"""


def _decide(lake, guard: bool):
    made = lake._sql(DECISIONS, events=lake.table("events"))
    out = O.review_decisions(lake.docs, made, F.to_timestamp(F.lit("2024-02-01")), guard, "event_id")
    return out.select("doc_id", "status", "notes", F.col("verified_at").isNotNull().alias("verified"))


@query("UPD01_several_decisions", "v1", _decided(False))
def _(lake):
    return _decide(lake, False)


@query("UPD01_guarded_decisions", "v1", _decided(True))
def _(lake):
    return _decide(lake, True)


@query(
    "UPD02_reprocess", "v1",
    f"""select doc_id, notes, extracted_row, case when {HIT} then 'QUEUED' else status end as status,
  md5(case when {HIT} then '' else full_text end) as text_md5, case when {HIT} then '' else markdown end as markdown,
  case when {HIT} then '[]' else text_blocks end as text_blocks, case when {HIT} then '' else verified_by end as verified_by,
  case when not {HIT} then processed_epoch end as processed, case when {HIT} then 0.0 else confidence end as confidence,
  case when {HIT} then 0 else page_count end as page_count, case when {HIT} then '{{}}' else extracted_json end as extracted_json
from v1""",
)
def _(lake):
    d = O.reprocess(lake.docs, lake.table("labels").filter("quality = 1"))
    return d.select(
        "doc_id", "notes", "extracted_row", "status", F.md5("full_text").alias("text_md5"), "markdown", "text_blocks", "verified_by",
        F.unix_timestamp("processed_at").alias("processed"), "confidence", "page_count", "extracted_json",
    )


@query(
    "UPD03_patch", "v1",
    """select d.doc_id, case when l.doc_id is not null and l.quality = 1 then concat('q', cast(l.toxic as varchar)) else d.notes end as notes,
  case when l.doc_id is not null and l.quality = 0 then null else d.extraction_type end as extraction_type
from v1 d left join labels l on d.doc_id = l.doc_id""",
)
def _(lake):
    p = lake.table("labels").select(
        "doc_id", F.when(F.col("quality") == 1, F.array(F.lit("notes"))).otherwise(F.array(F.lit("extraction_type"))).alias("set"),
        F.concat(F.lit("q"), F.col("toxic").cast("string")).alias("notes"), F.lit(None).cast("string").alias("extraction_type"),
    )
    return O.patch(lake.docs, p, ["notes", "extraction_type"]).select("doc_id", "notes", "extraction_type")


PATCHES = """select event_id, user_id as doc_id, event_type in ('click', 'view') as sets_notes, event_type in ('view', 'purchase') as sets_type,
  case when event_id % 4 = 0 then null else concat('n', event_id) end as notes, concat('T', event_id % 7) as extraction_type from events"""


@query(
    "UPD03_several_patches", "v1",
    f"""select d.doc_id, case when n.doc_id is null then d.notes else n.v end as notes, case when t.doc_id is null then d.extraction_type else t.v end as extraction_type
from v1 d left join (select doc_id, notes as v from ({PATCHES}) x where sets_notes qualify row_number() over (partition by doc_id order by event_id desc) = 1) n on n.doc_id = d.doc_id
left join (select doc_id, extraction_type as v from ({PATCHES}) x where sets_type qualify row_number() over (partition by doc_id order by event_id desc) = 1) t on t.doc_id = d.doc_id""",
)
def _(lake):
    p = lake._sql(PATCHES, events=lake.table("events"))
    names = F.filter(F.array(F.when(F.col("sets_notes"), F.lit("notes")), F.when(F.col("sets_type"), F.lit("extraction_type"))), lambda x: x.isNotNull())
    patches = p.select("event_id", "doc_id", names.alias("set"), "notes", "extraction_type")
    return O.patch(lake.docs, patches, ["notes", "extraction_type"], "event_id").select("doc_id", "notes", "extraction_type")


@query(
    "UPD04_recover_transient", "v1",
    """select doc_id, status in ('CANCELLING','SCANNING','PROCESSING') as recovered,
  case when status in ('CANCELLING','SCANNING','PROCESSING') then 'QUEUED' else status end as status from v1""",
)
def _(lake):
    return O.recover_transient(lake.docs).select("doc_id", "recovered", "status")


@query(
    "UPD05_cancel", "v1",
    """select doc_id, case when doc_id in (select distinct user_id from events) and status in ('QUEUED','SCANNING','PROCESSING','CANCELLING')
  then 'QUEUED' else status end as status from v1""",
)
def _(lake):
    return O.cancel(lake.docs, lake.events.select("doc_id").distinct()).select("doc_id", "status")


@query(
    "UPD06_apply_results", "v1",
    """select d.doc_id, case when l.doc_id is null then d.status when l.quality = 0 then 'ERROR' else 'REVIEW' end as status,
  case when l.quality = 1 then 99.5 else d.confidence end as confidence, case when l.quality = 1 then 7 else d.page_count end as page_count,
  case when l.quality = 0 then '["bad scan"]' when l.quality = 1 then '[]' else d.warnings end as warnings,
  case when l.quality = 1 then '# new' else d.markdown end as markdown, case when l.quality = 1 then '[{"text":"new"}]' else d.text_blocks end as text_blocks,
  case when l.quality = 1 then '[{"tableId":"n"}]' else d.ocr_tables end as ocr_tables, case when l.quality = 1 then '{"type":"NEW"}' else d.extracted_json end as extracted_json,
  case when l.quality = 1 then 1709164800 else d.processed_epoch end as processed, md5(case when l.quality = 1 then 'new' else d.full_text end) as text_md5
from v1 d left join labels l on d.doc_id = l.doc_id""",
)
def _(lake):
    known = lake.table("labels").unionByName(lake.table("labels").withColumn("doc_id", -F.col("doc_id") - 1))
    results = known.select(
        "doc_id", F.when(F.col("quality") == 0, "bad scan").alias("error"), F.lit("new").alias("full_text"),
        F.lit(99.5).alias("confidence"), F.lit(1.0).alias("processing_time"), F.lit(7).alias("page_count"), F.lit("[]").alias("warnings"),
        F.lit("# new").alias("markdown"), F.lit('[{"text":"new"}]').alias("text_blocks"), F.lit('[{"tableId":"n"}]').alias("ocr_tables"),
        F.lit('{"type":"NEW"}').alias("extracted_json"), F.to_timestamp(F.lit("2024-02-29")).alias("processed_at"),
    )
    return O.apply_results(lake.docs, results).select(
        "doc_id", "status", "confidence", "page_count", "warnings", "markdown", "text_blocks", "ocr_tables", "extracted_json",
        F.unix_timestamp("processed_at").alias("processed"), F.md5("full_text").alias("text_md5"),
    )


RESULTS = """select ts, event_id, user_id as doc_id, case when event_type in ('click', 'signup') then concat('failed ', event_id) end as error, concat('text ', event_id) as full_text,
  cast(event_id % 100 as double) as confidence, case when event_id % 3 = 0 then null else concat('["w', event_id, '"]') end as warnings from events"""


@query(
    "UPD06_several_results", "v1",
    f"""select d.doc_id, case when l.doc_id is null then d.status when l.error is null then 'REVIEW' else 'ERROR' end as status,
  md5(case when g.doc_id is null then d.full_text else g.full_text end) as text_md5, case when g.doc_id is null then d.confidence else g.confidence end as confidence,
  coalesce(w.told, d.warnings) as warnings
from v1 d left join (select * from ({RESULTS}) x qualify row_number() over (partition by doc_id order by event_id desc) = 1) l on l.doc_id = d.doc_id
left join (select * from ({RESULTS}) x where error is null qualify row_number() over (partition by doc_id order by event_id desc) = 1) g on g.doc_id = d.doc_id
left join (select doc_id, case when error is null then warnings else concat('["', error, '"]') end as told from ({RESULTS}) x where error is not null or warnings is not null
  qualify row_number() over (partition by doc_id order by event_id desc) = 1) w on w.doc_id = d.doc_id""",
)
def _(lake):
    results = lake._sql(RESULTS, events=lake.table("events")).drop("ts")
    return O.apply_results(lake.docs, results, "event_id").select("doc_id", "status", F.md5("full_text").alias("text_md5"), "confidence", "warnings")


@query(
    "UPD07_duplicate_session", "v0 v1",
    """select 'session' as kind, session_id as source, concat(name, ' (Copy)') as label, status from v0 where mode = 'TABLE_EXTRACT'
union all select 'document', cast(doc_id as varchar), filename, status from v1
  where session_id in (select session_id from v0 where mode = 'TABLE_EXTRACT')""",
)
def _(lake):
    ids = lake.sessions.filter("mode = 'TABLE_EXTRACT'")
    s, d = S.duplicate(lake.sessions, lake.docs, ids, True, F.lit("2024-02-01"))
    return s.select(F.lit("session").alias("kind"), F.col("source_session_id").alias("source"), F.col("name").alias("label"), "status").unionByName(
        d.select(F.lit("document").alias("kind"), F.col("source_doc_id").cast("string").alias("source"), F.col("filename").alias("label"), "status")
    )


@query(
    "UPD08_session_create_validate", "v0 v1",
    """select session_id, mode, concat_ws('; ', case when mode = 'JSON' then 'unknown mode' end,
  case when first_doc_id % 2 = 1 then 'unknown source type' end,
  case when mode = 'TABLE_EXTRACT' and first_doc_id % 3 = 0 then 'columns required' end,
  case when first_doc_id % 3 = 1 then 'blank column field' end) as errors,
  case when first_doc_id % 5 = 0 then 'docling' else 'pdfplumber' end as engine
from (select session_id, first_doc_id, case when mode = 'JSON_EXTRACT' then 'JSON' else mode end as mode from v0) t""",
)
def _(lake):
    k = F.col("first_doc_id")
    col = "array(named_struct('key', 'a', 'label', '{}', 'question', 'q'))"
    req = lake.sessions.select(
        "session_id", "name", F.when(F.col("mode") == "JSON_EXTRACT", "JSON").otherwise(F.col("mode")).alias("mode"),
        F.when(k % 2 == 1, "WEB").otherwise("FILES").alias("source_type"),
        F.when(k % 5 == 0, "none").otherwise("pdfplumber").alias("extraction_model"),
        F.when(k % 3 == 1, F.expr(col.format(""))).when(k % 3 == 2, F.expr(col.format("A"))).alias("columns"),
    )
    return S.validate(req, O.PDF_ENGINES).select("session_id", "mode", F.array_join("errors", "; ").alias("errors"), "engine")


@query(
    "UPD09_status_actions", "v1",
    """select doc_id, case status when 'QUEUED' then 'play,delete' when 'SCANNING' then 'stop,delete' when 'PROCESSING' then 'stop,delete'
  when 'REVIEW' then 'review,approve,reprocess,export,delete' when 'APPROVED' then 'reprocess,export,delete'
  when 'REJECTED' then 'reprocess,delete' when 'EXPORTED' then 'reprocess,export,delete' when 'ERROR' then 'play,reprocess,delete' end as actions from v1""",
)
def _(lake):
    return lake.docs.select("doc_id", F.array_join(O.status_actions(F.col("status")), ",").alias("actions"))


# -- type detection and routing ----------------------------------------------------------------

# Pages of two lines; the first three decide.
DENSITY_SQL = """select doc_id, case when sum(length(t)) + greatest(count(*) filter (where t <> '') - 1, 0) >= 120
  or sum(len(regexp_extract_all(t, '\\S+'))) >= 20 then 'PDF_TEXT' else 'PDF_IMAGE' end as density
from (select doc_id, page, case when page <= 3 then trim(string_agg(line, chr(10) order by i), ' ' || chr(10)) else '' end as t
  from (select doc_id, i, (i - 1) // 2 + 1 as page, lines[i] as line from (select doc_id, string_split(text, chr(10)) as lines from documents) s,
    unnest(range(1, len(lines) + 1)) as u(i)) p group by doc_id, page) q group by doc_id"""


def _densities(lake):
    lines = F.split("text", "\n")
    pages = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 2).cast("int")), lambda p: F.array_join(F.slice(lines, p * 2 + 1, F.lit(2)), "\n")
    )
    split = lake.texts.select("doc_id", F.posexplode(pages).alias("at", "text"))
    return O.text_density(split.withColumn("page", F.col("at") + 1), sample_pages=3)


@query("MTH05_text_density_class", "", DENSITY_SQL)
def _(lake):
    return _densities(lake)


DETECT_SQL = f"""select d.doc_id, d.session_id, case when d.filename like '%.xlsx' then 'EXCEL' when d.filename not like '%.pdf' then 'IMAGE' else p.density end as detected_type
from v1 d join ({DENSITY_SQL}) p on d.doc_id = p.doc_id"""


@query("MTH06_detect_type", "v1", f"select doc_id, detected_type from ({DETECT_SQL}) t")
def _(lake):
    return O.detect_type(lake.docs, _densities(lake)).select("doc_id", "detected_type")


@query(
    "MTH07_route_extractor", "v0 v1",
    f"""select t.doc_id, coalesce(s.mode, 'OCR_EXTRACT') as mode, t.detected_type,
  case when s.mode = 'TABLE_EXTRACT' and t.detected_type = 'PDF_TEXT' then 'pdfplumber'
    when s.mode = 'TABLE_EXTRACT' and t.detected_type in ('PDF_IMAGE', 'IMAGE') then 'docling'
    when (s.mode is null or s.mode <> 'TABLE_EXTRACT') and t.detected_type in ('PDF_TEXT', 'PDF_IMAGE') then
      case when s.mode = 'PDF_EXTRACT' then 'pdfplumber' else 'pymupdf' end
    else 'rapidocr' end as engine,
  case when s.mode = 'TABLE_EXTRACT' and t.detected_type in ('PDF_IMAGE', 'IMAGE') then 'rapidocr' end as fallback
from ({DETECT_SQL}) t left join v0 s on t.session_id = s.session_id""",
)
def _(lake):
    d = S.documents_with_session(O.detect_type(lake.docs, _densities(lake)), lake.sessions)
    return O.route_extractor(d, "pymupdf").select("doc_id", "mode", "detected_type", "engine", "fallback")


# -- display columns ---------------------------------------------------------------------------


@query(
    "STR08_safe_filename", "v0",
    """select session_id, concat('a_b_', replace(name, ' ', '_'), '_x_') as safe from v0""",
)
def _(lake):
    raw = F.concat(F.lit("  a/b: "), F.col("name"), F.lit(' "x"|'))
    return lake.sessions.select("session_id", X.safe_filename(raw).alias("safe"))


@query(
    "STR09_compact_filename", "v1",
    "select doc_id, case when length(filename) <= 12 then filename else concat(filename, '.copy') end as f, case when length(f) <= 16 then f else concat(substr(f, 1, 5), '...', right(f, 8)) end as short from v1",
)
def _(lake):
    f = F.when(F.length("filename") <= 12, F.col("filename")).otherwise(F.concat("filename", F.lit(".copy")))
    return lake.docs.select("doc_id", f.alias("f"), X.compact_filename(f).alias("short"))


@query(
    "STR11_code_labels", "v1",
    """select doc_id, concat(upper(substr(status, 1, 1)), lower(substr(status, 2))) as status_label,
  case extraction_type when 'AUTO' then 'Auto' when 'IMAGE' then 'Image' when 'PDF_TEXT' then 'PDF (Text)' when 'PDF_IMAGE' then 'PDF (Scanned)' else 'Excel' end as type_label,
  notes as unknown_label from v1""",
)
def _(lake):
    return lake.docs.select(
        "doc_id", X.status_label(F.col("status")).alias("status_label"), X.type_label(F.col("extraction_type")).alias("type_label"),
        X.status_label(F.col("notes")).alias("unknown_label"),
    )


@query(
    "DTM05_duration_text", "v1",
    """select doc_id, case when processing_time = 0 then '—' else printf('%.1fs', processing_time) end as short,
  case when processing_time = 0 then '—' when processing_time < 60 then printf('%.1fs', processing_time)
    else printf('%dm %ds', cast(floor(processing_time / 60) as bigint), cast(floor(processing_time % 60 + 0.5) as bigint)) end as readable from v1""",
)
def _(lake):
    t = F.col("processing_time")
    return lake.docs.select("doc_id", N.short_duration(t).alias("short"), N.readable_duration(t).alias("readable"))


@query(
    "DTM06_confidence_text", "v1",
    "select doc_id, case when confidence = 0 then '—' else printf('%.1f%%', confidence) end as shown from v1",
)
def _(lake):
    return lake.docs.select("doc_id", N.confidence_text(F.col("confidence")).alias("shown"))


@query(
    "MTH02_chunk_page_ranges", "v1",
    """select doc_id, k + 1 as chunk, k * 25 + 1 as page_start, case when doc_id % 10 <> 0 then k * 25 + 25 end as page_end
from (select doc_id, n, unnest(range(0, (n - 1) // 25 + 1)) as k
  from (select doc_id, case when doc_id % 10 = 0 then 1 else n_chars // 40 + 1 end as n from v1) a) b""",
)
def _(lake):
    pages = F.when(F.col("doc_id") % 10 == 0, 0).otherwise(F.floor(F.col("n_chars") / 40) + 1)
    d = lake.docs.select("doc_id", F.explode(D.page_ranges(pages)).alias("r"))
    return d.select("doc_id", *[F.col(f"r.{c}").cast("long").alias(c) for c in ("chunk", "page_start", "page_end")])


@query(
    "JSN05_warnings_append", "v1",
    """select doc_id, case when doc_id % 6 = 1 then '["slow","TABLE_EXTRACT failed: x"]' else '["TABLE_EXTRACT failed: x"]' end as warnings from v1""",
)
def _(lake):
    return lake.docs.select("doc_id", J.append_warning(F.col("warnings"), F.lit("TABLE_EXTRACT failed: x")).alias("warnings"))


# -- log and queue events ----------------------------------------------------------------------


@query(
    "WIN08_log_tail_500", "v6",
    "select doc_id, event_id, newest from (select doc_id, event_id, row_number() over (partition by doc_id order by ts desc, event_id desc) as newest from v6) t where newest <= 500",
)
def _(lake):
    return L.log_tail(lake.events).select("doc_id", "event_id", "newest")


@query(
    "STR15_log_line_clean", "v6",
    "select event_id, substr(line, 12) as shown from v6 where event_id % 10 <> 0",
)
def _(lake):
    blank = F.when(F.col("event_id") % 10 == 0, "\x1b[0m \t").otherwise(F.concat(F.lit(" \x1b[32m"), F.col("line"), F.lit("\x1b[0m\t")))
    d = lake.events.select("event_id", X.log_line(blank).alias("shown"))
    return d.filter(F.col("shown").isNotNull())


@query(
    "STR16_log_line_metrics", "v6",
    """select event_id, case when event_id % 2 = 0 then event_id % 101 else cast(floor((event_id % 50) * 100.0 / 64 + 0.5) as bigint) end as percent,
  case when event_id % 50 > 0 then cast((event_id % 50) * 1024 as double) end as downloaded_mb, cast(65536 as double) as total_mb, cast((event_id % 9) + 0.5 as double) as speed_mbps,
  concat(cast(event_id % 60 as varchar), 's') as eta from v6""",
)
def _(lake):
    k = F.col("event_id")
    line = F.concat(
        F.when(k % 2 == 0, F.concat((k % 101).cast("string"), F.lit("% "))).otherwise(""),
        (k % 50).cast("string"), F.lit(" gb/64 GB "), (k % 9).cast("string"), F.lit(".5 MB/s "), (k % 60).cast("string"), F.lit("s"),
    )
    d = lake.events.select("event_id", *[c.alias(n) for n, c in X.log_metrics(line).items()])
    return d.withColumn("percent", F.col("percent").cast("long"))


@query(
    "STR17_format_bytes", "",
    """select event_id, case when v = 0 then 'Unknown' when v < 1024 then concat(cast(cast(floor(v + 0.5) as bigint) as varchar), ' B')
  when v < 1048576 then concat(case when v / 1024 >= 10 then cast(cast(floor(v / 1024 + 0.5) as bigint) as varchar) else printf('%.1f', v / 1024 + 1e-9) end, ' KB')
  else concat(case when v / 1048576 >= 10 then cast(cast(floor(v / 1048576 + 0.5) as bigint) as varchar) else printf('%.1f', v / 1048576 + 1e-9) end, ' MB') end as shown
from (select event_id, case when event_id % 50 = 0 then 0 else floor(value * 1000) * 10 end as v from events) t""",
)
def _(lake):
    v = F.when(F.col("event_id") % 50 == 0, 0).otherwise(F.floor(F.col("value") * 1000) * 10).cast("double")
    return lake.events.select("event_id", N.format_bytes(v).alias("shown"))


@query(
    "STM04_idle_gaps", "v6",
    """select doc_id, after_event, event_id, round(idle, 3) as idle_s from (select doc_id, event_id, lag(event_id) over w as after_event, epoch(ts) - lag(epoch(ts)) over w as idle
  from v6 window w as (partition by doc_id order by event_id)) t where idle > 3600""",
)
def _(lake):
    return _rounded3(L.idle_gaps(lake.events, 3600.0))


def _rounded3(df):
    return df.withColumn("idle_s", F.round("idle_s", 3))


# -- saved views over rate rows ----------------------------------------------------------------

RATE_COLS = ["destination_city", "destination_via_city", "commodity", "cur", "direct_call", "rate20", "rate40"]
KEYS = ["l_orderkey", "row_no"]
QUICK = {"cur": "cur", "origin": "commodity", "via": "destination_via_city", "direct": "direct_call", "destination": "destination_city"}
OUT = "l_orderkey, row_no"
NUM20 = "case when trim(rate20) = '' then 0.0 else try_cast(rate20 as double) end"


@query(
    "FLT06_row_global_search", "v2r",
    f"select {OUT} from v2r where " + " or ".join(f"contains(lower({c}), 'ring')" for c in RATE_COLS),
)
def _(lake):
    return lake.rates.filter(V.search_filter("  RING ", RATE_COLS)).select(*KEYS)


@query(
    "FLT06_search_by_grams", "v1",
    "select doc_id, filename from v1 where contains(lower(filename), 'c1_10') or contains(lower(full_text), 'c1_10')",
)
def _(lake):
    texts = lake.docs.select("doc_id", "filename", "full_text")
    return TextIndex(texts, ["filename", "full_text"], [F.col("doc_id")]).search("  C1_10 ").select("doc_id", "filename")


CLAUSES = [
    {"field": "rate20", "op": "between", "value": "30", "valueTo": "10", "enabled": True},
    {"field": "destination_city", "op": "in", "value": "nation_1, NATION_2 ,,", "enabled": True},
    {"field": "rate40", "op": "gt", "value": "60000", "enabled": True},
    {"field": "commodity", "op": "startsWith", "value": "RED", "enabled": True},
    {"field": "cur", "op": "equals", "value": "x", "enabled": False},
]
CLAUSE_SQL = f"""({NUM20}) between 10 and 30 or lower(destination_city) in ('nation_1', 'nation_2')
  or try_cast(rate40 as double) > 60000 or starts_with(lower(commodity), 'red')"""


@query("FLT07_clause_filter", "v2r", f"select {OUT} from v2r where {CLAUSE_SQL}")
def _(lake):
    return lake.rates.filter(V.clause_filter(CLAUSES, "OR")).select(*KEYS)


@query(
    "FLT08_header_filter", "v2r",
    f"select {OUT} from v2r where contains(lower(commodity), 'e') and ({NUM20}) < 25 and direct_call = 'Y'",
)
def _(lake):
    spec = {
        "commodity": {"op": "contains", "value": "E"}, "rate20": {"op": "lt", "value": "25"},
        "direct_call": {"op": "equals", "value": "y"}, "cur": {"op": "equals", "value": "  "},
    }
    return lake.rates.filter(V.header_filter(spec)).select(*KEYS)


@query(
    "FLT09_quick_filters", "v2r",
    f"select {OUT} from v2r where cur = 'USD' and destination_via_city <> '' and direct_call = 'Y' and commodity <> '' and destination_city <> ''",
)
def _(lake):
    flags = dict.fromkeys(["usdOnly", "hasOrigin", "hasViaCity", "directCallOnly", "hasDestination"], True)
    return lake.rates.filter(V.quick_filter(flags, QUICK)).select(*KEYS)


VIEW = json.dumps(
    {
        "name": "usd", "searchText": "nation", "quickFilters": {"usdOnly": True}, "logic": "AND",
        "clauses": [{"field": "rate20", "op": "gt", "value": "5", "enabled": True}],
        "headerFilters": {"commodity": {"op": "contains", "value": "a"}}, "sortKey": "rate40", "sortDir": "desc",
    }
)


@query(
    "FLT10_saved_view", "v2r",
    f"""select {OUT}, row_number() over (order by cast(rate40 as double) desc, l_orderkey, row_no) as pos from v2r
where cur = 'USD' and ({" or ".join(f"contains(lower({c}), 'nation')" for c in RATE_COLS)}) and ({NUM20}) > 5 and contains(lower(commodity), 'a')""",
)
def _(lake):
    return V.apply_view(lake.rates, VIEW, RATE_COLS, QUICK, KEYS).select(*KEYS, "pos")


@query(
    "FLT11_derive_columns", "v2r",
    """select key, label, row_number() over (order by o, r, p) as ord from (select key, label, min(l_orderkey) as o, arg_min(row_no, (l_orderkey, row_no)) as r, min(p) as p
  from v2r, (values ('destinationCity', 'Destination', 0), ('commodity', 'Commodity', 1), ('rateTwentyFoot', 'rate Twenty Foot', 2), ('cntry_2', 'Via Cntry', 3)) as k(key, label, p)
  where (p <> 2 or rate20 <> '') and (p <> 3 or direct_call = 'Y') group by key, label) t""",
)
def _(lake):
    pairs = F.array(
        F.struct(F.lit("carrier").alias("k"), F.lit("x").alias("v")), F.struct(F.lit("destinationCity").alias("k"), F.col("destination_city").alias("v")),
        F.struct(F.lit("commodity").alias("k"), F.col("commodity").alias("v")),
        F.when(F.col("rate20") != "", F.struct(F.lit("rateTwentyFoot").alias("k"), F.col("rate20").alias("v"))),
        F.when(F.col("direct_call") == "Y", F.struct(F.lit("cntry_2").alias("k"), F.lit("US").alias("v"))),
    )
    rows = lake.rates.select(*KEYS, F.map_from_entries(F.filter(pairs, lambda p: p.isNotNull())).alias("fields"))
    return V.derive_columns(rows, "fields", KEYS)


@query("FLT12_project_visible", "v2r", "select l_orderkey, row_no, commodity, rate40 from v2r")
def _(lake):
    return V.visible(lake.rates, dict.fromkeys(["destination_city", "destination_via_city", "cur", "direct_call", "rate20"], False))


@query(
    "SRT02_mixed_sort", "v2r",
    f"""select {OUT}, row_number() over (order by ({NUM20}) is null, ({NUM20}), case when ({NUM20}) is null then lower(rate20) end, l_orderkey, row_no) as pos from v2r""",
)
def _(lake):
    return V.mixed_sort(lake.rates.select(*KEYS, "rate20"), "rate20", KEYS).select(*KEYS, "pos")
