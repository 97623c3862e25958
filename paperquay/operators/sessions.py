"""Sessions: counts, status sync, search, names, duplication, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperquay.operators.documents import FINISHED, PROCESSED
from paperquay.operators.ordered import block, ranked, running_sums
from paperquay.session import cut_lineage

# Allowed codes.
MODES = ["OCR_EXTRACT", "TABLE_EXTRACT", "PDF_EXTRACT", "JSON_EXTRACT"]
SOURCES = ["FILES", "FOLDER"]


def with_counts(sessions: DataFrame, docs: DataFrame) -> DataFrame:
    """Sessions, newest first, with the number of all and of processed documents (0 when none).

    Sessions of one time go by id; without ``created_at`` all do.
    """
    counts = docs.filter(F.col("session_id").isNotNull()).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("document_count"),
        F.count_if(F.col("status").isin(PROCESSED)).alias("processed_count"),
    )
    out = sessions.join(counts, "session_id", "left").fillna(0, ["document_count", "processed_count"])
    return out.orderBy(*([F.col("created_at").desc()] if "created_at" in sessions.columns else []), "session_id")


def documents_with_session(docs: DataFrame, sessions: DataFrame) -> DataFrame:
    """Documents with mode and engine of their session; without one the mode is OCR_EXTRACT."""
    s = sessions.select("session_id", "mode", "extraction_model")
    return docs.join(s, "session_id", "left").withColumn("mode", F.coalesce("mode", F.lit("OCR_EXTRACT")))


def cascade_delete(
    ids: DataFrame, sessions: DataFrame, docs: DataFrame, children: dict[str, DataFrame]
) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """What is left of sessions, their documents, and tables keyed by doc_id."""
    gone = ids.select("session_id")
    gone_docs = docs.join(gone, "session_id", "left_semi").select("doc_id")
    return (
        sessions.join(gone, "session_id", "left_anti"),
        docs.join(gone, "session_id", "left_anti"),
        {name: t.join(gone_docs, "doc_id", "left_anti") for name, t in children.items()},
    )


def sync_status(sessions: DataFrame, docs: DataFrame) -> DataFrame:
    """DONE when every document is finished, else PROCESSING; empty sessions keep their status."""
    verdict = docs.filter(F.col("session_id").isNotNull()).groupBy("session_id").agg(
        F.when(F.bool_and(F.col("status").isin(FINISHED)), "DONE").otherwise("PROCESSING").alias("__new")
    )
    return (
        sessions.join(verdict, "session_id", "left")
        .withColumn("status", F.coalesce("__new", "status"))
        .drop("__new")
    )


def search(
    sessions: DataFrame, text: str = "", status: str | None = None, mode: str | None = None
) -> DataFrame:
    out = sessions
    if text.strip():
        out = out.filter(F.lower("name").contains(text.lower()))
    if status not in (None, "", "all"):
        out = out.filter(F.col("status") == status)
    if mode:
        out = out.filter(F.col("mode") == mode)
    return out


def disambiguate(names: DataFrame, taken: DataFrame, wanted: str = "wanted", order: str = "ord") -> DataFrame:
    """A free ``name`` for every wanted one, in ``order``: "x", "x (1)", "x (2)"; blank gives "Unnamed", "Unnamed 2".

    ``taken`` has a column ``name``; ``order`` is unique. Two bases can ask for the same text if one
    is spelled with a suffix itself: the first in order gets it, and the others choose again with
    all names given so far taken, until no two are the same.
    """
    held, done, left = taken.select("name"), None, names
    while True:
        tried = cut_lineage(_suggested(left, held, wanted, order))
        firsts = tried.groupBy("name").agg(F.min(order).alias("__first"), F.count(F.lit(1)).alias("__c")).filter("__c > 1")
        again = cut_lineage(tried.join(firsts, "name").filter(F.col(order) > F.col("__first")).select(*names.columns, "name"))
        if again.isEmpty():
            return tried if done is None else done.unionByName(tried)
        settled = tried.join(again.select(order), order, "left_anti").select(*names.columns, "name")
        done = settled if done is None else done.unionByName(settled)
        held, left = taken.select("name").unionByName(done.select("name")), again.select(*names.columns)


def _suggested(names: DataFrame, taken: DataFrame, wanted: str, order: str) -> DataFrame:
    """Names that are free in ``taken``, and different for rows of one base.

    The n-th newcomer of a base takes the n-th suffix that is not taken. The free suffix is found
    from the taken suffixes of that base, ranked: the one ranked r at suffix k leaves k - r free
    suffixes before it.
    """
    base = F.trim(F.col(wanted))
    new = names.withColumn("__base", F.when(base == "", "Unnamed").otherwise(base)).withColumn("__blank", base == "")
    new = ranked(new, ["__base", "__blank"], [order], [block(order)], "__n")
    # A taken name blocks suffix 0 of itself, and suffix k of what stands before " (k)" or " k".
    t = taken.select(F.col("name").alias("__t")).distinct()
    as_self = t.select(F.col("__t").alias("__base"), F.lit(0).cast("long").alias("__k"), F.lit(None).cast("boolean").alias("__blank"))
    paren = r"^(.*) \(([1-9][0-9]{0,17})\)$"
    with_paren = t.filter(F.col("__t").rlike(paren)).select(
        F.regexp_extract("__t", paren, 1).alias("__base"), F.regexp_extract("__t", paren, 2).cast("long").alias("__k"),
        F.lit(False).alias("__blank"),
    )
    plain = r"^(Unnamed) ([1-9][0-9]{0,17})$"
    unnamed = t.filter(F.col("__t").rlike(plain)).select(
        F.lit("Unnamed").alias("__base"), (F.regexp_extract("__t", plain, 2).cast("long") - 1).alias("__k"),
        F.lit(True).alias("__blank"),
    ).filter(F.col("__k") >= 1)
    both = as_self.filter(F.col("__blank").isNull()).withColumn("__blank", F.explode(F.array(F.lit(True), F.lit(False))))
    used = both.unionByName(with_paren).unionByName(unnamed).distinct()
    used = used.join(new.select("__base", "__blank").distinct(), ["__base", "__blank"], "left_semi")
    used = ranked(used, ["__base", "__blank"], ["__k"], [block("__k")], "__r")
    # Free suffixes up to (not including) taken suffix k of rank r (1-based): k - r + 1.
    used = used.withColumn("__free", F.col("__k") - F.col("__r") + 1)
    # Newcomer n (1-based) skips every taken suffix that has fewer than n free ones before it:
    # a running sum over newcomers and skips in one order, a newcomer first at equal position.
    skips = used.groupBy("__base", "__blank", F.col("__free").alias("__at")).agg(F.count(F.lit(1)).alias("__c"))
    line = new.withColumns({"__at": F.col("__n"), "__c": F.lit(0).cast("long"), "__kind": F.lit(0)}).unionByName(
        skips.withColumn("__kind", F.lit(1)), allowMissingColumns=True
    )
    line = running_sums(
        line, ["__base", "__blank"], ["__at", "__kind"], {"__skipped": F.col("__c")}, [block("__at")]
    ).filter(F.col("__kind") == 0)
    suffix = F.col("__n") - 1 + F.col("__skipped")
    shown = (
        F.when(suffix == 0, F.col("__base"))
        .when(F.col("__blank"), F.concat(F.col("__base"), F.lit(" "), (suffix + 1).cast("string")))
        .otherwise(F.concat(F.col("__base"), F.lit(" ("), suffix.cast("string"), F.lit(")")))
    )
    return line.withColumn("name", shown).select(*names.columns, "name")


def duplicate(
    sessions: DataFrame, docs: DataFrame, ids: DataFrame, full: bool, now: Column, name: str = ""
) -> tuple[DataFrame, DataFrame]:
    """Copies of the given sessions and, if ``full``, of their documents, with new derived ids."""
    def copied(key: str) -> Column:
        return F.sha2(F.concat_ws("|", F.col(key).cast("string"), now.cast("string")), 256)

    src = sessions.join(ids.select("session_id"), "session_id", "left_semi")
    title = F.lit(name.strip()) if name.strip() else F.concat("name", F.lit(" (Copy)"))
    new_sessions = src.withColumn("source_session_id", F.col("session_id")).withColumns(
        {
            "session_id": copied("session_id"),
            "name": title,
            "status": F.col("status") if full else F.lit("PENDING"),
        }
    )
    picked = docs.join(ids.select("session_id"), "session_id", "left_semi") if full else docs.limit(0)
    new_docs = picked.withColumn("source_doc_id", F.col("doc_id")).withColumns(
        {"doc_id": copied("doc_id"), "session_id": copied("session_id")}
    )
    return new_sessions, new_docs


def validate(requests: DataFrame, engines: list[str]) -> DataFrame:
    """Session requests with ``errors`` (empty = valid) and the engine that would be used.

    ``requests``: name, mode, source_type, extraction_model, columns array<struct<key,label,question>>.
    """
    blank = F.exists("columns", lambda c: (c["key"] == "") | (c["label"] == "") | (c["question"] == ""))
    found = F.array(
        F.when(F.coalesce("name", F.lit("")) == "", "name is empty"),
        F.when(~F.col("mode").isin(MODES), "unknown mode"),
        F.when(~F.col("source_type").isin(SOURCES), "unknown source type"),
        F.when((F.col("mode") == "TABLE_EXTRACT") & (F.coalesce(F.size("columns"), F.lit(0)) <= 0), "columns required"),
        F.when(F.coalesce(blank, F.lit(False)), "blank column field"),
    )
    return requests.withColumn("errors", F.filter(found, lambda e: e.isNotNull())).withColumn(
        "engine", F.when(F.col("extraction_model").isin(engines), F.col("extraction_model")).otherwise("docling")
    )
