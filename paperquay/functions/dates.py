"""Date columns: contract dates in many spellings, date ranges, display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperquay.functions.text import clean_text, let, lookup

# English month names.
MONTHS = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]
_MONTH_NO = {m: f"{i:02d}" for i, m in enumerate(MONTHS, 1)} | {m[:3]: f"{i:02d}" for i, m in enumerate(MONTHS, 1)}

_D = r"(3[01]|[12][0-9]|0[1-9]|[1-9])"
_M = r"(1[0-2]|0[1-9]|[1-9])"
_Y = r"([0-9]{4})"

DATE_WORD = r"\d{4}-\d{2}-\d{2}|\d{8}|\d{1,2}\s+[A-Za-z]{3,9},?\s+\d{4}"
DATE_TOKEN = rf"(\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|{DATE_WORD})"
VALID_RANGE = rf"(?i)valid\s*(?:from)?\s*({DATE_WORD})\s*(?:to|through|thru)\s*({DATE_WORD})"


def _numeric(v: Column, pattern: str, year: int, month: int, day: int) -> Column:
    def group(i: int) -> Column:
        return F.regexp_extract(v, pattern, i).try_cast("int")

    ts = F.try_make_timestamp(group(year), group(month), group(day), F.lit(0), F.lit(0), F.lit(0))
    return F.when(v.rlike(pattern), F.date_format(ts, "yyyy-MM-dd"))


def _named(v: Column, pattern: str) -> Column:
    month = lookup(_MONTH_NO, F.lower(F.regexp_extract(v, pattern, 2)))
    ts = F.try_make_timestamp(
        F.regexp_extract(v, pattern, 3).try_cast("int"), month.try_cast("int"),
        F.regexp_extract(v, pattern, 1).try_cast("int"), F.lit(0), F.lit(0), F.lit(0),
    )
    return F.when(v.rlike(pattern), F.date_format(ts, "yyyy-MM-dd"))


def to_iso_date(c: Column) -> Column:
    """ISO date of ten accepted spellings, day before month where both fit; else unchanged."""
    return let(clean_text(c), _iso)


def _iso(v: Column) -> Column:
    return F.coalesce(
        _numeric(v, f"^{_D}/{_M}/{_Y}$", 3, 2, 1),
        _numeric(v, f"^{_D}-{_M}-{_Y}$", 3, 2, 1),
        _numeric(v, f"^{_M}/{_D}/{_Y}$", 3, 1, 2),
        _numeric(v, f"^{_M}-{_D}-{_Y}$", 3, 1, 2),
        _numeric(v, f"^{_Y}-{_M}-{_D}$", 1, 2, 3),
        _numeric(v, f"^{_Y}{_M}{_D}$", 1, 2, 3),
        _named(v, f"^{_D} ([A-Za-z]+),? {_Y}$"),
        v,
    )


def date_pairs(text: Column) -> Column:
    """Ordered distinct array of struct(start, end) of the validity ranges in ``text``."""
    starts = F.regexp_extract_all(text, F.lit(VALID_RANGE), F.lit(1))
    ends = F.regexp_extract_all(text, F.lit(VALID_RANGE), F.lit(2))
    pairs = F.zip_with(
        starts, ends, lambda a, b: F.struct(to_iso_date(a).alias("start"), to_iso_date(b).alias("end"))
    )
    # Most texts state none, which one search tells.
    none = F.array().cast("array<struct<start:string,end:string>>")
    return F.when(~F.lower(text).contains("valid"), none).otherwise(F.array_distinct(pairs))


def date_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(DATE_TOKEN), F.lit(1))


def short_datetime(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "dd/MM/yy HH:mm"), F.lit("—"))


def long_date(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "MMM d, yyyy, hh:mm a"), F.lit("—"))


def page_ranges(pages: Column, size: int = 25, unknown_limit: int | None = None) -> Column:
    """Array of struct(chunk, page_start, page_end) covering pages 1..n.

    An unknown n covers 1..``unknown_limit``; without such a limit it gives one range that begins at
    page 1 and has no end.
    """
    known = F.coalesce(pages, F.lit(0)) > 0
    if unknown_limit is None:
        # The last field is null where the end is open.
        open_range = F.array(F.struct(F.lit(1).alias("chunk"), F.lit(1).alias("page_start"), F.lit(None).cast("int").alias("page_end")))
        return F.when(known, page_ranges(F.when(known, pages), size, 1)).otherwise(open_range)
    last = F.when(known, pages).otherwise(F.lit(unknown_limit)).cast("int")
    chunks = F.sequence(F.lit(0), F.floor((last - 1) / size).cast("int"))
    return F.transform(
        chunks,
        lambda k: F.struct(
            (k + 1).alias("chunk"), (k * size + 1).alias("page_start"), (k * size + size).alias("page_end")
        ),
    )
