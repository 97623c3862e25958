"""Numeric columns: lenient parsing, display formats, answer-span arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperquay.functions.text import let, strip

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def js_number(c: Column) -> Column:
    """Finite number written in ``c``; blank is 0, anything else that is no number is null."""
    return let(strip(F.coalesce(c, F.lit(""))), parse_number)


def parse_number(t: Column) -> Column:
    """``js_number`` of a text that is already stripped and not null."""

    def finite(n: Column) -> Column:
        return F.when(F.abs(n) < float("inf"), n)

    digits = F.regexp_replace(t, "^0[xXoObB]0*(?=.)", "")

    def based(pattern: str, base: int, most: int) -> Column:
        # ``most`` digits fit into 64 bits; a longer number is not read rather than read wrongly.
        fits = digits.rlike(pattern) & (F.length(digits) <= most) & ~t.rlike("^..$")
        return F.when(fits, F.conv(digits, base, 10).try_cast("double"))

    return (
        F.when(t == "", F.lit(0.0))
        .when(t.rlike(NUMBER), let(t.try_cast("double"), finite))
        .when(t.rlike("^0[xX]"), based("^[0-9a-fA-F]+$", 16, 16))
        .when(t.rlike("^0[oO]"), based("^[0-7]+$", 8, 21))
        .when(t.rlike("^0[bB]"), based("^[01]+$", 2, 64))
    )


def _scaled(x: Column, factor: int) -> tuple[Column, Column]:
    """(p, e) with p + e equal to ``x * factor`` exactly: the product and its rounding error.

    Each factor is split in a high and a low half, whose products are exact.
    """
    split = float((1 << 27) + 1)
    c = x * split
    hi = c - (c - x)
    lo = x - hi
    p = x * float(factor)
    return p, (hi * float(factor) - p) + lo * float(factor)


def exact_round(x: Column, digits: int, half_up: bool) -> Column:
    """Integer nearest to the exact binary value of ``x * 10**digits``, for x >= 0.

    A true half goes up, or to the even neighbour.
    """
    p, e = _scaled(x, 10**digits)
    low = F.floor(p)
    rest = p - low
    tie_up = F.lit(True) if half_up else (low % 2 == 1)
    up = (rest > 0.5) | ((rest == 0.5) & ((e > 0) | ((e == 0) & tie_up)))
    return (low + F.when(up, 1).otherwise(0)).cast("long")


def fixed1(x: Column) -> Column:
    """One-decimal text of the exact binary value of ``x``; an exact half goes away from zero."""

    def text(tenths: Column) -> Column:
        return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))

    return F.concat(F.when(x < 0, "-").otherwise(""), let(exact_round(F.abs(x), 1, half_up=True), text))


def round_even(x: Column, digits: int) -> Column:
    """Round by the exact binary value, an exact half to the even neighbour."""
    n = exact_round(F.abs(x), digits, half_up=False) / float(10**digits)
    return F.when(x < 0, -n).otherwise(n)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def confidence_text(x: Column) -> Column:
    return F.when(F.coalesce(x, F.lit(0.0)) == 0, "—").otherwise(F.concat(fixed1(x), F.lit("%")))


def short_duration(x: Column) -> Column:
    return F.when(F.coalesce(x, F.lit(0.0)) == 0, "—").otherwise(F.concat(fixed1(x), F.lit("s")))


def readable_duration(x: Column) -> Column:
    minutes = F.concat(
        F.floor(x / 60).cast("string"), F.lit("m "), half_up(x % 60).cast("string"), F.lit("s")
    )
    return F.when(F.coalesce(x, F.lit(0.0)) < 60, short_duration(x)).otherwise(minutes)


def format_bytes(x: Column) -> Column:
    """``x`` bytes in the largest fitting unit of B..TB (steps of 1024)."""
    units = F.array(*[F.lit(u) for u in ["B", "KB", "MB", "GB", "TB"]])
    steps = sum((F.when(x >= float(1024**i), 1).otherwise(0) for i in range(1, 5)), F.lit(0))

    def shown(r: Column) -> Column:
        v, step = r["v"], r["step"]
        number = F.when((v >= 10) | (step == 0), half_up(v).cast("string")).otherwise(fixed1(v))
        return F.concat(number, F.lit(" "), F.get(units, step))

    scaled = F.struct((x / F.pow(F.lit(1024.0), steps)).alias("v"), steps.alias("step"))
    return F.when(F.coalesce(x, F.lit(0.0)) <= 0, "Unknown").otherwise(let(scaled, shown))


def percent_of(part: Column, whole: Column) -> Column:
    """Whole percent, 0 for an empty whole."""
    return F.when(whole > 0, half_up(part / whole * 100)).otherwise(F.lit(0).cast("long"))


def best_span(start: Column, end: Column, max_span: int = 24) -> Column:
    """Most likely span of start/end logits: struct(start_idx, end_idx, score)."""

    def total(xs: Column) -> Column:
        peak = F.array_max(xs)
        return F.aggregate(xs, F.lit(0.0).cast("double"), lambda acc, x: acc + F.exp(x - peak))

    s = F.transform(start, lambda x: x.cast("double"))
    e = F.transform(end, lambda x: x.cast("double"))
    s_at = F.array_position(s, F.array_max(s)) - 1
    e_at = F.greatest(F.array_position(e, F.array_max(e)) - 1, s_at)
    e_at = F.least(e_at, s_at + max_span)
    e_val = F.try_element_at(e, (e_at + 1).cast("int"))
    score = (F.lit(1.0) / total(s)) * (F.exp(e_val - F.array_max(e)) / total(e))
    return F.struct(s_at.alias("start_idx"), e_at.alias("end_idx"), score.alias("score"))
