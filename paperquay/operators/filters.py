"""Row filters and saved views: a JSON-like spec is compiled to one Column, so Catalyst can push it."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperquay.functions.numbers import NUMBER, js_number
from paperquay.functions.text import HEADER_KEYS, strip
from paperquay.operators.ordered import global_rank


def cell(name: str) -> Column:
    return strip(F.coalesce(F.col(name).cast("string"), F.lit("")))


def _finite(text: str | None) -> float | None:
    """``js_number`` of a filter value, on the driver: blank is 0, no number is None."""
    t = (text or "").strip()
    if not t:
        return 0.0
    if re.match(NUMBER, t):
        return float(t) if math.isfinite(float(t)) else None
    m = re.match(r"^0([xXoObB])([0-9a-fA-F]+)$", t)
    try:
        return float(int(m.group(2), {"x": 16, "o": 8, "b": 2}[m.group(1).lower()])) if m else None
    except ValueError:
        return None


def _op(name: str, op: str, value: str, value_to: str | None) -> Column:
    """One test of a cell. Filter values are parsed here, once, so the plan holds plain literals."""
    text, want = F.lower(cell(name)), (value or "").lower()
    if op == "contains":
        return text.contains(want)
    if op == "equals":
        return text == want
    if op == "startsWith":
        return text.startswith(want)
    if op in ("gt", "lt", "between"):
        a, b = _finite(value), _finite(value_to)
        if a is None or (op == "between" and b is None):
            return F.lit(False)
        num = js_number(F.col(name).cast("string"))
        test = num > a if op == "gt" else num < a if op == "lt" else num.between(min(a, b), max(a, b))
        return F.coalesce(test, F.lit(False))
    if op == "in":
        items = [s.strip().lower() for s in (value or "").split(",") if s.strip()]
        return text.isin(items) if items else F.lit(True)
    return F.lit(True)


def clause_filter(clauses: Sequence[Mapping], logic: str = "AND") -> Column:
    """Conjunction or disjunction of the enabled clauses {field, op, value, valueTo, enabled}."""
    used = [c for c in clauses if c.get("enabled", True) and c.get("field")]
    if not used:
        return F.lit(True)
    parts = [_op(c["field"], c["op"], c.get("value", ""), c.get("valueTo")) for c in used]
    return reduce(and_ if logic == "AND" else or_, parts)


def header_filter(filters: Mapping[str, Mapping]) -> Column:
    """Conjunction of per-column filters; those without a value are ignored."""
    used = {k: f for k, f in filters.items() if (f.get("value") or "").strip() and f.get("op") != "in"}
    return reduce(and_, [_op(k, f["op"], f["value"], f.get("valueTo")) for k, f in used.items()], F.lit(True))


def quick_filter(flags: Mapping[str, bool], columns: Mapping[str, str]) -> Column:
    """Named switches over the row columns; ``columns`` maps cur/origin/via/direct/destination."""
    tests = {
        "usdOnly": lambda: F.upper(cell(columns["cur"])) == "USD",
        "hasOrigin": lambda: cell(columns["origin"]) != "",
        "hasViaCity": lambda: cell(columns["via"]) != "",
        "directCallOnly": lambda: F.upper(cell(columns["direct"])) == "Y",
        "hasDestination": lambda: cell(columns["destination"]) != "",
    }
    return reduce(and_, [test() for name, test in tests.items() if flags.get(name)], F.lit(True))


def search_filter(text: str, columns: Sequence[str]) -> Column:
    """True when any column contains the trimmed text, in any case; blank text keeps all."""
    q = (text or "").strip().lower()
    if not q:
        return F.lit(True)
    return reduce(or_, [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(q) for c in columns])


def with_mixed_keys(df: DataFrame, name: str, desc: bool = False) -> tuple[DataFrame, list[Column]]:
    """``df`` with the sort keys of a column of numbers and texts, and the order over them.

    Numbers come first by value, then texts without regard to case and accents, by the root
    collation of Unicode. The keys are columns,
    so that sampling, shuffling and sorting do not parse the cells again.
    """
    keyed = df.withColumn("__num", js_number(F.col(name).cast("string"))).withColumn(
        "__text", F.when(F.col("__num").isNull(), fold(cell(name)))
    )
    num, text = F.col("__num"), F.col("__text")
    if desc:
        return keyed, [num.desc_nulls_last(), text.desc_nulls_last()]
    return keyed, [num.asc_nulls_last(), text.asc_nulls_first()]


def mixed_sort(df: DataFrame, name: str, tiebreak: Sequence[str], desc: bool = False) -> DataFrame:
    """Rows with their position ``pos`` in the mixed order of a column."""
    keyed, order = with_mixed_keys(df, name, desc)
    return global_rank(keyed, order + [F.col(t).asc() for t in tiebreak]).drop("__num", "__text")


def fold(c: Column) -> Column:
    """``c`` as a text that compares without regard to case and accents, in any script."""
    return F.collate(c, "UNICODE_CI_AI")


def apply_view(
    df: DataFrame, view: Mapping | str, columns: Sequence[str], quick_columns: Mapping[str, str], tiebreak: Sequence[str]
) -> DataFrame:
    """Quick switches, search, clauses, column filters, then the sort of a saved view.

    With a sort key, rows get their position ``pos``; without one they keep no order.
    """
    spec = json.loads(view) if isinstance(view, str) else view
    kept = df.filter(
        quick_filter(spec.get("quickFilters", {}), quick_columns)
        & search_filter(spec.get("searchText", ""), columns)
        & clause_filter(spec.get("clauses", []), spec.get("logic", "AND"))
        & header_filter(spec.get("headerFilters") or {})
    )
    key = spec.get("sortKey")
    if not key:
        return kept
    return mixed_sort(kept, key, tiebreak, spec.get("sortDir", "asc") == "desc")


def derive_columns(rows: DataFrame, fields: str, order: Sequence[str]) -> DataFrame:
    """Keys of a map column in first-seen order with display labels: (key, label, ord)."""
    from paperquay.functions.text import humanise_key

    seen = rows.select(*order, F.posexplode(F.map_keys(fields)).alias("__at", "key"))
    first = seen.filter(~F.col("key").isin(HEADER_KEYS)).groupBy("key").agg(
        F.min(F.struct(*order, "__at")).alias("__first")
    )
    numbered = global_rank(first, [F.col("__first").asc()], "ord")
    return numbered.select("key", humanise_key(F.col("key")).alias("label"), "ord")


def visible(df: DataFrame, hidden: Mapping[str, bool]) -> DataFrame:
    """Drop the columns whose visibility flag is False."""
    return df.select(*[c for c in df.columns if hidden.get(c, True) is not False])
