"""String columns: cleaning, names, labels, keys. Every function maps a Column to a Column."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every white space character, written out (faster than the Unicode class flag).
_SPACES = r"\s\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Most characters are printable ASCII, which one comparison tells.
_SPACE = f"[[^!-~]&&[{_SPACES}]]"
WS = _SPACE + "+"
# The same characters, to be trimmed; and runs of them that are not one plain space.
SPACES = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_OTHER = f"[[^ -~]&&[{_SPACES}]]"
_RUNS = f"{_SPACE}{{2,}}|{_OTHER}"
# Needs cleaning: white space at an end, two in a row, or any but the plain space.
_UNCLEAN = f"^{_SPACE}|{_SPACE}$|{_SPACE}{{2}}|{_OTHER}"
# Clean for sure: words of printable ASCII with one plain space between them; so are all cells of a row joined by _MARK.
_MARK = "\x01"
_CLEAN = "(?:[!-~]++(?: [!-~]++)*+)?+"
_CLEAN_ROW = rf"^{_CLEAN}(?:{_MARK}{_CLEAN})*+\z"
# The same without an underscore; and letters with only digits and underscores after them in each word.
_CLEAN_NAME = r"^(?:[!-^`-~]++(?: [!-^`-~]++)*+)?+\z"
_SIMPLE_WORDS = r"^[A-Za-z]*+[0-9_]*+(?: [A-Za-z]*+[0-9_]*+)*+\z"

# Table header spelling -> field name.
HEADER_FIELDS = {
    "destination": "destination_city",
    "destination city": "destination_city",
    "destination via": "destination_via_city",
    "destination via city": "destination_via_city",
    "point": "point",
    "via": "via",
    "cntry": "cntry",
    "term": "term",
    "type": "type",
    "cur": "cur",
    "service": "service",
    "lane": "lane",
    "trunk lane": "trunk_lane",
    "mode": "mode",
    "box": "box",
    "cmdt": "cmdt",
    "note": "note",
    "direct call": "direct_call",
    "20'": "rate20",
    "40'": "rate40",
    "40hc": "rate40h",
    "45'": "rate45",
    "20' agw": "agw20",
    "40' agw": "agw40",
    "45' agw": "agw45",
}

# Display labels of codes.
STATUS_LABELS = {
    "QUEUED": "Queued",
    "SCANNING": "Scanning",
    "PROCESSING": "Processing",
    "CANCELLING": "Cancelling",
    "REVIEW": "Review",
    "APPROVED": "Approved",
    "REJECTED": "Rejected",
    "EXPORTED": "Exported",
    "ERROR": "Error",
}
TYPE_LABELS = {
    "AUTO": "Auto",
    "IMAGE": "Image",
    "PDF_TEXT": "PDF (Text)",
    "PDF_IMAGE": "PDF (Scanned)",
    "EXCEL": "Excel",
}

# Display labels of known row keys.
KEY_LABELS = {
    "destinationCity": "Destination",
    "destinationViaCity": "Via City",
    "originCity": "Origin",
    "originViaCity": "Via City",
    "baseRate20": "20'",
    "baseRate40": "40'",
    "baseRate40H": "40HC",
    "baseRate45": "45'",
    "agw20": "AGW 20'",
    "agw40": "AGW 40'",
    "agw45": "AGW 45'",
    "agw": "AGW",
    "amsChina": "AMS (CN/JP)",
    "heaHeavySurcharge": "HEA Heavy",
    "redSeaDiversion": "Red Sea Div.",
    "commodity": "Commodity",
    "service": "Service",
    "remarks": "Remarks",
    "scope": "Scope",
    "origin": "Origin",
    "originVia": "Origin Via",
    "directCall": "Direct Call",
    "cntry": "Cntry",
    "cntry_2": "Via Cntry",
}
HEADER_KEYS = ["carrier", "contractId", "effectiveDate", "expirationDate"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def lookup(mapping: Mapping[str, str], c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.try_element_at(table, c)


def strip(c: Column) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.trim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, _RUNS, " "))


def clean_text(c: Column) -> Column:
    return collapse(F.coalesce(c, F.lit("")))


def title_case(c: Column) -> Column:
    """Upper-case the first letter after any non-letter, lower-case the others."""

    def cased(x: Column) -> Column:
        runs = F.regexp_extract_all(x, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
        return F.when(x.rlike(_SIMPLE_WORDS), F.initcap(x)).otherwise(F.array_join(F.transform(runs, lambda r: F.initcap(r)), ""))

    return let(c, cased)


def city_only(c: Column) -> Column:
    return title_case(F.trim(F.substring_index(clean_text(c), ",", 1)))


def preserve_city(c: Column) -> Column:
    return title_case(clean_text(c))


def short_commodity(c: Column) -> Column:
    kept = F.regexp_replace(clean_text(c), r"(?i)\bEXCLUDING\b.*$", "")
    kept = F.substring_index(kept, "(", 1)
    left = F.regexp_replace(kept, r"(?i)\band/or\b.*$", "")
    kept = F.when(left.contains(" - "), left).otherwise(kept)
    return clean_text(F.regexp_replace(kept, r"[:;,.\- ]+$", ""))


def normalize_header(c: Column) -> Column:
    full = F.regexp_replace(F.replace(F.lower(clean_text(c)), F.lit("_"), F.lit(" ")), WS, " ")
    key = F.when(c.rlike(_CLEAN_NAME), F.lower(c)).otherwise(full)
    return let(key, lambda k: F.coalesce(lookup(HEADER_FIELDS, k), k))


def dedupe_headers(cells: Column) -> Column:
    """Field names of a header row; the n-th repeat of a name gets the suffix ``_n``."""

    def body(names: Column) -> Column:
        def numbered(name: Column, i: Column) -> Column:
            nth = F.size(F.filter(F.slice(names, F.lit(1), i + 1), lambda other: other == name))
            return F.when(nth == 1, name).otherwise(F.concat(name, F.lit("_"), nth.cast("string")))

        alone = F.size(F.array_distinct(names)) == F.size(names)
        return F.when(alone, names).otherwise(F.transform(names, numbered))

    return let(F.transform(cells, normalize_header), body)


def normalize_text(c: Column) -> Column:
    return collapse(F.lower(c))


def normalize_loose(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def slug_key(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_|_$", "")


def safe_filename(c: Column) -> Column:
    name = F.when(F.coalesce(c, F.lit("")) == "", "Session").otherwise(c)
    name = strip(F.regexp_replace(name, r'[\\/:*?"<>|]', "_"))
    name = F.regexp_replace(F.regexp_replace(name, WS, "_"), "_+", "_")
    name = F.substring(name, 1, 120)
    return F.when(name == "", "Session").otherwise(name)


def compact_filename(c: Column) -> Column:
    return F.when(F.length(c) <= 16, c).otherwise(F.concat(F.substring(c, 1, 5), F.lit("..."), F.substring(c, -8, 8)))


def sheet_name(c: Column) -> Column:
    return F.substring(F.regexp_replace(c, r"[\\/*?\[\]]", "_"), 1, 28)


def humanise_key(c: Column) -> Column:
    return F.coalesce(lookup(KEY_LABELS, c), F.trim(F.regexp_replace(c, "([A-Z])", " $1")))


def status_label(c: Column) -> Column:
    return F.coalesce(lookup(STATUS_LABELS, c), c, F.lit("Unknown"))


def type_label(c: Column) -> Column:
    return F.coalesce(lookup(TYPE_LABELS, c), c, F.lit("—"))


def has_digit(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike("[0-9]")


def clean_cells(cells: Column) -> Column:
    """``clean_text`` of every cell; most rows need no change, which one search tells."""

    def clean(c: Column) -> Column:
        return F.when(c.rlike(_UNCLEAN), collapse(c)).otherwise(F.coalesce(c, F.lit("")))

    # A tab stands for a null, which is to be cleaned.
    return F.when(F.array_join(cells, _MARK, "\t").rlike(_CLEAN_ROW), cells).otherwise(F.transform(cells, clean))


def strip_cells(cells: Column) -> Column:
    """``strip`` of every cell, nulls stay; most rows need no change, which one search tells."""
    return F.when(F.array_join(cells, _MARK, "\t").rlike(_CLEAN_ROW), cells).otherwise(F.transform(cells, strip))


def is_blank_row(cells: Column) -> Column:
    return F.ltrim(F.array_join(cells, ""), F.lit(SPACES)) == ""


def is_header_row(cells: Column) -> Column:
    # The names hold no white space, so only what stands before them is to be cleaned.
    first = F.ltrim(F.coalesce(F.try_element_at(cells, F.lit(1)), F.lit("")), F.lit(SPACES))
    first = F.lower(F.left(first, F.lit(len("destination"))))
    return first.startswith("destination") | first.startswith("point")


def paragraphs(c: Column, delimiter: str = "\n\n") -> Column:
    """Array of trimmed non-blank pieces of ``c``; ``delimiter`` is literal."""
    pieces = F.split(c, rf"\Q{delimiter}\E")
    return F.filter(F.transform(pieces, strip), lambda p: p != "")


def word_chunks(c: Column, words: int = 850, overlap: int = 120) -> Column:
    """Array of overlapping word windows; a short text is its own only chunk, unchanged."""
    step = max(1, words - overlap)

    def cut(tokens: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0)), F.lit(step))
        pieces = F.transform(starts, lambda s: F.array_join(F.slice(tokens, s + 1, F.lit(words)), " "))
        return F.when(F.size(tokens) <= words, F.array(c)).otherwise(pieces)

    return let(F.filter(F.split(c, WS), lambda w: w != ""), cut)


def block_type(element: Column, text: Column | None = None) -> Column:
    """Type of a text block from its element name; a ``#`` prefix of the text marks a heading."""
    name = F.lower(element)
    kind = (
        F.when(name.contains("heading") | name.contains("title"), "heading")
        .when(name.contains("list"), "list")
        .when(name.contains("header"), "header")
        .when(name.contains("footer"), "footer")
        .otherwise("paragraph")
    )
    return kind if text is None else F.when(text.startswith("#"), "heading").otherwise(kind)


def markdown_row(cells: Column) -> Column:
    """One pipe-table row; ``|`` is escaped and line breaks become spaces."""
    safe = F.transform(
        cells, lambda c: F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    )
    return F.concat(F.lit("| "), F.array_join(safe, " | "), F.lit(" |"))


def question_prompt(context: Column, columns: Column) -> Column:
    """Prompt asking for every (key, question) of ``columns``; null when none has both."""
    asked = F.filter(columns, lambda q: (strip(q["key"]) != "") & (strip(q["question"]) != ""))
    lines = F.transform(asked, lambda q: F.concat(F.lit('- "'), strip(q["key"]), F.lit('": '), strip(q["question"])))
    # Fixed wording of the request.
    head = (
        "You are a precise data extraction assistant. "
        "Given the following document text, answer each question with ONLY the extracted value. "
        "If a value cannot be found, respond with an empty string.\n\n"
        "DOCUMENT TEXT:\n"
    )
    tail = (
        "\n\nRespond ONLY with a valid JSON object mapping each key to its extracted answer. "
        'Example: {"invoice_no": "12345", "date": "2024-01-15"}\nJSON:'
    )
    text = F.concat(F.lit(head), context, F.lit("\n\nQUESTIONS:\n"), F.array_join(lines, "\n"), F.lit(tail))
    return F.when(F.size(asked) > 0, text)


# -- log lines ---------------------------------------------------------------------------------

UNIT_BYTES = {"B": 1, "KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30, "TB": 1 << 40}
_AMOUNT = r"(\d+(?:\.\d+)?)\s*(B|KB|MB|GB|TB)"


def log_line(c: Column) -> Column:
    """Line without colour codes and progress tag; null when nothing is left."""
    plain = strip(F.regexp_replace(c, r"\x1B\[[0-9;]*m", ""))
    shown = F.when(plain.startswith("[progress]"), F.substring(plain, 12, 1 << 30)).otherwise(plain)
    return F.when(plain != "", shown)


def _bytes(c: Column, pattern: str, value: int, unit: int) -> Column:
    number = F.regexp_extract(c, pattern, value).try_cast("double")
    factor = F.try_element_at(
        F.create_map(*[F.lit(x) for k, v in UNIT_BYTES.items() for x in (k, float(v))]),
        F.upper(F.regexp_extract(c, pattern, unit)),
    )
    return number * factor


def log_metrics(c: Column) -> dict[str, Column]:
    """percent, downloaded_mb, total_mb, speed_mbps, eta of a progress line (null = absent)."""
    amounts, speed = rf"(?i){_AMOUNT}\s*/\s*{_AMOUNT}", rf"(?i){_AMOUNT}\s*/\s*s"
    mb = F.lit(float(1 << 20))
    done, total, rate = _bytes(c, amounts, 1, 2), _bytes(c, amounts, 3, 4), _bytes(c, speed, 1, 2)
    said = F.regexp_extract(c, r"(\d{1,3})%", 1).try_cast("int")
    derived = F.when(total > 0, F.floor(done / total * 100 + 0.5).cast("int"))
    percent = F.coalesce(said, derived)
    eta = F.regexp_extract(c, r"(?i)\b(\d+h\d+m\d+s|\d+m\d+s|\d+s)\b", 1)
    return {
        "percent": F.when(percent > 100, 100).otherwise(percent),
        "downloaded_mb": F.when(done > 0, F.round(done / mb, 1)),
        "total_mb": F.when(total > 0, F.round(total / mb, 1)),
        "speed_mbps": F.when(rate > 0, F.round(rate / mb, 2)),
        "eta": F.when(eta != "", eta),
    }
