"""Column functions on edge values. Expected values are written out from the rules."""

import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from paperquay.functions import dates as D
from paperquay.functions import json_cols as J
from paperquay.functions import numbers as N
from paperquay.functions import text as X


def apply(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_js_number(spark):
    cases = {
        "": 0.0, "  ": 0.0, " 12 ": 12.0, "1,200": None, "1e3": 1000.0, "1d": None, "Infinity": None, "NaN": None, "-.5": -0.5,
        "5.": 5.0, "+7": 7.0, "0x1F": 31.0, "0b101": 5.0, "0o17": 15.0, "0xZ": None, "1e999": None, " 3\t": 3.0, "--1": None,
    }
    assert apply(spark, N.js_number, list(cases)) == list(cases.values())
    assert apply(spark, N.js_number, [None]) == [0.0]


def test_fixed1_rounds_the_binary_value(spark):
    rng = random.Random(7)
    values = [0.15, 0.25, 0.35, 6.25, 0.05, 99.95, 0.0, 100.0, -1.25, 1e9 + 0.05] + [rng.uniform(0, 200) for _ in range(300)]
    values += [round(rng.uniform(0, 100), 2) for _ in range(300)] + [k / 20 for k in range(400)]
    want = [str(Decimal(v).quantize(Decimal("0.1"), ROUND_HALF_UP)) for v in values]
    assert apply(spark, N.fixed1, values, "double") == want


def test_round_even_is_exact(spark):
    rng = random.Random(8)
    values = [32.175, 0.125, 0.375, 2.675, 1.005] + [round(rng.uniform(0, 100), 3) for _ in range(500)]
    assert apply(spark, lambda c: N.round_even(c, 2), values, "double") == [round(v, 2) for v in values]


def test_format_bytes(spark):
    cases = {None: "Unknown", 0.0: "Unknown", -5.0: "Unknown", 1.0: "1 B", 1023.0: "1023 B", 1024.0: "1.0 KB", 10240.0: "10 KB", 6400.0: "6.3 KB", 1024.0**5: "1024 TB"}
    assert apply(spark, N.format_bytes, list(cases), "double") == list(cases.values())


def test_durations(spark):
    assert apply(spark, N.readable_duration, [0.0, None, 59.94, 60.0, 119.6, 3661.0], "double") == ["—", "—", "59.9s", "1m 0s", "1m 60s", "61m 1s"]


def test_iso_dates(spark):
    cases = {
        "01/02/2024": "2024-02-01", "31/12/2024": "2024-12-31", "12/31/2024": "2024-12-31", "1-2-2024": "2024-02-01", "20240102": "2024-01-02",
        "5 Jan, 2024": "2024-01-05", "5 JANUARY 2024": "2024-01-05", "1/2/24": "1/2/24", "junk": "junk", "2024-02-30": "2024-02-30", "": "",
        " 2024-1-5 ": "2024-01-05", "31 Feb 2024": "31 Feb 2024", "5 Foo 2024": "5 Foo 2024", "12024-01-01": "12024-01-01",
    }
    assert apply(spark, D.to_iso_date, list(cases)) == list(cases.values())


def test_cities_and_commodities(spark):
    cities = {"o'brien, XX": "O'Brien", "ST-LOUIS": "St-Louis", "": "", " , x": "", "são paulo  city": "São Paulo City", None: ""}
    assert apply(spark, X.city_only, list(cities)) == list(cities.values())
    goods = {
        "A - B and/or C": "A - B", "A and/or C": "A and/or C", "FAK EXCLUDING X (y):": "FAK", "fak (bulk)": "fak", "steel :;-": "steel",
        "": "", "a - b (c) and/or d": "a - b", "NONEXCLUDING X": "NONEXCLUDING X",
    }
    assert apply(spark, X.short_commodity, list(goods)) == list(goods.values())


def test_names(spark):
    assert apply(spark, X.safe_filename, ["", None, " a b ", 'x<>:"/\\|?*y', "   ", "a" * 130]) == ["Session", "Session", "a_b", "x_y", "Session", "a" * 120]
    assert apply(spark, X.compact_filename, ["short.pdf", "0123456789abcdef", "0123456789abcdefg"]) == ["short.pdf", "0123456789abcdef", "01234...9abcdefg"]
    assert apply(spark, X.slug_key, ["  Company Name! ", "__a", "--"]) == ["company_name", "a", ""]
    assert apply(spark, X.humanise_key, ["baseRate40H", "someNewKey", "ABC"]) == ["40HC", "some New Key", "A B C"]
    assert apply(spark, X.sheet_name, ["a/b[c]*d?.pdf" + "x" * 40]) == ["a_b_c__d_.pdf" + "x" * 15]


def test_headers(spark):
    row = [["Destination", "20'", "20'", " Direct_Call", "40HC", "x", "20'"]]
    got = apply(spark, X.dedupe_headers, row, "array<string>")
    assert got == [["destination_city", "rate20", "rate20_2", "direct_call", "rate40h", "x", "rate20_3"]]


def test_cells(spark):
    row = ["a", " a", "a\u00a0", "a  b", "a\tb", "a\nb c", "", None, "a b", "\u2003", "\x1c"]
    assert apply(spark, X.clean_cells, [row], "array<string>") == [["a", "a", "a", "a b", "a b", "a b c", "", "", "a b", "", ""]]
    rows = [[], ["", None], ["\u00a0 \t", "\n"], ["", "x"], [None, " . "]]
    assert apply(spark, X.is_blank_row, rows, "array<string>") == [True, True, True, False, False]
    heads = [[" DESTINATION x"], ["Point"], ["the point"], [None], []]
    assert apply(spark, lambda c: F.coalesce(X.is_header_row(c), F.lit(False)), heads, "array<string>") == [True, True, False, False, False]


def test_word_chunks(spark):
    long = " ".join(str(i) for i in range(1500))
    got = apply(spark, X.word_chunks, ["a  b", "", long])
    assert got[0] == ["a  b"] and got[1] == [""]
    words = long.split()
    assert got[2] == [" ".join(words[s : s + 850]) for s in range(0, 1500, 730)]


def test_replies(spark):
    replies = [
        'x ```json\n{"a": "1"}\n``` and ```{"a": "2"}```', "[1, 2]", '{"a": null}', '{"a": 0}', '{"a": false}', '{"a": true}', '{"a": 1.5}', '{"a": "0"}', '{"a": "x"} tail', None,
    ]
    got = apply(spark, lambda c: J.reply_answers(c, ["a"])["a"], replies)
    assert [(r.answer, r.score) for r in got] == [
        ("1", 1.0), ("", 0.0), ("", 0.0), ("0", 0.0), ("False", 0.0), ("True", 1.0), ("1.5", 1.0), ("0", 1.0), ("", 0.0), ("", 0.0),
    ]


def test_sidecar_payload(spark):
    got = apply(spark, J.sidecar_payload, ['note {"a": 1}', "none", '{"error": "bad"}', '{"a": 1', '{"error": ""}'])
    assert [(r.payload, r.error) for r in got] == [
        ('{"a": 1}', None), (None, "No JSON object found in output"), (None, "bad"), (None, "Output is not valid JSON"), ('{"error": ""}', None),
    ]


def test_log_lines(spark):
    got = apply(spark, X.log_line, ["\x1b[31m[progress] hello\x1b[0m ", "   ", "plain", "[progress] [progress] x"])
    assert got == ["hello", None, "plain", "[progress] x"]
    df = spark.createDataFrame([("at 120% 512 MB / 2 GB 1.5 kb/s 1h2m3s",), ("30 MB/60 MB",), ("nothing",)], "v string")
    rows = df.select(*[c.alias(n) for n, c in X.log_metrics(F.col("v")).items()]).collect()
    assert tuple(rows[0]) == (100, 512.0, 2048.0, 0.0, "1h2m3s")
    assert tuple(rows[1])[:3] == (50, 30.0, 60.0) and tuple(rows[2]) == (None,) * 5


def test_span(spark):
    df = spark.createDataFrame([([0.0, 5.0, 1.0], [3.0, 0.0, 0.0]), ([9.0] + [0.0] * 40, [0.0] * 40 + [9.0])], "s array<double>, e array<double>")
    got = [r.x for r in df.select(N.best_span(F.col("s"), F.col("e")).alias("x")).collect()]
    assert (got[0].start_idx, got[0].end_idx) == (1, 1) and (got[1].start_idx, got[1].end_idx) == (0, 24)


@pytest.mark.parametrize("text, want", [("valid from 2024-01-01 to 20240630 VALID 5 Jan 2024 thru 6 Jan, 2024 valid 2024-01-01 through 2024-06-30", 2), ("invalid", 0)])
def test_date_pairs(spark, text, want):
    assert len(apply(spark, D.date_pairs, [text])[0]) == want


def test_white_space_at_ends_and_inside(spark):
    """All white space of Unicode, in both forms: trimmed, and each run as one space."""
    import re

    rng, spaces = random.Random(8), [chr(i) for i in range(0x3001) if chr(i).isspace()]
    texts = ["", " ", "\n", "a", "a \n", "\u200b a \u180e", None]
    texts += ["".join(rng.choices([*spaces, " ", " ", "a", "\u00e9", "\U0001f600", "\u200b"], k=rng.randint(1, 12))) for _ in range(600)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.s, r.c) for r in df.select("i", X.strip(F.col("t")).alias("s"), X.collapse(F.col("t")).alias("c")).collect()}
    assert got == {i: (None, None) if t is None else (t.strip(), re.sub(r"\s+", " ", t).strip()) for i, t in enumerate(texts)}
