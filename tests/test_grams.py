"""Substring search by grams: the rows of a plain filter, from few blocks."""

import random

import pytest
from pyspark.sql import functions as F

from paperquay.operators.filters import search_filter
from paperquay.operators.grams import PIECE, TextIndex


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "DELTA", "\U0001f600 smile", "two\nlines", "\u00c9t\u00e9"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12))), rng.choice(words)) for i in range(2000)]
    rows[777] = (777, "a needle-42 here", None)
    rows[1500] = (1500, "x" * (PIECE - 2) + "NEEDLE-43" + "y" * PIECE, "")
    rows[1501] = (1501, "ab" * PIECE, "Q")
    rows[1502] = (1502, None, None)
    return spark.createDataFrame(rows + [rows[777]], "id long, text string, note string")


def test_search_gives_the_rows_of_a_filter(texts):
    index = TextIndex(texts, ["text", "note"], [F.col("id")], 40)
    for q in ["needle-4", "NEEDLE-42", "needle-43yyy", "aba", "Q", "", "  smile ", "two\nl", "\u00c9T\u00c9", "\U0001f600", "a\U0001f600", "nowhere", "bab" * 9]:
        want = sorted(r.id for r in texts.filter(search_filter(q, ["text", "note"])).collect())
        assert sorted(r.id for r in index.search(q).collect()) == want, q


def test_rare_text_reads_few_blocks(texts):
    index = TextIndex(texts, ["text", "note"], [F.col("id")], 40)
    assert len(index.may_hold("needle-42")) == 1 and index.may_hold("nowhere") == [] and index.may_hold("ab") is None
    read = index.search("Needle-42").select(F.col("id")).collect()
    assert [r.id for r in read] == [777, 777]


def test_empty_table(texts):
    assert TextIndex(texts.limit(0), ["text"], [F.col("id")], 4).search("abc").isEmpty()
