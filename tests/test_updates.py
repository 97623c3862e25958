"""Several changes of one document in one batch: one row in, one row out, whatever their order in the input."""

import pytest
from pyspark.sql import functions as F

from paperquay.functions import text as X
from paperquay.operators import documents as O

DOCS = "doc_id long, status string, notes string, full_text string, warnings string, confidence double"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, s, "n", "old", "[]", 1.0) for i, s in enumerate(["REVIEW", "APPROVED", "REJECTED", "QUEUED", "EXPORTED", None])]
    return spark.createDataFrame(rows, DOCS)


def fold(status, made, guard):
    """Decisions one by one."""
    notes, verified = "n", False
    for decision, reason in made:
        ok = decision == "APPROVE" and (not guard or status in ("REVIEW", "REJECTED"))
        if ok:
            status, verified = "APPROVED", True
        if decision == "REJECT" and (not guard or status in ("REVIEW", "APPROVED")):
            status, verified = "REJECTED", True
            notes = reason or notes
    return status, notes, verified


SEQUENCES = [
    [], [("APPROVE", None)], [("REJECT", "a"), ("REJECT", "b")], [("APPROVE", "x"), ("REJECT", "a"), ("REJECT", "b"), ("APPROVE", None)],
    [("NOTE", "z"), ("REJECT", ""), ("APPROVE", ""), ("REJECT", "c")], [(None, "q"), ("REJECT", "a"), ("APPROVE", ""), ("REJECT", None)],
]


@pytest.mark.parametrize("guard", [False, True])
@pytest.mark.parametrize("made", SEQUENCES)
def test_decisions_in_order(spark, docs, made, guard):
    rows = [(d, t * 70_000, *x) for d in [0, 1, 2, 3, 4, 5, 99, None] for t, x in enumerate(made)]
    frame = spark.createDataFrame(rows[::-1], "doc_id long, at long, decision string, reason string")
    for name, some in (("at", frame), ("time", frame.withColumn("time", F.timestamp_seconds("at")))):
        got = O.review_decisions(docs, some, F.current_timestamp(), guard, name).collect()
        assert len(got) == 6
        want = {d.doc_id: fold(d.status, made, guard) for d in docs.collect()}
        assert {r.doc_id: (r.status, r.notes, r.verified_at is not None) for r in got} == want


def test_changes_without_order(spark, docs):
    two = spark.createDataFrame([(0, "REJECT", "why"), (0, "APPROVE", None), (0, "REJECT", "why")], "doc_id long, decision string, reason string")
    for guard in (False, True):
        got = O.review_decisions(docs, two, F.current_timestamp(), guard).filter("doc_id = 0").collect()
        assert [(r.status, r.notes) for r in got] == [("REJECTED", "why")]


def test_patches_in_order(spark, docs):
    rows = [(0, 1, ["notes"], "a", 5.0), (0, 2, ["confidence"], "b", 6.0), (0, 3, ["notes"], None, 7.0), (1, None, ["notes"], "z", None), (None, 9, ["notes"], "q", None)]
    patches = spark.createDataFrame(rows[::-1], "doc_id long, at long, set array<string>, notes string, confidence double")
    got = {r.doc_id: (r.notes, r.confidence) for r in O.patch(docs, patches, ["notes", "confidence"], "at").collect()}
    assert got == {0: (None, 6.0), 1: ("z", 1.0), **{i: ("n", 1.0) for i in range(2, 6)}}


def test_results_in_order(spark, docs):
    rows = [(0, 1, None, "one", '["w"]'), (0, 2, "broken", "two", None), (1, 1, "broken", "x", None), (1, 2, None, "fine", None), (9, 1, None, "?", None)]
    results = spark.createDataFrame(rows[::-1], "doc_id long, at long, error string, full_text string, warnings string")
    got = {r.doc_id: (r.status, r.full_text, r.warnings) for r in O.apply_results(docs, results, "at").collect()}
    assert got[0] == ("ERROR", "one", '["broken"]') and got[1] == ("REVIEW", "fine", '["broken"]') and got[3] == ("QUEUED", "old", "[]")
    assert len(got) == 6 == docs.count()


def test_results_that_do_not_fit_are_an_error(spark, docs):
    for name in ("blocks", "markdown"):
        results = spark.createDataFrame([(0, None, "x")], f"doc_id long, error string, {name} string")
        with pytest.raises(ValueError, match=name):
            O.apply_results(docs, results)


def test_long_texts_are_split_once(spark):
    n = 200_000
    frame = spark.range(1).select(F.repeat(F.lit("word "), n).alias("t"))
    sizes = frame.select(F.transform(X.word_chunks(F.col("t")), lambda c: F.size(F.split(c, " "))).alias("s")).first().s
    assert sizes[0] == 850 and len(sizes) == -(-n // 730)
