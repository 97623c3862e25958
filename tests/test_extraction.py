"""Extractors as a table function, answers over long texts, whole records, session order: edge values."""

import pytest
from pyspark.sql import functions as F

from paperquay.operators import answers as A
from paperquay.operators import documents as O
from paperquay.operators import sessions as S
from paperquay.sources import extractors as X


def test_table_function_keeps_every_file(spark):
    def picky(content):
        if content == b"key":
            raise KeyError("missing")
        return {"full_text": content.decode(), "tables": [{"table_id": "t", "rows": 1}], "language": "en"}

    X.register("picky", picky)
    try:
        rows = [("a", b"fine", "picky"), ("b", b"\xff\xfe", "picky"), ("c", b"key", "picky"), ("d", None, "plain_text"), ("e", b"x", None), ("f", b"x\n\ny", "plain_text")]
        files = spark.createDataFrame(rows, "path string, content binary, engine string")
        got = {r.path: r for r in X.extract_each(files, F.col("engine")).collect()}
        same = {r.path: r for r in X.extract(files.filter("engine = 'picky'"), "picky").collect()}
    finally:
        del X.EXTRACTORS["picky"]
    assert set(got) == set("abcdef")
    assert got["a"].error is None and got["a"].extra == {"language": "en"} and got["a"].tables[0].cells is None
    assert got["b"].error.startswith("UnicodeDecodeError") and got["c"].error == "KeyError: 'missing'"
    assert got["d"].full_text == "" and got["e"].error == "Unknown model: None" and [b.text for b in got["f"].blocks] == ["x", "y"]
    for path in "abc":
        assert got[path].asDict() | {"processing_time": 0} == same[path].asDict() | {"processing_time": 0}
    assert X.extract_each(files.limit(0), F.col("engine")).count() == 0


def test_results_fit_what_is_stored(spark):
    files = spark.createDataFrame([("p", b"one\ntwo")], "path string, content binary")
    results = X.as_results(X.extract(files, "plain_text"), F.current_timestamp())
    docs = results.select(F.sha2(F.lit("p"), 256).alias("doc_id"), F.lit("QUEUED").alias("status"), *(F.lit(None).cast(t).alias(c) for c, t in results.drop("doc_id", "error").dtypes))
    (row,) = O.apply_results(docs, results).collect()
    assert (row.status, row.full_text, row.confidence, row.warnings) == ("REVIEW", "one\ntwo", 100.0, "[]")
    assert row.text_blocks == '[{"text":"one","block_type":"paragraph","page":1},{"text":"two","block_type":"paragraph","page":1}]'


def test_results_are_not_broadcast(spark, tmp_path):
    # The few bytes of the files that are read say nothing of the texts that come out.
    spark.createDataFrame([("p", b"one")], "path string, content binary").write.parquet(f"{tmp_path}/files")
    results = X.as_results(X.extract(spark.read.parquet(f"{tmp_path}/files"), "plain_text"), F.current_timestamp())
    docs = results.select("doc_id", F.lit("QUEUED").alias("status"), *(F.lit(None).cast(t).alias(c) for c, t in results.drop("doc_id", "error").dtypes))
    plan = O.apply_results(docs, results)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_answers_come_from_any_window(spark):
    far = " ".join(["word"] * 3000) + " Total 42 " + " ".join(["word"] * 3000)

    def after(context, columns):
        if "boom" in context:
            raise ValueError("boom")
        words = context.split()
        hit = words.index("Total") if "Total" in words[:-1] else -1
        return {"total": {"answer": words[hit + 1], "score": 0.9}} if hit >= 0 else {}

    docs = spark.createDataFrame([(1, far), (2, "Total 7 x"), (3, None), (4, ""), (5, "nothing"), (6, "boom " + far)], "doc_id long, full_text string")
    got = {(r.doc_id, r.key): (r.answer, r.score, r.error) for r in A.ask_texts(docs, [{"key": "total"}], after).collect()}
    assert got == {
        (1, "total"): ("42", 0.9, None), (2, "total"): ("7", 0.9, None), **{(i, "total"): ("", 0.0, None) for i in (3, 4, 5)},
        (6, "total"): ("42", 0.9, "ValueError: boom"),
    }


@pytest.mark.parametrize("timed", [True, False])
def test_sessions_newest_first(spark, timed):
    rows = [("a", 1), ("b", 3), ("c", None), ("d", 3)]
    sessions = spark.createDataFrame(rows, "session_id string, at int").select("session_id", F.timestamp_seconds("at").alias("created_at"))
    docs = spark.createDataFrame([("b", "APPROVED"), (None, "QUEUED"), ("b", "QUEUED")], "session_id string, status string")
    got = S.with_counts(sessions if timed else sessions.drop("created_at"), docs).collect()
    assert [r.session_id for r in got] == (["b", "d", "a", "c"] if timed else ["a", "b", "c", "d"])
    assert [(r.document_count, r.processed_count) for r in got if r.session_id == "b"] == [(2, 1)]
