"""Defined results for nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib

import public_tokenizers
import pytest

import corpus_pipeline
from paperquay.llm import bpe, exact, html_text, langid, packing, pii, simhash, substrings, syncmers, warc
from paperquay.session import run_dir

PROSE = "the cat sat on the mat and then it ran off to see what the old dog had found in the yard"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, c0 string, n string, fingerprint int"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
TEXTS = [
    (1, PROSE), (2, PROSE), (2, PROSE), (3, None), (4, ""), (5, LONG), (None, PROSE.upper()), (6, "x" * 50_000),
    (7, "  "), (8, "12 34 %%"), (9, f"before {PROSE} after"), (9, "another text under the same id"), (None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None, None if t is None else len(t), "a", "b", None, 1) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def keyed(df, key="doc_id"):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: repr(sorted(r.items(), key=str)))


def test_warc(spark, docs, none):
    pages = docs.selectExpr("doc_id as page_id", "source as url", "text as html", "id", "n")
    for frame, count in ((pages, len(TEXTS)), (pages.limit(0), 0)):
        folder = run_dir(spark, "warc-test")
        warc.write_archive(frame, folder)
        records = warc.read_records(spark, folder)
        rows = records.collect()
        assert len(rows) == count
    same = [r for r in rows] or warc.read_records(spark, folder).collect()
    folder = run_dir(spark, "warc-test")
    warc.write_archive(pages, folder)
    rows = warc.read_records(spark, folder).collect()
    prose = [r for r in rows if r.payload == PROSE.encode()]
    assert sorted((r.id, r.record_type, r.refers_to) for r in prose) == [(1, "response", None), (2, "revisit", 1), (2, "revisit", 1)]
    empty = sorted(((r.id or 0, r.record_type, r.refers_to) for r in rows if not r.payload))
    assert empty == [(0, "revisit", 3), (3, "response", None), (4, "revisit", 3)]
    assert len({r.record_id for r in rows}) == len(rows)
    assert same is not None


def test_syncmers(docs, none):
    got = syncmers.edited_fingerprints(docs)
    rows = got.collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert len({r.fingerprint for r in rows if r.doc_id in (1, 2)}) == 1
    assert {r.fingerprint for r in rows if r.doc_id in (3, 4, 7)} == {""}
    assert none.count() == 0 and syncmers.edited_fingerprints(none).count() == 0
    alone = syncmers.edited_fingerprints(docs.filter("doc_id = 5")).first()
    n = len(LONG)
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256((LONG[: n - n // 2] + LONG[: n // 2]).encode()).hexdigest()


def test_packing(docs, none):
    rows = packing.packed(docs).collect()
    assert len(rows) == len(TEXTS) and packing.packed(none).collect() == []
    assert packing.packed(none).columns == packing.packed(docs).columns
    assert len({(r.bucket, r.batch, r.slot) for r in rows}) == len(rows)
    over = [r for r in rows if r.n_tokens > packing.BUDGET]
    assert [r.n_tokens for r in over] == [60_000] and sum(r.bucket == over[0].bucket and r.batch == over[0].batch for r in rows) == 1


def test_packing_places_many_equal_rows(spark, monkeypatch):
    """Copies of one row are spread over pieces, and each gets a place of its own."""
    monkeypatch.setattr(packing, "BLOCK", 7)
    rows = packing.packed(spark.createDataFrame([(1 if i % 3 else i, "a b c") for i in range(300)], "doc_id long, text string"), budget=30).collect()
    assert sum(r.doc_id == 1 for r in rows) == 200 and sorted((r.batch, r.slot) for r in rows) == [(i // 10, i % 10) for i in range(300)]


def test_bpe(docs, none):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    rows = bpe.round_trip(docs, path, pattern).collect()
    assert sorted((r.doc_id or 0, r.decoded_sha256) for r in rows) == sorted((i or 0, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in TEXTS)
    assert bpe.round_trip(none, path, pattern).count() == 0
    back = bpe.decode(bpe.encode(docs, path, pattern), path, pattern)
    assert back.filter("decode(decoded, 'UTF-8') <> coalesce(text, '')").count() == 0 and "fingerprint" in back.columns


def test_language(docs, none):
    rows = langid.train_and_predict(docs).collect()
    assert len(rows) == len(TEXTS)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if r.doc_id in (3, 4, 7, 8))
    assert {r.lang_pred for r in rows} == {"und", "en"} and not any(r.held_out for r in rows if r.doc_id is None)
    assert langid.train_and_predict(none).count() == 0
    unlabelled = docs.withColumn("lang", docs.source)
    assert {r.lang_pred for r in langid.train_and_predict(unlabelled).collect()} == {"und"}
    for frame, langs in ((docs, {"en"}), (unlabelled, {None}), (docs.withColumn("lang", docs.lang.substr(1, 2)), {"en"})):
        kept = langid.keep_known(frame)
        assert kept.columns == docs.columns and kept.count() == len(TEXTS) - 5
        assert {r.lang for r in kept.collect()} == langs
    some = docs.selectExpr("doc_id", "text", "if(doc_id = 1, null, lang) as lang")
    assert {r.lang for r in langid.keep_known(some).filter("doc_id = 1").collect()} == {"en"}


def test_pii(docs, none):
    out = pii.pseudonymised(docs, "k", count="n_values")
    assert out.columns == [*docs.columns, "n_values"] and out.filter("n_values > 0").count() == 0
    assert keyed(out.drop("n_values")) == keyed(docs)
    assert pii.pseudonymised(none, "k").count() == 0


def test_substrings(docs, none):
    rows = substrings.remove_repeats(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.n_words, r.n_removed))
    n = len(PROSE.split())
    assert by[1] == [(n, 0)] and by[2] == [(n, n)] * 2 and by[3] == by[4] == by[7] == [(0, 0)]
    assert sorted(by[9]) == [(6, 0), (n + 2, n)] and by[6] == [(1, 0)] and by[5] == [(60_000, 0)]
    assert sorted(by[None]) == [(0, 0), (n, 0)]
    assert [r.kept_text for r in rows if r.n_words == n + 2] == ["before after"]
    assert substrings.remove_repeats(none).count() == 0


def test_html(spark, docs):
    pages = docs.selectExpr("doc_id as page_id", "source as url", "concat('<p>', text) as html", "id", "n")
    rows = html_text.main_text(pages).collect()
    assert len(rows) == len(TEXTS)
    assert all(r.text == "" and r.n_chars == 0 for r in rows if r.page_id in (3, 4, 7))
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_simhash(docs, none):
    rows = simhash.near_groups(docs).collect()
    assert len(rows) == len(TEXTS)
    by = {(r.doc_id, r.fingerprint): r.component_id for r in rows}
    assert {v for (k, f), v in by.items() if f == "0" * 16} == {3}
    prose = next(f for k, f in by if k == 1)
    assert by[1, prose] == by[2, prose] == by[None, prose] == 1
    assert simhash.near_groups(none).count() == 0
    kept = simhash.drop_near(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids.count(9) == 2 and 1 in ids and 2 not in ids and 3 in ids and 4 not in ids


def test_exact(docs, none):
    rows = exact.exact_groups(docs).collect()
    assert len(rows) == len(TEXTS)
    prose = [r for r in rows if r.text_sha256 == hashlib.sha256(PROSE.encode()).hexdigest()]
    assert {(r.keep_id, r.group_size) for r in prose} == {(2, 4)}
    assert sorted((r.doc_id or 0, r.kept) for r in prose) == [(0, False), (1, False), (2, False), (2, True)]
    empty = [r for r in rows if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert {(r.keep_id, r.group_size) for r in empty} == {(4, 3)}
    assert exact.exact_groups(none).count() == 0
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows)


def test_stages_keep_columns(spark, docs, none):
    frame = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, "")
        assert frame.columns == docs.columns
        assert stage(spark, none, "").count() == 0


def test_pipeline_without_labels_or_rows(spark, docs, tmp_path):
    plain = docs.select("doc_id", "text", "source", "n_chars").withColumn("lang", docs.source)
    for name, frame in (("unlabelled", plain), ("empty", plain.limit(0))):
        frame.write.parquet(str(tmp_path / name / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert (len(out) > 0) == (name == "unlabelled")
        if out:
            assert {r.doc_id for r in out} == {2, 5, 6, 9}  # prose: its greatest id, whatever its case
