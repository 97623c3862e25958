"""Folder listings, contents and watching of folders with many files."""

from __future__ import annotations

from paperquay.sources import files as S


def test_a_batch_of_a_watched_folder_takes_many_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(1100):
        (tmp_path / "in" / f"f{i}.pdf").write_bytes(b"x")
    stream = S.watch_folder(spark, str(tmp_path / "in")).select("filename").coalesce(2)
    q = (
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    assert [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]] == [1100]
    got = [r[0] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted(f"f{i}.pdf" for i in range(1100))


def _odd_folder(folder):
    for name in ("a b.PDF", "_h=.pdf", "_h.pdf", ".h.pdf", "ü%20.pdf", "n.txt"):
        (folder / name).write_bytes(name.encode())
    (folder / "empty.pdf").write_bytes(b"")
    (folder / "sub").mkdir()
    (folder / "sub" / "s.pdf").write_bytes(b"x")
    (folder / "dir.pdf").mkdir()


def test_tasks_list_a_folder_as_spark_does(spark, tmp_path):
    _odd_folder(tmp_path)
    own = S._listing(spark.read.format("binaryFile").load(str(tmp_path)), S.SUPPORTED)
    for path in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}/"):
        listed = S.scan_files(spark, path)
        assert listed.schema == own.schema and sorted(listed.collect()) == sorted(own.collect())
        # The driver's file index would keep every file of the folder and below it.
        assert "binaryFile" not in listed._jdf.queryExecution().toString()
    assert {r.filename for r in S.scan_files(spark, f"{tmp_path}/*.PDF").collect()} == {"a b.PDF"}


def test_contents_of_listed_files(spark, tmp_path):
    _odd_folder(tmp_path)
    got = S.read_files(S.register_files(S.scan_files(spark, str(tmp_path)), "s", S.F.current_timestamp()), "image_path")
    assert {(r.path.rsplit("/", 1)[1], bytes(r.content)) for r in got.collect()} == {
        (n, n.encode()) for n in ("a b.PDF", "_h=.pdf", "ü%20.pdf")
    }
