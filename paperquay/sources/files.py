"""File listings, contents of listed files, registration of files as documents, folder watching, page texts."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperquay.operators.documents import extension

# File types that can be ingested.
SUPPORTED = [".jpg", ".jpeg", ".png", ".tiff", ".tif", ".bmp", ".pdf"]

BINARY_FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)

RAW_PAGES = "struct<rawPages:array<struct<page:bigint,text:string>>>"


def _listing(files: DataFrame, exts: Sequence[str]) -> DataFrame:
    """Listing columns; file contents are not selected, so they are never read."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        "path", name.alias("filename"), extension(name).alias("ext"), "length",
        F.col("modificationTime").alias("modified"),
    ).filter(F.col("ext").isin([e.lower() for e in exts]))


def _folder(spark: SparkSession, path: str) -> str | None:
    """The folder as Spark names it in paths of its files; null if only Spark's own reader knows the place."""
    from pyarrow.fs import FileType

    if any(c in path for c in "*?[{"):
        return None
    if "://" not in path and not path.startswith("file:"):
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
        path = os.path.abspath(path) if default.startswith("file:") else default.rstrip("/") + os.path.abspath(path)
    if path.startswith(("/", "file:")):
        path = "file:/" + path.removeprefix("file:").strip("/")
    try:
        fs, root = _at(path)
        return path.rstrip("/") if fs.get_file_info(root).type == FileType.Directory else None
    except (pa.ArrowException, OSError):
        return None


def _at(path: str):
    """File system and path in it of a path as Spark writes it."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    return (LocalFileSystem(), path.removeprefix("file:")) if path.startswith("file:") else FileSystem.from_uri(path)


def _names(folder: str) -> Iterator[str]:
    """Names in a folder; of a local one they are streamed."""
    from pyarrow.fs import FileSelector, LocalFileSystem

    fs, root = _at(folder)
    if isinstance(fs, LocalFileSystem):
        with os.scandir(root) as found:
            yield from (e.name for e in found)
    else:
        yield from (i.base_name for i in fs.get_file_info(FileSelector(root)))


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scan_files(spark: SparkSession, path: str, exts: Sequence[str] = SUPPORTED) -> DataFrame:
    """Regular files directly in a folder whose extension (in any case) is accepted.

    One task streams the names of the folder, and as many tasks as shuffles have look the files up, so the driver
    keeps nothing of a file. Names that start with a dot or underscore, and empty files, are left out as Spark does.
    Patterns, and places that Arrow can't reach, are listed by Spark's reader, in the driver.
    """
    folder = _folder(spark, path)
    if folder is None:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
        return _listing(files, exts)

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                for some in batched(_names(part), 10_000):
                    yield pa.record_batch([[f"{part}/{n}" for n in some]], names=["path"])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileType

        fs, _ = _at(folder)
        for batch in batches:
            paths = batch.column("path").to_pylist()
            infos = fs.get_file_info([_at(p)[1] for p in paths])
            there = [(p, i.mtime_ns // 1_000_000 * 1000, i.size) for p, i in zip(paths, infos) if i.type == FileType.File and i.size]
            cols = list(zip(*there)) or [(), (), ()]
            kinds = [pa.string(), pa.timestamp("us", "UTC"), pa.int64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["path", "modificationTime", "length"])

    one = spark.createDataFrame([(folder,)], "folder string").coalesce(1)
    name = F.element_at(F.split("path", "/"), -1)
    shown = ~F.startswith(name, F.lit(".")) & (~F.startswith(name, F.lit("_")) | F.contains(name, F.lit("=")))
    listed = one.mapInArrow(names, "path string").filter(shown & extension(name).isin([e.lower() for e in exts]))
    files = listed.repartition(_tasks(spark), "path").mapInArrow(look_up, "path string, modificationTime timestamp, length long")
    return _listing(files, exts)


def read_files(listing: DataFrame, path: str = "path") -> DataFrame:
    """Path and content of each listed file, read by as many tasks as shuffles have; a batch holds about 16 MB."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def some(paths: list[str], contents: list[bytes]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

        for batch in batches:
            paths, contents, size = [], [], 0
            for p in batch.column("path").to_pylist():
                fs, at = _at(p)
                with fs.open_input_stream(at) as f:
                    contents.append(f.read())
                paths.append(p)
                size += len(contents[-1])
                if size >= 1 << 24:
                    yield some(paths, contents)
                    paths, contents, size = [], [], 0
            yield some(paths, contents)

    listed = listing.select(F.col(path).alias("path"))
    return listed.repartition(_tasks(listing.sparkSession), "path").mapInArrow(read, "path string, content binary")


def register_files(listing: DataFrame, session_id: str | None, now: Column) -> DataFrame:
    """Queued document rows of a listing; the id follows from the path, so a retry gives the same."""
    return listing.select(
        F.sha2("path", 256).alias("doc_id"), "filename", F.col("path").alias("image_path"),
        F.lit("QUEUED").alias("status"), now.alias("created_at"), F.lit(session_id).cast("string").alias("session_id"),
        F.lit("AUTO").alias("extraction_type"), F.lit("").alias("notes"), F.lit("").alias("full_text"),
        F.lit(0.0).alias("confidence"), F.lit(0.0).alias("processing_time"), F.lit(0).alias("page_count"),
        F.lit("[]").alias("ocr_tables"), F.lit("[]").alias("warnings"), F.lit("{}").alias("extracted_row"),
        F.lit("{}").alias("extracted_json"), F.lit(True).alias("quality_valid"), F.lit(0).alias("dpi"),
        F.lit(0).alias("width"), F.lit(0).alias("height"), F.lit("[]").alias("quality_issues"),
        F.lit("").alias("markdown"), F.lit("[]").alias("text_blocks"), F.lit("[]").alias("tags"), F.lit("{}").alias("user_edits"),
        F.lit(0.0).alias("blur_score"), F.lit(0.0).alias("skew_angle"), F.lit("").alias("thumbnail_path"),
        F.lit("").alias("verified_by"), F.lit(None).cast("timestamp").alias("verified_at"),
        F.lit(None).cast("timestamp").alias("processed_at"), F.lit(False).alias("exported"), F.lit("").alias("export_path"),
    )


def watch_folder(
    spark: SparkSession, path: str, since: Column | None = None, exts: Sequence[str] = SUPPORTED, per_batch: int = 100_000
) -> DataFrame:
    """Stream of queued documents for files that appear in a folder.

    ``since`` leaves out what was there before. Files must be renamed into the folder when complete.
    A batch reads no contents, so it can be large; every batch looks through the names known so far.
    """
    files = (
        spark.readStream.format("binaryFile").schema(BINARY_FILE).option("maxFilesPerTrigger", per_batch).load(path)
    )
    listing = _listing(files, exts)
    if since is not None:
        listing = listing.filter(F.col("modified") >= since)
    return register_files(listing, None, F.col("modified"))


def read_page_text(docs: DataFrame) -> DataFrame:
    """One row per stored page of each document: doc_id, page, text."""
    pages = F.from_json("extracted_json", RAW_PAGES)["rawPages"]
    return docs.select("doc_id", F.explode(pages).alias("p")).select("doc_id", "p.page", "p.text")
