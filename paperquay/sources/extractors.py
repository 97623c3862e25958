"""Registry of text extractors that run on the executors, per Arrow batch or as a table function."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

Extractor = Callable[[bytes], dict]

RESULT = (
    "path string, full_text string, markdown string, "
    "blocks array<struct<text:string,block_type:string,page:int,confidence:double,bbox:struct<x1:int,y1:int,x2:int,y2:int>>>, "
    "tables array<struct<table_id:string,rows:int,cols:int,cells:array<struct<row:int,col:int,text:string>>>>, "
    "avg_confidence double, processing_time double, page_count int, warnings array<string>, extra map<string,string>, error string"
)
BLOCK_KEYS = ["text", "block_type", "page", "confidence", "bbox"]
TABLE_KEYS = ["table_id", "rows", "cols", "cells"]


RESULT_COLUMNS = [
    "path", "full_text", "markdown", "blocks", "tables", "avg_confidence", "processing_time", "page_count", "warnings", "extra", "error",
]


def plain_text(content: bytes) -> dict:
    """Built-in extractor: UTF-8 text, one paragraph block per line."""
    text = content.decode("utf-8", errors="replace")
    blocks = [{"text": t, "block_type": "paragraph", "page": 1} for t in text.split("\n") if t.strip()]
    return {
        "full_text": text, "markdown": text, "blocks": blocks, "avg_confidence": 100.0, "page_count": 1, "warnings": [],
    }


EXTRACTORS: dict[str, Extractor] = {"plain_text": plain_text}


def register(name: str, extractor: Extractor) -> None:
    EXTRACTORS[name] = extractor


EMPTY = {
    "full_text": "", "markdown": "", "blocks": [], "tables": [], "avg_confidence": 0.0, "processing_time": 0.0, "page_count": 0, "warnings": [],
}


def outcome(extractors: Mapping[str, Extractor], engine: str | None, content: bytes | None) -> dict:
    """What an engine makes of a file: every field of RESULT but the path. Never fails; ``error`` says what went wrong."""
    try:
        if engine not in extractors:
            raise LookupError(f"Unknown model: {engine}")
        began = time.perf_counter()
        found = {"processing_time": None, **extractors[engine](bytes(content or b""))}
        if found["processing_time"] is None:
            found["processing_time"] = time.perf_counter() - began
        # What the result has beyond the schema is kept as text.
        extra = {k: str(found.pop(k)) for k in [*found] if k not in EMPTY}
        for name, keys in (("blocks", BLOCK_KEYS), ("tables", TABLE_KEYS)):
            found[name] = [{k: x.get(k) for k in keys} for x in found.get(name) or []]
        return {**EMPTY, **found, "extra": extra, "error": None}
    except LookupError as exc:
        if str(exc.args[0] if exc.args else "").startswith("Unknown model"):
            return {**EMPTY, "extra": {}, "error": exc.args[0]}
        return {**EMPTY, "extra": {}, "error": f"{type(exc).__name__}: {exc}"}
    except Exception as exc:  # a plug-in may fail in any way
        return {**EMPTY, "extra": {}, "error": f"{type(exc).__name__}: {exc}"}


def extract(files: DataFrame, engine: str) -> DataFrame:
    """Result row per file of (path, content); an unknown engine or a failure fills ``error``."""
    known = dict(EXTRACTORS)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [{"path": p, **outcome(known, engine, c)} for p, c in zip(pdf["path"], pdf["content"])]
            yield pd.DataFrame(found, columns=RESULT_COLUMNS)

    return files.select("path", "content").mapInPandas(batches, RESULT)


def register_table_function(spark: SparkSession, name: str = "extract_file") -> None:
    """A table function ``name(content, engine)`` for LATERAL joins, with the extractors known so far.

    It gives one row with the columns of RESULT but the path, so each file can name its own engine::

        select f.path, r.* from files f, lateral extract_file(f.content, f.engine) r
    """
    known, fields = dict(EXTRACTORS), RESULT_COLUMNS[1:]
    made = outcome  # as a value of its own, so that workers need nothing but this

    class ExtractFile:
        def eval(self, content: bytes, engine: str):
            found = made(known, engine, content)
            yield tuple(found[f] for f in fields)

    kind = RESULT.split(", ", 1)[1]
    spark.udtf.register(name, udtf(ExtractFile, returnType=kind))


def extract_each(files: DataFrame, engine: Column, name: str = "extract_file") -> DataFrame:
    """Result row per file of (path, content) by the engine that ``engine`` names for it, by the table function."""
    register_table_function(files.sparkSession, name)
    named = files.select("path", "content", engine.alias("engine"))
    return files.sparkSession.sql(f"select f.path, r.* from {{files}} f, lateral {name}(f.content, f.engine) r", files=named)


def as_results(extracted: DataFrame, processed_at: Column) -> DataFrame:
    """Extraction results in the shape that ``apply_results`` stores, for the documents that were registered by path."""
    return extracted.select(
        F.sha2("path", 256).alias("doc_id"), "error", "full_text", "markdown", F.to_json("blocks").alias("text_blocks"),
        F.to_json("tables").alias("ocr_tables"), F.to_json("extra").alias("extracted_json"), F.col("avg_confidence").alias("confidence"),
        "processing_time", "page_count", processed_at.alias("processed_at"), F.to_json("warnings").alias("warnings"),
    )
