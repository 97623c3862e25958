"""Answers of documents: pivoting, best answer over chunks, overrides, the answering plug-in."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperquay.functions.json_cols import ANSWERS
from paperquay.functions.numbers import half_up
from paperquay.functions.text import word_chunks

PENDING = ["QUEUED", "SCANNING", "PROCESSING"]


def pivot_answers(docs: DataFrame, answers: Column, columns: Sequence[str]) -> DataFrame:
    """One answer and one score column per session column, as shown in a grid."""
    pending = F.col("status").isin(PENDING)
    out = []
    for key in columns:
        got = F.try_element_at(answers, F.lit(key))
        text, score = F.coalesce(got["answer"], F.lit("")), F.coalesce(got["score"], F.lit(0.0))
        out.append(F.when(pending, "pending…").when(text == "", "—").otherwise(text).alias(key))
        out.append(F.when(~pending & (score > 0), half_up(score * 100)).alias(f"{key}_pct"))
    return docs.select("doc_id", "status", *out)


def best_answer(chunks: DataFrame) -> DataFrame:
    """Per (doc_id, key) the answer of the highest score, of the first chunk on a tie; ("", 0) if none scores."""
    rank = F.struct(F.col("score"), -F.col("chunk_no"))
    best = chunks.groupBy("doc_id", "key").agg(F.max_by(F.struct("answer", "score"), rank).alias("b"))
    good = F.coalesce(F.col("b.score"), F.lit(0.0)) > 0
    return best.select(
        "doc_id", "key",
        F.when(good, F.col("b.answer")).otherwise("").alias("answer"),
        F.when(good, F.round("b.score", 6)).otherwise(0.0).alias("score"),
    )


Answerer = Callable[[str, list[Mapping[str, str]]], Mapping[str, Mapping[str, object]]]


def label_lines(context: str, columns: list[Mapping[str, str]]) -> dict[str, dict[str, object]]:
    """Built-in answerer: the text after "label:" or "key:" at a line start."""
    out = {}
    for col in columns:
        for name in (col.get("label"), col.get("key")):
            hit = name and re.search(rf"(?im)^\s*{re.escape(name)}\s*:[ \t]*(\S.*)$", context)
            if hit:
                out[col["key"]] = {"answer": hit.group(1).strip(), "score": 1.0}
                break
    return out


def ask(docs: DataFrame, columns: Sequence[Mapping[str, str]], answerer: Answerer = label_lines) -> DataFrame:
    """Answer all columns for every (doc_id, context): doc_id, answers map JSON, error.

    The answerer runs per Arrow batch on the executors. Missing keys are filled; a failure of
    one document gives an error text for it and empty answers.
    """
    cols = [dict(c) for c in columns]

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found, errors = [], []
            for text in pdf["context"]:
                error, got = None, {}
                try:
                    got = answerer(text or "", cols)
                except Exception as exc:  # a plug-in may fail in any way
                    error = f"{type(exc).__name__}: {exc}"
                full = {c["key"]: got.get(c["key"], {"answer": "", "score": 0.0}) for c in cols}
                found.append(json.dumps(full, ensure_ascii=False))
                errors.append(error)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "answers": found, "error": errors})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "context").mapInPandas(batches, f"doc_id {kind}, answers string, error string")


def ask_texts(
    docs: DataFrame, columns: Sequence[Mapping[str, str]], answerer: Answerer = label_lines, text: str = "full_text", words: int = 850, overlap: int = 120
) -> DataFrame:
    """Best answer to each column over the whole text of each document: doc_id, key, answer, score, error.

    A text is cut into overlapping word windows, each of them is asked for itself, and the best
    answer wins (``best_answer``); so a long text is spread over tasks. ``error`` is that of the first
    window that failed, if any; the others still answer. A null text is asked as an empty one.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    chunks = docs.select("doc_id", F.posexplode(word_chunks(whole, words, overlap)).alias("chunk_no", "context"))
    spread = chunks.repartition("doc_id", "chunk_no").withColumn("doc_id", F.struct("doc_id", "chunk_no"))
    asked = ask(spread, columns, answerer).select("doc_id.doc_id", "doc_id.chunk_no", "answers", "error")
    found = asked.select("doc_id", "chunk_no", "error", F.explode(F.from_json("answers", ANSWERS)).alias("key", "a"))
    best = best_answer(found.select("doc_id", "chunk_no", "key", "a.answer", "a.score"))
    errors = found.groupBy("doc_id", "key").agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("chunk_no"))).alias("error"))
    return best.join(errors, ["doc_id", "key"])
