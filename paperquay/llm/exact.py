"""Exact dedup: per-partition counting quotient filters, merged losslessly, then byte verification.

Texts are equal when they are identical after lower-casing A-Z only; a null text counts as empty.
Every partition builds a counting quotient filter over the fingerprints of its rows: the leading
bits of a fingerprint (the quotient) name a run, and the run holds the remaining bits in sorted
order, each with a counter. Quotient and remainder are the whole fingerprint, so filters of two
partitions merge run by run without loss. Only fingerprints counted more than once go on: their
texts are grouped by their bytes, which decides equality; a fingerprint alone never does.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from paperquay.llm.common import added, parallelism, renamed, restored, written

#: Parts into which rows of one fingerprint are dealt for the byte check, before AQE splits further.
SALTS = 8


@dataclass
class QuotientFilter:
    """Counting quotient filter: runs of sorted remainders, with a counter for each remainder."""

    quotients: np.ndarray  # of the runs, ascending
    lengths: np.ndarray  # of the runs
    remainders: np.ndarray  # all runs, one after the other
    counts: np.ndarray  # one for each remainder

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray, bits: int) -> QuotientFilter:
        """Filter of fingerprints (uint64, with repeats); ``bits`` is the width of the quotient."""
        values, place = np.unique(fingerprints, return_inverse=True)
        sums = np.bincount(place, weights=counts, minlength=len(values)).astype(np.int64)
        shift = np.uint64(64 - bits)
        quotients, lengths = np.unique(values >> shift, return_counts=True)
        return cls(quotients, lengths, values & ((np.uint64(1) << shift) - np.uint64(1)), sums)

    def fingerprints(self, bits: int) -> np.ndarray:
        return (np.repeat(self.quotients, self.lengths) << np.uint64(64 - bits)) | self.remainders

    def merge(self, other: QuotientFilter, bits: int) -> QuotientFilter:
        """Filter of both inputs together."""
        values = np.concatenate([self.fingerprints(bits), other.fingerprints(bits)])
        return QuotientFilter.of(values, np.concatenate([self.counts, other.counts]), bits)


def fingerprinted(docs: DataFrame, text: str = "text", normal: bool = False) -> DataFrame:
    """``docs`` with ``__fp`` (long) and ``__sha`` (hex SHA-256) of each normalised text.

    ``normal`` adds the normalised text itself as ``__norm``.
    """
    extra = {"__fp": T.LongType(), "__sha": T.StringType()} | ({"__norm": T.StringType()} if normal else {})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(x or b"").lower() for x in batch.column(text).cast(pa.binary()).to_pylist()]
            shas = [hashlib.sha256(x).digest() for x in texts]
            out = batch.append_column("__fp", pa.array((int.from_bytes(x[:8], "big", signed=True) for x in shas), pa.int64()))
            out = out.append_column("__sha", pa.array([x.hex() for x in shas], pa.string()))
            yield out.append_column("__norm", pa.array(texts, pa.binary()).cast(pa.string())) if normal else out

    return docs.mapInArrow(add, added(docs.schema, **extra))


def repeated_fingerprints(rows: DataFrame) -> DataFrame:
    """Fingerprints (column ``__fp``) that more than one row has, with their counts ``n``.

    A partition sends one filter for each range of quotients; the number of ranges follows the
    number of shuffle partitions, so a merging task holds its share of the fingerprints only.
    """
    shard_bits = max(4, math.ceil(math.log2(4 * parallelism(rows.sparkSession))))
    bits = min(shard_bits + 8, 32)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches if b.num_rows]
        if not parts:
            return
        found = np.concatenate(parts)
        whole = QuotientFilter.of(found, np.ones(len(found)), bits)
        shards = whole.quotients >> np.uint64(bits - shard_bits)
        ends = np.cumsum(whole.lengths)
        names, first = np.unique(shards, return_index=True)
        last = np.append(first[1:], len(shards))
        columns: dict[str, list] = {"shard": names.astype(np.int64).tolist(), "q": [], "l": [], "r": [], "c": []}
        for i, j in zip(first, last, strict=True):
            lo, hi = (0 if i == 0 else ends[i - 1]), ends[j - 1]
            columns["q"].append(whole.quotients[i:j].tobytes())
            columns["l"].append(whole.lengths[i:j].tobytes())
            columns["r"].append(whole.remainders[lo:hi].tobytes())
            columns["c"].append(whole.counts[lo:hi].tobytes())
        yield pa.RecordBatch.from_pydict(columns)

    def merge(filters: pa.Table) -> pa.Table:
        merged = None
        parts = [
            QuotientFilter(np.frombuffer(q, np.uint64), np.frombuffer(n, np.int64), np.frombuffer(r, np.uint64), np.frombuffer(c, np.int64))
            for q, n, r, c in zip(*(filters.column(x).to_pylist() for x in "qlrc"), strict=True)
        ]
        while len(parts) > 1:  # pairwise, so that every fingerprint takes part in log(number of filters) merges
            parts = [a[0].merge(a[1], bits) if len(a) == 2 else a[0] for a in (parts[i : i + 2] for i in range(0, len(parts), 2))]
        merged = parts[0]
        many = merged.counts > 1
        return pa.table({"__fp": merged.fingerprints(bits)[many].view(np.int64), "n": merged.counts[many]})

    filters = rows.select("__fp").mapInArrow(build, "shard long, q binary, l binary, r binary, c binary")
    return filters.groupBy("shard").applyInArrow(merge, "__fp long, n long")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest key stays. Null keys are smaller than any other; of
    rows equal in key and text exactly one is kept; an empty table gives an empty result; columns
    beside key and text play no part.
    """
    plain = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    slim = fingerprinted(plain).select("id", "__fp", "__sha")
    rows = written(slim.withColumn("row", F.monotonically_increasing_id()), "exact")  # numbers of rows last once written
    again = repeated_fingerprints(rows).select("__fp", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    texts = fingerprinted(plain, normal=True).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    # The salt keeps the join's partitioning apart from the grouping's, so AQE may split a hot fingerprint.
    groups = (
        texts.join(again, ["__fp", "salt"], "left_semi")
        .groupBy("__fp", "__sha", "__norm")
        .agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep_id"))
        .select("__fp", "__sha", "n", "keep_id")
    )
    lasts = rows.groupBy("__fp", "__sha").agg(F.max(F.struct("id", "row")).alias("last"), F.count(F.lit(1)).alias("times"))
    marked = groups.join(lasts.filter("times > 1").select("__fp", "__sha", "last.row"), ["__fp", "__sha"]).withColumnRenamed("row", "keep_row")
    out = rows.join(marked, ["__fp", "__sha"], "left")
    return out.select(
        F.col("id").alias(key),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("keep_row").isNull() | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that an equal text with a larger key replaces; all columns stay."""
    rows, id_, body = renamed(docs, key, text)
    kept = exact_groups(docs, key, text).filter("kept").select(F.col(key).alias("id"), F.col("text_sha256").alias("sha"))
    rows = fingerprinted(rows, body)
    match = F.col(id_).eqNullSafe(F.col("id")) & (F.col("__sha") == F.col("sha"))
    first = W.partitionBy("__sha", id_).orderBy("__fp")
    stay = rows.join(kept, match, "left_semi").withColumn("n", F.row_number().over(first)).filter("n = 1")
    return restored(stay, docs)
