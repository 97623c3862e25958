"""Packing: length buckets with the least padding, and token-budget batches inside each bucket.

The boundaries are chosen by dynamic programming over the histogram of the lengths of all rows.
Lengths up to 256 have a cell each; above, every doubling has 128 cells, so the histogram has a
few thousand cells whatever the lengths are. A cell knows its count, its sum and its greatest
length, so the padding of a bucket is exact, and boundaries are greatest lengths of cells.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paperquay.llm.common import SPACE, written

BUCKETS = 8
BUDGET = 16_384
#: Cells in each doubling of the length.
CELLS = 128
#: Rows that are numbered together, about.
BLOCK = 4_096


def boundaries(lengths: np.ndarray, counts: np.ndarray, sums: np.ndarray, buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` buckets with the least padding.

    ``lengths`` ascend; ``counts`` and ``sums`` are the rows and the sum of their lengths per cell.
    """
    n = len(lengths)
    rows, total = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(sums)]
    best = np.full(n + 1, np.inf)
    best[0] = 0
    choices = []
    for _ in range(min(buckets, n)):
        now, back = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (rows[j] - rows[:j]) - (total[j] - total[:j])
            back[j] = int(cost.argmin())
            now[j] = cost[back[j]]
        choices.append(back)
        best = now
        best[0] = np.inf
    ends, j = [], n
    for back in reversed(choices):
        ends.append(int(lengths[j - 1]))
        j = back[j]
    return sorted(ends)


def cell(length: Column) -> Column:
    """Histogram cell of a length; cells ascend with the length."""
    width = F.greatest(F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double"))).cast("int") - 7, F.lit(0))
    return width.cast("long") * 2 * CELLS + F.floor(length / F.pow(F.lit(2.0), width)).cast("long")


def n_words(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(f"[^{SPACE}]+")).cast("long")


def packed(
    docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, budget: int = BUDGET
) -> DataFrame:
    """``key, n_tokens, bucket, padded, batch, slot`` for every row.

    A row goes to the shortest bucket that holds it and is padded to ``padded`` tokens. A batch of
    a bucket holds as many rows as ``budget`` has room for, at least one: a row longer than the
    budget is a batch of its own. Only a bucket's last batch may have room left. Tokens are words;
    a null text has none, and rows without tokens share batches as if they had one. Rows equal in
    key and length are interchangeable. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = written(docs.select(F.col(key).alias("id"), n_words(text).alias("n_tokens")), "packing")
    cells = rows.groupBy(cell(F.col("n_tokens")).alias("cell")).agg(
        F.max("n_tokens").alias("top"), F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("sum")
    )
    found = sorted(tuple(x)[1:] for x in cells.collect())  # bounded: a few thousand cells
    if not found:
        return spark.createDataFrame([], f"`{key}` {rows.schema['id'].dataType.simpleString()}, n_tokens long, bucket int, padded long, batch long, slot long")
    tops, counts, sums = (np.array(x, np.int64) for x in zip(*found, strict=True))
    ends = boundaries(tops, counts, sums, buckets)
    bucket = F.lit(len(ends) - 1)
    for i in range(len(ends) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= ends[i], F.lit(i)).otherwise(bucket)
    padded = F.element_at(F.array(*(F.lit(x) for x in ends)), F.col("bucket") + 1).cast("long")
    blocks = -(-int(counts.sum()) // BLOCK)
    counted = rows.groupBy("id", "n_tokens").agg(F.count(F.lit(1)).alias("n"))
    # Equal rows are placed in pieces of a block at most, however many there are.
    pieces = counted.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / BLOCK).cast("int"))))
    pieces = pieces.withColumn("copies", F.least(F.col("n") - F.col("piece").cast("long") * BLOCK, F.lit(BLOCK)).cast("int"))
    placed = pieces.withColumn("bucket", bucket).withColumn("padded", padded)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id", "n_tokens", "piece"), F.lit(blocks)))
    before = W.partitionBy("bucket").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy("bucket", "block").agg(F.sum("copies").alias("n"))
    starts = starts.select("bucket", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = W.partitionBy("bucket", "block").orderBy("n_tokens", "id", "piece").rowsBetween(W.unboundedPreceding, -1)
    first = F.col("start") + F.coalesce(F.sum("copies").over(within), F.lit(0))
    ranked = placed.join(starts, ["bucket", "block"]).withColumn("first", first)
    ranked = ranked.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).withColumn("at", F.col("first") + F.col("copy"))
    room = F.greatest(F.floor(F.lit(budget) / F.greatest("padded", F.lit(1))), F.lit(1)).cast("long")
    return ranked.select(
        F.col("id").alias(key), "n_tokens", "bucket", "padded",
        F.floor(F.col("at") / room).cast("long").alias("batch"), (F.col("at") % room).alias("slot"),
    )
