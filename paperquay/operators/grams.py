"""Substring search that reads only the blocks of rows whose texts hold every gram of what is looked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperquay.operators.filters import search_filter
from paperquay.session import stored

GRAM = 3
# Characters after which long texts of the tests go on.
PIECE = 512


def _grams(text: Column) -> Column:
    """The different grams of a text, in one pass: each match is one character and looks at a gram from there on."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(.{%d}))." % GRAM), F.lit(1)))


class TextIndex:
    """Rows in blocks that follow ``order``, and the lower-cased grams that texts of a block hold in ``columns``.

    Rows are written once, a folder per block; grams are a table (gram, block) sorted by gram, so
    that a search reads only those of its own grams. The driver gets at most one number per block
    (``blocks``: eight for each shuffle partition unless given). Nulls hold nothing; later changes of the rows are not seen.
    """

    def __init__(self, df: DataFrame, columns: Sequence[str], order: Sequence[Column], blocks: int | None = None) -> None:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.names, self.columns, self.blocks = df.columns, list(columns), blocks or 8 * parts
        placed = df.repartitionByRange(self.blocks, *order).withColumn("__block", F.spark_partition_id())
        self.rows = stored(placed, "texts", "__block")
        text = F.explode(F.array(*(F.lower(F.col(c).cast("string")) for c in self.columns)))
        held = self.rows.select("__block", text.alias("text")).filter(F.length("text") >= GRAM)
        held = held.select("__block", F.explode(_grams(F.col("text"))).alias("gram")).distinct()
        self.grams = stored(held.repartitionByRange(parts, "gram").sortWithinPartitions("gram"), "grams")

    def may_hold(self, text: str) -> list[int] | None:
        """Blocks that hold every gram of a text; None (any block) if it is shorter than a gram."""
        q = text.strip().lower()
        wanted = sorted({q[i : i + GRAM] for i in range(len(q) - GRAM + 1)})
        if not wanted:
            return None
        found = self.grams.filter(F.col("gram").isin(wanted)).groupBy("__block").agg(F.count(F.lit(1)).alias("n"))
        return [r["__block"] for r in found.filter(F.col("n") == len(wanted)).collect()]

    def search(self, text: str) -> DataFrame:
        """Rows with the trimmed text in any of the columns, in any case; blank text keeps all."""
        blocks = self.may_hold(text)
        rows = self.rows if blocks is None else self.rows.filter(F.col("__block").isin(blocks))
        return rows.filter(search_filter(text, self.columns)).select(*self.names)
