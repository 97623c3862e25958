"""SimHash near-dedup: fingerprints that differ in few bits share blocks, so they meet in equi-joins.

The 64 bits are cut into six blocks. Fingerprints that differ in two bits or fewer agree in at
least four blocks, so they agree on one of the 15 choices of four blocks: joining on those finds
every close pair, and the Hamming distance of each pair found is then verified. Equal fingerprints
are one node, whatever their number. Where very many different fingerprints agree on four blocks,
pairs are not listed: each of them is sent to itself and its 64 neighbours at one bit, and two
fingerprints meet there exactly if they differ in two bits or fewer.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from xxhash import xxh64_intdigest

from paperquay.llm.common import added, components, renamed, restored, written
from paperquay.session import cut_lineage

MAX_BITS = 2
WIDTHS = (11, 11, 11, 11, 10, 10)
#: From so many fingerprints in one block key on, neighbours at one bit replace the pairs.
DENSE = 64
#: Shingle hashes whose bits are counted at once.
STEP = 1 << 15


def simhash(text: bytes, width: int) -> int:
    """64-bit SimHash of the ``width``-word shingles of a text, as an unsigned number."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    hashes = np.fromiter((xxh64_intdigest(x, 42) for x in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), STEP):
        part = hashes[i : i + STEP].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def with_simhash(docs: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """``docs`` with ``__fp``, the SimHash of every whole text (null: empty), as a signed long."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhash(x or b"", width) for x in batch.column(text).cast(pa.binary()).to_pylist()]
            yield batch.append_column("__fp", pa.array(np.array(found, np.uint64).view(np.int64)))

    return docs.mapInArrow(add, added(docs.schema, __fp=T.LongType()))


def block_keys(fp: Column) -> Column:
    """The 15 keys of a fingerprint: (number of the choice, bits of its four blocks)."""
    masks, low = [], 0
    for width in WIDTHS:
        masks.append(((1 << width) - 1) << low)
        low += width
    chosen = [sum(x) for x in combinations(masks, len(WIDTHS) - MAX_BITS)]
    signed = [x - (1 << 64) if x >> 63 else x for x in chosen]
    return F.array(*(F.struct(F.lit(i).alias("choice"), fp.bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(signed)))


def links(nodes: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between the different fingerprints of ``nodes`` (column ``fp``).

    Every pair at two bits or fewer is linked directly or, in dense blocks, through a third one.
    """
    keyed = nodes.select("fp", F.explode(block_keys(F.col("fp"))).alias("k")).select("fp", "k.choice", "k.bits")
    sizes = keyed.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = cut_lineage(keyed.join(sizes, ["choice", "bits"]))
    few = shared.filter(F.col("n") <= DENSE).select("choice", "bits", "fp")
    pairs = few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), ["choice", "bits"]).filter("a < b")
    close = pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).select("a", "b")
    flips = [0, *(1 << i for i in range(63)), -(1 << 63)]
    many = shared.filter(F.col("n") > DENSE).select("fp").distinct()
    near = many.select("fp", F.explode(F.array(*(F.col("fp").bitwiseXOR(F.lit(x)) for x in flips))).alias("at"))
    middle = cut_lineage(near.groupBy("at").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low < high"))
    met = near.join(middle, "at").select(F.col("low").alias("a"), F.col("fp").alias("b")).filter("a < b")
    return close.unionByName(met).distinct()


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """One row per document: ``key, fingerprint, component_id``.

    ``fingerprint`` is 16 hex digits; ``component_id`` is the smallest key that links reach, the
    row's own included. A text of fewer than ``width`` words is one shingle, one without words has
    fingerprint zero and links like any other; null keys never become an id unless there is none
    else; repeated rows stay; an empty table gives an empty result.
    """
    plain = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    rows = written(with_simhash(plain, "text", width).select("id", F.col("__fp").alias("fp")), "simhash")
    nodes = written(rows.groupBy("fp").agg(F.min("id").alias("low")), "simhash-nodes")
    labels = components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    named = nodes.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    lowest = cut_lineage(named.groupBy("label").agg(F.min("low").alias("component_id")))
    of = cut_lineage(named.join(lowest, "label").select("fp", "component_id"))
    return rows.join(of, "fp").select(
        F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest key; all columns stay.

    Of several rows with that key and fingerprint, one stays.
    """
    rows, id_, body = renamed(docs, key, text)
    groups = near_groups(docs, key, text, width).filter(F.col(key).eqNullSafe(F.col("component_id")))
    stay = groups.select(F.col(key).alias("id"), F.col("fingerprint").alias("f")).distinct()
    rows = with_simhash(rows, body, width).withColumn("hex", F.lower(F.lpad(F.hex("__fp"), 16, "0")))
    match = F.col(id_).eqNullSafe(F.col("id")) & (F.col("hex") == F.col("f"))
    one = W.partitionBy("hex", id_).orderBy("__fp")
    return restored(rows.join(stay, match, "left_semi").withColumn("n", F.row_number().over(one)).filter("n = 1"), docs)
