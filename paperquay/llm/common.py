"""Helpers that the operators of this package share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from paperquay.session import cut_lineage, run_dir

#: ASCII white space: space and U+0009 to U+000D. What lies between is a word.
SPACE = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a parquet table in the shared folder: one evaluation, and later readers prune columns."""
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def added(schema: T.StructType, **columns: T.DataType) -> T.StructType:
    """``schema`` with further columns at its end."""
    return T.StructType([*schema.fields, *(T.StructField(k, v) for k, v in columns.items())])


def renamed(docs: DataFrame, *names: str) -> tuple[DataFrame, ...]:
    """``docs`` with columns c0, c1, ... and the new names of ``names``.

    Working columns can then have any name; ``restored`` gives the old names back.
    """
    return (docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), *(f"c{docs.columns.index(n)}" for n in names))


def restored(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from a frame made of its renamed form, under their own names."""
    return df.select(*(f"c{i}" for i in range(len(docs.columns)))).toDF(*docs.columns)


def parallelism(spark: SparkSession) -> int:
    """Number of partitions that shuffles are given."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: Column) -> Column:
    """Words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def components(edges: DataFrame) -> DataFrame:
    """Connected components: ``(node, label)`` with the smallest node of each component as label.

    ``edges`` has two long columns ``a`` and ``b``; nodes without an edge are not returned. Each
    round takes the smallest label among a node's neighbours, hooks it onto the node and onto the
    node's present label, and then follows labels one step, so paths shrink by halves. A round is
    joins and a minimum with map-side combine, and its labels are written to reliable storage.
    """
    pairs = edges.select("a", "b").filter("a <> b")
    links = cut_lineage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    before = None
    while (now := _checksum(labels)) != before:
        before = now
        theirs = labels.select(F.col("node").alias("b"), F.col("label").alias("low"))
        own = labels.select(F.col("node").alias("a"), F.col("label").alias("root"))
        seen = links.join(theirs, "b").join(own, "a").filter("low < root")
        hooks = seen.select(F.explode(F.array("a", "root")).alias("node"), F.col("low").alias("label"))
        best = labels.unionByName(hooks).groupBy("node").agg(F.min("label").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        labels = cut_lineage(best.join(up, "label", "left").select("node", F.least("label", "up").alias("label")))
    return labels


def _checksum(labels: DataFrame) -> tuple:
    """Labels only ever get smaller, so an equal sum means equal labels."""
    return tuple(labels.agg(F.count(F.lit(1)), F.sum(F.col("label").cast("decimal(38,0)"))).first())


#: Bytes from which a piece of a joined text is closed.
PIECE_BYTES = 1 << 20


def pieces_of(rows: DataFrame, keys: list[str], part: Column, order: list[str], text: str, sep: str) -> DataFrame:
    """``keys, part, piece, body``: the texts of each key and ``part``, joined in ``order``.

    ``part`` is a number that follows the order, so a key with very many rows is joined in as many
    tasks as it has parts. A piece is closed at about a megabyte.
    """
    parts = [*keys, "part"]
    placed = rows.withColumn("part", part).repartition(*parts).sortWithinPartitions(*parts, *order)
    return joined_pieces(placed.select(*parts, F.encode(text, "UTF-8").alias("body")), sep)


def joined_pieces(placed: DataFrame, sep: str) -> DataFrame:
    """``pieces_of`` for rows (keys, part, body) that are together and in order in their partitions."""
    mark = sep.encode()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, held, size = None, 0, [], 0
        for batch in batches:
            out: list[tuple] = []
            *names, bodies = (c.to_pylist() for c in batch.columns)
            for *key, body in zip(*names, bodies, strict=True):
                if key != now or size >= PIECE_BYTES:
                    if held:
                        out.append((*now, number, mark.join(held)))
                    now, number, held, size = key, number + 1, [], 0
                held.append(body)
                size += len(body)
            if out:
                yield batch_of(out, schema)
        if held:
            yield batch_of([(*now, number, mark.join(held))], schema)

    kinds = T.StructType([*placed.schema.fields[:-1], T.StructField("piece", T.LongType()), T.StructField("body", T.BinaryType())])
    schema = to_arrow_schema(kinds)
    return placed.mapInArrow(join, kinds)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """An Arrow batch of at least one row."""
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def digests_of(pieces: DataFrame, keys: list[str], sep: str) -> DataFrame:
    """``keys, sha256``: lower-case digest of each key's pieces in order, with ``sep`` between them.

    SHA-256 is sequential, so one task reads all pieces of a key; it holds one of them at a time.
    """
    mark = sep.encode()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        for batch in batches:
            out: list[tuple] = []
            *names, bodies = (c.to_pylist() for c in batch.columns)
            for *key, body in zip(*names, bodies, strict=True):
                if key == now:
                    state.update(mark)
                else:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                state.update(body)
            if out:
                yield batch_of(out, schema)
        if now is not None:
            yield batch_of([(*now, state.hexdigest())], schema)

    placed = pieces.repartition(*keys).sortWithinPartitions(*keys, "part", "piece").select(*keys, "body")
    kinds = T.StructType([*(placed.schema[c] for c in keys), T.StructField("sha256", T.StringType())])
    schema = to_arrow_schema(kinds)
    return placed.mapInArrow(digest, kinds)
