"""Queue and log relations: order of arrival, log tails, idle gaps.

``events``: event_id, doc_id, ts, status, line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperquay.operators.ordered import block, carry_forward, global_rank


def arrival_order(events: DataFrame) -> DataFrame:
    """Every id once, with its place by first arrival."""
    first = events.groupBy("doc_id").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    return global_rank(first.select("doc_id", "at.ts"), [F.col("ts").asc(), F.col("doc_id").asc()], "place")


def queue_difference(queue: DataFrame, ids: DataFrame) -> DataFrame:
    return queue.join(ids.select("doc_id"), "doc_id", "left_anti")


def prune_deleted(queue: DataFrame, docs: DataFrame) -> DataFrame:
    """Queue entries whose document still exists; their ``place`` keeps the order."""
    return queue.join(docs.select("doc_id"), "doc_id", "left_semi")


def log_tail(events: DataFrame, keep: int = 500, doc_id: object | None = None, parts: int = 32) -> DataFrame:
    """The newest ``keep`` lines of each document, or of one.

    The limit is applied first within hash parts of a document (and there per map task, before the
    shuffle), then within the document: no task gets more than ``keep`` lines of each part.
    """
    d = events if doc_id is None else events.filter(F.col("doc_id") == F.lit(doc_id))
    w = W.partitionBy("doc_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    part = W.partitionBy("doc_id", "__part").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    d = d.withColumn("__part", F.pmod(F.xxhash64("event_id"), F.lit(parts)))
    d = d.withColumn("newest", F.row_number().over(part)).filter(F.col("newest") <= keep).drop("newest", "__part")
    return d.withColumn("newest", F.row_number().over(w)).filter(F.col("newest") <= keep)


def idle_gaps(events: DataFrame, budget_s: float = 60.0) -> DataFrame:
    """Silences longer than the budget: doc_id, the event before and after, seconds between.

    Assumes event_id grows with ts (an arrival number).
    """
    d = events.select("doc_id", "event_id", "ts")
    prev = carry_forward(
        d, ["doc_id"], ["event_id"], {"prev": F.struct("event_id", "ts")}, [block("event_id")], inclusive=False
    )
    gap = F.col("ts").cast("double") - F.col("prev.ts").cast("double")
    return prev.select(
        "doc_id", F.col("prev.event_id").alias("after_event"), "event_id", gap.alias("idle_s")
    ).filter(F.col("idle_s") > budget_s)
