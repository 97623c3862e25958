"""Structured Streaming over status and log events.

What is known of a document lives in Spark's state store (RocksDB), so a batch costs what it
touches, and a replayed batch starts from the state it started from before. Events of a document
are ordered by time, then by id. An event that is not newer than the document's state is late (or
comes again): it changes nothing and gives no output. Output is written per batch and overwritten
when a batch is replayed; depth and session counts are sums of signed changes.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ACTIVE = ["QUEUED", "PROCESSING"]
LATEST = "doc_id bigint, event_id bigint, ts timestamp, status string, line string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: An event as the state holds it; ``at`` is microseconds.
HELD = "at bigint, event_id bigint, status string, line string"


def event_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Events of the parquet files that appear in a folder.

    Batches must bring the events of a document in order, so files limit a batch only where they
    are written one after the other.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_stream(found: DataFrame, root: str, reduce: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over what is available; the outputs of all batches, with their ``batch`` number.

    ``reduce`` is applied to what a batch gives before it is written. A restart with the same
    ``root`` goes on where the last run stopped.
    """
    spark = found.sparkSession

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        out = reduce(batch) if reduce else batch
        out.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:  # a query keeps the settings it was started with
        query = (
            found.writeStream.outputMode("update").foreachBatch(on_batch)
            .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        )
    finally:
        spark.conf.set(PROVIDER, before)
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out")


def state_of(spark: SparkSession, root: str, name: str) -> DataFrame:
    """What the state store holds after the last batch: ``doc_id`` and the event's columns."""
    held = spark.read.format("statestore").option("stateVarName", name).load(f"{root}/checkpoint")
    value = "list_element" if "list_element" in held.columns else "value"
    event = held.select("key.doc_id", f"{value}.*")
    return event.select("doc_id", "event_id", F.timestamp_micros("at").alias("ts"), "status", "line")


def latest(events: DataFrame) -> DataFrame:
    """Newest event per document; works on a batch, and on a stream in update mode."""
    newest = F.max_by(F.struct("event_id", "ts", "status", "line"), F.struct("ts", "event_id"))
    return events.groupBy("doc_id").agg(newest.alias("e")).select("doc_id", "e.*")


def run_latest(stream: DataFrame, root: str) -> DataFrame:
    """Newest event per document of a stream: Spark's own aggregation, read back from its state."""
    run_stream(latest(stream), root, lambda batch: batch.agg(F.count(F.lit(1)).alias("documents")))
    held = stream.sparkSession.read.format("statestore").load(f"{root}/checkpoint")
    newest = held.schema["value"].dataType.names[0]  # max_by keeps the event first, then its place
    return held.select("key.doc_id", f"value.`{newest}`.*")


def _keyed(stream: DataFrame):
    events = stream.select("doc_id", F.unix_micros("ts").alias("at"), "event_id", "status", "line")
    return events.filter("at is not null and event_id is not null").groupBy("doc_id")


def _place(event) -> tuple[int, int]:
    return event[0], event[1]


def _event(row: Row) -> tuple:
    return row.at, row.event_id, row.status, row.line


class _Newest(StatefulProcessor):
    """Keeps the newest event of each document."""

    def init(self, handle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", HELD)

    def close(self) -> None:
        pass


class _Changes(_Newest):
    """One row for each document whose newest event changes: the status before and now."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.newest.get()
        now = max(map(_event, rows), key=_place)
        if before is None or _place(now) > _place(before):
            self.newest.update(now)
            yield Row(doc_id=key[0], was=before[2] if before else None, now=now[2], first=before is None)


class _Accepted(_Newest):
    """QUEUED events of documents that neither wait nor run.

    The events that a batch has of one document are put in order in memory.
    """

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = self.newest.get()
        for event in sorted(map(_event, rows), key=_place):
            if now is not None and _place(event) <= _place(now):
                continue
            if event[2] == "QUEUED" and (now is None or now[2] not in ACTIVE):
                yield Row(doc_id=key[0], event_id=event[1], at=event[0])
            now = event
        self.newest.update(now)


class _Silences(_Newest):
    """Silences longer than the budget: ``lasting`` when a timer runs out, ``ended`` when the document speaks again.

    No silence lies between two events of one slice of time as long as the budget, so only the
    first and the last event of a slice are held, however much a document says.
    """

    def __init__(self, budget_us: int) -> None:
        self.budget = budget_us

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if key[0] is None:
            return
        now = before = self.newest.get()
        slices: dict[int, tuple] = {}
        for event in map(_event, rows):
            if event[0] is None or event[1] is None:
                continue
            if before is None or _place(event) > _place(before):
                low, high = slices.get(event[0] // self.budget, (event, event))
                slices[event[0] // self.budget] = min(low, event, key=_place), max(high, event, key=_place)
        for n in sorted(slices):
            low, high = slices[n]
            if now is not None and low[0] - now[0] > self.budget:
                yield Row(doc_id=key[0], event_id=low[1], kind="ended", since=now[0], since_event=now[1], idle_s=low[0] / 1e6 - now[0] / 1e6)
            now = high
        if now is not before:
            if before is not None:
                self.handle.deleteTimer(self._due(before))
            self.handle.registerTimer(self._due(now))
            self.newest.update(now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = self.newest.get()
        yield Row(doc_id=key[0], event_id=None, kind="lasting", since=now[0], since_event=now[1], idle_s=None)

    def _due(self, event) -> int:
        return (event[0] + self.budget) // 1000


class _Tail(StatefulProcessor):
    """Keeps the newest lines of each document."""

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle) -> None:
        self.tail = handle.getListState("tail", HELD)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = {_place(x): x for x in self.tail.get()}
        n = 0

        def fresh() -> Iterator[tuple]:
            nonlocal n
            for event in map(_event, rows):
                n += 1
                if _place(event) not in held:
                    yield event

        kept = heapq.nlargest(self.keep, (x for part in (held.values(), fresh()) for x in part), key=_place)
        self.tail.put(kept)
        yield Row(doc_id=key[0], lines=n)

    def close(self) -> None:
        pass


class _Placed(StatefulProcessor):
    """Keeps the newest status and the newest session of each document; one row if either changes."""

    def init(self, handle) -> None:
        # One state for both: each state that is asked or told costs a round trip per document.
        self.placed = handle.getValueState("placed", "at bigint, id bigint, status string, moved_at bigint, move_id bigint, session_id string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = tuple(self.placed.get() or (None,) * 6)
        was = now = {m: side if side[0] is not None else None for m, side in ((False, held[:3]), (True, held[3:]))}
        # By position: looking fields up by name takes most of the time of a row.
        for _, at, no, status, session_id, moves in rows:
            newest = now[moves]
            if newest is None or (at, no) > newest[:2]:
                now = now | {moves: (at, no, session_id if moves else status)}
        if now is not was:
            self.placed.update(sum(((now[m] or (None,) * 3) for m in (False, True)), ()))
        old, new = ([side[m][2] if side[m] else None for m in (True, False)] for side in (was, now))
        if old != new:
            yield Row(was_session=old[0], was=old[1], now_session=new[0], now=new[1])

    def close(self) -> None:
        pass


def status_changes(stream: DataFrame) -> DataFrame:
    """``doc_id, was, now, first`` for each document whose newest event changes."""
    return _keyed(stream).transformWithState(_Changes(), "doc_id bigint, was string, now string, first boolean", "Update", "None")


def _gain(status: str):
    """How many documents more have a status after the changes."""
    return F.count_if(F.col("now") == status) - F.count_if(F.col("was") == status)


def run_queue_depth(stream: DataFrame, root: str) -> DataFrame:
    """How many documents wait and how many run at the end; one row of changes is kept per batch."""
    gains = {"queued": _gain("QUEUED"), "processing": _gain("PROCESSING")}
    out = run_stream(status_changes(stream), root, lambda batch: batch.agg(*(v.alias(k) for k, v in gains.items())))
    return out.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in gains))


def session_changes(stream: DataFrame, moves: DataFrame) -> DataFrame:
    """``was_session, was, now_session, now`` for each document whose newest status or newest session changes."""
    events = stream.select("doc_id", F.unix_micros("ts").alias("at"), F.col("event_id").alias("id"), "status", F.lit(None).cast("string").alias("session_id"), F.lit(False).alias("moves"))
    placed = moves.select("doc_id", F.unix_micros("ts").alias("at"), F.col("move_id").alias("id"), F.lit(None).cast("string").alias("status"), "session_id", F.lit(True).alias("moves"))
    both = events.unionByName(placed).filter("doc_id is not null and at is not null and id is not null")
    schema = "was_session string, was string, now_session string, now string"
    return both.groupBy("doc_id").transformWithState(_Placed(), schema, "Update", "None")


def run_session_counts(stream: DataFrame, moves: DataFrame, root: str) -> DataFrame:
    """Documents by status per session at the end; sessions without any are left out.

    ``moves`` is a stream of doc_id, move_id, ts, session_id: the newest move says where a document
    is (null: in no session). A document counts once it has a session and a status, in whatever
    order they come, and a moved one leaves the counts of its old session.
    """
    from paperquay.operators.documents import BUCKETS

    def reduce(batch: DataFrame) -> DataFrame:
        sides = F.inline(F.array(
            F.struct(F.col("was_session").alias("session_id"), F.col("was").alias("status"), F.lit(-1).alias("n")),
            F.struct(F.col("now_session").alias("session_id"), F.col("now").alias("status"), F.lit(1).alias("n")),
        ))
        counts = {s.lower(): F.sum(F.when(F.col("status") == s, F.col("n")).otherwise(0)) for s in BUCKETS}
        held = batch.select(sides).filter("session_id is not null and status is not null")
        return held.groupBy("session_id").agg(F.sum("n").alias("total"), *(v.alias(k) for k, v in counts.items()))

    out = run_stream(session_changes(stream, moves), root, reduce)
    names = [c for c in out.columns if c not in ("session_id", "batch")]
    return out.groupBy("session_id").agg(*(F.sum(k).alias(k) for k in names)).filter("total > 0")


def run_enqueue_dedupe(stream: DataFrame, root: str) -> DataFrame:
    """Accepted requests, i.e. QUEUED events of documents that neither wait nor run.

    An ignored request changes nothing, and it only comes while a document is active, so the
    event before tells whether the document is active.
    """
    found = _keyed(stream).transformWithState(_Accepted(), "doc_id bigint, event_id bigint, at bigint", "Update", "None")
    return run_stream(found, root).select("doc_id", "event_id", F.timestamp_micros("at").alias("ts"))


def run_idle_watchdog(stream: DataFrame, budget_s: float, root: str, late: str = "0 seconds") -> DataFrame:
    """Silences of documents longer than the budget.

    ``ended`` rows come when a document speaks again (``event_id``, and ``since_event`` before it),
    ``lasting`` rows when event time has passed a document's last event by the budget. Rows
    without a doc_id only move the time. Events that come more than ``late`` behind are left out.
    """
    # Rows without a document are not filtered here: Spark would drop them before they move the time.
    keyed = stream.withWatermark("ts", late).select("doc_id", "ts", F.unix_micros("ts").alias("at"), "event_id", "status", "line").groupBy("doc_id")
    schema = "doc_id bigint, event_id bigint, kind string, since bigint, since_event bigint, idle_s double"
    found = keyed.transformWithState(_Silences(int(budget_s * 1_000_000)), schema, "Update", "EventTime")
    return run_stream(found, root).withColumn("since", F.timestamp_micros("since"))


def stalled(silences: DataFrame, now, budget_s: float) -> DataFrame:
    """Documents whose silence has not ended and is longer than the budget at ``now``."""
    ended = silences.filter("kind = 'ended'").select("doc_id", "since_event")
    lasting = silences.filter("kind = 'lasting'").join(ended, ["doc_id", "since_event"], "left_anti")
    gap = now.cast("double") - F.col("since").cast("double")
    return lasting.select("doc_id", F.col("since_event").alias("event_id"), gap.alias("idle_s")).filter(F.col("idle_s") > budget_s)


def run_tail(stream: DataFrame, root: str, keep: int = 500) -> DataFrame:
    """The newest ``keep`` lines of each document."""
    found = _keyed(stream).transformWithState(_Tail(keep), "doc_id bigint, lines bigint", "Update", "None")
    run_stream(found, root, lambda batch: batch.agg(F.sum("lines").alias("lines")))
    return state_of(stream.sparkSession, root, "tail")
