"""Streaming queries: the event table arrives as a stream, is read until nothing is left, and the end state returned."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperquay.plans.registry import query
from paperquay.session import run_dir
from paperquay.streaming import status as T

LATEST_SQL = """select doc_id, arg_max(status, (ts, event_id)) as status, arg_max(line, (ts, event_id)) as line, max(ts) as ts,
  arg_max(event_id, (ts, event_id)) as event_id from v6 group by doc_id"""


def _in_rounds(lake, name, run, clock=None, moves=None):
    """``run(stream, root)`` after each of three rounds of new event files; the last result.

    The events of the table arrive in time order. Every round restarts the query from its
    checkpoint. A ``clock`` comes as one more row, without a document. ``moves`` arrive a third each
    round, in any order of time, as a second stream that ``run`` gets, too.
    """
    root, events = run_dir(lake.spark, name), lake.events
    lo, hi = events.agg(F.min("ts"), F.max("ts")).first()
    step = (hi - lo) / 3
    for i in range(3):
        part = events.filter(F.col("ts") >= F.lit(lo + i * step)) if i else events
        part = part.filter(F.col("ts") < F.lit(lo + (i + 1) * step)) if i < 2 else part
        part.write.parquet(f"{root}/events/round={i}")
        streams = [T.event_stream(lake.spark, f"{root}/events", events.schema).drop("round")]
        if moves is not None:
            moves.filter(F.pmod("move_id", F.lit(3)) == i).write.parquet(f"{root}/moves/round={i}")
            streams.append(T.event_stream(lake.spark, f"{root}/moves", moves.schema).drop("round"))
        result = run(*streams, f"{root}/run")
    if clock is not None:
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema]
        lake.spark.range(1).select(*blank).withColumn("ts", clock).write.parquet(f"{root}/events/round=3")
        result = run(*streams, f"{root}/run")
    return result


@query("STM01_latest_status", "v6", f"select doc_id, event_id, status from ({LATEST_SQL}) t")
def _(lake):
    return _in_rounds(lake, "latest", T.run_latest).select("doc_id", "event_id", "status")


@query(
    "STM02_queue_depth", "v6",
    f"select count(*) filter (where status = 'QUEUED') as queued, count(*) filter (where status = 'PROCESSING') as processing from ({LATEST_SQL}) t",
)
def _(lake):
    return _in_rounds(lake, "depth", T.run_queue_depth)


@query(
    "STM03_enqueue_dedupe", "v6",
    """select doc_id, event_id from (select doc_id, event_id, status, lag(status) over (partition by doc_id order by ts, event_id) as prev from v6) t
where status = 'QUEUED' and (prev is null or prev not in ('QUEUED', 'PROCESSING'))""",
)
def _(lake):
    return _in_rounds(lake, "enqueue", T.run_enqueue_dedupe).select("doc_id", "event_id")


@query(
    "STM04_idle_watchdog", "v6",
    """select doc_id, event_id, round(idle, 3) as idle_s from (select doc_id, event_id, epoch(ts) - lag(epoch(ts)) over (partition by doc_id order by ts, event_id) as idle from v6) t where idle > 7200
union all select doc_id, event_id, round(epoch(timestamp '2024-02-01') - epoch(ts), 3) from (""" + LATEST_SQL + """) l where epoch(timestamp '2024-02-01') - epoch(ts) > 7200""",
)
def _(lake):
    """Silences that ended, and those that last at the end."""
    end = F.to_timestamp(F.lit("2024-02-01"))
    found = _in_rounds(lake, "idle", lambda stream, root: T.run_idle_watchdog(stream, 7200.0, root), clock=end)
    gaps = found.filter("kind = 'ended'").select("doc_id", "event_id", "idle_s")
    return gaps.unionByName(T.stalled(found, end, 7200.0)).withColumn("idle_s", F.round("idle_s", 3))


@query(
    "STM05_log_tail_stream", "v6",
    "select doc_id, event_id, line from (select *, row_number() over (partition by doc_id order by ts desc, event_id desc) as r from v6) t where r <= 40",
)
def _(lake):
    return _in_rounds(lake, "tail", lambda stream, root: T.run_tail(stream, root, 40)).select("doc_id", "event_id", "line")


@query("STM06_progress_latest", "v6", f"select doc_id, cast(regexp_extract(line, '([0-9]+)%', 1) as bigint) as percent, substr(line, 12) as message from ({LATEST_SQL}) t")
def _(lake):
    from paperquay.functions.text import log_line, log_metrics

    d = _in_rounds(lake, "progress", T.run_latest)
    line = F.col("line")
    return d.select("doc_id", log_metrics(line)["percent"].cast("long").alias("percent"), log_line(line).alias("message"))


# A document starts in its session, and every 23rd event moves its document: to another session, or out of any.
MOVES_SQL = """select doc_id, -1 - doc_id as move_id, timestamp '2000-01-01' as ts, session_id from v1
union all select doc_id, event_id, ts, case when event_id % 46 = 0 then null else concat('moved', event_id % 5) end from v6 where event_id % 23 = 0"""


@query(
    "STM07_stream_session_stats", "v1 v6",
    f"""select session_id, count(*) as total, count(*) filter (where l.status = 'QUEUED') as queued, count(*) filter (where l.status = 'PROCESSING') as processing,
  count(*) filter (where l.status = 'REVIEW') as review, count(*) filter (where l.status = 'APPROVED') as approved, count(*) filter (where l.status = 'REJECTED') as rejected,
  count(*) filter (where l.status = 'EXPORTED') as exported, count(*) filter (where l.status = 'ERROR') as error
from ({LATEST_SQL}) l join (select doc_id, session_id from ({MOVES_SQL}) m qualify row_number() over (partition by doc_id order by ts desc, move_id desc) = 1) d
  on d.doc_id = l.doc_id where session_id is not null group by session_id""",
)
def _(lake):
    first = lake.docs.select("doc_id", (-1 - F.col("doc_id")).alias("move_id"), F.to_timestamp(F.lit("2000-01-01")).alias("ts"), "session_id")
    place = F.when(F.col("event_id") % 46 != 0, F.concat(F.lit("moved"), (F.col("event_id") % 5).cast("string")))
    later = lake.events.filter("event_id % 23 = 0").select("doc_id", F.col("event_id").alias("move_id"), "ts", place.alias("session_id"))
    return _in_rounds(lake, "sessions", T.run_session_counts, moves=first.unionByName(later))
