"""Streams: several batches, a restart from the checkpoint, late and repeated events, timers, and lost state."""

import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from paperquay.streaming import status as T

T0 = datetime(2024, 1, 1)


def rounds(spark, tmp_path, run, *parts):
    """Result of ``run(stream, root)`` after each part of the events has come."""
    folder, root = str(tmp_path / "in"), str(tmp_path / "run")
    for n, events in enumerate(parts):
        rows = [(d, i, None if s is None else T0 + timedelta(seconds=s), st, f"l{i}") for d, i, s, st in events]
        spark.createDataFrame(rows, T.LATEST).coalesce(1).write.parquet(f"{folder}/round={n}")
        schema = spark.createDataFrame([], T.LATEST).schema
        result = run(T.event_stream(spark, folder, schema), root)
    return result


def test_dedupe_with_late_and_repeated_events(spark, tmp_path):
    parts = [
        [(1, 0, 0, "QUEUED"), (2, 1, 1, "QUEUED"), (1, 2, 2, "QUEUED")],
        [(1, 3, 3, "PROCESSING"), (1, 4, 4, "QUEUED"), (2, 5, 500, "REVIEW"), (1, 2, 2, "QUEUED"), (2, 50, 400, "QUEUED")],
        [(1, 6, 6, "ERROR"), (1, 7, 7, "QUEUED"), (2, 8, 501, "QUEUED"), (3, 9, 502, "QUEUED"), (2, 51, 499, "ERROR"), (4, 52, None, "QUEUED")],
    ]
    out = rounds(spark, tmp_path, T.run_enqueue_dedupe, *parts)
    assert sorted(r.event_id for r in out.collect()) == [0, 1, 7, 8, 9]
    held = {r.doc_id: r.event_id for r in T.state_of(spark, str(tmp_path / "run"), "newest").collect()}
    assert held == {1: 7, 2: 8, 3: 9}


def test_counts_are_sums_of_changes(spark, tmp_path):
    parts = [
        [(1, 0, 0, "QUEUED"), (2, 1, 1, "QUEUED"), (None, 2, 2, "QUEUED")],
        [(1, 3, 3, "PROCESSING"), (1, 4, 1, "ERROR"), (3, 5, 5, "REVIEW")],
        [(2, 6, 6, "REVIEW"), (1, 3, 3, "PROCESSING")],
    ]
    depth = rounds(spark, tmp_path / "d", T.run_queue_depth, *parts).first()
    assert (depth.queued, depth.processing) == (1, 1)


def test_session_counts_follow_moves(spark, tmp_path):
    parts = [
        [(1, 0, 0, "QUEUED"), (2, 1, 1, "QUEUED"), (None, 2, 2, "QUEUED")],
        [(1, 3, 3, "PROCESSING"), (1, 4, 1, "ERROR"), (3, 5, 5, "REVIEW"), (5, 8, 5, "ERROR")],
        [(2, 6, 6, "REVIEW"), (1, 3, 3, "PROCESSING")],
    ]
    moves = [  # the third part has a late move and a repeated one
        [(1, 0, 0, "a"), (2, 1, 0, "a"), (9, 2, 0, "c"), (4, 3, 0, None), (5, 9, 0, "d")],
        [(3, 4, 9, "b"), (1, 5, 9, "b"), (1, 6, 8, "z")],
        [(2, 7, 9, "b"), (2, 8, 10, "a"), (1, 6, 8, "z"), (1, 5, 9, "b"), (5, 10, 9, None)],
    ]
    shape, seen = "doc_id long, move_id long, ts timestamp, session_id string", []

    def run(stream, root):
        rows = [(d, i, T0 + timedelta(seconds=s), to) for d, i, s, to in moves[len(seen)]]
        spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"{tmp_path}/moves/round={len(seen)}")
        stream_of_moves = T.event_stream(spark, f"{tmp_path}/moves", spark.createDataFrame([], shape).schema)
        out = T.run_session_counts(stream, stream_of_moves, root)
        seen.append({r.session_id: (r.total, r.queued, r.processing, r.review, r.error) for r in out.collect()})

    rounds(spark, tmp_path, run, *parts)
    assert seen == [
        {"a": (2, 2, 0, 0, 0)},
        {"a": (1, 1, 0, 0, 0), "b": (2, 0, 1, 1, 0), "d": (1, 0, 0, 0, 1)},
        {"a": (1, 0, 0, 1, 0), "b": (2, 0, 1, 1, 0)},
    ]


def test_watchdog_finds_silences_that_last(spark, tmp_path):
    parts = [
        [(1, 0, 0, "QUEUED"), (1, 1, 50, "QUEUED"), (1, 2, 130, "REVIEW"), (2, 3, 10, "QUEUED"), (4, 9, 125, "QUEUED")],
        [(2, 4, 140, "QUEUED"), (1, 5, 160, "QUEUED")],
        [(None, None, 300, None)],
    ]
    found = rounds(spark, tmp_path, lambda stream, root: T.run_idle_watchdog(stream, 60.0, root), *parts)
    ended = {(r.doc_id, r.event_id, r.since_event, r.idle_s) for r in found.filter("kind = 'ended'").collect()}
    assert ended == {(1, 2, 1, 80.0), (2, 4, 3, 130.0)}
    lasting = {(r.doc_id, r.since_event) for r in found.filter("kind = 'lasting'").collect()}
    assert lasting == {(2, 3), (1, 5), (2, 4), (4, 9)}  # the first ended later
    gone = T.stalled(found, F.lit(T0 + timedelta(seconds=300)), 60.0).collect()
    assert {(r.doc_id, r.event_id, r.idle_s) for r in gone} == {(1, 5, 140.0), (2, 4, 160.0), (4, 9, 175.0)}


def test_tail_keeps_the_newest(spark, tmp_path):
    parts = [
        [(1, 100, 100, "QUEUED")],
        [(d, i, i, "QUEUED") for d in (1, 2) for i in range(9 * d)],
        [(1, 100, 100, "QUEUED"), (2, 17, 17, "QUEUED")],
    ]
    kept = rounds(spark, tmp_path, lambda stream, root: T.run_tail(stream, root, 3), *parts).collect()
    assert sorted((r.doc_id, r.event_id) for r in kept) == [(1, 7), (1, 8), (1, 100), (2, 15), (2, 16), (2, 17)]


def test_latest_comes_from_the_state(spark, tmp_path):
    parts = [[(1, 0, 9, "QUEUED"), (2, 1, 1, "QUEUED")], [(1, 2, 3, "REVIEW"), (2, 3, 1, "ERROR")]]
    got = rounds(spark, tmp_path, T.run_latest, *parts).collect()
    assert sorted((r.doc_id, r.event_id, r.status, r.line) for r in got) == [(1, 0, "QUEUED", "l0"), (2, 3, "ERROR", "l3")]


def test_lost_state_fails(spark, tmp_path):
    rounds(spark, tmp_path, T.run_queue_depth, [(1, 0, 0, "QUEUED")])
    shutil.rmtree(tmp_path / "run" / "checkpoint" / "state")
    with pytest.raises(StreamingQueryException):
        folder = str(tmp_path / "in")
        spark.createDataFrame([(1, 1, T0, "REVIEW", "x")], T.LATEST).write.parquet(f"{folder}/round=1")
        T.run_queue_depth(T.event_stream(spark, folder, spark.createDataFrame([], T.LATEST).schema), str(tmp_path / "run"))
