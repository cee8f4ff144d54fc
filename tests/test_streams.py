"""Streams against plain loops."""

from __future__ import annotations

import random
from collections import deque
from datetime import datetime, timedelta, timezone

import pandas as pd

from loomwork.plans.source_queries import drained
from loomwork.streaming import jobs
from loomwork.tables import scratch

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "case long, activity string, ts timestamp, lifecycle string"


def paired(events, timeout_ms):
    """First in, first out by time, key by key; starts come before completes of the same time."""
    out = []
    for key in {e[:2] for e in events}:
        waiting = deque()
        for ms, ends in sorted((ms, kind != "start") for *k, ms, kind in events if tuple(k) == key):
            while waiting and waiting[0] + timeout_ms < ms:
                out.append((*key, waiting.popleft(), None, "start without complete"))
            if not ends:
                waiting.append(ms)
            elif waiting:
                out.append((*key, waiting.popleft(), ms, "paired"))
            else:
                out.append((*key, None, ms, "complete without start"))
        out += [(*key, ms, None, "start without complete") for ms in waiting]
    return out


def rows(events):
    return [(c, a, None if ms is None else START + timedelta(milliseconds=ms), kind) for c, a, ms, kind in events]


def run(spark, files, timeout_ms):
    work = scratch(spark, "stream")
    for f in files:
        spark.createDataFrame(rows(f), SCHEMA).coalesce(1).write.mode("append").parquet(f"{work}/in")
    stream = jobs.file_stream(spark, f"{work}/in", spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
    base = int(START.timestamp() * 1000)
    shift = lambda v: None if v is None else v - base
    return [(r.case, r.activity, shift(r.start_ms), shift(r.end_ms), r.status) for r in drained(jobs.pair(stream, timeout_ms, "10 days"), work).collect()]


def ordered(found):
    return sorted(found, key=str)


def test_pairs_follow_event_time_across_shuffled_batches(spark):
    rng = random.Random(3)
    events = [(rng.randrange(3), rng.choice("xy"), 1000 * rng.randrange(400), rng.choice(["start", "start", "complete"])) for _ in range(300)]
    events += events[:5] + [(1, "x", None, "start")]
    rng.shuffle(events)
    closing = [(-1, "", 86_400_000 * 30, "start")]
    got = run(spark, [events[:150], events[150:], closing], 20_000)
    want = paired([e for e in events if e[2] is not None], 20_000)
    assert {s for *_, s in want} == {"paired", "complete without start", "start without complete"}
    assert ordered(got) == ordered(want)


def test_only_what_the_watermark_has_passed_comes_out(spark):
    day = 86_400_000
    got = run(spark, [[(1, "x", 1000, "complete"), (1, "x", 0, "start")], [(1, "x", 12 * day, "start")]], 5 * day)
    assert got == [(1, "x", 0, 1000, "paired")]
    # the second batch finds the start timed out, and the third file's complete lies behind what has been paired: it is dropped
    got = run(spark, [[(1, "x", 0, "start"), (1, "x", 16 * day, "complete")], [(1, "x", 17 * day, "start")], [(1, "x", 1000, "complete")]], 5 * day)
    assert got == [(1, "x", 0, None, "start without complete")]


def test_calls_to_the_state_do_not_grow_with_the_keys():
    calls = []

    class Held:
        values = []

        def appendList(self, values):
            calls.append("append")
            self.values = self.values + values

        def get(self):
            calls.append("get")
            return iter(self.values)

        def put(self, values):
            calls.append("put")
            self.values = values

        def clear(self):
            calls.append("clear")
            self.values = []

    class Handle:
        timers = []

        def getListState(self, *_):
            return Held()

        def registerTimer(self, at):
            self.timers.append(at)

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    pairing = jobs.Pairing(5000)
    pairing.init(Handle())
    keys = [str(i) for i in range(500)] + [None]
    for kind, ms in (("complete", 1000), ("start", 0), ("start", 9000)):
        batch = pd.DataFrame({"case": keys, "activity": "a", "ms": ms, "lifecycle": kind})
        assert list(pairing.handleInputRows((3,), iter([batch]), None)) == []
    got = pd.concat(pairing.handleExpiredTimer((3,), At(2000), At(0)))
    assert (got.status == "paired").all() and len(got) == 501 and got.case.isna().sum() == 1
    assert list(pairing.handleExpiredTimer((3,), At(9500), At(9000))) == [] and Handle.timers[-1] == 14_000
    late = pd.concat(pairing.handleExpiredTimer((3,), At(14_001), At(14_000)))
    assert len(late) == 501 and (late.status == "start without complete").all() and pairing.held.values == []
    assert calls == ["append"] * 3 + ["get", "put"] * 2 + ["get", "clear"]
