"""Stateful streams: each in micro-batches of several splits, with a restart from its checkpoint, against its batch form."""

import math
import random
import tempfile
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import judge
from tidemark.streaming import extractor, sessions

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


class Run:
    """One streaming query over folders of files; each ``feed`` is a restart from the checkpoint."""

    def __init__(self, spark, schema, make, sources=1):
        self.spark, self.schema, self.make, self.n = spark, schema, make, 0
        self.root = tempfile.mkdtemp(prefix="/tmp/stream-")
        self.names = [f"{self.root}/in{k}" for k in range(sources)]
        for name in self.names:
            spark.createDataFrame([], schema).write.parquet(f"{name}/none")

    def feed(self, *parts):
        for name, rows in zip(self.names, parts):
            if rows is not None and len(rows):
                self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{name}/{self.n:03d}")
        self.n += 1
        streams = [self.spark.readStream.schema(self.schema).option("recursiveFileLookup", "true").parquet(name) for name in self.names]
        query = (
            self.make(*streams).writeStream.format("parquet").option("path", f"{self.root}/out").option("checkpointLocation", f"{self.root}/checkpoint")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return query

    def rows(self):
        return self.spark.read.parquet(f"{self.root}/out").collect()


def moment(ms):
    return datetime.fromtimestamp(ms / 1000, timezone.utc)


def same(a, b):
    return len(a) == len(b) and all(alike(x, y) for x, y in zip(a, b))


def alike(x, y):
    if isinstance(x, float) or isinstance(y, float):
        return abs(x - y) < 1e-9
    if isinstance(x, (list, tuple)):
        return len(x) == len(y) and all(alike(p, q) for p, q in zip(x, y))
    return x == y


CHUNK = "stream_id string, recorded_ms double, host_ms double, rate double, samples array<double>, at timestamp"


def chunks():
    """``a`` without a break, ``b`` with a recorded gap, a host gap and a change of rate, ``c`` too short, and rows of no use."""
    draw, out = np.random.default_rng(8), []
    for key, sizes in (("a", [700, 30, 1200, 2048, 5, 900]), ("b", [1500, 1500, 1500, 1500, 1600]), ("c", [200, 100])):
        at, lag, rate = 1000.0, 50.0, 48_000.0
        for k, n in enumerate(sizes):
            if key == "b":
                at, lag, rate = at + 500 * (k == 1), lag + 80 * (k == 2), 48_000.0 if k < 4 else 44_100.0
            t = np.arange(n) / rate
            samples = 0.3 * np.sin(2 * np.pi * 440 * (k + 1) * t) + 0.1 * draw.normal(size=n)
            out.append((key, at, at + lag, rate, [float(x) for x in samples], moment(int(at))))
            at += 1000 * n / rate
    return out + [(None, 0.0, 0.0, 48_000.0, [1.0], moment(1)), ("a", 5000.0, 5000.0, 0.0, [1.0], moment(5000)), ("a", 5000.0, 5000.0, 1.0, [], moment(5000))]


def test_extractor_stream_equals_batch_in_any_split(spark):
    rows = chunks()
    whole = sorted(extractor.frames(spark.createDataFrame(rows, CHUNK)).collect(), key=lambda r: (r.stream_id, r.segment, r.recorded_ms))
    of_b = [r for r in whole if r.stream_id == "b"]
    assert {r.segment for r in of_b} == {0, 1, 2, 3} and {r.segment for r in whole if r.stream_id == "a"} == {0} and {r.stream_id for r in whole} == {"a", "b"}
    # (700 + 30 + 1200 + 2048 + 5 + 900 - 1024) // 512 + 1 windows of a
    assert sum(r.stream_id == "a" for r in whole) == (4883 - 1024) // 512 + 1
    first = {(r.stream_id, r.segment): r for r in reversed(whole)}
    assert all(r.onset == 0 and r.snr_db == 0 and not r.landmarks for r in first.values()) and any(r.onset > 0 and r.landmarks for r in whole)
    assert all(r.kept_from_ms == first[r.stream_id, r.segment].recorded_ms for r in whole)
    for cuts in ((1, 2, 9),):
        run = Run(spark, CHUNK, extractor.live_frames)
        for a, b in zip((0, *cuts), (*cuts, len(rows))):
            run.feed(rows[a:b])
        assert same(sorted(run.rows(), key=lambda r: (r.stream_id, r.segment, r.recorded_ms)), whole)


def test_extractor_keeps_and_forgets(spark):
    shape = extractor.Shape(keep_ms=20.0)
    rows = [r for r in chunks() if r[0] == "a"]
    kept = extractor.frames(spark.createDataFrame(rows, CHUNK), shape).collect()
    assert all(0 <= r.recorded_ms - r.kept_from_ms <= 20 for r in kept) and any(r.kept_from_ms > 1050 for r in kept)
    run = Run(spark, CHUNK, lambda x: extractor.live_frames(x, late="0 seconds", idle_ms=1000))
    run.feed(rows[:1])
    run.feed([("z", 9e6, 9e6, 48_000.0, [0.0] * 10, moment(9_000_000))])
    query = run.feed([("z", 9e6 + 1, 9e6, 48_000.0, [0.0] * 10, moment(9_001_000))])
    # a was idle: one key with its state is left
    assert query.lastProgress.stateOperators[0].numRowsTotal <= 3
    run.feed([("a", 1014.0, 1064.0, 48_000.0, [0.0] * 600, moment(9_001_000))])
    assert not [r for r in run.rows() if r.stream_id == "a"]  # 700 + 600 samples would have been a window


def test_flat_landmarks_and_payloads(spark):
    kind = f"id long, recorded_ms double, landmarks array<struct<{extractor.LANDMARK}>>, landmark_hashes array<bigint>"
    one = [(7, 1.0, 2, 3, 4)]
    rows = spark.createDataFrame([(1, 10.0, one, [5]), (2, 20.0, [], [5, 5]), (3, 30.0, None, None), (4, 40.0, None, [6])], kind)
    got = sorted(map(tuple, extractor.flat_landmarks(rows, ["id"]).collect()))
    assert got == [(1, 7, 1.0, 2, 3, 4), (2, 5, 20.0, 0, 1, 1), (2, 5, 20.0, 0, 1, 1), (4, 6, 40.0, 0, 1, 1)]
    framed = extractor.payload_frames(rows.select("recorded_ms", F.struct(F.col("id").alias("energy_db")).alias("payload")))
    assert framed.columns == ["recorded_ms", "energy_db"]


ROWS = "session_id string, seq long, kind string, lane int, item string, time_ms double, now_ms double, limit int"


def plays():
    """Sessions with late objects before and after the start, two ends, a cut batch, and a failure."""
    draw, out = random.Random(9), []
    for key in ("x", "y", "fails", "short"):
        seq = 0

        def add(kind, lane=None, item=None, time=None, now=None, limit=None):
            nonlocal seq
            out.append((key, seq, kind, lane, item, time, now, limit))
            seq += 1

        for t in range(1200, 4000, 400):
            add("object", draw.randrange(4), "tap", float(t))
        add("object", 1, "tap", 1500.0)  # within the closed window: late
        add("object", 1, "tap", float("nan"))
        add("object", 1, "tap", -5.0)
        add("read", time=3000.0, now=100.0, limit=50)  # too little is buffered
        if key == "short":
            add("finish", time=3600.0)
            add("read", time=3000.0, now=100.0, limit=50)
            add("read", time=9000.0, now=100.0, limit=2)  # cut: no end yet
            add("read", time=9000.0, now=100.0, limit=50)
            add("read", time=9000.0, now=100.0, limit=50)
            continue
        for t in range(4400, 9000, 300):
            add("object", draw.randrange(4), "tap", float(t))
        add("object", 2, "holdStart", 9000.0)
        add("read", time=2500.0, now=100.0, limit=3)
        add("object", 3, "tap", 2450.0)  # taken now, and after the start
        add("object", 3, "tap", 900.0)  # taken, but before the window: never sent
        add("read", time=2500.0, now=100.0, limit=50)
        if key == "fails":
            add("failure", item="broken")
        add("read", time=5000.0, now=100.0, limit=50)
        add("finish", time=8000.0)
        add("finish", time=7000.0)
        add("finish", time=float("nan"))
        add("object", 0, "tap", 6500.0)  # closed
        add("read", time=6900.0, now=100.0, limit=50)
        add("read", time=7000.0, now=100.0, limit=50)
        add("read", time=7500.0, now=100.0, limit=50)
    return out + [(None, 0, "read", None, None, 1.0, 1.0, 1)]


def test_sessions_end_once_and_in_any_split(spark):
    rows = plays()
    whole = sorted(sessions.play(spark.createDataFrame(rows, ROWS)).collect(), key=str)
    of = lambda key: sorted((r for r in whole if r.session_id == key), key=lambda r: r.seq)
    for key in ("x", "y"):
        statuses = [r.status for r in of(key)]
        assert statuses.count("end") == 1 and statuses[-1] == "end" and statuses.count("late") == 1 and statuses.count("outside") == 2 and statuses.count("closed") == 1
        sent = [r.time_ms for r in of(key) if r.status == "sent"]
        assert 2450.0 in sent and 900.0 not in sent and max(sent) <= 7000 and sorted(sent) != sent  # 2450 came after its time was read
    assert [r.status for r in of("fails")][-1] == "failed" and sum(r.status == "failed" for r in of("fails")) == 5 and not any(r.status == "end" for r in of("fails"))
    assert [r.status for r in of("short")].count("end") == 1 and [r.status for r in of("short")].count("waiting") == 1
    for cuts in ((10, 11, 25, 60),):
        run = Run(spark, ROWS, sessions.live_play)
        for a, b in zip((0, *cuts), (*cuts, len(rows))):
            run.feed(rows[a:b])
        assert sorted(run.rows(), key=str) == whole


GATE = "session_id string, kind string, lane int, id long, time_ms double, at timestamp"


def stamped(rows):
    return [(*r, moment(int(r[4]))) for r in rows]


def games():
    draw = random.Random(12)
    objects, inputs = [], []
    for key in ("p", "q"):
        at = 10_000.0
        for i in range(24):
            lane, at = draw.randrange(4), at + draw.choice([150.0, 400.0, 700.0])
            hold = draw.random() < 0.3
            objects.append((key, "holdStart" if hold else "tap", lane, 2 * i, at))
            press = at + draw.randrange(-120, 120)
            inputs.append((key, "press", lane, 1000 + 2 * i, press))
            if hold:
                objects.append((key, "holdEnd", lane, 2 * i + 1, at + 120))
                inputs.append((key, "release", lane, 1001 + 2 * i, at + 120 + draw.randrange(-100, 100)))
            at += 130
        objects.append((key, "complete", 0, -1, at + 5000))
        inputs.append((key, "end", 0, 9999, at + 1000))
    return stamped(sorted(objects, key=lambda r: r[4])), stamped(sorted(inputs, key=lambda r: r[4]))


def test_judgement_waits_for_both_watermarks(spark):
    objects, inputs = games()
    plain = [r for r in objects + inputs if r[1] not in ("complete", "end")]
    want = judge.judge(spark.createDataFrame(plain, GATE).drop("at")).collect()
    want = sorted((r.session_id, r.object_id, r.tier, r.error_ms, r.at_ms) for r in want if r.tier < 5) + sorted((r.session_id, r.object_id) for r in want if r.tier == 5)
    closing = stamped([("p", "complete", 0, -2, 200_000.0)]), stamped([("p", "press", 0, 1, 200_000.0)])
    for first in ((len(objects), 0), (0, len(inputs))):
        run = Run(spark, GATE, lambda o, i: sessions.gated_judgement(o, i), sources=2)
        complete = [r for r in objects if r[1] == "complete"]
        rest = [r for r in objects if r[1] != "complete"]
        run.feed(complete[:0] + rest[: first[0]], inputs[: first[1]])
        early = [r for r in run.rows() if r.status == "judged"]
        assert not early  # nothing is judged while one side is silent
        run.feed(rest[first[0] :] + complete, inputs[first[1] :])
        run.feed(*closing)
        run.feed(stamped([("z", "tap", 0, 1, 300_000.0)]), stamped([("z", "press", 0, 2, 300_000.0)]))
        got = [r for r in run.rows() if r.session_id in ("p", "q")]
        assert {r.status for r in got} == {"judged"}
        hits = sorted((r.session_id, r.object_id, r.tier, r.error_ms, r.at_ms) for r in got if r.tier < 5)
        assert hits + sorted((r.session_id, r.object_id) for r in got if r.tier == 5) == want


def test_a_chart_that_falls_behind_fails_its_session(spark):
    objects = stamped([("s", "tap", 0, 1, 5000.0), ("s", "complete", 0, -1, 6000.0), ("t", "tap", 0, 1, 5000.0), ("t", "complete", 0, -1, 99_000.0)])
    inputs = stamped([("s", "press", 0, 2, 5010.0), ("s", "press", 0, 3, 8000.0), ("s", "press", 0, 4, 9000.0), ("t", "press", 0, 2, 5010.0), ("t", "press", 0, 3, 8000.0)])
    run = Run(spark, GATE, lambda o, i: sessions.gated_judgement(o, i), sources=2)
    run.feed(objects, inputs)
    run.feed(stamped([("z", "tap", 0, 1, 300_000.0)]), stamped([("z", "press", 0, 2, 300_000.0)]))
    run.feed(stamped([("z", "tap", 0, 1, 300_001.0)]), stamped([("z", "press", 0, 2, 300_001.0)]))
    got = sorted((r.session_id, r.at_ms, r.status) for r in run.rows())
    assert got == [("s", 5010.0, "judged"), ("s", 8000.0, "fell_behind"), ("t", 5010.0, "judged")]
    assert math.isclose([r.error_ms for r in run.rows() if r.session_id == "t"][0], 10.0)
