"""Calibration against a plain walk, history of queries without evidence, and ids of recordings."""

import random
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import calibration as C
from tidemark.operators import resolve

SCHEMA = "key string, id long, at_ms double, kind string, value double"


def half_up(x):
    return int(Decimal(repr(x)).quantize(Decimal(1), ROUND_HALF_UP))


def walk(rows):
    """Every rule in turn, over one key's rows in order."""
    resolved, samples, offset, pending, published, out = set(), [], 0, 0, None, []
    for _, id_, at, kind, value in sorted(rows, key=lambda r: (r[2], r[1])):
        if kind == "set":
            pending = max(-500, min(500, half_up(value)))
        if kind == "tap":
            time = at + offset
            resolved = {b for b in resolved if 1000 + 500 * b >= time - 620}
            near = half_up((time - 1000) / 500)
            choice = None
            for b in sorted({0, near - 1, near, near + 1}):
                if b >= 0 and b not in resolved and (choice is None or abs(time - 1000 - 500 * b) < abs(time - 1000 - 500 * choice)):
                    choice = b
            choice = max(0, near) if choice is None else choice
            error = time - 1000 - 500 * choice
            if abs(error) <= 120:
                resolved.add(choice)
                samples.append(max(-500, min(500, half_up(offset - error))))
                last = sorted(samples[-16:])
                n = len(last)
                median = last[n // 2] if n % 2 else (last[n // 2 - 1] + last[n // 2]) / 2
                out.append((id_, at, choice, error, offset, samples[-1], n, half_up(median)))
        if pending != offset and (published is None or at - published >= 500):
            offset, published = pending, at
    return out


def taps():
    draw = random.Random(21)
    rows = []
    for key in ("a", "b", "c"):
        at = 700.0
        for i in range(120):
            at += draw.choice([40.0, 90.5, 240.0, 250.0, 500.0])
            kind = draw.choices(["tap", "set", "tick"], [8, 1, 1])[0]
            rows.append((key, i, at, kind, draw.uniform(-60, 60) if kind == "set" else None))
    # two taps for one beat: the second takes the open neighbour only if that is in reach
    return rows + [("d", 1, 1000.0, "tap", None), ("d", 2, 1010.0, "tap", None), ("d", 3, 1385.0, "tap", None), ("d", 4, 1510.0, "tap", None), (None, 1, 1.0, "tap", None), ("d", 5, None, "tap", None)]


def test_taps_equal_a_plain_walk_in_batch_and_parts(spark):
    rows = taps()
    got = C.calibrate(spark.createDataFrame(rows, SCHEMA)).collect()
    for key in "abcd":
        own = [r for r in rows if r[0] == key and r[2] is not None]
        want = walk(own)
        assert sorted(tuple(r)[1:] for r in got if r.key == key) == sorted(want) and want
        state, out = None, []
        frame = pd.DataFrame(own, columns=["key", "id", "at_ms", "kind", "value"])
        for a, b in ((0, 1), (1, 50), (50, 200)):
            state, found = C.step(state, key, frame[a:b])
            out += found
        assert sorted(x[1:] for x in out) == sorted(want)
    assert [r.beat for r in sorted((r for r in got if r.key == "d"), key=lambda r: r.id)] == [0, 1]
    assert any(r.offset_ms for r in got) and C.calibrate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_history_has_every_query(spark):
    tracks = spark.createDataFrame([(1, "zebra", "nobody", None, 90_000_000, None, "live"), (2, "blue ring", "ann", None, 1000, None, "live")], "query_id int, title string, artist string, album string, duration_ms int, isrc string, provider string")
    kind = "asset_id int, path string, file_name string, title string, artist string, album string, duration_ms int, isrc string, status string"
    catalog = spark.createDataFrame([(7, "b", "x.mp3", "blue ring", "ann", None, 1000, None, "ready"), (8, "a", "y.mp3", "other", "ben", None, 5000, None, "ready"), (9, "0", "z.mp3", "gone", "ben", None, 1, None, "missingFile")], kind)
    got = sorted(map(tuple, resolve.history(resolve.resolve(tracks, catalog), tracks, catalog).collect()))
    assert got[0] == (1, 8, 0.0, "reject") and got[1][:2] == (2, 7)
    none = catalog.where("asset_id < 0")
    assert resolve.history(resolve.resolve(tracks, none), tracks, none).count() == 0


def test_ids_of_recordings(spark):
    at = F.lit("2024-05-06 07:08:09").cast("timestamp")
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.recording_id(F.lit("My Gröup"), F.lit(None), F.lit("n"), at)) == "my-group-take-20240506-070809"
    assert one(T.recording_id(F.lit(" "), F.lit("Take 2"), F.lit("A b"), at)) == "a-b-take-2-20240506-070809"
    assert one(T.recording_id(F.lit(None), F.lit("--"), F.lit(None), at)) == "ambient-sync-take-20240506-070809"
    assert one(T.clip_id("clip", F.lit("A" * 90 + ".x.wav"), at)) == "clip-" + "a" * 90 + "-x-20240506-070809"
    assert one(T.clip_id("clip", F.lit("!!.wav"), at)) == "clip-fixture-20240506-070809"


def test_taps_are_dealt_over_all_partitions_after_a_join(spark):
    """the shuffle of a join by the same key does not stand in for that of the fold, whose partitions are not joined into few."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.createDataFrame(taps(), SCHEMA)
        found = C.calibrate(rows.join(rows.groupBy("key").agg(F.min("at_ms").alias("first")), "key").drop("first"))
        assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
        want = sorted(map(tuple, C.calibrate(rows).collect()))
        assert sorted(map(tuple, found.collect())) == want and want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
