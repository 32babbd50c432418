"""F1 landmark_lock_chain: frames are dealt by recording, not once more for each window and each offset."""

import random
import re
from dataclasses import replace

from pyspark.sql import functions as F

from tests.test_landmark_chain import SETTINGS, frames_of
from tidemark.operators import landmark_chain as C
from tidemark.operators import nearest

NAN = float("nan")
FRAME = "ref string, frame_id long, t_us long, usable boolean, weight double, onset array<double>, subband array<double>, pcen array<double>, chroma array<double>, cens array<double>"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_frames_are_not_multiplied_by_windows_or_offsets(spark, monkeypatch):
    frames, marks, targets, postings = frames_of(spark)
    timed = frames.where("key IS NOT NULL AND t_us IS NOT NULL")
    dealt, own = [], C.evaluated
    monkeypatch.setattr(C, "evaluated", lambda asked, live, reference, s, prune=True: dealt.append((asked, live.count())) or own(asked, live, reference, s, prune))
    found = C.chain(frames, marks, targets, postings, SETTINGS)
    assert found.count() and len(dealt) == 1
    # a frame lies in five or six windows, and every window asks for several offsets on a grid of five
    assert dealt[0][1] <= timed.count() * 1.1
    shown = plan(own(dealt[0][0], timed.withColumn("unit", F.lit("a@0")), targets.withColumnRenamed("key", "ref"), SETTINGS))
    assert "MapInArrow" in shown and not re.search(r"Join.*(bucket|offset_us)#", shown)


def test_votes_of_recordings_equal_those_of_windows(spark):
    _, marks, _, postings = frames_of(spark)
    dice = random.Random(9)
    more = spark.createDataFrame([("x", dice.randrange(4), dice.randrange(9_000_000)) for _ in range(80)], "key string, hash long, t_us long")
    timed = marks.unionByName(more).where("key IS NOT NULL AND hash IS NOT NULL AND t_us IS NOT NULL")
    known = postings.unionByName(more.withColumn("t_us", F.col("t_us") + 700_000))
    want = C.coarse_candidates(C.window_id(C.windowed(timed, SETTINGS)).select("window", "key", "hash", "t_us"), known, SETTINGS)
    found = C.recorded_candidates(timed, known, C.marks_of_windows(timed, SETTINGS), SETTINGS)
    told = lambda df: sorted(map(tuple, df.select(want.columns).collect()))
    assert told(found) == told(want) and want.where("key = 'x'").count()


def test_evaluations_by_arrays_equal_those_by_joins(spark):
    """Ties, repeated times, nulls, NaN, and arrays of unequal size or none: raw scores as ``offset_features`` has them."""
    dice = random.Random(6)

    def array(n):
        odd = dice.random()
        if odd < 0.02:
            return None
        if odd < 0.04:
            return [1.0] * dice.randrange(4)
        return [dice.choice([None, NAN]) if dice.random() < 0.004 else float(dice.randrange(5)) for _ in range(n)]

    def frame(ref, i, t):
        return (ref, i, t, dice.choice([True, True, False, None]), dice.choice([1.0, 0.25, 1.0, None]), array(1), array(3), array(3), array(4), array(2))

    refs = [f"r{k}" for k in range(12)]
    live = [frame(r, i, dice.randrange(900)) for r in refs for i in range(20)]
    known = [frame(r, i, dice.randrange(0, 1200)) for r in refs[:-1] for i in range(60)]
    live, known = spark.createDataFrame(live, FRAME), spark.createDataFrame(known, FRAME)
    query = live.withColumn("key", F.col("ref"))
    asked = [(r, r, place, dice.randrange(-300, 600), 3.0, 2, 0.5) for r in [*refs, "absent"] for place in range(6)]
    candidates = spark.createDataFrame(asked, "window string, key string, place long, coarse_us long, weighted double, hashes long, landmark double")
    gate = nearest.Dense(min_frames=1, min_duration=0, min_coverage=0.1, tolerance=9)
    s = replace(SETTINGS, window_us=100, radius_us=40, step_us=20, timing=gate, robust=gate, refined=0, refined_margin=-1.0)
    found = {(r.window, r.coarse_us): r.timing for r in C.scored(candidates, query, known, s).collect()}
    offsets = candidates.select(F.col("window").alias("key"), F.col("coarse_us").alias("offset_us")).distinct()
    want = nearest.evaluate_offsets(query, known, offsets, gate).collect()
    assert set(found) == {(r.key, r.offset_us) for r in want} and sum(r.sufficient for r in want) > 20
    for r in want:
        names = [c for c in r.asDict() if c not in ("key", "offset_us")]
        assert [(c, repr(found[r.key, r.offset_us][c])) for c in names] == [(c, repr(r[c])) for c in names]
