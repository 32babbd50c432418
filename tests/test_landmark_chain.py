"""The landmark chain from postings and frames to states."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import landmark_chain as C
from tidemark.operators import landmark_lock, nearest, voting

SETTINGS = C.Chain(
    hop_us=1_000_000, long_us=4_000_000, most=4, radius_us=40_000, step_us=20_000, timing=nearest.Dense(min_frames=8, min_duration=1_000_000, min_coverage=0.5),
    robust=nearest.Dense(weights=(0.30, 0.0, 0.35, 0.05, 0.30), min_frames=16, min_duration=2_500_000, min_coverage=0.6, agree=0.50),
)
FRAME = "key string, frame_id long, t_us long, energy_db double, usable boolean, weight double, onset array<double>, subband array<double>, pcen array<double>, chroma array<double>, cens array<double>"


def recordings():
    """Frames and landmarks of live recordings and references: ``a`` plays 1.5 s in, ``b`` is another tune, ``c`` repeats itself, ``d`` has no reference, ``e`` is silent."""
    draw = random.Random(11)

    def tune(n):
        return [(40_000 * i, draw.randrange(1 << 20), [draw.random() for _ in range(4)]) for i in range(n)]

    tunes = {k: tune(240) for k in "abe"}
    half = tune(120)
    tunes["c"] = half + [(t + 4_800_000, h, x) for t, h, x in half]
    other = tune(240)
    frames, marks, targets, postings = [], [], [], []
    for key in "abcde":
        played = {"b": other}.get(key, tunes.get(key, other))
        for i, (t, h, x) in enumerate(played[::1]):
            if t >= 1_500_000 and i % 7:
                energy = -90.0 if key == "e" else -30.0
                frames.append((key, i, t - 1_500_000, energy, True, 1.0, [x[0]], x, [v + 0.05 * (i % 3) for v in x], x[1:], x[:2]))
                marks.append((key, h, t - 1_500_000))
        if key != "d":
            targets += [(key, i, t, -30.0, True, 1.0, [x[0]], x, x, x[1:], x[:2]) for i, (t, h, x) in enumerate(tunes[key])]
            postings += [(key, h, t) for t, h, x in tunes[key]]
    return frames, marks, targets, postings


def frames_of(spark):
    frames, marks, targets, postings = recordings()
    mark = "key string, hash long, t_us long"
    odd = [(None, 1, 5, -30.0, True, 1.0, [1.0], [1.0], [1.0], [1.0], [1.0])]
    return (spark.createDataFrame(frames + odd, FRAME), spark.createDataFrame([*marks, (None, 1, 2), ("a", None, 2), ("a", 5, None)], mark),
            spark.createDataFrame(targets, FRAME).drop("energy_db"), spark.createDataFrame(postings, mark))


def test_pruned_refinement_equals_the_whole_and_locks(spark):
    inputs = frames_of(spark)
    rows = lambda prune: sorted(landmark_lock.align(C.chain(*inputs, SETTINGS, prune=prune)).collect())
    pruned = rows(True)
    assert pruned == rows(False)
    own = lambda key: [r for r in pruned if r.key == key]
    locked = [r for r in own("a") if r.state == "locked"]
    assert len(locked) >= 4 and all(abs(r.offset_ms - 1500) <= 20 for r in locked)
    assert {r.state for r in own("b")} <= {"listening", "locking", "lost", "relocking"} and not any(r.state == "locked" for r in own("b"))
    assert {r.state for r in own("d")} == {"failed"}
    assert {r.reason for r in own("e")} <= {"insufficient_duration", "insufficient_energy"}
    assert not any(r.state == "locked" for r in own("c"))  # two places fit alike


def test_refined_candidates_equal_a_plain_selection(spark):
    frames, marks, targets, postings = frames_of(spark)
    own = lambda rows: C.window_id(C.windowed(rows.where("key = 'c' AND t_us IS NOT NULL AND key IS NOT NULL"), SETTINGS))
    candidates = C.coarse_candidates(own(marks).where("hash IS NOT NULL").select("window", "key", "hash", "t_us"), postings, SETTINGS)
    query = own(frames).withColumnRenamed("key", "ref").withColumnRenamed("window", "key").drop("end_us", "energy_db")
    found = C.scored(candidates, query, targets.withColumnRenamed("key", "ref"), SETTINGS).collect()
    offsets = candidates.select(F.col("window").alias("key"), F.col("coarse_us").alias("offset_us"))
    grid = nearest.refinement_grid(offsets, SETTINGS.radius_us, SETTINGS.step_us)
    for gate in C.GATES:
        every = nearest.evaluate_offsets(query, targets.withColumnRenamed("key", "ref"), grid.select("key", "offset_us").distinct(), getattr(SETTINGS, gate)).collect()
        score = {(r.key, r.offset_us): r for r in every}
        for window in {r.window for r in found}:
            here = [r for r in found if r.window == window]
            coarse = {r.place: score[window, r.coarse_us] for r in here}
            order = sorted(here, key=lambda r: (not coarse[r.place].sufficient, -coarse[r.place].combined, -coarse[r.place].agreement, -r.weighted, -r.hashes, -r.landmark, r.coarse_us))
            lead = coarse[order[0].place].combined
            for rank, r in enumerate(order):
                want = coarse[r.place]
                if rank < SETTINGS.refined or lead - want.combined <= SETTINGS.refined_margin:
                    around = [score[window, r.coarse_us + d] for d in range(-SETTINGS.radius_us, SETTINGS.radius_us + 1, SETTINGS.step_us)]
                    want = min(around, key=lambda e: (not e.sufficient, -e.combined, -e.comparable, e.mean_error_us if e.mean_error_us is not None else np.inf, abs(e.offset_us - r.coarse_us), e.offset_us))
                assert (r[gate].offset_us, r[gate].sufficient, r[gate].agreement) == (want.offset_us, want.sufficient, want.agreement)
                assert abs(r[gate].combined - want.combined) < 1e-12


def test_a_frequent_hash_is_dealt_to_the_same_votes(spark, monkeypatch):
    draw = random.Random(4)
    query = spark.createDataFrame([(q, draw.choice([1, 1, 1, 2, 3]), draw.randrange(500)) for q in range(4) for _ in range(30)], "query_id int, hash long, t_us long")
    reference = spark.createDataFrame([(draw.choice([1, 1, 1, 2, 3]), draw.randrange(9000)) for _ in range(400)], "hash long, t_us long")
    want = sorted(voting.vote_histogram(query, reference, 40).collect())
    monkeypatch.setattr(voting, "HOT_POSTINGS", 16)
    assert sorted(voting.vote_histogram(query, reference, 40).collect()) == want
    keyed = lambda rows: rows.withColumn("key", F.lit("k"))
    assert sorted(voting.vote_histogram(keyed(query), keyed(reference), 40, by=["key"]).collect()) == want


def test_chain_of_nothing(spark):
    none, marks = spark.createDataFrame([], FRAME), spark.createDataFrame([], "key string, hash long, t_us long")
    assert landmark_lock.align(C.chain(none, marks, none.drop("energy_db"), marks, SETTINGS)).count() == 0
