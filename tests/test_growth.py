"""Steps whose work must grow with their rows, not with the pairs among them."""

import random
import re

from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.operators import nearest


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_meets_no_pairs(spark):
    """A crowd within the tolerance, ties and repeated times: the rows of brute force, and no join that pairs them."""
    dice = random.Random(5)
    rows = lambda n, span: [(dice.choice("ab"), i, dice.randrange(-span, span)) for i in range(n)]
    for span in (30, 400, 20_000):
        left, right = rows(120, span), [*rows(150, span), (None, 900, 1), ("a", 901, None)]
        make = lambda x: spark.createDataFrame(x, "k string, id int, t long")
        found = nearest.nearest(make([*left, (None, 900, 1), ("b", 901, None)]), make(right), ["k"], ["id"], "t", 10)
        assert "Join" not in plan(found)
        want = set()
        for k, i, t in left:
            near = [(-abs(s - t), s, j) for key, j, s in right if key == k and s is not None and abs(s - t) <= 10]
            if near:
                d, s, j = max(near)
                want.add((k, i, t, s, j, -d))
        assert {(r.k, r.id, r.t, r.r_t, r.r_id, r.distance) for r in found.collect()} == want
        assert want


def test_offsets_meet_no_pairs(spark):
    """Frames that all lie within the tolerance: rows of joins grow with the frames."""
    from pyspark.sql import Row

    one = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    frames = spark.range(400).select(
        F.lit("k").alias("key"), F.col("id").alias("frame_id"), F.col("id").alias("t_us"), F.lit(True).alias("usable"), F.lit(1.0).alias("weight"),
        one(1).alias("onset"), one(1, 2).alias("subband"), one(1, 2).alias("pcen"), F.array(F.col("id").cast("double")).alias("chroma"), one(3).alias("cens"),
    )
    offsets = spark.createDataFrame([Row(key="k", offset_us=0), Row(key="k", offset_us=-5)])
    found = nearest.offset_features(frames, frames, offsets, 1000)
    few = nearest.offset_features(frames.limit(60), frames, offsets, 3, few=True)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, nearest.offset_features(frames.limit(60), frames, offsets, 3).collect()))
    # the join that met all times of a bucket was by key and bucket; those left are by id, key and offset
    assert "bucket#" not in " ".join(line for line in plan(found).splitlines() if "Join" in line)
    assert {(r.offset_us, r.matched, r.mean_error_us) for r in found.collect()} == {(0, 400, 0.0), (-5, 400, 15 / 400)}


def test_profiles_resolve_as_rows_do(spark):
    """Copies of few assets: the k best results equal those of scoring every pair, and equal rows are scored once."""
    from tidemark.operators import resolve

    dice = random.Random(11)
    names, artists = ["red ring", "red rings", "blue bolt", "", None], ["Ann", "Ann, Bob", "Brand#1", "Brand#2", None]
    row = lambda i: (i, dice.choice(names), dice.choice(artists), dice.choice(["x", None]), dice.choice([1000, 2500, 9000, None]), f"i-{dice.randrange(40)}" if i % 7 == 0 else None)
    rows = [(*row(i), dice.choice(["manual", "live"])) for i in range(60)]
    tracks = spark.createDataFrame(rows, "query_id long, title string, artist string, album string, duration_ms long, isrc string, provider string")
    files = [(*row(i), f"p{i * 37 % 101}", dice.choice(["red ring.mp3", "z.mp3"]), dice.choice(["ready", "failed", "metadataPartial"])) for i in range(300)]
    assets = spark.createDataFrame(files, "asset_id long, title string, artist string, album string, duration_ms long, isrc string, path string, file_name string, status string")
    told = lambda df: sorted(map(tuple, df.select("query_id", "rank", "asset_id", "path", "confidence", "decision", F.to_json("evidence")).collect()))
    whole = resolve.resolve(tracks, assets)
    for k in (1, 3):
        assert told(resolve.resolve(tracks, assets, k)) == told(whole.where(F.col("rank") <= k))
    copies = assets.crossJoin(spark.range(20)).withColumns({"asset_id": F.col("asset_id") + 1000 * F.col("id"), "isrc": F.lit(None).cast("string")}).drop("id")
    scored, score = [], resolve.score
    resolve.score = lambda q, a, k=None: scored.append(a.count()) or score(q, a, k)
    try:
        resolve.resolve(tracks, copies, 3)
    finally:
        resolve.score = score
    assert scored[0] <= 300


def test_votes_by_tiles_equal_those_by_joins(spark, monkeypatch):
    """Votes summed in tiles equal those of joined meetings, in one part and in several, in small pieces; no join meets postings."""
    from tidemark.operators import voting

    dice = random.Random(3)
    at = lambda: dice.choice([dice.randrange(-400, 400), dice.randrange(-5000, 5000), 50])
    query = spark.createDataFrame([(f"q{dice.randrange(12)}", dice.choice([1, 1, 2, 3, 99, None]), dice.choice([at(), at(), None])) for _ in range(300)], "query_id string, hash long, t_us long")
    reference = spark.createDataFrame([(dice.choice([1, 1, 1, 2, 3, 4, None]), at()) for _ in range(200)] + [(5, None)], "hash long, t_us long")
    names = ["query_id", "bin", *voting.TALLIED]
    for reach in (None, 500):
        want = sorted(map(tuple, voting._by_joins(query, reference, 100, reach, []).select(names).collect()), key=repr)
        assert want
        for most in ({}, {"TILE_POSTINGS": 60, "BLOCK": 40, "LISTED": 50, "TAKEN": 7, "MET": 30}):
            with monkeypatch.context() as m:
                for k, v in most.items():
                    m.setattr(voting, k, v)
                assert sorted(map(tuple, voting.by_tiles(query, reference, 100, reach).select(names).collect()), key=repr) == want
    whole = plan(voting.vote_histogram(query, reference, 100))
    assert "MapInArrow" in whole and "salt#" not in whole


def test_folds_take_many_keys_a_batch_and_long_ones_piece_by_piece(spark):
    """one call for each batch, not for each key; a time or a key that batches cut gives the same rows."""
    from tidemark.operators import landmark_lock, tracker

    dice = random.Random(8)
    rows = [(f"k{dice.randrange(40)}", dice.choice([float(dice.randrange(40)) * 100, None, float("nan")]), float(dice.randrange(9) * 30), dice.choice([0.9, 0.4, None, float("nan")])) for _ in range(900)]
    rows += [(None, 100.0, 30.0, 0.5)] + [("long", 100.0 * (i // 9), 20.0 * i % 100, 0.8) for i in range(300)]
    found = spark.createDataFrame(rows, "key string, at_ms double, offset_ms double, confidence double")
    place = F.struct("offset_ms", F.lit("passed").alias("stage"), F.lit("none").alias("reason"), "confidence", F.lit(0.5).alias("provisional"), F.lit(0.6).alias("final"))
    windows = found.where("confidence > 0 AND at_ms >= 0").groupBy("key", "at_ms").agg(F.lit("none").alias("ready"), F.lit(True).alias("long"), F.array_sort(F.collect_list(place)).alias("candidates"))
    told = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    plain = []
    for key, own in found.toPandas().groupby("key", dropna=False):
        plain += tracker.follow((tracker.EMPTY, None), str(key) if key == key and key is not None else "None", own)[1]
    want = sorted(map(repr, plain)), told(landmark_lock.align(windows))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for most in (7, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        try:
            assert (told(tracker.track(found)), told(landmark_lock.align(windows))) == want
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for folded in (tracker.track(found), landmark_lock.align(windows)):
        assert "MapInArrow" in plan(folded) and "FlatMapGroups" not in plan(folded)


def test_votes_of_windows_are_made_once(spark):
    """candidates of windows come from one pass over the meetings, not from one for each figure beside them."""
    from tidemark.operators import landmark_chain

    marks = spark.createDataFrame([(f"w{i % 3}", "k", i % 5, 10_000 * i) for i in range(40)], "window string, key string, hash long, t_us long")
    known = spark.createDataFrame([("k", i % 5, 10_000 * i + 500_000) for i in range(40)], "key string, hash long, t_us long")
    found = landmark_chain.coarse_candidates(marks, known, landmark_chain.Chain(most=3, apart_us=100_000))
    rows = found.collect()
    assert {r.window for r in rows} == {"w0", "w1", "w2"} and {r.key for r in rows} == {"k"} and max(r.place for r in rows) == 2
    # the meetings are what is summed by hash within bins
    assert len(re.findall(r"Aggregate \[query_id#\d+, bin#\d+L?, hash#", plan(found))) == 1


def test_sources_meet_the_manifest_by_a_shuffle(spark, tmp_path):
    """no table with a row for each source is sent to the driver, however small its files are."""
    from tidemark.sources import files, index_cache

    kind = "path string, size_bytes long, modified timestamp, sha256 string, config string"
    sources = spark.range(9).select(F.concat(F.lit("p"), "id").alias("path"), "id", F.timestamp_seconds("id").alias("modified"), F.lit("s").alias("sha256")).withColumnRenamed("id", "size_bytes")
    build = lambda rows: rows.select("path", F.lit(1).alias("frame"), F.when(F.col("size_bytes") == 4, "bad").alias("problem"))
    assert index_cache.refresh(spark, str(tmp_path), sources, build, 1, "c") == {"kept": 0, "built": 8, "failed": 1, "gone": 0}
    assert index_cache.refresh(spark, str(tmp_path), sources.where("size_bytes < 7"), build, 1, "c") == {"kept": 6, "built": 0, "failed": 1, "gone": 2}
    shown = index_cache.index(spark, str(tmp_path))
    assert sorted(r.path for r in shown.collect()) == ["p0", "p1", "p2", "p3", "p5", "p6"]
    held = spark.createDataFrame([], f"{kind}, version int, part string")
    for df in (shown, files.stale(held, sources.withColumn("config", F.lit("c")), 1)):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().sparkPlan().toString()


def test_percentiles_of_a_key_are_many_tasks(spark):
    """nearest ranks as by sorting, with nulls, NaN, repeats and a null key; no group's values come together."""
    from tidemark.operators import replay

    dice = random.Random(2)
    rows = [(dice.choice(["a", "a", "a", "b", None]), dice.choice([None, float(dice.randrange(30)), dice.random()])) for _ in range(500)] + [("one", 4.0), ("none", None), ("nan", 1.0), ("nan", float("nan")), *[("c", float(i)) for i in range(140)]]
    calls = spark.createDataFrame(rows, "k string, ms double")
    got = {r.k: r for r in replay.timing(calls, "k", "ms").collect()}
    assert "percentile" not in plan(replay.timing(calls, "k", "ms")).lower()
    assert set(got) == {k for k, _ in rows}
    other = {r.k: r for r in replay.percentiles(calls, "k", "ms", [0.05, 0.5]).collect()}
    for key, r in got.items():
        own = sorted((v for k, v in rows if k == key and v is not None), key=lambda v: (v != v, v))
        rank = lambda p: own[max(1, -(-len(own) * p // 100)) - 1] if own else None  # noqa: E731,B023
        assert r.calls == sum(k == key for k, _ in rows)
        assert repr((r.p50, r.p95, other[key].p5, other[key].p50)) == repr((rank(50), rank(95), rank(5), rank(50)))
