import base64
import hashlib
import hmac
import io
import wave

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import numbers, text
from tidemark.operators import catalog, chart, judge, resolve, series
from tidemark.sources import audio as audio_files
from tidemark.sources import files
from tidemark.streaming import stateful


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


lit = F.lit


def test_text_keys(spark):
    lit = F.lit
    assert one(spark, text.search_key(lit("  Été--Fool's  Día 20 "))) == "ete fool s dia 20"
    assert one(spark, text.artist_parts(lit("A, B/A , 0"))) == ["A", "B", "0"]
    assert one(spark, text.slug(lit("--Ça va? Brand#20 / X--"), 10)) == "ca-va-bran"
    assert one(spark, text.fuzzy(lit("blue ring"), lit("ring blue"))) == 1.0
    assert one(spark, text.fuzzy(lit(""), lit("x"))) == 0.0
    assert one(spark, text.fnv1a(lit("a"))) == "af63dc4c8601ec8c"
    assert one(spark, text.last_json_object(lit('p {1%} {"a": 2}'))) == '{"a": 2}'
    assert one(spark, text.string_list(lit("oops"))) == []
    assert one(spark, text.blank_to_null(lit("  "))) is None
    assert [tuple(x) for x in one(spark, text.lane_actions(lit(25)))] == [(0, 1)]
    assert one(spark, text.lane_actions(lit(24))) == []
    mac = base64.b64encode(hmac.new(b"k", b"a", hashlib.sha1).digest()).decode()
    assert one(spark, text.signature("k")(lit("a"))) == mac


def test_numbers(spark):
    lit = F.lit
    values = [one(spark, numbers.duration_term(lit(d))) for d in (0, 250, 2000, 2001, 8000, 8001, 30000, 90000)]
    assert values[0] == values[1] == 0.24 and abs(values[2] - values[3]) < 1e-3 and abs(values[4] - values[5]) < 1e-3 and values[-1] == -0.24
    assert [one(spark, numbers.tier(lit(e), "B")) for e in (47, -48, 88, 118, 200, 201)] == [0, 1, 2, 3, 4, 5]
    assert one(spark, numbers.unsigned_ms(lit(-1.0))) is None and one(spark, numbers.unsigned_ms(lit(2.5))) == 3
    assert one(spark, numbers.landmark_hash(lit(1), lit(2), lit(3))) == (1 << 32) | (2 << 16) | 3
    assert one(spark, numbers.cosine(F.array(lit(0.0)), F.array(lit(1.0)))) == 0.0


def track(spark, rows):
    return spark.createDataFrame(rows, "query_id int, title string, artist string, album string, duration_ms int, isrc string, provider string")


def asset(spark, rows):
    return spark.createDataFrame([(*r, "ready") for r in rows], "asset_id int, path string, file_name string, title string, artist string, album string, duration_ms int, isrc string, status string")


def test_resolver_policies(spark):
    q = track(spark, [(1, "Song", "Band", "Album", 180000, "US-1", "live"), (2, "Fool's Day", None, None, None, None, "manual"), (3, "Fool's Day", None, None, None, None, "live")])
    a = asset(spark, [(1, "a", "x.mp3", "Song", "Band", "Album", 180000, "us1"), (2, "b", "y.mp3", "Fool's Day", "Other", "Else", 200000, None)])
    got = {(r.query_id, r.asset_id): (r.decision, r.confidence) for r in resolve.resolve(q, a).collect()}
    assert got[1, 1] == ("accept", 1.0)
    assert got[2, 2][0] == "confirm" and got[3, 2][0] == "reject" and got[2, 2][1] < 0.7
    twins = asset(spark, [(1, "a", "x.mp3", "Song", "Band", "Album", 180000, None), (2, "b", "x.mp3", "Song", "Band", "Album", 180000, None)])
    both = resolve.resolve(q.where("query_id = 1"), twins).collect()
    assert [r.decision for r in both] == ["confirm", "confirm"] and all(r.confidence >= 0.9 for r in both)
    weak = asset(spark, [(1, "a", "x.mp3", "Song", "Band", "Album", 185000, "us1")])
    assert resolve.resolve(q.where("query_id = 1"), weak).first().decision == "confirm"


def test_catalog_upsert_and_cascade(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, None)], "id int, v string")
    assert {r.id: r.v for r in catalog.upsert(old, new, "id").collect()} == {1: "a", 2: "d", 3: None}
    child = spark.createDataFrame([(10, 1), (11, 2)], "cid int, id int")
    grand = spark.createDataFrame([(5, 10), (6, 11)], "gid int, cid int")
    left = catalog.cascade(old.where("id = 1"), "id", [(child, "id"), (grand, "cid")])
    assert [r.gid for r in left[1].collect()] == [5]


TEXT = "[General]\nMode: 3\n// no\n[HitObjects]\n64,192,1000,1,0,0:0:0:0:\n448,192,2000,128,0,1500:0:0:0:0:\n192,192,3000,2,0\nx,1,2,1,0\n"


def test_chart_text(spark):
    lines = chart.parse_sections(spark.createDataFrame([("c", TEXT)], "chart_id string, text string"))
    found = chart.parse_objects(lines).orderBy(*chart.stream_order()).collect()
    good = [(r.lane, r.kind, r.time_ms) for r in found if r.problem is None]
    assert good == [(0, "tap", 1000.0), (3, "holdStart", 2000.0), (3, "holdEnd", 2000.0)]
    assert sorted(r.problem for r in found if r.problem) == ["unreadable", "unsupported"]
    assert chart.parse_pairs(lines).first().value == "3"


def test_judgement_engine():
    e = judge.Engine("B")
    e.add(0, 1, 1000, None, False)
    assert e.press(0, 700) == [] and e.press(0, 1040) == [(1, 0, 40)]
    e.add(1, 2, 1000, 2000, True)
    assert e.press(1, 1060) == [] and e.release(1, 2090) == [(2, 1, 60)]
    e.add(2, 3, 1000, None, False)
    e.add(2, 4, 1100, None, False)
    assert e.press(2, 1100) == [(3, 5, None), (4, 0, 0)]
    e.add(3, 5, 1000, 2000, True)
    assert e.press(3, 1000) == [] and e.release(3, 1500) == [(5, 5, None)]
    e.add(0, 6, 3000, None, False)
    assert e.advance(3200) == [] and e.advance(3201) == [(6, 5, None)]


def test_judgement_on_show():
    state, shown = judge.show(None, [0, 10, 20, 130, 140, 900], [3, 2, 3, 0, 4, 0], 100, 500)
    assert shown == [True, False, True, True, True, True] and state == (0, 900)


def test_resolver_rules(spark):
    key = lambda a, b: one(spark, text.token_score(lit(a), lit(b)))
    assert abs(key("blue moon river song", "moon river extra blue nights song") - 0.92) < 1e-12
    assert key("moon", "blue moon river") == 0.92 and key("a b", "b c") == 0.46
    assets = spark.createDataFrame(
        [(1, "Ring Blue", "X", None, "", 100_000, "f1.mp3", "a"), (2, None, "Other", None, "", 101_500, "01 my blue ring live.mp3", "b"), (3, None, "Other", None, "", 160_000, "01 my blue ring live.mp3", "c"), (4, "Zzz", "Q", None, "", 100_100, "q.mp3", "d"), (5, "Zzz", "Q", None, "", 300_000, "q.mp3", "e")],
        "asset_id int, title string, artist string, album string, isrc string, duration_ms long, file_name string, path string",
    ).withColumn("status", F.lit("ready"))
    track = spark.createDataFrame([(9, "Blue Ring", "X", None, None, 100_000, "live")], "query_id int, title string, artist string, album string, isrc string, duration_ms long, provider string")
    got = {r.asset_id: r for r in resolve.resolve(track, assets).collect()}
    assert set(got) == {1, 2, 3, 4}  # 5 has nothing in common
    assert abs(got[1].confidence - (0.28 + 0.34 + 0.24)) < 1e-6  # words in another order are similar, not equal
    assert abs(got[2].confidence - (0.62 + 0.24 + (1500 - 250) * -0.08 / 1750)) < 1e-6  # no title, near in time: the file name weighs most
    assert abs(got[3].confidence - 0.0) < 1e-6 and [e.kind for e in got[3].evidence] == ["file_similar"]
    assert abs(got[4].confidence - 0.24) < 1e-6 and [e.kind for e in got[4].evidence] == ["duration"]


def test_emptied_folder_is_missing(spark):
    assets = spark.createDataFrame([(1, 1, "a", "ready"), (2, 2, "b", "ready"), (3, 3, "c", "ready")], "asset_id int, directory_id int, path string, status string")
    seen = spark.createDataFrame([(1, "a")], "directory_id int, path string")
    folders = spark.createDataFrame([(1,), (2,)], "directory_id int")
    assert {r.asset_id: r.status for r in catalog.mark_missing(assets, seen, folders).collect()} == {1: "ready", 2: "missingFile", 3: "ready"}


def test_judged_session_resolves_each_object_once():
    draw = np.random.default_rng(1)
    kinds = ["tap", "holdStart", "holdEnd", "press", "release"]
    rows = pd.DataFrame([("s", float(draw.integers(0, 20000)), kinds[draw.integers(0, 5)], int(draw.integers(0, 4)), i) for i in range(300)], columns=["session_id", "time_ms", "kind", "lane", "id"])
    out = judge.judge_session(rows)
    assert out["object_id"].is_unique and set(out["object_id"]) <= set(rows[rows["kind"].isin(["tap", "holdStart"])]["id"])


def test_recursions_equal_loops(spark):
    rows = spark.createDataFrame([("a", i, float((i * 37) % 11)) for i in range(50)], "key string, i int, x double")
    got = [r.pcen for r in series.pcen(rows, "key", ["i"], "x").orderBy("i").collect()]
    level = None
    for i in range(50):
        x = float((i * 37) % 11)
        level = x if level is None else 0.975 * level + 0.025 * x
        want = max(0.0, (x / max(1e-6, level) ** 0.98 + 2) ** 0.5 - 2**0.5)
        assert abs(got[i] - want) < 1e-9
    kept = [r.i for r in series.cadence(rows, "key", "i", 20).orderBy("i").collect()]
    assert kept == [0, 20, 40, 49]
    assert series.growing_durations(5, 5, 12) == [5, 10, 12]


def test_audio_and_traces(spark, tmp_path):
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(24000)
        w.writeframes(np.repeat((np.sin(np.arange(2400) / 20) * 20000).astype("<i2"), 2).tobytes())
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.wav").write_bytes(buffer.getvalue())
    audio = audio_files.read_audio(spark, str(tmp_path / "in")).collect()
    assert sum(len(r.samples) for r in audio) == 4800
    assert files.scan_directory(spark, str(tmp_path / "in")).first().extension == "wav"
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        files.scan_directory(spark, str(tmp_path / "none"))
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/x").write_bytes(np.arange(3.0).tobytes())
    assert files.read_raw(spark, str(tmp_path / "raw")).first()["values"] == [0.0, 1.0, 2.0]
    rows = spark.createDataFrame([(float("inf"), 1)], "b double, a int")
    files.write_trace(rows, str(tmp_path / "trace"))
    assert spark.read.text(str(tmp_path / "trace")).first().value == '{"a":1,"b":"Infinity"}'
    env = tmp_path / ".env"
    env.write_text("# c\nexport A='x y'\nB=1 # note\nA=2\n")
    assert files.read_env([str(tmp_path / "no"), str(env)]) == {"A": "x y", "B": "1"}


def test_growing_clip(spark):
    blocks = spark.createDataFrame([("k", 0, [1.0, 2.0]), ("k", 1, [3.0, 4.0]), ("k", 2, [5.0])], "key string, n int, s array<double>")
    assert [r.s for r in files.growing_clip(blocks, "key", "n", "s", 3).orderBy("n").collect()] == [[1.0, 2.0], [3.0]]


def run(spark, tmp_path, fn, schema, batches):
    source, n = tmp_path / "stream", 0
    source.mkdir()
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").json(str(source / f"b{n}"))
        n += 1
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(source))
    q = fn(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out"))


def test_punctuated_stream_reports_late_rows(spark, tmp_path):
    schema = "session_id string, time_ms double, item string, complete_through_ms double"
    out = run(spark, tmp_path, stateful.punctuated, schema, [[("s", 10.0, "a", 20.0)], [("s", 15.0, "b", 30.0)], [("s", 40.0, "c", 50.0)]])
    assert {r.item: r.status for r in out.collect()} == {"a": "ok", "b": "late", "c": "failed"}


def test_hop_windows_cross_chunks_and_stop_at_gaps():
    step = stateful.hop_step(4, 2, 1000.0)
    chunk = lambda *rows: pd.DataFrame(rows, columns=["start_ms", "samples"])
    state, first = step(None, ("x",), chunk((0.0, [1, 2, 3])))
    assert first == []
    state, second = step(state, ("x",), chunk((3.0, [4, 5, 6])))
    assert [(r[1], r[2], r[3]) for r in second] == [(0, 0.0, [1, 2, 3, 4]), (0, 2.0, [3, 4, 5, 6])]
    state, third = step(state, ("x",), chunk((50.0, [7, 8, 9, 10])))
    assert [(r[1], r[2], r[3]) for r in third] == [(1, 50.0, [7, 8, 9, 10])]
