"""Wave files in blocks by byte range, and the sink for recordings."""

import io
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.sources import audio, files


def wav(samples, rate, channels=1, width=2):
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(samples)
    return buffer.getvalue()


def tone(rate, seconds, hz=440):
    return (np.sin(2 * np.pi * hz * np.arange(int(rate * seconds)) / rate) * 20000).astype("<i2")


@pytest.mark.parametrize("rate, target", [(44_100, 48_000), (48_000, 16_000), (44_101, 48_000), (8_000, 8_000)])
def test_blocks_equal_one_pass(rate, target):
    x = np.random.default_rng(1).normal(size=9000)
    total = -(-len(x) * target // rate)
    whole = audio.resampled(x, 0, 0, total, rate, target)
    parts = []
    for first in range(0, total, 1000):
        last = min(first + 1000, total)
        low, high = audio.span_of(first, last, len(x), rate, target)
        parts.append(audio.resampled(x[low:high], low, first, last, rate, target))
    assert np.array_equal(np.concatenate(parts), whole)


def test_tones_keep_their_shape_and_high_ones_go():
    x = np.sin(2 * np.pi * 440 * np.arange(44_100) / 44_100)
    y = audio.resampled(x, 0, 0, 48_000, 44_100, 48_000)
    want = np.sin(2 * np.pi * 440 * np.arange(48_000) / 48_000)
    assert np.abs(y - want)[200:-200].max() < 1e-4
    high = np.sin(2 * np.pi * 12_000 * np.arange(48_000) / 48_000)
    assert np.abs(audio.resampled(high, 0, 0, 16_000, 48_000, 16_000))[200:-200].max() < 1e-3


def test_one_long_file_is_read_by_many_tasks(spark, tmp_path):
    folder = tmp_path / "in put"
    folder.mkdir()
    (folder / "long.wav").write_bytes(wav(np.repeat(tone(44_100, 8), 2).tobytes(), 44_100, 2))
    (folder / "empty.wav").write_bytes(wav(b"", 44_100))
    (folder / "quiet.wav").write_bytes(wav(bytes([128]) * 80, 8_000, width=1))
    rows = audio.read_audio(spark, str(folder), 48_000, 24_000).withColumn("task", F.spark_partition_id()).cache()
    long = rows.where("path like '%long.wav'").orderBy("block").collect()
    assert len(long) == 16 and len({r.task for r in long}) > 1
    got = np.concatenate([r.samples for r in long])
    x = tone(44_100, 8) / 32768
    assert np.array_equal(got, audio.resampled(x, 0, 0, 384_000, 44_100, 48_000).astype(np.float32))
    other = {r.path.rsplit("/", 1)[1]: r for r in rows.where("path not like '%long.wav'").collect()}
    assert other["empty.wav"].samples == [] and other["quiet.wav"].samples == [0.0] * 480
    rows.unpersist()


def test_headers(spark, tmp_path):
    extra = wav(b"\x01\x02" * 10, 8_000)
    listed = extra[:12] + struct.pack("<4sI", b"LIST", 3) + b"abc\0" + extra[12:]
    (tmp_path / "list.wav").write_bytes(listed)
    (tmp_path / "cut.wav").write_bytes(extra[:-7])
    (tmp_path / "text.wav").write_bytes(b"no sound at all")
    rows = {r.path.rsplit("/", 1)[1]: r for r in audio.headers(files.scan_directory(spark, str(tmp_path))).collect()}
    assert rows["list.wav"].frames == 10 and rows["list.wav"].start == 56
    assert rows["cut.wav"].frames == 6
    assert rows["text.wav"].problem == "no wave file" and rows["text.wav"].frames is None
    with pytest.raises(Exception, match="text.wav: no wave file"):
        audio.read_audio(spark, str(tmp_path)).collect()


def test_samples_of_every_width():
    want = np.array([-1.0, 0.0, 0.5])
    assert np.array_equal(audio.mono(bytes([0, 128, 192]), 1, 1, audio.PCM), want)
    assert np.array_equal(audio.mono((want * 32768).astype("<i2").tobytes(), 1, 2, audio.PCM), want)
    three = b"".join(int(v * (1 << 23)).to_bytes(3, "little", signed=True) for v in want)
    assert np.array_equal(audio.mono(three, 1, 3, audio.PCM), want)
    assert np.array_equal(audio.mono(want.astype("<f8").tobytes(), 1, 8, audio.FLOAT), want)
    assert np.array_equal(audio.mono(np.array([0.5, -0.5, 1, 0], "<f4").tobytes(), 2, 4, audio.FLOAT), [0.0, 0.5])


TAKE = "recordingID string, stem string, createdAt string, sampleRate int, channelCount int, block int, samples array<float>"


def takes():
    rows = [("r1", "one", "2024-01-01T00:00:00Z", 8000, 2, b, [b / 8, -b / 8] * 400) for b in range(5)]
    return rows[::-1] + [("r2", "two", "2024-01-02T00:00:00Z", 44_100, 1, 0, [0.25] * 441), ("r3", "three", None, 8000, 1, 0, None)]


def test_recordings_round_trip(spark, tmp_path):
    root = str(tmp_path / "my takes")
    audio.write_recordings(spark.createDataFrame(takes(), TAKE), root)
    found = files.scan_directory(spark, root).cache()
    sidecars = {r.recordingID: r for r in files.read_sidecars(spark, root, ".json", found).collect()}
    assert {k: (r.durationMS, r.audioFileName) for k, r in sidecars.items()} == {"r1": (250.0, "one.wav"), "r2": (10.0, "two.wav"), "r3": (0.0, "three.wav")}
    heads = {r.path.rsplit("/", 1)[1]: r for r in audio.headers(found.where("extension = 'wav'")).collect()}
    one = heads["one.wav"]
    assert (one.frames, one.rate, one.channels, one.kind) == (2000, 8000, 2, audio.FLOAT)
    path = next((tmp_path / "my takes").rglob("one.wav"))
    data = np.frombuffer(path.read_bytes()[one.start :], "<f4").reshape(-1, 2)
    assert np.array_equal(data[:, 0], np.repeat(np.arange(5) / 8, 400).astype("f4")) and np.array_equal(data[:, 1], -data[:, 0])
    found.unpersist()
    # A sidecar whose audio is gone, or lies elsewhere, does not count.
    next((tmp_path / "my takes").rglob("two.wav")).unlink()
    left = files.read_sidecars(spark, root, ".json", files.scan_directory(spark, root))
    assert sorted(r.recordingID for r in left.collect()) == ["r1", "r3"]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    root = tmp_path / "takes"
    whole = spark.createDataFrame(takes(), TAKE)
    half = spark.createDataFrame([("r4", "four", None, 8000, 2, 0, [0.5] * 3)], TAKE)
    with pytest.raises(Exception, match="3 samples for 1 frames"):
        audio.write_recordings(whole.unionByName(half), str(root))
    assert not root.exists() or not [p for p in root.rglob("*") if p.is_file()]
    with pytest.raises(Exception, match="no bare name"):
        audio.write_recordings(whole.withColumn("stem", F.lit("../out")), str(root))
    assert not list(tmp_path.rglob("out*"))
    audio.write_recordings(whole.limit(0), str(root))
