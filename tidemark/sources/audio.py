"""PCM wave files, read by byte ranges and resampled in blocks; and recordings, written as wave files with sidecars.

Files are reached through ``pyarrow.fs``, by local path or by the address of a
store that it knows.
"""

from __future__ import annotations

import json
import math
import struct
import uuid
from functools import lru_cache
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tidemark.session import spread
from tidemark.sources.files import scan_directory

# Kernel of the resampler: zero crossings to either side and the shape of its window.
CROSSINGS, BETA = 64, 9.0
# Most weights that are held at once.
CELLS = 1 << 19
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
HEADER = "path string, problem string, start long, frames long, rate int, channels int, width int, kind int"


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path and its place there. Paths are as ``binaryFile`` tells them, not quoted."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(quote(path, safe="/:@?=&%")) if "://" in path else (pafs.LocalFileSystem(), path)


def _open(path: str):
    fs, where = _store(path)
    return fs.open_input_file(where)


def header(f) -> tuple[int, int, int, int, int, int]:
    """Start of the samples, frames, rate, channels, bytes of a sample and kind of a wave file, open for reading.

    Chunks are passed over by their sizes. A last chunk that claims more than
    the file holds, as of a recording cut short, ends with the file.
    """
    size, at, form = f.size(), 12, None
    f.seek(0)
    head = f.read(12)
    if head[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise ValueError("no wave file")
    while at + 8 <= size:
        f.seek(at)
        name, length = struct.unpack("<4sI", f.read(8))
        if name == b"fmt ":
            data = f.read(min(length, 40))
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", data[:16])
            form = (struct.unpack("<H", data[24:26])[0] if kind == EXTENSIBLE and len(data) >= 26 else kind, channels, rate, bits // 8)
        elif name == b"data":
            if form is None:
                raise ValueError("samples before their format")
            kind, channels, rate, width = form
            if not rate or not channels or (kind, width) not in {(PCM, 1), (PCM, 2), (PCM, 3), (PCM, 4), (FLOAT, 4), (FLOAT, 8)}:
                raise ValueError(f"samples of kind {kind} and {width} bytes, {channels} channels, rate {rate}")
            return at + 8, min(length, size - at - 8) // (width * channels), rate, channels, width, kind
        at += 8 + length + length % 2
    raise ValueError("no samples")


def mono(data: bytes, channels: int, width: int, kind: int) -> np.ndarray:
    """Mean over the channels of whole frames, in -1..1."""
    if kind == FLOAT:
        x = np.frombuffer(data, f"<f{width}").astype(float)
    elif width == 1:
        x = (np.frombuffer(data, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(data, f"<i{width}").astype(float) / (1 << (8 * width - 1))
    return x.reshape(-1, channels).mean(axis=1)


def _weights(rate: int, target: int, phases: np.ndarray) -> np.ndarray:
    """For target samples that lie ``phases`` (0 to 1) after a source sample, the weights of the samples around it."""
    half, cut = _half(rate, target), min(1.0, target / rate)
    away = np.arange(-half, half + 1)[None, :] - phases[:, None]
    inside = np.clip(1 - (away / (half + 1)) ** 2, 0, None)
    return cut * np.sinc(cut * away) * np.i0(BETA * np.sqrt(inside)) / np.i0(BETA)


def _half(rate: int, target: int) -> int:
    return math.ceil(CROSSINGS / min(1.0, target / rate))


@lru_cache(8)
def _table(rate: int, target: int) -> np.ndarray | None:
    """Weights of all phases, where they are few; else None, and they are made when needed."""
    up = target // math.gcd(rate, target)
    return _weights(rate, target, np.arange(up) / up) if up * (2 * _half(rate, target) + 1) <= CELLS else None


def span_of(first: int, last: int, frames: int, rate: int, target: int) -> tuple[int, int]:
    """The source frames that target samples ``first`` to ``last`` (left out) need."""
    if rate == target:
        return first, min(last, frames)
    half = _half(rate, target)
    return max(0, first * rate // target - half), min(frames, (last - 1) * rate // target + half + 1)


def resampled(x: np.ndarray, offset: int, first: int, last: int, rate: int, target: int) -> np.ndarray:
    """Target samples ``first`` to ``last`` from source samples ``x`` that begin at ``offset``; silence beyond the ends.

    A windowed sinc; each sample depends on those around it alone, so blocks
    put together are, bit by bit, what one pass over the file gives.
    """
    if rate == target:
        return x[first - offset : last - offset]
    half, table = _half(rate, target), _table(rate, target)
    g, out = math.gcd(rate, target), np.empty(last - first)
    up, down, step = target // g, rate // g, max(1, CELLS // (2 * half + 1))
    padded = np.concatenate([np.zeros(half), x, np.zeros(half + 1)])
    for k in range(first, last, step):
        n = np.arange(k, min(k + step, last))
        near = (n * down // up - offset)[:, None] + np.arange(2 * half + 1)[None, :]
        phase = n * down % up
        out[n - first] = (padded[near] * (_weights(rate, target, phase / up) if table is None else table[phase])).sum(axis=1)
    return out


def headers(files: DataFrame) -> DataFrame:
    """path, problem, start, frames, rate, channels, width and kind of wave files (path), read from their heads alone."""

    def run(batches):
        for p in batches:
            for path in p["path"]:
                try:
                    with _open(path) as f:
                        row = (path, None, *header(f))
                except (ValueError, struct.error, OSError) as e:
                    row = (path, str(e) or type(e).__name__, *[None] * 6)
                yield pd.DataFrame([row], columns=[c.split()[0] for c in HEADER.split(", ")]).astype(object)

    return spread(files.select("path"), "path").mapInPandas(run, HEADER)


def blocks(heads: DataFrame, target_rate: int = 48_000, span: int = 48_000) -> DataFrame:
    """path, block, rate and samples (float array): mono samples at the target rate in blocks of ``span``.

    heads: what ``headers`` gives. A block is a row before anything is read, and
    rows are dealt over all tasks: each reads its own bytes and those of its
    neighbours that the kernel reaches. A file with a problem raises; a file
    without frames gives one empty block.
    """
    total = F.ceil(F.col("frames") * target_rate / F.col("rate"))
    bad = F.raise_error(F.concat("path", F.lit(": "), "problem")).cast("long")
    total = F.when(F.col("problem").isNotNull(), bad).otherwise(total)
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((total - 1) / span))))
    rows = heads.withColumn("total", total).withColumn("block", number)

    def run(batches):
        for p in batches:
            for r in p.itertuples(index=False):
                first, last = r.block * span, min((r.block + 1) * span, r.total)
                x = np.empty(0)
                if last > first:
                    low, high = span_of(first, last, r.frames, r.rate, target_rate)
                    with _open(r.path) as f:
                        f.seek(r.start + low * r.channels * r.width)
                        data = f.read((high - low) * r.channels * r.width)
                    x = resampled(mono(data, r.channels, r.width, r.kind), low, first, last, r.rate, target_rate)
                yield pd.DataFrame({"path": [r.path], "block": [r.block], "rate": [target_rate], "samples": [x.astype(np.float32)]})

    return spread(rows.drop("problem"), "path", "block").mapInPandas(run, "path string, block long, rate int, samples array<float>")


def read_audio(spark: SparkSession, root: str, target_rate: int = 48_000, span: int = 48_000) -> DataFrame:
    """The blocks of all wave files below ``root``."""
    return blocks(headers(scan_directory(spark, root).where("extension = 'wav'")), target_rate, span)


class Recordings(DataSource):
    """Sink ``recordings``: one wave file of floats and one sidecar for each recording.

    Use ``write_recordings``. Tasks write below a hidden folder; the commit moves
    it into place by one rename, so files and sidecars of a write appear
    together or not at all. Needs a store that can rename a folder.
    """

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("recordings are only added")
        return RecordingWriter(self.options["path"])


class TaskFolder(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name


class RecordingWriter(DataSourceArrowWriter):
    def __init__(self, root: str):
        self.root, self.job = root.rstrip("/"), uuid.uuid4().hex

    def _place(self):
        fs, root = _store(self.root)
        return fs, root, f"{root}/_writing-{self.job}"

    def write(self, batches) -> TaskFolder:
        fs, _, stage = self._place()
        task = uuid.uuid4().hex
        fs.create_dir(f"{stage}/{task}", recursive=True)
        out = now = None
        written = 0

        def close():
            if out is None:
                return
            out.close()
            if written != now["frames"] * now["channelCount"]:  # so also where a frame is not whole
                raise ValueError(f"{now['recordingID']}: {written} samples for {now['frames']} frames of {now['channelCount']} channels")
            sidecar = {k: now[k] for k in ("recordingID", "createdAt", "sampleRate", "channelCount")}
            sidecar |= {"audioFileName": f"{now['stem']}.wav", "durationMS": math.floor(now["frames"] / now["sampleRate"] * 1000 + 0.5)}
            with fs.open_output_stream(f"{stage}/{task}/{now['stem']}.json") as f:
                f.write(json.dumps(sidecar, sort_keys=True, indent=1).encode())

        for batch in batches:
            for row in batch.to_pylist():
                if now is None or row["recordingID"] != now["recordingID"]:
                    close()
                    now, written = row, 0
                    out = fs.open_output_stream(f"{stage}/{task}/{row['stem']}.wav")
                    size, wide = row["frames"] * row["channelCount"] * 4, row["channelCount"] * 4
                    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, FLOAT, row["channelCount"], int(row["sampleRate"]), int(row["sampleRate"]) * wide, wide, 32)
                    out.write(struct.pack("<4sI4s", b"RIFF", 36 + size, b"WAVE") + form + struct.pack("<4sI", b"data", size))
                samples = np.asarray(row["samples"] or [], "<f4")
                written += len(samples)
                out.write(samples.tobytes())
        close()
        return TaskFolder(task)

    def commit(self, messages) -> None:
        fs, root, stage = self._place()
        kept = {m.name for m in messages if m is not None}
        if fs.get_file_info(stage).type == pafs.FileType.NotFound:
            return
        for found in fs.get_file_info(pafs.FileSelector(stage)):  # what failed attempts have left
            if found.base_name not in kept:
                fs.delete_dir(found.path)
        fs.move(stage, f"{root}/takes-{self.job}")

    def abort(self, messages) -> None:
        fs, _, stage = self._place()
        if fs.get_file_info(stage).type != pafs.FileType.NotFound:
            fs.delete_dir(stage)


def write_recordings(blocks: DataFrame, root: str) -> None:
    """Write recordings below ``root``: recordingID, stem, createdAt, sampleRate, channelCount, block and samples (interleaved).

    ``stem`` names the files and must be a bare name of its own for each
    recording. Blocks go to their file one after the other, in order of
    ``block``; a task holds one batch. Rates are whole numbers. A recording over
    4 GB, the most that a wave file can say, fails the write.
    """
    spark = blocks.sparkSession
    spark.dataSource.register(Recordings)
    safe = F.when(F.col("stem").rlike(r"^[^/\\.][^/\\]*$"), F.col("stem")).otherwise(F.raise_error(F.concat(F.lit("no bare name: "), F.coalesce("stem", F.lit("null")))))
    size = blocks.groupBy("recordingID").agg(F.sum(F.coalesce(F.size("samples"), F.lit(0))).alias("n"))
    rows = blocks.join(size, "recordingID").select(
        "recordingID", safe.alias("stem"), "createdAt", F.col("sampleRate").cast("double"), F.col("channelCount").cast("int"), "block",
        F.col("samples").cast("array<float>"), F.floor(F.col("n") / F.col("channelCount")).alias("frames"),
    )
    rows = spread(rows, "recordingID").sortWithinPartitions("recordingID", "block")
    rows.write.format("recordings").mode("append").save(root)
