"""The feature extractor over audio chunks, in batch and as a stream.

A source's chunks are joined to windows every hop; each window becomes a frame
of features. Some of them remember: onsets the bands before, normalised mel and
chroma their smoothed levels, the signal-to-noise ratio a noise floor, landmarks
the anchors that still look for a target. A change of rate, or a gap in the
recorded time or in the host's, forgets all of that and begins a segment. Batch
and stream run one fold; the stream keeps its state in named variables, so that
a small part of it is written where a small part changes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators import spectra
from tidemark.operators.series import PCEN_BIAS, PCEN_FLOOR, PCEN_GAIN, PCEN_RATE, PCEN_ROOT
from tidemark.session import spread

# Smoothing of chroma, steps of its levels, the noise floor's rates and least level.
CENS_RATE, CENS_STEPS, RISE, FALL, SILENCE = 0.25, (0.05, 0.10, 0.20, 0.40), 0.02, 0.25, -120.0

LANDMARK = "hash:bigint,anchor_ms:double,anchor_bin:int,target_bin:int,delta:int"
FRAMES = (
    "stream_id string, segment int, recorded_ms double, host_ms double, energy_db double, snr_db double, onset double, subband array<double>, "
    f"pcen array<double>, chroma array<double>, cens array<double>, landmarks array<struct<{LANDMARK}>>, kept_from_ms double"
)
COLUMNS = [c.split(" ")[0] for c in FRAMES.split(", ")]


@dataclass(frozen=True)
class Shape:
    """Samples of a window and of a hop, the hop in ms that gaps are counted in, hops a gap may have, and ms that frames are kept."""

    size: int = 1024
    hop: int = 512
    hop_ms: float = 512 / 48
    gap_hops: int = 2
    keep_ms: float = 8000.0


@dataclass
class Memory:
    """What a source carries from window to window; a segment's beginning knows nothing."""

    bands: list[float] | None = None
    levels: list[float] | None = None
    chroma: list[float] | None = None
    floor: float | None = None
    frame: int = 0
    anchors: list[tuple[int, float, int, int]] = field(default_factory=list)

    def landmarks(self, peaks: list[dict], at: float) -> list[dict]:
        """Pairs of waiting anchors with this frame's peaks, strongest first, FAN_OUT for an anchor."""
        found, waiting = [], []
        for frame, since, anchor, sent in self.anchors:
            delta = self.frame - frame
            for peak in peaks[: max(0, spectra.FAN_OUT - sent)] if 1 <= delta <= spectra.MAX_DELTA else []:
                hash_ = (anchor & 0xFFFF) << 32 | (peak["bin"] & 0xFFFF) << 16 | delta & 0xFFFF
                found.append({"hash": hash_, "anchor_ms": since, "anchor_bin": anchor, "target_bin": peak["bin"], "delta": delta})
                sent += 1
            if delta < spectra.MAX_DELTA and sent < spectra.FAN_OUT:
                waiting.append((frame, since, anchor, sent))
        self.anchors = waiting + [(self.frame, at, p["bin"], 0) for p in peaks]
        self.frame += 1
        return found

    def frame_of(self, window: np.ndarray, rate: float, at: float) -> dict:
        """The features of one window that ends at ``at``; the memory moves on."""
        own = spectra.window_features(window, rate)
        bands, mel, chroma = (np.asarray(own[c], float) for c in ("subband", "mel", "chroma"))
        rise = np.zeros(len(bands)) if self.bands is None else np.maximum(0.0, bands - self.bands)
        before = mel if self.levels is None else np.asarray(self.levels)
        levels = (1 - PCEN_RATE) * before + PCEN_RATE * mel
        pcen = np.maximum(0.0, (mel / np.maximum(PCEN_FLOOR, levels) ** PCEN_GAIN + PCEN_BIAS) ** PCEN_ROOT - PCEN_BIAS**PCEN_ROOT)
        smooth = chroma if self.chroma is None else (1 - CENS_RATE) * np.asarray(self.chroma) + CENS_RATE * chroma
        steps = np.searchsorted(CENS_STEPS, smooth, side="right").astype(float)
        length = np.linalg.norm(steps)
        energy, snr = own["energy_db"], 0.0
        if self.floor is None:
            floor = energy
        else:
            floor = self.floor + (energy - self.floor) * (RISE if energy > self.floor else FALL)
            snr = max(0.0, energy - floor)
        self.bands, self.levels, self.chroma, self.floor = bands.tolist(), levels.tolist(), smooth.tolist(), max(SILENCE, floor)
        return {
            "energy_db": energy, "snr_db": snr, "onset": float(rise.sum()), "subband": rise.tolist(), "pcen": pcen.tolist(), "chroma": chroma.tolist(),
            "cens": (steps / length if length > 0 else steps).tolist(), "landmarks": self.landmarks(own["peaks"], at),
        }


@dataclass
class Source:
    """The audio not yet framed, its clocks, and the times of the frames kept of this segment."""

    rate: float | None = None
    recorded_ms: float = 0.0
    host_ms: float = 0.0
    recorded_end: float = 0.0
    host_end: float = 0.0
    segment: int = 0
    framed: bool = False
    pending: list[float] = field(default_factory=list)
    kept: list[float] = field(default_factory=list)
    memory: Memory = field(default_factory=Memory)

    def breaks(self, recorded: float, host: float, rate: float, s: Shape) -> bool:
        most = s.hop_ms * s.gap_hops
        return self.rate is not None and (self.rate != rate or abs(recorded - self.recorded_end) > most or abs(host - self.host_end) > most)

    def append(self, recorded: float, host: float, rate: float, samples: np.ndarray, s: Shape) -> list[dict]:
        """The frames that a chunk completes. A chunk without samples or rate is passed over."""
        if samples is None or not len(samples) or not rate > 0:
            return []
        if self.breaks(recorded, host, rate, s):
            # a segment that never had a frame is not counted
            self.segment, self.framed, self.pending, self.kept, self.rate, self.memory = self.segment + self.framed, False, [], [], None, Memory()
        if self.rate is None:
            self.rate, self.recorded_ms, self.host_ms = rate, recorded, host
        audio = np.concatenate([self.pending, np.asarray(samples, float)])
        self.recorded_end, self.host_end = (x + 1000 * len(samples) / rate for x in (recorded, host))
        out, at, long, step = [], 0, 1000 * s.size / rate, 1000 * s.hop / rate
        while len(audio) - at >= s.size:
            end = self.recorded_ms + long
            self.kept = [t for t in [*self.kept, end] if t >= end - s.keep_ms]
            found = self.memory.frame_of(audio[at : at + s.size], rate, end)
            out.append({"segment": self.segment, "recorded_ms": end, "host_ms": self.host_ms + long, **found, "kept_from_ms": self.kept[0]})
            at, self.recorded_ms, self.host_ms, self.framed = at + s.hop, self.recorded_ms + step, self.host_ms + step, True
        self.pending = audio[at:].tolist()
        return out


CHUNK = ["recorded_ms", "host_ms", "rate", "samples"]


def _framed(source: Source, key: str, rows: pd.DataFrame, s: Shape) -> pd.DataFrame:
    """The frames of a key's chunks in order of recorded time."""
    out = []
    for recorded, host, rate, samples in rows.sort_values(["recorded_ms", "host_ms"], kind="stable")[CHUNK].itertuples(index=False):
        if recorded == recorded and host == host:
            out += source.append(float(recorded), float(host), float(rate) if rate == rate and rate is not None else 0.0, samples, s)
    return pd.DataFrame([{"stream_id": key, **x} for x in out], columns=COLUMNS)


def frames(chunks: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """Frames of recorded chunks (stream_id, recorded_ms, host_ms, rate, samples), a source in a task, as its memory demands.

    Chunks without a source, a time, a rate or samples have no part; chunks of
    one time are taken by host time. An empty table gives no frames.
    """
    rows = chunks.where("stream_id IS NOT NULL").select("stream_id", *CHUNK)
    return spread(rows, "stream_id").groupBy("stream_id").applyInPandas(lambda p: _framed(Source(), str(p["stream_id"].iloc[0]), p, shape), FRAMES)


class Extractor(StatefulProcessor):
    """``Source`` over micro-batches: clocks, audio, memory, anchors and kept times are state variables of their own.

    A key without a chunk for ``idle_ms`` of event time is forgotten.
    """

    def __init__(self, shape: Shape, idle_ms: int):
        self.shape, self.idle_ms = shape, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "rate double, recorded_ms double, host_ms double, recorded_end double, host_end double, segment int, framed boolean, frame int")
        self.audio = handle.getValueState("audio", "pending array<double>")
        self.memory = handle.getValueState("memory", "bands array<double>, levels array<double>, chroma array<double>, floor double")
        self.anchors = handle.getListState("anchors", "frame int, at_ms double, bin int, sent int")
        self.kept = handle.getListState("kept", "at_ms double")

    def load(self) -> Source:
        if not self.clock.exists():
            return Source()
        rate, recorded, host, recorded_end, host_end, segment, framed, frame = self.clock.get()
        bands, levels, chroma, floor = self.memory.get()
        memory = Memory(*[list(x) if x is not None else None for x in (bands, levels, chroma)], floor, frame, [tuple(x) for x in self.anchors.get()])
        return Source(rate, recorded, host, recorded_end, host_end, segment, framed, list(self.audio.get()[0]), [x[0] for x in self.kept.get()], memory)

    def store(self, x: Source) -> None:
        m = x.memory
        self.clock.update((x.rate, x.recorded_ms, x.host_ms, x.recorded_end, x.host_end, x.segment, x.framed, m.frame))
        self.audio.update((x.pending,))
        self.memory.update((m.bands, m.levels, m.chroma, m.floor))
        for state, rows in ((self.anchors, m.anchors), (self.kept, [(t,) for t in x.kept])):
            if rows:
                state.put(rows)
            else:
                state.clear()

    def handleInputRows(self, key, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        source, own = self.load(), pd.concat(list(rows), ignore_index=True)
        found = _framed(source, str(key[0]), own, self.shape)
        if source.rate is not None:
            self.store(source)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            last = int(own["at"].max().timestamp() * 1000)
            self.handle.registerTimer(max(last, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        yield found

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.clock, self.audio, self.memory, self.anchors, self.kept):
            state.clear()
        return iter([])

    def close(self) -> None:
        pass


def live_frames(chunks: DataFrame, shape: Shape = Shape(), late: str = "10 seconds", idle_ms: int = 60_000) -> DataFrame:
    """``frames`` of a stream of chunks, which also have ``at``, their event time.

    However the chunks are dealt to micro-batches, as long as a source's come in
    order, the frames are those of the batch form. The session's state store
    must be RocksDB.
    """
    rows = chunks.where("stream_id IS NOT NULL").select("stream_id", *CHUNK, "at").withWatermark("at", late)
    return rows.groupBy("stream_id").transformWithStateInPandas(Extractor(shape, idle_ms), FRAMES, "Append", "EventTime")


def flat_landmarks(frames: DataFrame, keys: list[str], time: str = "recorded_ms") -> DataFrame:
    """Every frame's landmarks as rows: keys, hash, anchor_ms, anchor_bin, target_bin, delta.

    A frame without landmarks that has ``landmark_hashes`` gives each of them,
    anchored at the frame's own time, with bins 0 and 1 and a delta of 1. Null
    lists are empty; repeated landmarks stay.
    """
    kind = f"array<struct<{LANDMARK}>>"
    alone: Column = F.transform(
        F.coalesce("landmark_hashes", F.array().cast("array<bigint>")),
        lambda h: F.struct(h.alias("hash"), F.col(time).cast("double").alias("anchor_ms"), F.lit(0).alias("anchor_bin"), F.lit(1).alias("target_bin"), F.lit(1).alias("delta")),
    )
    every = F.when(F.size(F.coalesce("landmarks", F.array().cast(kind))) > 0, F.col("landmarks")).otherwise(alone.cast(kind))
    return frames.select(*keys, F.explode(every).alias("l")).select(*keys, "l.*")


def payload_frames(windows: DataFrame, payload: str = "payload") -> DataFrame:
    """Windows (with recorded_ms, host_ms and a struct of features) as frames: the struct's fields become columns beside the times."""
    return windows.select(*[c for c in windows.columns if c != payload], f"{payload}.*")
