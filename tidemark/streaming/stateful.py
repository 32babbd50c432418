"""Stateful streams: one step function for each key, the same as in batch.

A step takes the state so far and the key's new rows and returns the next state
and output rows. State is stored by Structured Streaming with the query's
checkpoint, so a lost executor resumes from the last committed batch.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators import landmark_lock, lock
from tidemark.operators.judge import JUDGED, Engine
from tidemark.operators.tracker import EMPTY, TRACKED, follow

Step = Callable[[object, tuple, pd.DataFrame], tuple[object, list[tuple]]]


def stateful(rows: DataFrame, key: str, step: Step, schema: str) -> DataFrame:
    """Run ``step`` over a stream keyed by ``key``; outputs are appended."""
    columns = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = pickle.loads(bytes(state.get[0])) if state.exists else None
        new = pd.concat(list(batches), ignore_index=True)  # one key's rows of one micro-batch
        now, out = step(now, k, new)
        state.update((pickle.dumps(now),))
        yield pd.DataFrame(out, columns=columns)

    return rows.groupBy(key).applyInPandasWithState(run, schema, "state binary", "append", GroupStateTimeout.NoTimeout)


PUNCTUATED = "session_id string, time_ms double, item string, status string"


def punctuated_step(state, key, rows):
    """Rows carry ``complete_through_ms``, the source's own watermark.

    An object at or before the watermark declared by earlier batches fails the
    session: it is reported as ``late`` and everything after as ``failed``.
    Within a batch rows are sorted by time. The watermark is the greatest one
    declared and never falls.
    """
    mark, failed = state or (float("-inf"), False)
    out, limit = [], mark
    for time, item in rows.sort_values(["time_ms", "item"], kind="stable")[["time_ms", "item"]].itertuples(index=False):
        late = not failed and time <= limit
        out.append((key[0], time, item, "late" if late else "failed" if failed else "ok"))
        failed |= late
    declared = rows["complete_through_ms"].max()
    return (max(mark, declared) if declared == declared else mark, failed), out


def punctuated(rows: DataFrame) -> DataFrame:
    """Objects (session_id, time_ms, item, complete_through_ms) with their status."""
    return stateful(rows, "session_id", punctuated_step, PUNCTUATED)


WINDOWS = "stream_id string, segment int, start_ms double, samples array<double>"


def hop_step(size: int, hop: int, rate: float) -> Step:
    """Windows of ``size`` samples every ``hop`` across chunks; a gap of over two hops starts a new segment."""

    def step(state, key, rows):
        left, next_ms, start_ms, segment = state or ([], None, None, 0)
        out = []
        for at, samples in rows.sort_values("start_ms", kind="stable")[["start_ms", "samples"]].itertuples(index=False):
            if next_ms is None or abs(at - next_ms) > 2000 * hop / rate:
                segment += next_ms is not None
                left, start_ms = [], at
            left = [*left, *samples]
            next_ms = at + 1000 * len(samples) / rate
            while len(left) >= size:
                out.append((key[0], segment, start_ms, [float(x) for x in left[:size]]))
                left, start_ms = left[hop:], start_ms + 1000 * hop / rate
        return (left, next_ms, start_ms, segment), out

    return step


def hop_windows(chunks: DataFrame, size: int = 1024, hop: int = 512, rate: float = 48_000) -> DataFrame:
    """Sample windows of chunks (stream_id, start_ms, samples)."""
    return stateful(chunks, "stream_id", hop_step(size, hop, rate), WINDOWS)


def judge_step(table: str) -> Step:
    """The judgement engine over live rows: objects must come before the inputs that meet them."""

    def step(engine, key, rows):
        engine, out = engine or Engine(table), []
        for kind, lane, id_, at in rows.sort_values(["time_ms", "id"], kind="stable")[["kind", "lane", "id", "time_ms"]].itertuples(index=False):
            if kind == "holdEnd":
                engine.close(int(lane), at)
            elif kind in ("tap", "holdStart"):
                engine.add(int(lane), int(id_), at, None, kind == "holdStart")
            else:
                found = engine.advance(at)
                found += engine.press(int(lane), at) if kind == "press" else engine.release(int(lane), at)
                out += [(key[0], *x, at) for x in found]
        return engine, out

    return step


def judge(rows: DataFrame, table: str = "B") -> DataFrame:
    """Live judgements of rows (session_id, kind, lane, id, time_ms)."""
    return stateful(rows, "session_id", judge_step(table), JUDGED)


def track_step(state, key, rows):
    return follow(state or (EMPTY, None), str(key[0]), rows)


def track(measurements: DataFrame) -> DataFrame:
    """The offset tracker over live measurements (key, at_ms, offset_ms, confidence)."""
    return stateful(measurements, "key", track_step, TRACKED)


def align_step(hop_ms: float, window_ms: float, cadence_ms: float) -> Step:
    """The fold of ``lock.align`` over live frames.

    Rows of kind ``reference`` must come before the frames that they serve, or
    with them. State holds the reference, the frames of the last window and
    what ``lock.advance`` carries, as arrays and plain tuples.
    """

    def step(state, key, rows):
        reference, tail, held = state or (None, None, None)
        held = lock.Held(*held) if held else lock.Held()
        if held.guess:
            held = held._replace(guess=lock.Position(*held.guess))
        if held.track:
            held = held._replace(track=lock.Position(*held.track))
        rows = rows[rows["t_ms"].notna() & rows["bands"].notna()].sort_values("t_ms", kind="stable")

        def arrays(part):
            return part["t_ms"].to_numpy(float), np.array(part["bands"].tolist(), float), part["energy_dbfs"].astype(float).fillna(-200.0).to_numpy()

        def joined(old, new):
            return new if old is None else tuple(np.concatenate(x) for x in zip(old, new))

        targets, frames = rows[rows["kind"] == "reference"], rows[rows["kind"] != "reference"]
        if len(targets):
            reference = joined(reference, arrays(targets)[:2])
        if not len(frames):
            return (reference, tail, tuple(held)), []
        matcher = None
        if reference is not None:
            order = np.argsort(reference[0], kind="stable")
            matcher = lock.Matcher(reference[1][order], float(reference[0][order[0]]), hop_ms)
        begin = 0 if tail is None else len(tail[0])
        times, bands, energy = joined(tail, arrays(frames))
        held, out = lock.fold(held, times, bands, energy, matcher, hop_ms, window_ms, cadence_ms, begin)
        recent = times >= times[-1] - window_ms - hop_ms
        plain = tuple(tuple(x) if isinstance(x, tuple) else x for x in held)
        return (reference, (times[recent], bands[recent], energy[recent]), plain), [(str(key[0]), *x) for x in out]

    return step


def align(rows: DataFrame, hop_ms: float, window_ms: float = 5000.0, cadence_ms: float = 500.0) -> DataFrame:
    """Live alignment of rows (key, kind, t_ms, bands, energy_dbfs): kind is ``reference`` or ``frame``."""
    return stateful(rows, "key", align_step(hop_ms, window_ms, cadence_ms), lock.ALIGNED)


def landmark_align_step(state, key, rows):
    now, out = landmark_lock.follow(state, str(key[0]), rows)
    return tuple(now), out


def landmark_align(windows: DataFrame) -> DataFrame:
    """The alignment by landmark candidates over live windows (key, at_ms, ready, long, candidates)."""
    return stateful(windows, "key", landmark_align_step, landmark_lock.SHOWN)


def throttle_step(least_ms: float) -> Step:
    """Let a row through when ``least_ms`` have passed, or time moved backwards or is undefined."""

    def step(last, key, rows):
        out = []
        for at in rows["at_ms"].astype(float):
            if last is None or at != at or at < last or at - last >= least_ms:
                out.append((key[0], at))
                last = at if at == at else last
        return last, out

    return step


def throttle(rows: DataFrame, least_ms: float = 100.0) -> DataFrame:
    return stateful(rows, "key", throttle_step(least_ms), "key string, at_ms double")


def of_session(rows: DataFrame, sessions: DataFrame, generation: str = "generation") -> DataFrame:
    """Rows of current sessions and generations; stale and foreign ones are dropped."""
    now = sessions.groupBy("session_id").agg(F.max(generation).alias(generation))
    return rows.join(now, ["session_id", generation], "left_semi")


def event_windows(rows: DataFrame, key: str, time: str, late: str, size: str, slide: str) -> DataFrame:
    """Counts in sliding event-time windows behind a watermark; later rows are dropped."""
    return rows.withWatermark(time, late).groupBy(key, F.window(time, size, slide)).agg(F.count("*").alias("n"))
