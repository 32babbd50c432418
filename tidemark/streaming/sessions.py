"""Sessions as state machines over streams: a buffered chart with a terminal record, and judgement behind two watermarks.

Each has one fold that batch and stream share; the stream keeps its state in
named variables and forgets a session once it is over.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.judge import TAIL, Engine, Lane
from tidemark.session import spread

# Fixed values, in ms: how long the buffer must be before rendering starts, and how far from now its first object is.
BUFFERED_MS, LEAD_MS = 5000.0, 1000.0

SHOWN = "session_id string, seq long, status string, lane int, item string, time_ms double"
SHOWN_COLUMNS = [c.split(" ")[0] for c in SHOWN.split(", ")]


def closed_span(objects: Iterable[tuple[float, int, str]], least: float | None = None) -> tuple[float, float] | None:
    """From the first time (of ``least`` on, with no lane held before it) to the last time at which no lane is held."""
    held: set[int] = set()
    start = end = None
    by_time: dict[float, list[tuple[int, str]]] = {}
    for at, lane, item in objects:
        by_time.setdefault(at, []).append((lane, item))
    for at in sorted(by_time):
        if start is None and (least is None or (at >= least and not held)):
            start = at
        for lane, item in by_time[at] if least is None else sorted(by_time[at], key=lambda x: x[0]):
            if item == "holdStart":
                held.add(lane)
            elif item == "holdEnd":
                held.discard(lane)
        if start is not None and not held:
            end = at
    return None if start is None or end is None else (start, end)


def _time(x: object) -> float | None:
    """A time that counts: finite and not below 0."""
    return float(x) if x is not None and x == x and 0 <= float(x) < math.inf else None


@dataclass
class Buffered:
    """A chart that arrives: buffering, then streaming from ``start`` on, in the end ended or failed."""

    phase: str = "buffering"
    start: float | None = None
    end: float | None = None
    least: float | None = None
    most: float | None = None
    objects: list[tuple[float, int, str]] = field(default_factory=list)

    def inside(self, at: float | None) -> bool:
        return at is not None and (self.least is None or at >= self.least) and (self.most is None or at <= self.most)

    def take(self, at: float | None, lane: int, item: str) -> str | None:
        """Why an object is not taken; before the start nothing goes into the window already closed."""
        if self.end is not None:
            return "closed"
        if not self.inside(at):
            return "outside"
        window = closed_span(self.objects) if self.phase == "buffering" else None
        if window is not None and at <= window[1]:
            return "late"
        self.objects.append((at, lane, item))
        return None

    def bound(self, least: float | None = None, most: float | None = None) -> None:
        self.least, self.most = self.least if least is None else least, self.most if most is None else most
        self.objects = [o for o in self.objects if self.inside(o[0])]

    def finish(self, at: float | None) -> None:
        """The earliest end declared counts; each declaration prunes."""
        if at is not None:
            self.end = at if self.end is None else min(self.end, at)
            self.bound(most=at)

    def begin(self, now: float | None) -> bool:
        """Whether rendering goes on, or starts now: the buffer is long enough, or nothing more will come."""
        if self.phase != "buffering":
            return True
        window = None if now is None else closed_span(self.objects, now + LEAD_MS)
        if window is not None and window[1] - window[0] >= BUFFERED_MS:
            self.start = window[0]
        elif self.end is not None:
            self.start = (window or closed_span(self.objects) or (0.0,))[0]
        else:
            return False
        self.phase = "streaming"
        return True

    def read(self, through: float, limit: int) -> tuple[list[tuple[float, int, str]], bool]:
        """The next objects in order of time and lane, ``limit`` at most, and whether that was the end: never in a batch that was cut."""
        limit = max(limit, 1)
        due = sorted((o for o in self.objects if self.start <= o[0] <= through), key=lambda o: (o[0], o[1]))[:limit]
        for o in due:
            self.objects.remove(o)
        return due, self.end is not None and through >= self.end and len(due) < limit


def serve(b: Buffered, row: tuple) -> list[tuple]:
    """One row (seq, kind, lane, item, time_ms, now_ms, limit): what it shows, as (seq, status, lane, item, time_ms)."""
    seq, kind, lane, item, time, now, limit = row
    if b.phase == "ended":
        return []
    if kind == "failure" or b.phase == "failed":
        b.phase, b.objects = "failed", []
        return [(seq, "failed", None, item if kind == "failure" else None, None)] if kind in ("failure", "read") else []
    if kind == "object":
        why = b.take(_time(time), int(lane), item)
        return [(seq, why, int(lane), item, time)] if why else []
    if kind == "finish":
        b.finish(_time(time))
    elif kind == "least":
        b.bound(least=float(time))
    elif kind == "most":
        b.bound(most=float(time))
    elif kind == "read":
        if not b.begin(_time(now)):
            return [(seq, "waiting", None, None, time)]
        sent, over = b.read(float(time), int(limit))
        out = [(seq, "sent", lane_, item_, at) for at, lane_, item_ in sent]
        if over:
            b.phase, b.objects = "ended", []
            out.append((seq, "end", None, None, b.end))
        return out
    return []


ROW = ["seq", "kind", "lane", "item", "time_ms", "now_ms", "limit"]


def _served(b: Buffered, key: str, rows: pd.DataFrame) -> pd.DataFrame:
    out = [(key, *x) for row in rows.sort_values("seq", kind="stable")[ROW].itertuples(index=False) for x in serve(b, tuple(row))]
    shown = pd.DataFrame(out, columns=SHOWN_COLUMNS)
    return shown.astype({"lane": "Int32", "seq": "Int64"})


def play(rows: DataFrame) -> DataFrame:
    """Sessions replayed: rows (session_id, seq, kind, lane, item, time_ms, now_ms, limit) in order of ``seq``.

    Kinds: object; finish (complete through time_ms); least and most (bounds);
    read (through time_ms, at reference time now_ms, ``limit`` objects);
    failure. Shown are objects that are not taken (late, outside, closed),
    reads that wait, objects sent, one end, and failed for each read after a
    failure. After the end nothing is shown. Rows without a session have no
    part; a session is in one task, as its order demands.
    """
    own = rows.where("session_id IS NOT NULL").select("session_id", *ROW)
    return spread(own, "session_id").groupBy("session_id").applyInPandas(lambda p: _served(Buffered(), str(p["session_id"].iloc[0]), p), SHOWN)


class Charts(StatefulProcessor):
    """``Buffered`` over micro-batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.life = handle.getValueState("life", "phase string, start double, end double, least double, most double")
        self.objects = handle.getListState("objects", "at double, lane int, item string")

    def handleInputRows(self, key, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        b = Buffered(*self.life.get(), [tuple(o) for o in self.objects.get()]) if self.life.exists() else Buffered()
        shown = _served(b, str(key[0]), pd.concat(list(rows), ignore_index=True))
        self.life.update((b.phase, b.start, b.end, b.least, b.most))  # stays: a session that is over answers no more
        if b.objects:
            self.objects.put(b.objects)
        else:
            self.objects.clear()
        yield shown

    def close(self) -> None:
        pass


def live_play(rows: DataFrame) -> DataFrame:
    """``play`` over a stream in which each session's rows come in order; dealt to micro-batches in any way."""
    own = rows.where("session_id IS NOT NULL").select("session_id", *ROW)
    return own.groupBy("session_id").transformWithStateInPandas(Charts(), SHOWN, "Append", "None")


GATED = "session_id string, object_id long, tier int, error_ms double, at_ms double, status string"
GATED_COLUMNS = [c.split(" ")[0] for c in GATED.split(", ")]


class Gate(StatefulProcessor):
    """Inputs wait until the watermark of objects and inputs both has passed all that can meet them.

    A timer releases them in order of time, and only then are they judged.
    ``complete`` rows tell how far the chart is whole: an input beyond that
    fails the session, unless ``end`` was told. An ended or failed session
    keeps only that fact.
    """

    def __init__(self, table: str):
        self.table = table

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "phase string, complete double, last double")
        self.objects = handle.getListState("objects", "time_ms double, id long, kind string, lane int")
        self.waiting = handle.getListState("waiting", "time_ms double, id long, kind string, lane int")
        self.lanes = handle.getListState("lanes", "lane int, id long, start double, end double, hold boolean, tier int, error double")

    def engine(self) -> Engine:
        engine = Engine(self.table)
        for lane, *row in self.lanes.get():
            engine.lanes.setdefault(lane, Lane()).append(*row)
        return engine

    def put(self, state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def reach(self) -> float:
        """How long after an input the latest object that it can meet lies."""
        return TAIL * Engine(self.table).gate

    def handleInputRows(self, key, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        phase, complete, last = self.life.get() if self.life.exists() else ("open", -math.inf, -math.inf)
        if phase in ("over", "failed"):
            return
        objects, waiting, timers = [], [], set()
        for kind, lane, id_, time in pd.concat(list(rows), ignore_index=True)[["kind", "lane", "id", "time_ms"]].itertuples(index=False):
            last = max(last, float(time)) if kind not in ("complete", "end") else last
            if kind == "complete":
                complete = max(complete, float(time))
            elif kind in ("press", "release", "end"):
                waiting.append((float(time), int(id_), kind, int(lane)))
                timers.add(math.ceil(time + self.reach()) + 1)
            else:
                objects.append((float(time), int(id_), kind, int(lane)))
        self.life.update((phase, complete, last))
        for state, new in ((self.objects, objects), (self.waiting, waiting)):
            if new:
                state.appendList(new)
        for timer in timers:
            self.handle.registerTimer(timer)
        return
        yield

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        phase, complete, last = self.life.get()
        if phase in ("over", "failed"):
            return
        now = expiredTimerInfo.getExpiryTimeInMs() - 1 - self.reach()
        held = sorted(self.waiting.get())
        due, later = [w for w in held if w[0] <= now], [w for w in held if w[0] > now]
        ended = any(w[2] == "end" for w in held)
        known = sorted(self.objects.get())
        engine, out = self.engine(), []
        for time, _, kind, lane in due:
            over = kind == "end"
            ready, known = [o for o in known if over or o[0] <= time + self.reach()], [o for o in known if not over and o[0] > time + self.reach()]
            for at, id_, what, on in ready:
                if what == "holdEnd":
                    engine.close(on, at)
                else:
                    engine.add(on, id_, at, None, what == "holdStart")
            if over:
                at = last + 10 * engine.gate
                out += [(*x, at, "judged") for x in engine.advance(at)]
                phase = "over"
            elif time > complete and not ended:
                out.append((None, None, None, time, "fell_behind"))
                phase = "failed"
            else:
                found = engine.advance(time)
                found += engine.press(lane, time) if kind == "press" else engine.release(lane, time)
                out += [(*x, time, "judged") for x in found]
            if phase != "open":
                known = later = []
                engine = Engine(self.table)
                break
        self.life.update((phase, complete, last))
        self.put(self.objects, known)
        self.put(self.waiting, later)
        self.put(self.lanes, [(k, *row) for k, own in engine.lanes.items() for row in zip(*own.columns())])
        yield pd.DataFrame([(str(key[0]), *x) for x in out], columns=GATED_COLUMNS).astype({"object_id": "Int64", "tier": "Int32"})

    def close(self) -> None:
        pass


def gated_judgement(objects: DataFrame, inputs: DataFrame, late: str = "1 second", table: str = "B") -> DataFrame:
    """Live judgements of two streams with a watermark each: (session_id, kind, lane, id, time_ms, at).

    ``at`` is the event time, ``time_ms`` since the epoch. objects: tap,
    holdStart, holdEnd, and ``complete``; inputs: press, release, and ``end``.
    An input is judged once the slower of both watermarks is past every object
    that it can meet, so no interleaving of the streams changes a judgement.
    """
    columns = ["session_id", "kind", "lane", "id", "time_ms", "at"]
    both = objects.select(*columns).withWatermark("at", late).unionByName(inputs.select(*columns).withWatermark("at", late))
    return both.where("session_id IS NOT NULL").groupBy("session_id").transformWithStateInPandas(Gate(table), GATED, "Append", "EventTime")
