"""Calibration: inputs matched one to one to the nearest beat that is still open.

Which beat an input gets depends on the inputs before it, so a key's inputs are
folded in order; batch and stream share the step. What is remembered is small:
beats are forgotten once no input can reach them, and samples beyond the last
SAMPLES count no more.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial
from math import floor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.folds import folded

# Fixed values, in ms: the first beat, the time between beats, how far an input may be off, how long a beat is remembered, and between publications.
LEAD_IN, TICK, REACH, PUBLISH = 1000, 500, 120, 500
RETAIN = REACH + TICK
# Samples that count, and the largest offset.
SAMPLES, MOST = 16, 500

MATCHED = "key string, id long, at_ms double, beat long, error_ms double, offset_ms int, suggested_ms int, samples int, median_ms int"


def _whole(x: float) -> int:
    """Rounded, halves away from zero."""
    n = floor(abs(x) + 0.5)
    return -n if x < 0 else n


def _clamped(x: int) -> int:
    return max(-MOST, min(MOST, x))


@dataclass
class Calibration:
    """Beats taken, the suggestions that count, the offset in force, the one that waits, and when one came into force last."""

    taken: set[int] = field(default_factory=set)
    suggestions: list[int] = field(default_factory=list)
    offset: int = 0
    pending: int = 0
    published: float | None = None

    def note(self, beat: int, first: float) -> float:
        return first + beat * TICK

    def open_beat(self, at: float, first: float) -> int:
        """The nearest of the beats around ``at`` and the very first that is not taken; the lower of two as near."""
        near = _whole((at - first) / TICK)
        free = [b for b in {0, near - 1, near, near + 1} if b >= 0 and b not in self.taken]
        return min(free, key=lambda b: (abs(at - self.note(b, first)), b)) if free else max(0, near)

    def tap(self, raw: float, first: float) -> tuple[int, float, int] | None:
        """An input: its beat, how far off it is and the offset that would mend it; None if no open beat is in reach."""
        at = raw + self.offset
        self.taken = {b for b in self.taken if self.note(b, first) >= at - RETAIN}
        beat = self.open_beat(at, first)
        error = at - self.note(beat, first)
        if abs(error) > REACH:
            return None
        self.taken.add(beat)
        suggested = _clamped(_whole(self.offset - error))
        self.suggestions = [*self.suggestions, suggested][-SAMPLES:]
        return beat, error, suggested

    def publish(self, raw: float) -> None:
        """The offset that waits comes into force, PUBLISH after the last one at the earliest."""
        if self.pending != self.offset and (self.published is None or raw - self.published >= PUBLISH):
            self.offset, self.published = self.pending, raw

    def median(self) -> int:
        last, n = sorted(self.suggestions), len(self.suggestions)
        return _clamped(_whole((last[(n - 1) // 2] + last[n // 2]) / 2)) if n else 0


def step(state: Calibration | None, key: str, rows: pd.DataFrame, first: float = LEAD_IN) -> tuple[Calibration, list[tuple]]:
    """The fold over a key's rows (at_ms, id, kind, value) in order of time and id, for batch and streams."""
    ordered = rows.sort_values(["at_ms", "id"], kind="stable")
    return stepped(state, key, list(zip([key] * len(rows), *[ordered[c] for c in ("at_ms", "id", "kind", "value")])), first)


def stepped(state: Calibration | None, key: str, rows: list[tuple], first: float = LEAD_IN) -> tuple[Calibration, list[tuple]]:
    """``step`` over rows (key, at_ms, id, kind, value) in order."""
    c, out = state or Calibration(), []
    for _, at, id_, kind, value in rows:
        if kind == "set" and value == value and value is not None:
            c.pending = _clamped(_whole(float(value)))
        elif kind == "tap":
            found = c.tap(float(at), first)
            if found is not None:
                beat, error, suggested = found
                out.append((key, int(id_), float(at), beat, error, c.offset, suggested, len(c.suggestions), c.median()))
        c.publish(float(at))
    return c, out


def calibrate(rows: DataFrame, first: float = LEAD_IN) -> DataFrame:
    """The taps that meet an open beat, each with its beat, error, suggested offset and the median of the last samples.

    rows: key, id, at_ms, kind and value. Kinds: ``tap``, an input at raw time
    at_ms; ``set``, the offset to come into force; anything else is a tick of
    the clock. An input is moved by the offset in force; it takes the nearest
    open beat, of those beside its time and the first one, within REACH. A new
    offset comes into force PUBLISH after the last one at the earliest, at
    whatever row comes then. Rows without key or time have no part; repeated
    rows are inputs each. A key's rows are in one task, as their order demands.
    """
    own = rows.where("key IS NOT NULL AND at_ms IS NOT NULL").select("key", "at_ms", "id", "kind", "value")
    return folded(own, [F.asc("at_ms"), F.asc_nulls_last("id")], partial(stepped, first=first), MATCHED)
