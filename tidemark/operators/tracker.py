"""A tracker of offset hypotheses as one step over a small table.

A row of the table is a track, a column one of its figures. A step takes the
table, the measurements of one time and that time, and gives the next table:
all tracks drift, the surest choose first among the measurements near them,
and what nobody chose starts a track. The table never has more than MOST rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from math import isfinite, nan

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.folds import folded

# Fixed values of the tracker, in ms and log odds.
GATE_NEW, GATE_KNOWN, KNOWN, MOST = 120.0, 80.0, 2.8, 8
MISS_COST, DROP, MISSES, COAST, COAST_MISSES, LEAD = 0.75, -2.5, 4, 1.2, 2, 1.0
SETTLE_MS, FASTEST, FOLLOW, GAIN, START, START_GAIN = 250.0, 250.0, 0.65, 2.2, 0.6, 1.2

#: Columns of the table; ``step`` is how far the last hit lay off (NaN after a miss), ``known`` whether the track was ever confirmed, ``ours`` whether an alignment follows it.
OFFSET, ODDS, SEEN, SPEED, HITS, LOST, STEP, SURE, OURS = range(9)
EMPTY = np.zeros((0, 9))


def usable(offsets: Iterable[float], confidences: Iterable[float]) -> list[tuple[float, float]]:
    """Measurements (offset, confidence) of one time that count, at most MOST, in the order given."""
    return [(o, c) for o, c in zip(offsets, confidences) if isfinite(o) and isfinite(c) and c > 0][:MOST]


def coasts(r: list[float]) -> bool:
    """Whether a track is confirmed and a few misses do not remove it."""
    return r[SURE] > 0 and r[ODDS] >= COAST and r[LOST] <= COAST_MISSES


def owners(t: list[list[float]], found: list[tuple[float, float]]) -> list[int]:
    """The measurement of each track, or -1: the nearest within its gate, of equally near ones the more confident."""
    out, free = [-1] * len(t), list(range(len(found)))
    for i in sorted(range(len(t)), key=lambda i: -t[i][ODDS]):
        at, gate = t[i][OFFSET], GATE_KNOWN if t[i][SURE] > 0 or t[i][ODDS] >= KNOWN else GATE_NEW
        near = min(((abs(found[j][0] - at), -found[j][1], j) for j in free if abs(found[j][0] - at) <= gate), default=None)
        if near:
            out[i] = near[2]
            free.remove(near[2])
    return out


def _by_odds(r: list[float]) -> tuple:
    return -r[ODDS], -r[HITS], r[OFFSET]


def kept(t: list[list[float]]) -> list[list[float]]:
    """Tracks that stay, coasting ones first, then by odds, hits and small offset."""
    stay = [r for r in t if (r[ODDS] > DROP and r[LOST] <= MISSES) or coasts(r)]
    return sorted(stay, key=lambda r: (not coasts(r), *_by_odds(r)))[:MOST] if len(stay) > 1 else stay


def confirmed(t: list[list[float]]) -> int:
    """The row that is sure now, or -1: it leads clearly, was hit twice and close by, and no coasting track contradicts it."""
    if not t:
        return -1
    best = min(range(len(t)), key=lambda i: _by_odds(t[i]))
    own = t[best]
    if not (own[HITS] >= 2 and own[ODDS] >= KNOWN and own[LOST] == 0 and abs(own[STEP]) <= GATE_KNOWN):
        return -1
    if any(own[ODDS] - r[ODDS] < LEAD for i, r in enumerate(t) if i != best):
        return -1
    return -1 if any(abs(r[OFFSET] - own[OFFSET]) > GATE_KNOWN and coasts(r) for r in t) else best


def stepped(t: list[list[float]], now: float | None, found: list[tuple[float, float]], at: float) -> tuple[list[list[float]], int]:
    """``advance`` over rows as lists, which are changed in place: on so few numbers plain Python is many times as fast as arrays."""
    drift = max(0.0, at - (at if now is None else now))
    for r in t:
        r[OFFSET] += r[SPEED] * drift / 1000
    chosen = owners(t, found)
    for r, j in zip(t, chosen):
        if j < 0:
            r[ODDS] -= MISS_COST
            r[LOST] += 1
            r[HITS], r[SPEED], r[STEP] = 0.0, 0.0, nan
            continue
        step, passed = found[j][0] - r[OFFSET], at - r[SEEN]
        if passed >= SETTLE_MS:
            r[SPEED] = 0.75 * r[SPEED] + 0.25 * min(max(step / (passed / 1000), -FASTEST), FASTEST)
        else:
            r[SPEED] = 0.5 * r[SPEED]
        r[OFFSET] += FOLLOW * step
        r[ODDS] += GAIN * found[j][1] - min(0.5, abs(step) / GATE_NEW * 0.5)
        r[ODDS] -= MISS_COST
        r[STEP], r[SEEN], r[LOST] = step, at, 0.0
        r[HITS] += 1
    born = [[o, START + START_GAIN * c, at, 0.0, 1.0, 0.0, nan, 0.0, 0.0] for j, (o, c) in enumerate(found) if j not in chosen]
    t = kept(t + born)
    best = confirmed(t)
    if best < 0:
        return t, -1
    own = t[best]
    own[SURE] = 1.0
    t = kept(t)
    return t, next(i for i, r in enumerate(t) if r[OFFSET] == own[OFFSET] and r[ODDS] == own[ODDS])


def array(t: list[list[float]]) -> np.ndarray:
    """A table of rows as lists, as streams keep it."""
    return np.array(t, float).reshape(-1, EMPTY.shape[1])


def advance(t: np.ndarray, now: float | None, found: np.ndarray, at: float) -> tuple[np.ndarray, int]:
    """The table after the measurements at ``at``, and the row confirmed now, or -1. Time that goes back moves nothing."""
    rows, best = stepped(t.tolist(), now, [tuple(x) for x in np.asarray(found, float).tolist()], at)
    return array(rows), best


TRACKED = "key string, at_ms double, offset_ms double, log_odds double, hits int, tracks int"


def follow(state: tuple[np.ndarray, float | None], key: str, rows: pd.DataFrame) -> tuple[tuple[np.ndarray, float | None], list[tuple]]:
    """Step over a key's rows (at_ms, offset_ms, confidence), a time at once: the next state and a row for each time."""
    times, confidences, offsets = (rows[c].to_numpy(float) for c in ("at_ms", "confidence", "offset_ms"))
    order = np.lexsort((offsets, -confidences, times))
    (table, now), out = followed((state[0].tolist(), state[1]), key, list(zip([key] * len(rows), times[order].tolist(), offsets[order].tolist(), confidences[order].tolist())))
    return (array(table), now), out


def followed(state: tuple[list[list[float]], float | None] | None, key: str, rows: list[tuple]) -> tuple[tuple[list[list[float]], float | None], list[tuple]]:
    """``follow`` over rows (key, at_ms, offset_ms, confidence) in order, with the table as lists."""
    (table, now), out = state or ([], None), []
    a = 0
    for b in range(1, len(rows) + 1):
        if b < len(rows) and rows[b][1] == rows[a][1]:
            continue
        at = rows[a][1]
        table, best = stepped(table, now, usable(*zip(*[r[2:] for r in rows[a:b]])), at)
        now, a = at, b
        figures = (table[best][OFFSET], table[best][ODDS], int(table[best][HITS])) if best >= 0 else (None, None, None)
        out.append((key, at, *figures, len(table)))
    return (table, now), out


def track(measurements: DataFrame) -> DataFrame:
    """The tracker over each key's measurements (key, at_ms, offset_ms, confidence), one row for each time."""
    own = measurements.select("key", *[F.coalesce(F.col(c).cast("double"), F.lit(nan)).alias(c) for c in ("at_ms", "offset_ms", "confidence")])
    sure = F.nanvl("confidence", F.lit(None).cast("double"))
    return folded(own, [F.asc("at_ms"), F.desc_nulls_last(sure), F.asc("offset_ms")], followed, TRACKED, together=1)
