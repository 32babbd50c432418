"""Alignment by landmark candidates: gates as columns, then a fold of the tracker over the gated windows.

Whether a window is ready and at which gate a candidate stops are column
expressions (``gates``) over all windows at once. What depends on the windows
before is the tracker of offsets, the track that is followed and how far the
recording ever got; that is all the fold carries.
"""

from __future__ import annotations

from math import exp, isnan
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import tracker as T
from tidemark.operators.folds import folded

# Reach of a tracking search in ms, and what a weak candidate's confidence counts for the tracker.
REACH_MS, WEAK = 750.0, 0.35
# What a track is worth by odds, lead and steadiness, and the part of a candidate's steadiness in ms.
ODDS_PART, LEAD_PART, STEADY_PART, STEADY, COASTING, SHAKY = 0.65, 0.20, 0.15, 1.0, 0.65, 0.25
FINAL_STEADY_PART, STABLE_MS = 0.10, 180.0

PHASES = ("none", "provisional", "confirmed", "final")
PROVISIONAL, CONFIRMED, FINAL = 1, 2, 3
SILENT = ("insufficient_energy", "insufficient_active_frames")
SHOWN = "key string, at_ms double, state string, phase string, stage string, reason string, offset_ms double, confidence double"


class Carried(NamedTuple):
    """The tracker's table and time, and how far the recording got."""

    table: np.ndarray = T.EMPTY
    now: float | None = None
    depth: int = 0


def gated(coarse: Column, timing: Column, final: Column, long: Column) -> Column:
    """The gate a candidate stops at and why, as struct(stage, reason); the last gate is for long windows. Reasons are ``none`` where passed."""
    at = lambda stage, reason: F.struct(F.lit(stage).alias("stage"), reason.alias("reason"))
    return (
        F.when(coarse != "none", at("coarse", coarse)).when(timing != "none", at("timing", timing))
        .when(long & (final != "none"), at("final", final)).otherwise(at("passed", F.lit("none")))
    )


def measured(candidates: list, table: list[list[float]], depth: int) -> list:
    """The candidates a window's search finds: all, or those within reach of the track that is followed."""
    ours = followed(table) if depth >= CONFIRMED else None
    return candidates if ours is None else [c for c in candidates if abs(c["offset_ms"] - ours[T.OFFSET]) <= REACH_MS]


def followed(table: list[list[float]]) -> list[float] | None:
    """The row followed, while its odds and misses let it coast."""
    return next((r for r in table if r[T.OURS] > 0 and r[T.ODDS] >= T.COAST and r[T.LOST] <= T.COAST_MISSES), None)


class Standing(NamedTuple):
    """What the first track of a table amounts to."""

    stable: bool = False
    sure: bool = False
    worth: float = 0.0


def standing(table: np.ndarray | list[list[float]]) -> Standing:
    if not len(table):
        return Standing()
    best = table[0]
    lead = best[T.ODDS] - (table[1][T.ODDS] if len(table) > 1 else 0.0)
    stable = best[T.LOST] == 0 and not abs(best[T.STEP]) > T.GATE_KNOWN  # a track just born has no step and is stable
    sure = stable and best[T.HITS] >= 2 and best[T.ODDS] >= T.KNOWN and lead >= T.LEAD
    steady = STEADY if stable else COASTING if best[T.ODDS] >= T.COAST and best[T.LOST] <= T.COAST_MISSES else SHAKY
    worth = ODDS_PART / (1 + exp(-best[T.ODDS])) + LEAD_PART * min(1.0, lead / (2 * T.LEAD)) + STEADY_PART * steady
    return Standing(bool(stable), bool(sure), min(1.0, max(0.0, float(worth))))


def held_back(stage: str, reason: str, depth: int) -> str:
    """State of a window that a gate holds back and no track carries on."""
    if stage == "readiness":
        return "failed" if reason == "no_reference" else "listening" if depth == 0 else "lost" if reason in SILENT else "relocking"
    if depth == FINAL:
        return "drifting" if reason == "ambiguous" or (stage == "final" and reason == "unstable") else "relocking"
    return "locking" if depth < CONFIRMED else "relocking" if stage == "final" else "confirmed"


def advance(c: Carried, at: float, ready: str, long: bool, candidates: list) -> tuple[Carried, tuple]:
    """One window: the next ``Carried`` and (state, phase, stage, reason, offset_ms, confidence)."""
    now, shown = _stepped(c._replace(table=c.table.tolist()), at, ready, long, candidates)
    return now._replace(table=T.array(now.table)), shown


def _stepped(c: Carried, at: float, ready: str, long: bool, candidates: list) -> tuple[Carried, tuple]:
    """``advance`` with the table as lists, whose rows are changed in place."""
    found = measured(candidates, c.table, c.depth) if ready == "none" else []
    lead = found[0] if found else None
    stage, reason = ("readiness", ready) if ready != "none" else ("coarse", "insufficient_landmarks") if lead is None else (lead["stage"], lead["reason"])
    share = 0.0 if stage in ("readiness", "coarse") else 1.0 if reason in ("none", "ambiguous") else WEAK
    given = T.usable([x["offset_ms"] for x in found], [min(1.0, max(0.0, x["confidence"])) * share for x in found])
    table, _ = T.stepped(c.table, c.now, given, at)
    depth = max(c.depth, PROVISIONAL if stage in ("final", "passed") else 0)
    best, ours = standing(table), followed(table)

    passed = stage == "passed"
    if passed and long and not (best.sure and best.stable and abs(lead["offset_ms"] - table[0][T.OFFSET]) <= T.GATE_KNOWN):
        stage, reason, passed = "final", "unstable", False
    accept = passed and (long or (best.sure and depth < FINAL and not (depth == CONFIRMED and ours is not None)))
    if accept:
        depth = max(depth, FINAL if long else CONFIRMED)
        for r in table:
            r[T.OURS] = 0.0
        table[0][T.OURS], ours = 1.0, table[0]

    name = "locked" if depth == FINAL else "confirmed"
    early, out = depth < CONFIRMED, None
    known = ours is not None and not early
    if passed and long:
        steady = 1 - min(1.0, abs(0.0 if isnan(ours[T.STEP]) else ours[T.STEP]) / STABLE_MS)
        out = ("locked", "tracking" if c.depth == FINAL else "robust", None, ours[T.OFFSET], lead["final"] + FINAL_STEADY_PART * steady)
    elif passed and known:
        out = (name, "tracking", None, ours[T.OFFSET], max(lead["provisional"], best.worth) if depth == FINAL else best.worth)
    elif passed and early:
        out = ("locking", "timing", None, table[0][T.OFFSET] if table else lead["offset_ms"], lead["provisional"])
    elif passed:
        followed_still = [r for r in table if r[T.OURS] > 0]
        at_offset = followed_still[0][T.OFFSET] if depth == FINAL and followed_still else None
        out = ("drifting" if depth == FINAL else "relocking", "tracking", "unstable", at_offset, best.worth)
    elif known and stage != "readiness":
        out = (name, "tracking", reason, ours[T.OFFSET], best.worth)
    elif stage == "final":
        out = (held_back(stage, reason, depth), "robust", reason, lead["offset_ms"] if early else None, lead["provisional"] if early else best.worth)
    else:
        out = (held_back(stage, reason, depth), "relock" if stage == "coarse" and not early else stage, reason, None, 0.0)
    state, part, why, offset, confidence = out
    return Carried(table, at, depth), (state, PHASES[depth], part, why, None if offset is None else float(offset), min(1.0, max(0.0, float(confidence))))


def follow(state: Carried | None, key: str, rows: pd.DataFrame) -> tuple[Carried, list[tuple]]:
    """Step over a key's windows in order of time, for batch and streams."""
    now = Carried(*state) if state else Carried()
    ordered = rows.sort_values("at_ms", kind="stable")
    now, out = followed_on(now._replace(table=now.table.tolist()), key, list(zip([key] * len(rows), *[ordered[c] for c in ("at_ms", "ready", "long", "candidates")])))
    return now._replace(table=T.array(now.table)), out


def followed_on(state: Carried | None, key: str, rows: list[tuple]) -> tuple[Carried, list[tuple]]:
    """``follow`` over windows (key, at_ms, ready, long, candidates) in order, with the table as lists."""
    now, out = state or Carried([]), []
    for _, at, ready, long, candidates in rows:
        now, shown = _stepped(now, float(at), ready, bool(long), list(candidates) if candidates is not None else [])
        out.append((key, float(at), *shown))
    return now, out


def align(windows: DataFrame) -> DataFrame:
    """State, offset and confidence at every window (key, at_ms, ready, long, candidates).

    ``ready`` is ``none`` or why the window is not ready; ``candidates`` are
    ranked structs of offset_ms, stage and reason (``gated``), confidence (for
    the tracker), provisional and final (its confidence without the part for
    steadiness, that is 0.10 of it). Once a track is followed only candidates
    within 750 ms count and the first of them leads; its margin stays that of
    the whole search. Null candidates are none; rows without key or time are
    left out; of equal times the order is open, so give each window its own.
    One key's windows are in one task, as their order demands.
    """
    rows = windows.where("key IS NOT NULL AND at_ms IS NOT NULL").select("key", F.col("at_ms").cast("double").alias("at_ms"), F.coalesce("ready", F.lit("none")).alias("ready"), F.coalesce("long", F.lit(False)).alias("long"), "candidates")
    return folded(rows, [F.asc("at_ms")], followed_on, SHOWN)
