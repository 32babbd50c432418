"""Alignment of live recordings with their references: sightings first, then a fold over them.

Where a window of frames lies in its reference does not depend on any other
window. Those sightings are found for all windows at once, in chunks of a
recording over all partitions. What is left for one task per recording is a
fold of ``advance`` over the sightings, with a look at the 200 ms around the
tracked position now and then. A stream runs the same fold.
"""

from __future__ import annotations

from collections.abc import Callable
from math import inf
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.spectra import Matcher
from tidemark.session import cut

# Scores a sighting must reach to be acquired, to be strong, and to support a track.
ACQUIRE = {"score": 0.25, "margin": 0.06, "first": 0.10, "second": 0.10}
STRONG = {"score": 0.45, "margin": 0.12, "first": 0.20, "second": 0.20}
SUPPORT, FRESH = {"score": 0.15, "recent": 0.12}, {"recent": 0.15}
# Fixed values, in ms: reach of a look, agreement, coasting, age of a guess, new evidence, smoothing.
LOOK_MS, AGREE_MS, COAST_MS, GUESS_MS, EVIDENCE_MS, SMOOTH_MS = 100.0, 80.0, 1500.0, 2500.0, 1000.0, 300.0
# Fixed values, in ms: between searches without and with support, a repeated window, lengths of windows, the margin of centring.
SEARCH_MS, SUPPORTED_SEARCH_MS, REPEAT_MS, READY_MS, TRACKING_MS, FINAL_MS, CENTRE_MS = 500.0, 2000.0, 90.0, 2500.0, 2000.0, 4500.0, 250.0
# Energies in dBFS and the share of active frames.
ENERGY, ACTIVE_ENERGY, ACTIVE = -62.0, -70.0, 0.35

#: How far a recording ever got, and the state shown at each of these depths.
PHASES = ("none", "provisional", "confirmed", "final")
CONFIRMED, FINAL = PHASES.index("confirmed"), PHASES.index("final")
STATES = {
    "waiting": ("listening", "listening", "lost", "lost"),
    "searching": ("locking", "locking", "relocking", "relocking"),
    "tracking": ("confirmed", "confirmed", "confirmed", "locked"),
}
ALIGNED = "key string, end_ms double, state string, phase string, reason string, offset_ms double, confidence double"
SEEN = "key string, end_ms double, offset_ms double, score double, margin double, first double, second double, recent double"


class Sighting(NamedTuple):
    """Where a window fits best. ``margin`` is the lead over the next place, or the score of a lone one."""

    offset_ms: float
    score: float
    margin: float
    first: float
    second: float
    recent: float


class Position(NamedTuple):
    """An offset, the evidence times between which it was seen, and its last score."""

    offset_ms: float
    since: float
    seen: float
    score: float


class Held(NamedTuple):
    """What a recording carries from window to window; plain values, fit for stream state."""

    end: float | None = None
    searched: float = -inf
    guess: Position | None = None
    track: Position | None = None
    depth: int = 0
    shown: tuple | None = None


class Heard(NamedTuple):
    """A window's own facts."""

    start: float
    end: float
    hop: float
    regular: bool = True
    energy: float = 0.0
    active: float = 1.0
    indexed: bool = True

    def withheld(self, depth: int) -> str | None:
        """The first thing this window lacks; a recording once confirmed is content with a shorter one."""
        least = READY_MS if depth < CONFIRMED else min(READY_MS, TRACKING_MS - self.hop)
        lacks = {
            "no_reference": not self.indexed, "too_short": self.end - self.start < least, "bad_grid": not self.regular,
            "silent": not self.energy >= ENERGY, "inactive": self.active < ACTIVE,
        }
        return next((name for name, is_so in lacks.items() if is_so), None)


def reaches(s: Sighting | None, limits: dict[str, float]) -> bool:
    return s is not None and all(getattr(s, name) >= least for name, least in limits.items())


def agree(a: Position | Sighting, b: Position | Sighting) -> bool:
    return abs(a.offset_ms - b.offset_ms) <= AGREE_MS


def smoothed(track: Position | None, at: float, look: Callable[[float, float], Sighting | None]) -> tuple[Position | None, Sighting | None]:
    """The track drawn towards what a look around it finds, and that; a track too long unseen is dropped."""
    if track is None or at - track.seen > COAST_MS:
        return None, None
    near = look(track.offset_ms - LOOK_MS, track.offset_ms + LOOK_MS)
    if not reaches(near, SUPPORT) or not agree(near, track):
        return track, near
    drawn = -np.expm1((track.seen - at) / SMOOTH_MS) * (near.offset_ms - track.offset_ms)
    return Position(track.offset_ms + float(drawn), track.since, at, near.score), near


def guessed(guess: Position | None, seen: Sighting | None, at: float) -> Position | None:
    """The guess a sighting leaves: carried on where it agrees, begun anew where not, none below the limits."""
    if not reaches(seen, ACQUIRE):
        return None
    carried = guess is not None and agree(guess, seen) and at - guess.seen <= GUESS_MS
    return Position(seen.offset_ms, guess.since if carried else at, at, seen.score)


def attained(guess: Position | None, seen: Sighting | None, at: float, heard: Heard) -> int:
    """The depth a guess earns by its new evidence: final for long windows, confirmed for strong sightings."""
    if guess is None:
        return 0
    long = heard.end - heard.start >= FINAL_MS
    earned = at - guess.since >= EVIDENCE_MS - heard.hop and reaches(seen, FRESH) and (long or reaches(seen, STRONG))
    return (FINAL if long else CONFIRMED) if earned else 1


def advance(held: Held, heard: Heard, sight: Callable[[], Sighting | None], look: Callable[[float, float], Sighting | None]) -> tuple[Held, tuple]:
    """One window: the next ``Held`` and (state, phase, reason, offset_ms, confidence).

    A window that ends under 90 ms after the last shows the same again; one
    that goes back or leaves a gap of two hops forgets all but the depth.
    """
    moved = inf if held.end is None else heard.end - held.end
    if moved < 0 or heard.start > (inf if held.end is None else held.end) + 2 * heard.hop:
        held = Held(depth=held.depth)
    elif moved < REPEAT_MS and held.shown and (heard.regular or not heard.indexed):
        return held, held.shown
    lacking = heard.withheld(held.depth)
    if lacking:
        state = "failed" if lacking == "no_reference" else STATES["waiting"][held.depth]
        shown = (state, PHASES[held.depth], lacking, None, 0.0)
        return Held(heard.end, held.searched, None, None, held.depth, shown), shown

    at = heard.end - round(CENTRE_MS / heard.hop) * heard.hop
    (track, seen), guess, depth, searched = smoothed(held.track, at, look), held.guess, held.depth, held.searched
    supported = track is not None and track.seen == at
    if heard.end - searched >= (SUPPORTED_SEARCH_MS if supported else SEARCH_MS):
        searched, seen = heard.end, sight()
        guess = guessed(guess, seen, at)
        earned = attained(guess, seen, at, heard)
        depth = max(depth, earned)
        if earned >= CONFIRMED and not (supported and agree(track, guess)):
            track, supported = guess, True

    if track:
        reason = None if supported else "weak_peak"
        shown = ("tracking", reason, track.offset_ms, track.score * (1 - (at - track.seen) / COAST_MS))
    else:
        reason = "ambiguous" if seen and seen.margin < ACQUIRE["margin"] else "weak_peak"
        open_ = guess if depth < CONFIRMED else None
        shown = ("searching", reason, open_.offset_ms if open_ else None, seen.score if open_ and seen else 0.0)
    part, reason, offset, confidence = shown
    shown = (STATES[part][depth], PHASES[depth], reason, offset, float(np.clip(confidence, 0, 1)))
    return Held(heard.end, searched, guess, track, depth, shown), shown


def sighted(matcher: Matcher, frames: np.ndarray, start_ms: float, near: tuple[float, float] | None = None) -> Sighting | None:
    found = matcher.match(frames, start_ms, near)
    if not found:
        return None
    best, rest = found[0], found[1:]
    return Sighting(best["offset_ms"], best["score"], best["score"] - (rest[0]["score"] if rest else 0.0), best["first"], best["second"], best["recent"])


def window_ends(times: np.ndarray, cadence_ms: float, begin: int = 0) -> list[int]:
    """Positions from ``begin`` on of frames that are the first of a slot of ``cadence_ms``: no position depends on an earlier choice."""
    slots = np.floor(times / cadence_ms)
    return [i for i in range(begin, len(times)) if i == 0 or slots[i] != slots[i - 1]]


def _heard(times: np.ndarray, energy: np.ndarray, hop_ms: float, indexed: bool) -> Heard:
    with np.errstate(divide="ignore"):
        loud = 10 * np.log10(np.mean(10 ** (energy / 10)))
    regular = bool(np.all(np.abs(np.diff(times) - hop_ms) <= 0.05 * hop_ms))
    return Heard(times[0], times[-1], hop_ms, regular, float(loud), float(np.mean(energy >= ACTIVE_ENERGY)), indexed)


def fold(held: Held, times, frames, energy, matcher: Matcher | None, hop_ms: float, window_ms: float, cadence_ms: float, begin: int = 0, seen: dict | None = None) -> tuple[Held, list[tuple]]:
    """``advance`` over the windows that end at position ``begin`` or later; sightings come from ``seen`` by end, or are looked up."""
    out = []
    for i in window_ends(times, cadence_ms, begin):
        a = int(np.searchsorted(times, times[i] - window_ms - 1e-6))
        own = frames[a : i + 1]
        sight = (lambda: seen.get(times[i])) if seen is not None else lambda: sighted(matcher, own, times[a])  # noqa: B023
        look = lambda low, high: sighted(matcher, own, times[a], (low, high))  # noqa: E731,B023
        held, shown = advance(held, _heard(times[a : i + 1], energy[a : i + 1], hop_ms, matcher is not None), sight, look)
        out.append((float(times[i]), *shown))
    return held, out


def _matcher(reference: pd.DataFrame, hop_ms: float) -> Matcher | None:
    reference = reference.sort_values("t_ms", kind="stable")
    return Matcher(np.stack(reference["bands"].to_numpy()), float(reference["t_ms"].iloc[0]), hop_ms) if len(reference) else None


def sightings(query: DataFrame, reference: DataFrame, hop_ms: float, window_ms: float = 5000.0, cadence_ms: float = 500.0, chunk_ms: float = 32_000.0) -> DataFrame:
    """The best place of every window in its key's reference: key, end_ms and the fields of ``Sighting``.

    A recording is dealt in chunks of ``chunk_ms`` with the frames that their
    first windows reach back to, so a long one is many tasks; the reference of
    a key, one piece of audio, goes to each. Windows too short or off the grid,
    or without a reference, have no row.
    """
    chunk = lambda t: F.floor(t / chunk_ms)
    frames = query.select("key", "t_ms", "bands", F.explode(F.sequence(chunk(F.col("t_ms")), chunk(F.col("t_ms") + window_ms))).alias("chunk"))
    wanted = query.select("key", chunk(F.col("t_ms")).alias("chunk")).distinct()
    targets = reference.select("key", "t_ms", "bands").join(wanted, "key")
    least = min(READY_MS, TRACKING_MS - hop_ms)

    def run(k: tuple, q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        columns, out = ["key", "end_ms", *Sighting._fields], []
        if len(q) and len(r):
            q, matcher = q.sort_values("t_ms", kind="stable"), _matcher(r, hop_ms)
            bands, times = np.stack(q["bands"].to_numpy()), q["t_ms"].to_numpy(float)
            for i in window_ends(times, cadence_ms):
                a = int(np.searchsorted(times, times[i] - window_ms - 1e-6))
                if times[i] // chunk_ms == k[1] and times[i] - times[a] >= least:
                    found = sighted(matcher, bands[a : i + 1], times[a])
                    out += [(k[0], times[i], *found)] if found else []
        return pd.DataFrame(out, columns=columns)

    return frames.groupBy("key", "chunk").cogroup(targets.groupBy("key", "chunk")).applyInPandas(run, SEEN)


def alike(query: DataFrame, reference: DataFrame) -> DataFrame:
    """Each recording's key and ``first``, the least key whose frames, and those of its reference, are the same.

    Sides are told apart by their number of frames and two sums of 64-bit
    hashes of frames, which meet before the shuffle: no frame is shuffled.
    """
    sums = []
    for seed in (1, 2):
        h = F.xxhash64(F.lit(seed), "t_ms", "bands", "energy")
        sums += [F.sum(F.shiftright(h, 32)), F.sum(h.bitwiseAND(F.lit((1 << 32) - 1)))]
    told = lambda rows, name: rows.groupBy("key").agg(F.array(F.count("*"), *sums).alias(name))
    both = cut(told(query, "own").join(told(reference.withColumn("energy", F.lit(0.0)), "known"), "key", "left"), "lock-digests")
    same = both.groupBy("own", "known").agg(F.min("key").alias("first"))
    matches = (F.col("a.own") == F.col("b.own")) & F.col("a.known").eqNullSafe(F.col("b.known"))
    return both.alias("a").join(same.alias("b"), matches).select("key", "first")


def align(query: DataFrame, reference: DataFrame, hop_ms: float, window_ms: float = 5000.0, cadence_ms: float = 500.0) -> DataFrame:
    """Replay of recordings (key, t_ms, bands, perhaps energy_dbfs) against references (key, t_ms, bands).

    A row for each window of ``window_ms``, one for each slot of ``cadence_ms``
    that has a frame. Frames without time or bands are left out, without energy
    they are silent; without the column all are loud. Repeated times put a
    window off the grid. A key without a reference fails, and a reference
    without a recording gives no rows. The fold holds one recording and its
    reference in a task; the searches do not. Recordings that are the same, frame
    by frame, and whose references are, are aligned once (``alike``); what was
    found of the first is then joined to all of them.
    """
    energy = F.coalesce(F.col("energy_dbfs").cast("double"), F.lit(-200.0)) if "energy_dbfs" in query.columns else F.lit(0.0)
    whole = F.col("t_ms").isNotNull() & F.col("bands").isNotNull() & F.col("key").isNotNull()
    query = query.where(whole).select("key", F.col("t_ms").cast("double").alias("t_ms"), "bands", energy.alias("energy"))
    # new names for all columns, as both sides may come from one table
    reference = reference.where(whole).select(F.col("key").alias("key"), F.col("t_ms").cast("double").alias("t_ms"), F.col("bands").alias("bands"))
    members = cut(alike(query, reference), "lock-alike")
    firsts = members.where("key = first").select("key")
    # each is read several times below: once written, the frames of all others are not made again
    query, reference = (cut(rows.join(firsts, "key", "left_semi"), "lock-frames") for rows in (query, reference))
    seen = sightings(query, reference, hop_ms, window_ms, cadence_ms)
    found = seen.select("key", F.col("end_ms").alias("t_ms"), F.array(*Sighting._fields).alias("seen"))
    both = query.unionByName(found, allowMissingColumns=True)

    def run(k: tuple, rows: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows):  # the other side alone has no columns here
            q, places = rows[rows["bands"].notna()].sort_values("t_ms", kind="stable"), {}
            for at, values in rows.loc[rows["seen"].notna(), ["t_ms", "seen"]].itertuples(index=False):
                places[at] = Sighting(*map(float, values))
            times, frames, energy_ = q["t_ms"].to_numpy(float), np.stack(q["bands"].to_numpy()), q["energy"].to_numpy(float)
            out = fold(Held(), times, frames, energy_, _matcher(r, hop_ms), hop_ms, window_ms, cadence_ms, seen=places)[1]
        return pd.DataFrame([(str(k[0]), *x) for x in out], columns=[c.split(" ")[0] for c in ALIGNED.split(", ")])

    found = both.groupBy("key").cogroup(reference.groupBy("key")).applyInPandas(run, ALIGNED)
    names = members.select(F.col("key").cast("string").alias("member"), F.col("first").cast("string").alias("key"))
    return found.join(names, "key").select(F.col("member").alias("key"), *found.columns[1:])


def lock_times(aligned: DataFrame) -> DataFrame:
    """When each recording first reached a phase: key, provisional_ms, confirmed_ms, final_ms."""
    first = lambda at: F.min(F.when(F.array_position(F.array(*map(F.lit, PHASES)), F.col("phase")) > at, F.col("end_ms")))
    return aligned.groupBy("key").agg(*[first(at).alias(f"{name}_ms") for at, name in enumerate(PHASES) if at])
