"""What a task does with a unit of windows: the dense evaluation of its candidates' offsets, by arrays.

A unit's rows come sorted: the reference's frames, the live ones, both in order
of time, then the candidates. Scores are those of ``nearest.offset_features``
and ``nearest.judged``; sums run in order of time, as there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.operators.nearest import FEATURES, Dense

REFERENCE, LIVE, CANDIDATE = 0, 1, 2
#: Frames under evaluation that a task holds at once.
HELD = 1 << 17
EVALUATION = {
    "offset_us": "bigint", "matched": "bigint", "comparable": "bigint", "coverage": "double", "mean_error_us": "double", "sufficient": "boolean",
    **{f: "double" for f in FEATURES}, "combined": "double", "agreement": "int",
}
KINDS = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32()}


class Arrays(NamedTuple):
    """A column of arrays: values with zeros for what is not there, where a value is, and sizes, -1 for null."""

    values: np.ndarray
    valid: np.ndarray
    size: np.ndarray

    def take(self, at: np.ndarray) -> Arrays:
        return Arrays(*[x[at] for x in self])


class Frames(NamedTuple):
    unit: np.ndarray
    t_us: np.ndarray
    usable: np.ndarray
    weight: np.ndarray
    weighed: np.ndarray
    arrays: dict[str, Arrays]


def _arrays(column: pa.Array) -> Arrays:
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    there = np.arange(max(size.max(initial=1), 1)) < size[:, None]
    values, valid = np.zeros(there.shape), there.copy()
    values[there] = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
    valid[there] = flat.is_valid().to_numpy(zero_copy_only=False)
    return Arrays(values, valid, size)


def _plain(column: pa.Array, absent) -> np.ndarray:
    return pc.fill_null(column, absent).to_numpy(zero_copy_only=False)


def _frames(rows: pa.Table, unit: np.ndarray) -> Frames:
    one = lambda c: rows[c].combine_chunks()
    return Frames(
        unit, _plain(one("t_us"), 0), _plain(one("usable"), False), _plain(one("weight"), 0.0), one("weight").is_valid().to_numpy(zero_copy_only=False),
        {f: _arrays(one(f)) for f in FEATURES},
    )


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, and the number of rows."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), len(new))


def _expanded(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of each range, and which range each is of."""
    n = last - first
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of], of


def _partners(unit: np.ndarray, at: np.ndarray, reference: Frames) -> tuple[np.ndarray, np.ndarray]:
    """The reference row nearest to each time of a unit, the later and then the last one on equal distance, and how far it is; -1 for none."""
    if not len(reference.t_us) or not len(at):
        return np.zeros(len(at), np.int64), np.full(len(at), -1)
    ends = _runs(reference.unit, reference.t_us)
    last = np.repeat(ends[1:] - 1, np.diff(ends))  # the last row of the same time
    low, high = np.searchsorted(reference.unit, unit, "left"), np.searchsorted(reference.unit, unit, "right")
    after = np.empty(len(at), np.int64)
    cuts = _runs(unit)
    for a, b in zip(cuts, cuts[1:]):
        after[a:b] = low[a] + np.searchsorted(reference.t_us[low[a] : high[a]], at[a:b], "right")
    ahead, behind = last[np.minimum(after, len(last) - 1)], np.maximum(after - 1, 0)
    to, back = np.abs(reference.t_us[ahead] - at), np.abs(at - reference.t_us[behind])
    some, before = after < high, after > low
    later = some & (~before | (to <= back))
    return np.where(later, ahead, behind), np.where(later, to, np.where(before, back, -1))


def _dot(x: Arrays, y: Arrays) -> tuple[np.ndarray, np.ndarray]:
    """Products of arrays, and where both are there without a null."""
    whole = lambda a: (a.size >= 0) & (a.valid.sum(1) == a.size)
    found = np.zeros(len(x.size))
    for k in range(min(x.values.shape[1], y.values.shape[1])):
        found = found + x.values[:, k] * y.values[:, k]
    return found, whole(x) & whole(y)


def _cosine(w: np.ndarray, weighed: np.ndarray, x: Arrays, y: Arrays, of: np.ndarray, n: int) -> np.ndarray:
    """``nearest.weighted_cosine`` over the pairs of each of ``n`` evaluations."""

    def total(a, b):
        dot, there = _dot(a, b)
        return np.bincount(of, np.where(there & weighed, w * dot, 0.0), n)

    unlike = (x.size == 0) | (x.size >= 0) & (y.size >= 0) & (x.size != y.size)
    clean = np.bincount(of[unlike], minlength=n) == 0
    with np.errstate(all="ignore"):
        norm = np.sqrt(total(x, x) * total(y, y))
        share = total(x, y) / norm
    # as in Spark, what is not a number is above all numbers
    share = np.where(np.isnan(share), 1.0, np.clip(share, 0.0, 1.0))
    return np.where(clean & ~(norm <= 0), share, 0.0)


def _rise(x: Arrays, now: np.ndarray, before: np.ndarray) -> Arrays:
    """Rises of arrays since those before: as long as the longer one, 0 where one has no value; empty where one is null."""
    both = x.valid[now] & x.valid[before]
    rise = np.where(both, np.maximum(x.values[now] - x.values[before], 0.0), 0.0)
    known = (x.size[now] >= 0) & (x.size[before] >= 0)
    size = np.where(known, np.maximum(x.size[now], x.size[before]), 0)
    return Arrays(rise, np.arange(rise.shape[1]) < size[:, None], size)


def _features(live: Frames, reference: Frames, first: np.ndarray, last: np.ndarray, offset: np.ndarray, tolerance: int) -> dict[str, np.ndarray]:
    """``nearest.offset_features`` of each evaluation: live rows first to last, moved by an offset."""
    n = len(first)
    at, of = _expanded(first, last)
    partner, apart = _partners(live.unit[at], live.t_us[at] + offset[of], reference)
    met = (apart >= 0) & (apart <= tolerance)
    at, of, partner, apart = at[met], of[met], partner[met], apart[met]
    mine, theirs = live.weighed[at], reference.weighed[partner]
    a, b = live.weight[at], reference.weight[partner]
    weighed = mine | theirs
    w = np.where(mine & theirs, np.fmin(a, b), np.where(mine, a, b))
    count = lambda x: np.bincount(of[x], minlength=n)
    found = {"matched": np.bincount(of, minlength=n), "comparable": count(live.usable[at] & reference.usable[partner]), "error": np.zeros(n, np.int64)}
    np.add.at(found["error"], of, apart)
    for f in FEATURES:
        if f != "chroma":
            found[f] = _cosine(w, weighed, live.arrays[f].take(at), reference.arrays[f].take(partner), of, n)
    # chroma is compared by its rise since the pair before, which the first pair of an evaluation has not
    i = np.flatnonzero(np.append(False, (of[1:] == of[:-1]) & weighed[:-1])[: len(of)])
    least = np.where(weighed[i], np.fmin(w[i], w[i - 1]), w[i - 1])
    x, y = _rise(live.arrays["chroma"], at[i], at[i - 1]), _rise(reference.arrays["chroma"], partner[i], partner[i - 1])
    found["chroma"] = _cosine(least, np.ones(len(i), bool), x, y, of[i], n)
    return found


def _evidence(live: Frames, first: np.ndarray, last: np.ndarray) -> dict[str, np.ndarray]:
    """What a window has whatever the offset: frames, usable ones and the time from the first of these to the last."""
    many = np.append(0, np.cumsum(live.usable))
    usable = many[last] - many[first]
    places = np.append(np.flatnonzero(live.usable), 0)
    begin, end = places[np.minimum(many[first], len(places) - 1)], places[np.maximum(many[last] - 1, 0)]
    return {"frames": last - first, "usable_frames": usable, "usable_us": np.where(usable > 0, live.t_us[end] - live.t_us[begin], 0)}


def _evaluated(live: Frames, reference: Frames, first: np.ndarray, last: np.ndarray, offset: np.ndarray, tolerance: int) -> dict[str, np.ndarray]:
    """Evidence and features of each evaluation, made in pieces of some HELD frames."""
    piece = np.cumsum(last - first) // HELD
    cuts = _runs(piece) if len(piece) else [0, 0]
    parts = [_features(live, reference, first[a:b], last[a:b], offset[a:b], tolerance) for a, b in zip(cuts, cuts[1:])]
    return {"offset_us": offset, **_evidence(live, first, last), **{k: np.concatenate([p[k] for p in parts]) for k in parts[0]}}


def _judged(raw: dict[str, np.ndarray], s: Dense) -> dict[str, np.ndarray]:
    """``nearest.judged`` and the columns of ``EVALUATION``; an unknown mean error is infinite."""
    coverage = raw["matched"] / raw["frames"].astype(float)
    enough = (raw["usable_frames"] >= s.min_frames) & (raw["usable_us"] >= s.min_duration) & (raw["comparable"] >= s.min_frames) & (coverage >= s.min_coverage)
    scores = {f: np.where(enough, raw[f], 0.0) for f in FEATURES}
    combined = sum((scores[f] * w for f, w in zip(FEATURES, s.weights)), 0.0) / sum(s.weights)
    agreement = sum((scores[f] >= s.agree).astype(np.int32) for f in FEATURES)
    mean = np.where(raw["matched"] > 0, raw["error"] / np.maximum(raw["matched"], 1).astype(float), np.inf)
    return {
        "offset_us": raw["offset_us"], "matched": raw["matched"], "comparable": raw["comparable"], "coverage": coverage, "mean_error_us": mean, "sufficient": enough,
        **scores, "combined": combined, "agreement": np.where(enough, agreement, 0),
    }


def _told(found: dict[str, np.ndarray]) -> pa.StructArray:
    one = lambda c, kind: pa.array(found[c], KINDS[kind], mask=np.isinf(found[c]) if c == "mean_error_us" else None)
    return pa.StructArray.from_arrays([one(c, kind) for c, kind in EVALUATION.items()], list(EVALUATION))


def _leading(window: np.ndarray, c: dict[str, np.ndarray], e: dict[str, np.ndarray], refined: int, margin: float) -> np.ndarray:
    """The candidates of each window that are refined: the first ones, and those that come close to the very first."""
    order = np.lexsort((e["offset_us"], -c["landmark"], -c["hashes"], -c["weighted"], -e["agreement"], -e["combined"], ~e["sufficient"], window))
    ends = _runs(window[order])
    begin = np.repeat(ends[:-1], np.diff(ends))
    score = e["combined"][order]
    found = np.empty(len(order), bool)
    found[order] = (np.arange(len(order)) - begin < refined) | (score[begin] - score <= margin)
    return found


def _best(of: np.ndarray, coarse: np.ndarray, e: dict[str, np.ndarray]) -> np.ndarray:
    """The place of each candidate's best offset, in order of candidates."""
    order = np.lexsort((-e["offset_us"], -np.abs(e["offset_us"] - coarse), -e["mean_error_us"], e["comparable"], e["combined"], e["sufficient"], of))
    return order[_runs(of[order])[1:] - 1]


def scored(units: Iterator[pa.Table], settings: dict[str, Dense], radius: int, step: int, refined: int, margin: float, prune: bool) -> Iterator[pa.RecordBatch]:
    """The candidates (column ``c``) of whole units with the evaluation by each gate of ``settings``."""
    tolerance = next(iter(settings.values())).tolerance
    moves = np.arange(-(radius // step), radius // step + 1) * step
    for rows in units:
        ids, kinds = rows["unit"].combine_chunks().dictionary_encode().indices.to_numpy(), rows["kind"].to_numpy()
        reference, live, asked = [rows.filter(pa.array(kinds == k)) for k in (REFERENCE, LIVE, CANDIDATE)]
        reference, live, unit = _frames(reference, ids[kinds == REFERENCE]), _frames(live, ids[kinds == LIVE]), ids[kinds == CANDIDATE]
        low, high = np.searchsorted(live.unit, unit, "left"), np.searchsorted(live.unit, unit, "right")
        since, until = asked["since_us"].to_numpy(), asked["until_us"].to_numpy()
        first, last = low.copy(), high.copy()
        cuts = _runs(unit)
        for a, b in zip(cuts, cuts[1:]):
            own = live.t_us[low[a] : high[a]]
            first[a:b], last[a:b] = low[a] + np.searchsorted(own, since[a:b], "left"), low[a] + np.searchsorted(own, until[a:b], "right")
        some = last > first
        if not some.any():
            continue
        first, last = first[some], last[some]
        told = asked["c"].combine_chunks().filter(pa.array(some))
        c = {name: told.field(name).to_numpy(zero_copy_only=False) for name in ("coarse_us", "weighted", "hashes", "landmark")}
        window = told.field("window").dictionary_encode().indices.to_numpy()
        coarse = {g: _judged(raw, s) for raw in [_evaluated(live, reference, first, last, c["coarse_us"], tolerance)] for g, s in settings.items()}
        chosen = {g: _leading(window, c, e, refined, margin) for g, e in coarse.items()}
        wanted = np.flatnonzero(np.logical_or.reduce(list(chosen.values()))) if prune else np.arange(len(first))
        of = np.repeat(wanted, len(moves))
        grid = _evaluated(live, reference, first[of], last[of], c["coarse_us"][of] + np.tile(moves, len(wanted)), tolerance)
        columns = [told]
        for g, s in settings.items():
            around, e = _judged(grid, s), {name: values.copy() for name, values in coarse[g].items()}  # the gates share some
            best = _best(of, c["coarse_us"][of], around)
            use = chosen[g][wanted]
            for name in EVALUATION:
                e[name][wanted[use]] = around[name][best][use]
            columns.append(_told(e))
        yield pa.RecordBatch.from_arrays(columns, names=["c", *settings])


def whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of whole units, as many as a batch ends."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch["unit"]
        end = pc.index(ids, ids[-1]).as_py()
        if waiting and (end or ids[0] != waiting[-1]["unit"][-1]):
            yield pa.Table.from_batches([*waiting, batch.slice(0, end)])
            waiting = []
        elif end:
            yield pa.Table.from_batches([batch.slice(0, end)])
        waiting.append(batch.slice(end))
    if waiting:
        yield pa.Table.from_batches(waiting)


def task(settings: dict[str, Dense], radius: int, step: int, refined: int, margin: float, prune: bool) -> Callable:
    def run(batches):
        yield from scored(whole_units(batches), settings, radius, step, refined, margin, prune)

    return run
