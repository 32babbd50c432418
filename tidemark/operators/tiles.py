"""What a task does with a tile of query landmarks and postings: sums of votes by query and bin."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NAMES = ("hash", "t_us", "weight", "postings", "landmarks")


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _summed(table: list[np.ndarray], keys: int) -> list[np.ndarray]:
    """Rows of equal keys, the first columns, as one: sums, but for the last two columns, a minimum and a maximum."""
    order = np.lexsort(table[:keys][::-1])
    table = [c[order] for c in table]
    at = _edges(*table[:keys])
    how = [np.add] * (len(table) - keys - 2) + [np.minimum, np.maximum]
    return [c[at] for c in table[:keys]] + [f.reduceat(c, at) for f, c in zip(how, table[keys:])] if len(at) else table


def _met(q: np.ndarray, x: dict[str, np.ndarray], first: np.ndarray, n: np.ndarray, times: np.ndarray, bin_us: int) -> list[np.ndarray]:
    """Votes of landmarks by query, bin and hash: these, votes, weight, moment, postings of all votes, first and last time.

    A landmark's postings stand in order of time, so its votes for a bin stand
    together; only landmarks whose hash their query repeats need sorting.
    """
    ask = np.repeat(np.arange(len(n)), n)
    met = np.arange(len(ask)) - np.repeat(np.cumsum(n) - n - first, n)
    apart = times[met] - x["t_us"][ask]
    size = np.abs(apart) / float(bin_us)
    down = np.floor(size)
    bins = np.copysign(down + (size - down >= 0.5), apart).astype(np.int64)
    at = _edges(ask, bins)
    if not len(at):
        return [ask[:0]] * 9
    votes, ask, bins = np.diff(np.append(at, len(bins))), ask[at], bins[at]
    w, t = x["weight"][ask], x["t_us"][ask]
    rows = [q[ask], bins, x["hash"][ask], votes, w * votes, w * (np.add.reduceat(apart, at) - votes * bins * bin_us), x["postings"][ask] * votes, t, t]
    starts = _edges(q, x["hash"])
    many = np.repeat(np.diff(np.append(starts, len(q))) > 1, np.diff(np.append(starts, len(q))))[ask]
    if not many.any():
        return rows
    return [np.concatenate(c) for c in zip([c[~many] for c in rows], _summed([c[many] for c in rows], 3))]


#: Cells of a table of sums for each row that it takes in; with more of them rows are sorted instead.
SPARSE = 8


def _by_bin(rows: list[np.ndarray]) -> list[np.ndarray]:
    """``_summed`` of rows (query, bin, ...) by these two: in a table of all queries and bins where it is well filled."""
    q, bins = rows[:2]
    low, least = q.min(), bins.min()
    wide = int(bins.max()) - int(least) + 1
    if (int(q.max()) - int(low) + 1) * wide > SPARSE * len(q):
        return _summed(rows, 2)
    cell = (q - low) * wide + (bins - least)
    cells = np.flatnonzero(np.bincount(cell))
    place = np.zeros(cell.max() + 1, np.int64)
    place[cells] = np.arange(len(cells))
    at = place[cell]
    sums = []
    for c in rows[2:-2]:
        total = np.zeros(len(cells), np.int64)
        np.add.at(total, at, c)
        sums.append(total)
    early, late = np.full(len(cells), np.iinfo(np.int64).max), np.full(len(cells), np.iinfo(np.int64).min)
    np.minimum.at(early, at, rows[-2])
    np.maximum.at(late, at, rows[-1])
    return [cells // wide + low, cells % wide + least, *sums, early, late]


def _sums(q: np.ndarray, x: dict[str, np.ndarray], first: np.ndarray, n: np.ndarray, times: np.ndarray, bin_us: int, most: int) -> list[np.ndarray]:
    """Sums of whole queries by query and bin, from pieces of about ``most`` meetings."""
    piece = (np.cumsum(n) - n) // most
    cuts = [*_edges(piece).tolist(), len(n)]
    found = [_met(q[a:b], {c: v[a:b] for c, v in x.items()}, first[a:b], n[a:b], times, bin_us) for a, b in zip(cuts, cuts[1:])]
    q, bins, _, votes, weight, moment, postings, low, high = found[0] if len(found) == 1 else _summed([np.concatenate(c) for c in zip(*found)], 3)
    common = np.where(postings > votes, votes, 0)  # a hash with one posting adds one for each vote
    return _by_bin([q, bins, votes, weight, moment, np.ones(len(q), np.int64), common, postings, low, high])


class _Postings:
    """The times of a tile's postings, which come by hash: ``held`` in memory, and in a file of the task's own where they are more."""

    def __init__(self, held: int):
        self.held, self.parts, self.count, self.file, self.runs = held, [], 0, None, []

    def add(self, hashes: np.ndarray, lengths: np.ndarray, times: np.ndarray) -> None:
        self.runs.append((hashes, lengths))
        self.parts.append(times)
        self.count += len(times)
        if self.count > self.held:
            self._write()

    def _write(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
        for part in self.parts:
            self.file.write(np.ascontiguousarray(part, np.int64).data)
        self.parts, self.count = [], 0

    def index(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes in order, where the times of each begin (and the end of all), and these times in order."""
        hashes, lengths = (np.concatenate([r[i] for r in self.runs]) for i in (0, 1))
        if self.file is None:
            times = np.concatenate(self.parts)
        else:
            self._write()
            self.file.flush()
            times = np.memmap(self.file, np.int64, "r+")
        self.parts = []
        at = _edges(hashes)
        starts = np.append((np.cumsum(lengths) - lengths)[at], lengths.sum())
        for a, b in zip(starts.tolist(), starts[1:].tolist()):
            times[a:b].sort()
        return hashes[at], starts, times


def tally(batches: Iterator[pa.RecordBatch], bin_us: int, reach_us: int | None, taken: int, most: int, held: int) -> Iterator[pa.RecordBatch]:
    """Sums by query and bin of tiles, one after the other, each with its postings first, by hash, then landmarks by query and hash.

    Whole queries are taken together, ``taken`` landmarks or a little more; of
    meetings about ``most`` are held at once, of postings ``held`` in memory.
    """
    tile, posts, hashes, times, starts, waiting = None, None, None, None, None, []

    def index():
        nonlocal posts, hashes, times, starts
        if posts:
            (hashes, starts, times), posts = posts.index(), None

    def told(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = rows["query_id"].combine_chunks()
        x = {c: rows[c].to_numpy() for c in NAMES}
        new = np.ones(len(ids), bool)
        if len(ids) > 1:
            new[1:] = pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)
        q = np.flatnonzero(new)
        at = np.searchsorted(hashes, x["hash"])
        first, last = starts[at].copy(), starts[at + 1].copy()
        if reach_us is not None:
            order = np.argsort(at, kind="stable")
            runs = [*_edges(at[order]).tolist(), len(at)]
            for a, b in zip(runs, runs[1:]):
                i = order[a:b]
                low, high, t = starts[at[i[0]]], starts[at[i[0]] + 1], x["t_us"][i]
                first[i] = low + np.searchsorted(times[low:high], t - reach_us, "left")
                last[i] = low + np.searchsorted(times[low:high], t + reach_us, "right")
        n, of = last - first, np.cumsum(new) - 1
        # whole queries together, as many as hold some ``most`` meetings
        group = np.cumsum(np.add.reduceat(n, q)) // most
        ends = [*q[_edges(group)].tolist(), len(n)]
        for a, b in zip(ends, ends[1:]):
            if not n[a:b].sum():
                continue
            got = _sums(of[a:b], {c: v[a:b] for c, v in x.items()}, first[a:b], n[a:b], times, bin_us, most)
            at_row = q[got[0]]
            columns = [ids.take(pa.array(at_row)), *[pa.array(c) for c in got[1:]], pa.array(x["landmarks"][at_row])]
            names = ["query_id", "bin", "votes", "weight", "moment", "unique_hashes", "common_votes", "posting_sum", "q_first", "q_last", "landmarks"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def flushed(whole: bool) -> Iterator[pa.RecordBatch]:
        nonlocal waiting
        if sum(map(len, waiting)) >= (1 if whole else taken):
            rows = pa.Table.from_batches(waiting)
            ids = rows["query_id"].combine_chunks()
            end = len(rows) if whole else pc.index(pc.equal(ids, ids[-1]), True).as_py()
            waiting = rows.slice(end).combine_chunks().to_batches()
            if end:
                yield from told(rows.slice(0, end))

    for batch in batches:
        tiles = batch["tile"].to_numpy()
        kinds = batch["asks"].to_numpy(zero_copy_only=False)
        cuts = [*_edges(tiles, kinds).tolist(), len(tiles)]
        for a, b in zip(cuts, cuts[1:]):
            if tiles[a] != tile:
                yield from flushed(True)
                tile, posts = tiles[a], None
            if kinds[a]:
                index()
                waiting.append(batch.select(["query_id", *NAMES]).slice(a, b - a))
                yield from flushed(False)
            else:
                lists = batch["times"].slice(a, b - a)
                posts = posts or _Postings(held)
                posts.add(batch["hash"].slice(a, b - a).to_numpy(), pc.list_value_length(lists).to_numpy().astype(np.int64), lists.flatten().to_numpy())
    yield from flushed(True)
