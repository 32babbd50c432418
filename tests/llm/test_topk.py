import numpy as np
import pytest

from tidemark.llm import topk

SCHEMA = "vec_id long, embedding array<double>, label int, score double"


def brute(rows, k, every):
    use = [(i, np.floor(64 * np.array(v)).astype(np.int64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(use):
        if i % every == 0:
            near = sorted(((-int(q @ c), j) for m, (j, c) in enumerate(use) if m != n and len(c) == len(q)))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near)]
    return sorted(out)


def rows_of(n, dim, seed, repeats=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim)) / 4
    out = [(i, v.tolist()) for i, v in enumerate(base)]
    return out + [(n + i, out[3][1]) for i in range(repeats)]


@pytest.mark.parametrize("rows", [
    rows_of(300, 8, 1),
    rows_of(200, 16, 2, repeats=150),
    rows_of(9, 4, 3),
    [*rows_of(60, 5, 4), (0, [0.5] * 5), (0, [0.5] * 5), (20, None), (40, [None, 1.0, 0.0, 0.0, 0.0]), (60, [float("nan")] * 5), (80, [float("inf"), 0, 0, 0, 0]), (None, [1.0] * 5), (100, []), (120, [1.0, 2.0]), (140, [1e6, -1e6, 3.0, 2.0, 1.0])],
    [],
])
def test_equals_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(topk, "BLOCK", 64)
    rows = [(i, v if v is None else [None if x is None else float(x) for x in v]) for i, v in rows]
    got = topk.top_k(spark.createDataFrame([(*r, 1, 2.0) for r in rows], SCHEMA), k=7, every=5).collect()
    assert sorted(map(tuple, got)) == brute(rows, 7, 5)


def test_bounds_hold_and_leave_few():
    rng = np.random.default_rng(0)
    exact = rng.integers(-2000, 2000, size=(3000, 16))
    exact[17] = exact[99] = 6000
    packed = topk.pack(np.arange(3000), exact, 2)
    low, width = topk.numbers(packed["low"]), topk.numbers(packed["width"])
    cells = np.frombuffer(packed["cells"], np.uint8).reshape(-1, 16)
    queries = np.array([[3000] * 16, [-5] * 16, rng.integers(-2000, 2000, 16)])
    lower, upper = topk.bound(queries, cells, low, width)
    scores = queries @ exact.T
    assert (width > 1).all() and (lower <= scores).all() and (scores <= upper).all()
    held = np.full((3, 2), -np.inf)
    kept = []
    for part in (slice(0, 1000), slice(1000, 2000), slice(2000, 3000)):
        keep, held = topk.narrow(lower[:, part], upper[:, part], held)
        kept.append(keep)
    kept = np.concatenate(kept, axis=1)
    for q in range(3):
        assert kept[q, np.argsort(-scores[q], kind="stable")[:2]].all()
    assert np.flatnonzero(kept[0])[:2].tolist() == [17, 99] and kept[0, 1000:].sum() == 0 and kept.sum() < 500


def test_copies_beyond_k_are_no_candidates():
    exact = np.array([[1, 2], [0, 0], [1, 2], [1, 2], [0, 0], [1, 2]])
    assert topk.copies_within(exact, 2).tolist() == [0, 1, 2, 4]
    assert topk.numbers(topk.pack(np.arange(6), exact, 2)["places"]).tolist() == [0, 1, 2, 3, 4]


def test_coarse_cells_need_a_second_reading(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "CELLS", 2)
    monkeypatch.setattr(topk, "FIRST", 1)
    rows = rows_of(400, 6, 9, repeats=30)
    got = topk.top_k(spark.createDataFrame([(i, [float(x) for x in v], 1, 2.0) for i, v in rows], SCHEMA), k=5, every=4).collect()
    assert sorted(map(tuple, got)) == brute(rows, 5, 4)
