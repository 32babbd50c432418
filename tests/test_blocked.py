"""Blocked recursions equal plain loops, wherever the borders of the blocks fall."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocked, series


def walk(values, rise, fall):
    out, now = [], None
    for x in values:
        if x is not None:
            now = x if now is None else now + (rise if x > now else fall) * (x - now)
        out.append(None if x is None else now)
    return out


@pytest.mark.parametrize("rise, fall", [(0.25, 0.25), (0.02, 0.25), (0.9, 0.1)])
@pytest.mark.parametrize("seed", range(6))
def test_a_block_as_a_map(rise, fall, seed):
    draw = np.random.default_rng(seed)
    values = draw.integers(0, 9, 400).astype(float) if seed % 2 else np.cumsum(draw.normal(size=400))
    before, after = blocked.knots(values, values.min(), values.max(), rise, fall)
    assert (np.diff(before) >= 0).all() and len(before) < 400
    for start in np.linspace(values.min(), values.max(), 17):
        want = blocked.levels(values, start, rise, fall)[-1]
        assert np.interp(start, before, after) == pytest.approx(want, abs=1e-9)
    short = values[:3]
    before, after = blocked.knots(short, values.min(), values.max(), rise, fall)
    for start in np.linspace(values.min(), values.max(), 17):
        assert np.interp(start, before, after) == pytest.approx(blocked.levels(short, start, rise, fall)[-1], abs=1e-9)


def test_long_and_short_keys_equal_the_walk(spark):
    draw = np.random.default_rng(5)
    sizes = {"long": 3000, "b": 40, "c": 1, None: 30}
    rows = [(k, i, None if i % 17 == 3 or i == 0 and k == "b" else float(draw.integers(0, 50)), f"{k}{i}") for k, n in sizes.items() for i in range(n)]
    table = spark.createDataFrame(rows, "k string, i int, v double, c0 string")
    assert table.where("k = 'long'").repartitionByRange(4, "k", "i").select(F.spark_partition_id()).distinct().count() > 1
    for rise, fall in ((0.1, 0.1), (0.02, 0.25)):
        got = {(r.k, r.i): r for r in blocked.follow(table, "k", ["i"], "v", "level", rise, fall).collect()}
        assert len(got) == len(rows)
        for k, n in sizes.items():
            mine = [r for r in rows if r[0] == k]
            for r, want in zip(mine, walk([r[2] for r in mine], rise, fall)):
                row = got[r[0], r[1]]
                assert row.v == r[2] and row.c0 == r[3]
                assert (row.level is None) == (want is None) and (want is None or row.level == pytest.approx(want, abs=1e-9))


def test_a_single_key_runs_in_many_blocks(spark):
    table = spark.range(2000).select(F.lit("only").alias("k"), F.col("id").alias("i"), (F.col("id") % 13).cast("double").alias("v"))
    out = series.noise_floor(table, "k", ["i"], "v")
    got = [(r.floor, r.snr) for r in out.orderBy("i").collect()]
    want = walk([float(i % 13) for i in range(2000)], 0.02, 0.25)
    assert [g[0] for g in got] == pytest.approx(want, abs=1e-9)
    assert [g[1] for g in got] == pytest.approx([max(0.0, i % 13 - f) for i, f in enumerate(want)], abs=1e-9)


def test_no_rows(spark):
    assert blocked.follow(spark.createDataFrame([], "k string, i int, v double"), "k", ["i"], "v", "level", 0.1, 0.1).collect() == []


def test_cens_equals_a_loop(spark):
    draw = np.random.default_rng(2)
    vectors = draw.random((40, 12)) ** 3
    rows = [("a", i, v.tolist()) for i, v in enumerate(vectors)] + [("b", 0, None), ("b", 1, [0.0] * 12)]
    got = {(r.k, r.i): r.cens for r in series.cens(spark.createDataFrame(rows, "k string, i int, chroma array<double>"), "k", ["i"], "chroma").collect()}
    now = None
    for i, v in enumerate(vectors):
        now = v if now is None else now + 0.25 * (v - now)
        share = now / now.sum()
        steps = sum((share >= t).astype(float) for t in (0.05, 0.1, 0.2, 0.4))
        norm = np.sqrt((steps**2).sum())
        assert got["a", i] == pytest.approx((steps / norm if norm else steps).tolist(), abs=1e-9)
    assert got["b", 0] is None and set(got["b", 1]) == {0.0}
