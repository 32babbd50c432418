"""Recursions over keyed series of any length, as blocks that run at once.

A recursion that moves a level towards each value is a rising, piecewise linear
map of the level before a block to the level after it. Such a map is held as
knots: levels before and their levels after, linear in between. Only keys that
cross the border of a block need maps; they are composed in order, and then
every block runs from its own first level.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut, spread


# Up to this length a plain loop is quicker.
SHORT = 200


def levels(values: np.ndarray, start: float, rise: float, fall: float) -> np.ndarray:
    """Levels after each value: moved by ``rise`` of the distance to a higher value, by ``fall`` to a lower one."""
    if rise == fall and len(values) > SHORT:
        seeded = np.concatenate([[start], values])
        return pd.Series(seeded).ewm(alpha=rise, adjust=False).mean().to_numpy()[1:]
    out, now = np.empty(len(values)), float(start)
    for i, x in enumerate(values.tolist()):
        now += (rise if x > now else fall) * (x - now)
        out[i] = now
    return out


def knots(values: np.ndarray, low: float, high: float, rise: float, fall: float) -> tuple[np.ndarray, np.ndarray]:
    """The map of a whole block over levels from ``low`` to ``high``: levels before and after.

    A value inside the range of the levels reached adds one knot. The range
    shrinks by a fixed share at every value, so few values add one, however long
    the block; knots whose levels have become equal are put together.
    """
    before = np.array([low, high], float)
    if rise == fall:
        return before, np.array([levels(values, x, rise, fall)[-1] for x in before])
    after = before.copy()
    for x in values:
        if after[0] < x < after[-1]:
            at = int(np.searchsorted(after, x))
            if after[at] != x:
                share = (x - after[at - 1]) / (after[at] - after[at - 1])
                before = np.insert(before, at, before[at - 1] + share * (before[at] - before[at - 1]))
                after = np.insert(after, at, x)
        after = after + np.where(x > after, rise, fall) * (x - after)
        if len(after) > 2 and after[0] == after[-1]:
            before, after = before[[0, -1]], after[[0, -1]]
    return before, after


def follow(rows: DataFrame, key: str, order: list[str], value: str, out: str, rise: float, fall: float) -> DataFrame:
    """``rows`` with ``out``, the level after each row; a key's first value is its first level.

    Rows of a key go by ``order``, equal ones by value; null values, and
    undefined ones, have no level and leave it as it is. No rows give no rows.
    Rows are dealt by ranges of (key, order), so a long key runs in many tasks.
    At most one key crosses each border of two blocks: only those are summed up,
    and their levels at the borders, no more rows than blocks, go to all tasks.
    """
    names, parts = rows.columns, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = F.col(value).cast("double")
    place = [F.col(key), *[F.col(c) for c in order], number]
    dealt = rows.repartitionByRange(parts, *place).sortWithinPartitions(*place)
    held = [F.col(c).alias(f"c{j}") for j, c in enumerate(names)]
    dealt = dealt.select(*held, F.col(key).alias("k"), F.when(~F.isnan(number), number).alias("v"), F.monotonically_increasing_id().alias("i"))
    dealt = cut(dealt.withColumn("block", F.shiftright("i", 33)), "blocks")

    known = dealt.where("v is not null").select("k", "block", "i", "v")
    spans = known.groupBy("k").agg(F.min("block").alias("first"), F.max("block").alias("last"), F.min("v").alias("low"), F.max("v").alias("high"))
    spans = cut(spans.where("first < last").withColumnRenamed("k", "across"), "spans")
    crossing = known.join(F.broadcast(spans), F.col("k").eqNullSafe(F.col("across"))).select("first", "block", "i", "v", "low", "high")

    def summed(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("i")
        before, after = knots(p["v"].to_numpy(float), p["low"].iloc[0], p["high"].iloc[0], rise, fall)
        return pd.DataFrame({"first": [p["first"].iloc[0]], "block": [p["block"].iloc[0]], "seed": [p["v"].iloc[0]], "before": [before], "after": [after]})

    def composed(p: pd.DataFrame) -> pd.DataFrame:
        p, now, starts = p.sort_values("block"), None, []
        for seed, before, after in zip(p["seed"], p["before"], p["after"]):
            now = seed if now is None else now
            starts.append(now)
            now = float(np.interp(now, before, after))
        return pd.DataFrame({"first": p["first"], "at": p["block"], "start": starts})

    # A block that one key crosses from is its first one, so ``first`` names the key.
    maps = spread(crossing, "first", "block").groupBy("first", "block").applyInPandas(summed, "first long, block long, seed double, before array<double>, after array<double>")
    starts = maps.groupBy("first").applyInPandas(composed, "first long, at long, start double").join(F.broadcast(spans), "first").select("across", "at", "start")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        place = p["i"].to_numpy()
        if len(p) > 1 and not (place[1:] > place[:-1]).all():
            p = p.take(np.argsort(place))
        values, start = p["v"].to_numpy(float), p["start"].iat[0]
        some = ~np.isnan(values)
        level = np.full(len(p), np.nan)
        if some.any():
            known = values[some]
            level[some] = levels(known, start if start == start and start is not None else known[0], rise, fall)
        out = p.iloc[:, : len(names)].copy()
        out["level"] = level  # undefined numbers come back as nulls
        return out

    begun = dealt.join(F.broadcast(starts), (F.col("block") == F.col("at")) & F.col("k").eqNullSafe(F.col("across")), "left").drop("at", "across")
    schema = ", ".join([*(f"c{j} {f.dataType.simpleString()}" for j, f in enumerate(rows.schema)), "level double"])
    done = spread(begun, "block", "k").groupBy("block", "k").applyInPandas(run, schema)
    return done.select(*[F.col(f"c{j}").alias(c) for j, c in enumerate(names)], F.col("level").alias(out))
