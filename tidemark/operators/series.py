"""Series operators over keyed, ordered rows: means, differences, gaps, peaks, recursions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.blocked import follow
from tidemark.session import spread


def along(key: str, *order: str):
    return Window.partitionBy(key).orderBy(*order)


def trailing(rows: DataFrame, key: str, time: str, span: int, **aggregates: Column) -> DataFrame:
    """Aggregates over the closed window [time - span, time]. Use a segment in ``key`` to stop at gaps."""
    w = Window.partitionBy(key).orderBy(time).rangeBetween(-span, 0)
    return rows.withColumns({name: c.over(w) for name, c in aggregates.items()})


def gap_segments(rows: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """``segment``: grows by one where a row comes more than ``most`` after the one before."""
    w = along(key, *order)
    gap = F.coalesce((F.col(order[0]) - F.lag(order[0]).over(w) > most).cast("int"), F.lit(0))
    return rows.withColumn("gap", gap).withColumn("segment", F.sum("gap").over(w)).drop("gap")


def is_regular(rows: DataFrame, key: str, time: str, hop: float, slack: float = 0.05) -> DataFrame:
    """Whether every step, and every position counted from the first, is within ``slack`` of the hop."""
    w = along(key, time)
    step = F.abs(F.col(time) - F.lag(time).over(w) - hop)
    place = F.abs(F.col(time) - F.first(time).over(w) - (F.row_number().over(w) - 1) * hop)
    checked = rows.withColumn("ok", (F.coalesce(step, F.lit(0.0)) <= slack * hop) & (place <= slack * hop))
    return checked.groupBy(key).agg(F.bool_and("ok").alias("regular"), F.count("*").alias("rows"))


def centered_mean(rows: DataFrame, key: str, order: list[str], value: str, radius: int) -> DataFrame:
    """``mean`` over 2 * radius + 1 rows; beyond an end its value is repeated."""
    w = along(key, *order)
    inner = w.rowsBetween(-radius, radius)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(w)
    before = F.greatest(F.lit(0), radius + 1 - place)
    after = F.greatest(F.lit(0), radius - (F.count("*").over(whole) - place))
    total = F.sum(value).over(inner) + before * F.first(value).over(whole) + after * F.last(value).over(whole)
    return rows.withColumn("mean", total / F.lit(float(2 * radius + 1)))


def positive_difference(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``rise``: growth since the row before; falls, and the first row, count 0."""
    return rows.withColumn("rise", F.greatest(F.lit(0), F.coalesce(F.col(value) - F.lag(value).over(along(key, *order)), F.lit(0))))


def vector_rise(rows: DataFrame, key: str, order: list[str], vector: str) -> DataFrame:
    """The same for every element of an array, and ``envelope``, its sum."""
    before = F.lag(vector).over(along(key, *order))
    rise = F.zip_with(vector, F.coalesce(before, F.col(vector)), lambda x, y: F.greatest(x - y, F.lit(0).cast("double")))
    return rows.withColumn("rise", rise).withColumn("envelope", F.aggregate("rise", F.lit(0.0), lambda s, x: s + x))


def prefix_energy(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``energy``: sum of squares up to the row; a range's energy is a difference of two."""
    w = along(key, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("energy", F.sum(F.col(value) * F.col(value)).over(w))


def decimate(rows: DataFrame, key: str, order: list[str], value: str, by: int = 4) -> DataFrame:
    """Means of each ``by`` rows; an incomplete last group is left out."""
    placed = rows.withColumn("place", F.row_number().over(along(key, *order)) - 1)
    groups = placed.groupBy(key, F.floor(F.col("place") / by).alias("slot")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return groups.where(F.col("n") == by).select(key, "slot", (F.col("total") / F.lit(float(by))).alias("mean"))


def local_peaks(rows: DataFrame, key: str, order: list[str], value: str, share: float = 0.1, most: int | None = None) -> DataFrame:
    """Rows at least as high as both neighbours (0 beyond the ends) and a share of the key's highest; the top ``most``."""
    w = along(key, *order)
    top = F.max(value).over(Window.partitionBy(key))
    left, right = F.coalesce(F.lag(value).over(w), F.lit(0)), F.coalesce(F.lead(value).over(w), F.lit(0))
    peaks = rows.withColumn("top", top).withColumn("left", left).withColumn("right", right)
    peaks = peaks.where((F.col(value) >= F.col("left")) & (F.col(value) >= F.col("right")) & (F.col(value) >= share * F.col("top")) & (F.col(value) > 0))
    if most is not None:
        rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(value), *order))
        peaks = peaks.withColumn("rank", rank).where(F.col("rank") <= most)
    return peaks.drop("top")


def milestones(rows: DataFrame, key: str, time: str, state: str) -> DataFrame:
    """When each state was first reached, and at what place among the key's rows."""
    placed = rows.withColumn("place", F.row_number().over(along(key, time)))
    return placed.groupBy(key, state).agg(F.min(time).alias("first"), F.min("place").cast("long").alias("place"), F.count("*").alias("rows"))


def reverse_count(rows: DataFrame, key: str, order: list[str], flag: Column) -> DataFrame:
    """``left``: rows from here to the end for which ``flag`` holds."""
    w = along(key, *order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return rows.withColumn("left", F.count_if(flag).over(w))


def growing_durations(first: float, cadence: float, most: float) -> list[float]:
    """first, first + cadence, ... and the most, each once."""
    out = [float(x) for x in np.arange(first, most, cadence)] if cadence > 0 else [first]
    return [*out, most] if not out or out[-1] < most else out


def _recursive(rows: DataFrame, key: str, order: list[str], columns: dict[str, str], step: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Apply a recursion to each key's ordered rows; a key is one source's stream, a bounded group."""
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), *(f"{c} {k}" for c, k in columns.items())])
    return spread(rows, key).groupBy(key).applyInPandas(lambda p: step(p.sort_values(order, kind="stable")), schema)


def ewma(rows: DataFrame, key: str, order: list[str], value: str, rate: float) -> DataFrame:
    """``smooth``: exponential mean, seeded by the first value; long keys run in blocks."""
    return follow(rows, key, order, value, "smooth", rate, rate)


# Fixed values of the per-channel energy normalisation.
PCEN_RATE, PCEN_GAIN, PCEN_BIAS, PCEN_ROOT, PCEN_FLOOR = 0.025, 0.98, 2.0, 0.5, 1e-6


def pcen(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``pcen``: the value over its own smoothed level, compressed."""
    level = F.greatest(F.lit(PCEN_FLOOR), F.col("pcen"))
    out = F.pow(F.col(value).cast("double") / F.pow(level, F.lit(PCEN_GAIN)) + PCEN_BIAS, F.lit(PCEN_ROOT)) - PCEN_BIAS**PCEN_ROOT
    smoothed = follow(rows, key, order, value, "pcen", PCEN_RATE, PCEN_RATE)
    return smoothed.withColumn("pcen", F.when(F.col("pcen").isNotNull(), F.greatest(F.lit(0.0), out)))


def noise_floor(rows: DataFrame, key: str, order: list[str], level: str, rise: float = 0.02, fall: float = 0.25) -> DataFrame:
    """``floor`` follows the level slowly up and quickly down; ``snr`` is the level above it, 0 at first."""
    followed = follow(rows, key, order, level, "floor", rise, fall)
    return followed.withColumn("snr", F.when(F.col("floor").isNotNull(), F.greatest(F.lit(0.0), F.col(level) - F.col("floor"))))


CHROMA_RATE = 0.25


def cens(rows: DataFrame, key: str, order: list[str], chroma: str) -> DataFrame:
    """``cens``: smoothed shares of the pitch classes in whole steps, of length 1; a null vector has none.

    ``order`` must tell the rows of a key apart. Classes are smoothed one by one,
    so a recording runs in blocks and in as many series as it has classes.
    """
    from tidemark.functions.numbers import l2_normalize

    names = rows.columns
    whole = rows.select(F.struct(*names).alias("row"), F.struct(key, *order).alias("at"), F.col(chroma).alias("values"))
    long = whole.select("row", "at", F.posexplode_outer("values").alias("class", "x")).select("row", F.struct(F.col("at")[key].alias("k"), "class").alias("k"), "at", "class", "x")
    smooth = ewma(long, "k", ["at"], "x", CHROMA_RATE)
    vector = F.transform(F.array_sort(F.collect_list(F.when(F.col("class").isNotNull(), F.struct("class", "smooth")))), lambda e: e["smooth"])
    whole = smooth.groupBy("at").agg(F.first("row").alias("row"), vector.alias("smooth"))
    return whole.select("row.*", F.when(F.size("smooth") > 0, l2_normalize(quantize_chroma(F.col("smooth")))).alias("cens"))


def cadence(rows: DataFrame, key: str, time: str, step: float) -> DataFrame:
    """Keep a row when ``step`` has passed since the last one kept, and always the last."""

    def choose(p):
        kept, last = [], None
        for x in p[time].astype(float):
            hit = last is None or x >= last + step
            kept.append(hit)
            last = x if hit else last
        kept[-1] = True
        return p[np.array(kept)]

    return _recursive(rows, key, [time], {}, choose)


def quantize_chroma(values: Column) -> Column:
    """Shares of the sum in steps 0 to 4 (at 0.05, 0.1, 0.2, 0.4)."""
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    at = lambda x: F.when(total <= 0, 0).otherwise(sum((F.when(x / total >= t, 1).otherwise(0) for t in (0.05, 0.1, 0.2, 0.4)), F.lit(0)))
    return F.transform(values, lambda x: at(x).cast("double"))


def trim_oldest(rows: DataFrame, key: str, order: list[str], amount: str, most: float) -> DataFrame:
    """The newest rows of each key that hold ``most`` of ``amount`` in sum; of the oldest one kept only the rest that fits."""
    later = F.coalesce(F.sum(amount).over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("later", later).where(F.col("later") < most).withColumn(amount, F.least(F.col(amount), F.lit(most) - F.col("later"))).drop("later")


def expire(rows: DataFrame, key: str, time: str, keep: int) -> DataFrame:
    """Rows no older than ``keep`` before the newest of their key."""
    return rows.withColumn("newest", F.max(time).over(Window.partitionBy(key))).where(F.col(time) >= F.col("newest") - keep).drop("newest")
