"""Numeric column functions: weights, confidence terms, tiers and curves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights are summed as whole thousandths, so that sums do not depend on the order of rows.
MILLI = 1000

# The judgement windows in ms (perfect, great, good, fair, gate) of each table.
WINDOWS = {
    "A": (60, 105, 120, 135, 200),
    "B": (47, 63, 88, 118, 200),
    "C": (40, 56, 81, 111, 200),
    "D": (34, 50, 75, 105, 200),
    "E": (25, 50, 75, 105, 200),
}
# Accuracy of tiers 0 (best) to 5 (miss).
ACCURACY = (1.0, 0.9, 0.85, 0.8, 0.4, 0.0)
TIER_LABELS = ("big_perfect", "perfect", "great", "good", "poor", "miss")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def landmark_hash(anchor: Column, target: Column, delta: Column) -> Column:
    """Three 16-bit fields in one key: anchor, target, delta."""
    part = lambda c: c.cast("long").bitwiseAND(0xFFFF)
    return F.shiftleft(part(anchor), 32).bitwiseOR(F.shiftleft(part(target), 16)).bitwiseOR(part(delta))


def idf(total: Column, frequency: Column) -> Column:
    return F.log1p(total / (frequency + 1))


def match_weight(idf_: Column, term_frequency: Column) -> Column:
    """Damped by the square root of the query's term frequency; 0.05 to 3."""
    return clamp(idf_ / F.sqrt(F.greatest(term_frequency.cast("double"), F.lit(1.0))), 0.05, 3.0)


def as_milli(weight: Column) -> Column:
    return F.round(weight * MILLI).cast("long")


def frame_weight(low_energy: Column, low_snr: Column) -> Column:
    """A quarter for low energy and again for a low or unknown signal-to-noise ratio."""
    down = lambda c: F.when(c, F.lit(0.25)).otherwise(F.lit(1.0))
    return down(F.coalesce(low_energy, F.lit(False))) * down(F.coalesce(low_snr, F.lit(True)))


def mean_power_db(energy_db: Column) -> Column:
    """Aggregate: mean of powers, in decibels; null for no rows."""
    return 10 * F.log10(F.avg(F.pow(F.lit(10.0), energy_db / 10)))


def rms_db(samples: Column) -> Column:
    """Level of an array of samples, floored at -120."""
    power = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    mean = F.try_divide(power, F.size(samples))
    return F.when(F.coalesce(mean, F.lit(0.0)) <= 0, F.lit(-120.0)).otherwise(F.greatest(F.lit(-120.0), 10 * F.log10(mean)))


def norm(values: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalize(values: Column) -> Column:
    """Unit length; an array of zeros stays as it is."""
    n = norm(values)
    return F.when(n > 0, F.transform(values, lambda x: x.cast("double") / n)).otherwise(F.transform(values, lambda x: x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 to 1; 0 for an empty or zero vector or unequal sizes."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), clamp(dot(a, b) / n, 0.0, 1.0)).otherwise(F.lit(0.0))


# Knots of the duration term, distance in ms and value.
DURATION_KNOTS = ((250, 0.24), (2000, 0.16), (8000, 0.02), (30000, -0.24))


def duration_term(distance_ms: Column) -> Column:
    """Piecewise linear between the knots, constant outside, 0 for an unknown distance."""
    d = distance_ms.cast("double")
    out = F.when(d.isNull(), F.lit(0.0)).when(d <= DURATION_KNOTS[0][0], F.lit(DURATION_KNOTS[0][1]))
    for (x0, y0), (x1, y1) in zip(DURATION_KNOTS, DURATION_KNOTS[1:]):
        out = out.when(d <= x1, F.lit(y0) + (d - x0) * F.lit((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.lit(DURATION_KNOTS[-1][1]))


def tier(error_ms: Column, table: str, lenience: float = 1.0) -> Column:
    """0 (best) to 5 (miss) by the absolute error; limits belong to the better tier."""
    e = F.abs(error_ms)
    out = F.when(e.isNull(), F.lit(5))
    for k, limit in enumerate(WINDOWS[table]):
        out = out.when(e <= limit * lenience, F.lit(k))
    return out.otherwise(F.lit(5)).cast("int")


def tier_label(tier_: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in TIER_LABELS]), tier_)


def tier_accuracy(tier_: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in ACCURACY]), tier_)


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def smooth_step(x: Column) -> Column:
    t = clamp(x, 0.0, 1.0)
    return t * t * (3 - 2 * t)


def interpolate(a: Column, b: Column, at: Column) -> Column:
    return a + (b - a) * clamp(at, 0.0, 1.0)


def parabola_peak(left: Column, middle: Column, right: Column) -> Column:
    """Offset of the vertex from the middle, within half a step; 0 unless clearly curved down."""
    curve = left - 2 * middle + right
    return F.when(curve < -1e-6, clamp(0.5 * (left - right) / curve, -0.5, 0.5)).otherwise(F.lit(0.0))


def hz_to_mel(hz: Column) -> Column:
    return 2595 * F.log10(1 + hz / 700)


def pitch_class(hz: Column) -> Column:
    return F.pmod(F.round(69 + 12 * F.log2(hz / 440)), F.lit(12)).cast("int")


def unsigned_ms(value: Column, bits: int = 32) -> Column:
    """Rounded to a whole number; null unless finite, not negative and within the bits."""
    limit = float(1 << min(bits, 63))
    ok = value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < limit - 0.5)
    return F.when(ok, F.round(value)).cast("long")


def latency_ms(value: Column) -> Column:
    """0 unless finite and 0 to 30000."""
    return F.when(F.coalesce(~F.isnan(value) & value.between(0, 30000), F.lit(False)), value).otherwise(F.lit(0.0))


def scroll_time_ms(speed: Column) -> Column:
    return 11485 / clamp(speed, 1.0, 40.0)
