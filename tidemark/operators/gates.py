"""Gates between evidence and a published lock: why a window or a candidate is held back, with what confidence and in which state.

All are column expressions over one row; reasons are tried in the order given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of readiness (ms, dBFS, share, landmarks).
DURATION_MS, ENERGY, ACTIVE_ENERGY, ACTIVE, LANDMARKS = 2500, -62.0, -70.0, 0.35, 8
# The first gate of a candidate, the last one, and the dense gates of both.
VOTES, DENSITY, DISAGREE_MS, AMBIGUOUS_MARGIN = 8, 0.08, 100, 0.04
PROVISIONAL = {"votes": 8, "landmark": 0.08, "combined": 0.55, "margin": 0.02, "agreement": 2, "feature": 0.50, "agree": 0.55, "apart_ms": 100}
FINAL = {"votes": 10, "landmark": 0.08, "combined": 0.55, "margin": 0.02, "agreement": 2, "feature": 0.52, "agree": 0.50, "apart_ms": 180}
FINAL_COMBINED, FINAL_MARGIN, FINAL_AGREEMENT, FINAL_PCEN, FINAL_CENS, STABLE_MS, TRACK_MS, LEAD = 0.55, 0.02, 2, 0.65, 0.65, 180.0, 80, 1.0
TIMING_FEATURES, ROBUST_FEATURES = ("onset", "pcen", "chroma", "cens"), ("pcen", "cens")


def readiness(frames: DataFrame, keys: list[str], time_ms: str, energy: str, landmarks: str) -> DataFrame:
    """A row for each window: duration_ms, energy (mean power as dBFS), active (share of loud frames), landmarks.

    Sums meet before the shuffle. Null energies count as silence, null landmarks as none.
    """
    power = F.avg(F.coalesce(F.pow(F.lit(10.0), F.col(energy) / 10), F.lit(0.0)))
    loud = F.avg(F.when(F.col(energy) >= ACTIVE_ENERGY, 1.0).otherwise(0.0))
    return frames.groupBy(*keys).agg(
        (F.max(time_ms) - F.min(time_ms)).alias("duration_ms"), F.when(power > 0, 10 * F.log10(power)).alias("energy"),
        loud.alias("active"), F.coalesce(F.sum(landmarks), F.lit(0)).alias("landmarks"),
    )


def readiness_reason(duration_ms: float = DURATION_MS) -> Column:
    """Of a row of ``readiness``: the first limit missed, or ``none``; a null measure misses its limit."""
    low = lambda c, limit: ~F.coalesce(F.col(c) >= limit, F.lit(False))
    return (
        F.when(low("duration_ms", duration_ms), "insufficient_duration").when(low("energy", ENERGY), "insufficient_energy")
        .when(low("active", ACTIVE), "insufficient_active_frames").when(low("landmarks", LANDMARKS), "insufficient_landmarks").otherwise("none")
    )


def _margin(least: float) -> Column:
    return F.when(F.col("ambiguous"), F.lit(max(least, AMBIGUOUS_MARGIN))).otherwise(F.lit(least))


def _rivalled(least: float) -> Column:
    return (F.col("candidates") > 1) & (F.col("margin") < _margin(least))


def timing_reason() -> Column:
    """Why a candidate fails the first gate, or ``none``. ``ambiguous`` is what the coarse stage found; a lone candidate needs no margin."""
    p = PROVISIONAL
    strong = (
        F.col("sufficient") & (F.col("votes") >= p["votes"]) & (F.col("landmark") >= p["landmark"])
        & (F.col("combined") >= p["combined"]) & (F.col("agreement") >= p["agreement"])
    )
    far = F.abs(F.col("offset_ms") - F.col("coarse_ms")) > DISAGREE_MS
    return F.when(~strong, "weak_peak").when(_rivalled(p["margin"]), "ambiguous").when(far, "weak_peak").otherwise("none")


def final_reason() -> Column:
    """Why a candidate fails the last gate, or ``none``."""
    strong = (
        (F.col("combined") >= FINAL_COMBINED) & (F.col("agreement") >= FINAL_AGREEMENT)
        & (F.col("pcen") >= FINAL_PCEN) & (F.col("cens") >= FINAL_CENS)
    )
    return F.when(~strong, "weak_peak").when(_rivalled(FINAL_MARGIN), "ambiguous").otherwise("none")


def tracker_reason() -> Column:
    """Whether the tracker backs a candidate: ``none``, or ``unstable``. Without a track it does not."""
    backed = F.col("confirmed") & F.col("stable") & (F.abs(F.col("offset_ms") - F.col("track_ms")) <= TRACK_MS)
    return F.when(F.coalesce(backed, F.lit(False)), "none").otherwise("unstable")


def dense_gate(limits: dict = PROVISIONAL) -> Column:
    """Whether a candidate's dense evaluation is enough by ``limits``: one timing feature and one robust one must speak for it."""
    of = lambda names, least: F.greatest(*[F.col(f) for f in names]) >= least
    return (
        F.col("sufficient") & (F.col("votes") >= limits["votes"]) & (F.col("landmark") >= limits["landmark"]) & (F.col("combined") >= limits["combined"])
        & (F.col("margin") >= limits["margin"]) & (F.col("agreement") >= limits["agreement"])
        & (F.abs(F.col("offset_ms") - F.col("coarse_ms")) <= limits["apart_ms"])
        & of(TIMING_FEATURES, limits["feature"]) & of(ROBUST_FEATURES, limits["agree"])
    )


def lock_phase() -> Column:
    """How far a session got by its first times: final_ms, confirmed_ms, provisional_ms."""
    return F.when(F.col("final_ms").isNotNull(), "final").when(F.col("confirmed_ms").isNotNull(), "confirmed").when(F.col("provisional_ms").isNotNull(), "provisional").otherwise("none")


def held_state(stage: Column, phase: Column, reason: Column) -> Column:
    """State shown when a ``stage`` (readiness, coarse, timing, final) holds a window back, by phase and reason."""
    before = F.when(phase == "confirmed", F.when(stage == "final", "relocking").otherwise("confirmed")).otherwise("locking")
    drifts = (reason == "ambiguous") | ((stage == "final") & (reason == "unstable"))
    silent = reason.isin("insufficient_energy", "insufficient_active_frames")
    ready = F.when(phase == "none", "listening").when(silent, "lost").otherwise("relocking")
    return F.when(stage == "readiness", ready).when(phase != "final", before).when(drifts, "drifting").otherwise("relocking")


def _share(c: Column, whole: float) -> Column:
    return F.least(F.lit(1.0), c / F.lit(float(whole)))


def _blend(*parts: tuple[Column, float]) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), sum((c * w for c, w in parts), F.lit(0.0))))


def vote_confidence() -> Column:
    return _share(F.col("weighted"), 2 * VOTES)


def provisional_confidence() -> Column:
    return _blend((vote_confidence(), 0.25), (_share(F.col("landmark"), 2 * DENSITY), 0.20), (F.col("combined"), 0.40), (_share(F.col("margin"), 4 * PROVISIONAL["margin"]), 0.15))


def final_confidence() -> Column:
    """``stability_ms`` is how far the offset moved lately; null counts half."""
    steady = F.coalesce(1 - _share(F.col("stability_ms"), STABLE_MS), F.lit(0.5))
    robust = F.least("pcen", "cens")
    return _blend((vote_confidence(), 0.20), (F.col("combined"), 0.35), (robust, 0.20), (_share(F.col("margin"), 4 * FINAL_MARGIN), 0.15), (steady, 0.10))


def measurement_confidence() -> Column:
    """What a candidate is worth to the offset tracker."""
    agreed = _share(F.col("agreement"), max(FINAL["agreement"], 1))
    return _blend((F.col("combined"), 0.45), (F.col("landmark"), 0.20), (F.col("coverage"), 0.15), (agreed, 0.10), (vote_confidence(), 0.10))


def track_confidence() -> Column:
    """Of a track: log_odds, lead over the next, stable, can_coast; 0 without a track."""
    odds = 1 / (1 + F.exp(-F.col("log_odds")))
    steady = F.when(F.col("stable"), 1.0).when(F.col("can_coast"), 0.65).otherwise(0.25)
    return F.coalesce(_blend((odds, 0.65), (_share(F.col("lead"), 2 * LEAD), 0.20), (steady, 0.15)), F.lit(0.0))


def dense_rank(candidates: DataFrame, keys: list[str], k: int | None = None) -> DataFrame:
    """``rank`` of each candidate among its key's: evidence, score, agreement, weighted votes, distinct hashes, landmark score, then small offset."""
    order = [F.desc("sufficient"), F.desc("combined"), F.desc("agreement"), F.desc("weighted"), F.desc("hashes"), F.desc("landmark"), F.asc("offset_ms")]
    ranked = candidates.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def projected(reference_ms: Column, recorded_ms: Column, endpoint_ms: Column, now_ms: Column, duration_ms: Column | None = None) -> dict[str, Column]:
    """offset_ms of a match, reference_end_ms at the window's endpoint, and reference_now_ms on the session's clock, within the track if its length is known."""
    offset = reference_ms - recorded_ms
    now = now_ms + offset
    if duration_ms is not None:
        now = F.greatest(F.lit(0.0), F.least(now, F.coalesce(duration_ms, now)))
    return {"offset_ms": offset, "reference_end_ms": endpoint_ms + offset, "reference_now_ms": now}
