"""What a player is shown: states of objects, their places, popups of judgements and the light of lanes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import interpolate, smooth_step

# Fixed values of popups, for perfect, good and miss: pulse, start of the fade, end (ms),
# scale at the start and at the end, and how far it moves.
POPUPS = (
    (60.0, 180.0, 280.0, 0.90, 0.98, 0.0),
    (70.0, 200.0, 320.0, 0.90, 0.98, 0.0),
    (70.0, 260.0, 400.0, 1.08, 0.98, 6.0),
)
# Fixed values of the light of a lane: peak and rest while pressed, time to come to rest, time to go out (ms).
RECEPTOR, LANE = (0.52, 0.24), (0.13, 0.05)
PRESS_MS, RELEASE_MS = 85.0, 110.0
# Fixed values of the layout: least height of a hold's body, space above the receptors.
BODY, TOP = 12.0, 18.0
# How long judgements are kept (ms).
KEPT_MS = 600


def visible_state(kind: Column, state: Column, tier: Column, end: Column, miss: int = 5) -> Column:
    """openEnded, waiting, holding, missedButVisible or resolved, by the object's own state."""
    open_ = (state == "waiting") & (kind == "holdStart") & end.isNull()
    return F.when(open_, "openEnded").when((state == "resolved") & (tier == miss), "missedButVisible").otherwise(state)


def popup(rows: DataFrame, judgement: str, age: str) -> DataFrame:
    """``opacity``, ``scale`` and ``lift`` of a popup by judgement (0 perfect, 1 good, 2 miss) and age in ms; null once it has ended."""
    at = lambda k: F.get(F.array(*[F.lit(p[k]) for p in POPUPS]), F.col(judgement))
    pulse, fade, end, first, last, lift = (at(k) for k in range(6))
    old = F.greatest(F.lit(0.0), F.col(age).cast("double"))
    fading = smooth_step((old - fade) / (end - fade))
    scale = F.when(old < pulse, interpolate(first, F.lit(1.0), smooth_step(old / pulse))).otherwise(interpolate(F.lit(1.0), last, fading))
    shown = F.col(age) < end
    return rows.withColumns({
        "opacity": F.when(shown, 1 - fading), "scale": F.when(shown, scale), "lift": F.when(shown, lift * smooth_step(old / end)),
    })


def brightness(inputs: DataFrame, key: list[str], order: list[str], time: str) -> DataFrame:
    """``receptor`` and ``lane``: the light just before each input, and ``start_receptor``, ``start_lane``, from which it goes on.

    inputs: ``phase`` press or release. A press begins at the peak and comes to
    rest; a release goes out from the light that it finds, so one release after
    another dims what the one before has left. Before any input all is dark.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    press = F.col("phase") == "press"
    at = F.col(time).cast("double")
    rows = inputs.withColumns({"run": F.count_if(press).over(w), "before_ms": F.lag(at).over(w), "before": F.lag("phase").over(w)})
    age = F.greatest(F.lit(0.0), at - F.col("before_ms"))
    left = 1 - smooth_step(age / RELEASE_MS)
    rest = smooth_step(age / PRESS_MS)
    # Of a run of releases after one press, what each leaves is a product.
    run = Window.partitionBy(*key, "run").orderBy(*order)
    rows = rows.withColumns({"left": F.when(F.col("before") == "release", left).otherwise(F.lit(1.0)), "rest": F.when(F.col("before") == "press", rest)})
    dim = F.product(F.when(press, F.lit(1.0)).otherwise(F.col("left"))).over(run)
    first = F.max(F.when(~press, F.col("rest"))).over(run)
    light = lambda peak, hold: F.when(F.col("run") == 0, F.lit(0.0)).otherwise(interpolate(F.lit(peak), F.lit(hold), F.coalesce("first", F.lit(0.0))) * F.col("dim"))
    rows = rows.withColumns({"dim": dim, "first": first})
    rows = rows.withColumns({"start_receptor": F.when(press, F.lit(RECEPTOR[0])).otherwise(light(*RECEPTOR)), "start_lane": F.when(press, F.lit(LANE[0])).otherwise(light(*LANE))})

    def found(name: str, peak: float, hold: float) -> Column:
        before = F.lag(f"start_{name}").over(w)
        held, going = interpolate(F.lit(peak), F.lit(hold), rest), before * left
        return F.when(F.col("before").isNull(), F.lit(0.0)).when(F.col("before") == "press", held).otherwise(going)

    rows = rows.withColumns({"receptor": found("receptor", *RECEPTOR), "lane_light": found("lane", *LANE)})
    return rows.select(*inputs.columns, "receptor", "lane_light", "start_receptor", "start_lane")


def layout(objects: DataFrame, start: str, end: str, state: str, now: Column, scroll: Column, receptor: float) -> DataFrame:
    """``head_y``, ``tail_y``, ``body_top`` and ``body_bottom`` of objects; a tap has a head alone.

    An object is at the receptors when due and one scroll time before at the top.
    A held one goes no lower. A body reaches from tail to head, or from the top
    where the end is not known, and is at least ``BODY`` high, grown upwards.
    """
    travel = max(receptor - TOP, 1.0)
    raw = lambda c: F.lit(receptor) - (F.col(c) - now) / F.greatest(scroll, F.lit(1.0)) * travel
    shown = lambda c: F.when(F.col(state) == "holding", F.least(raw(c), F.lit(receptor))).otherwise(raw(c))
    hold = F.col(end).isNotNull() | F.col(state).isin("holding", "openEnded")
    rows = objects.withColumns({"head_y": shown(start), "tail_y": F.when(F.col(end).isNotNull(), shown(end))})
    other = F.coalesce("tail_y", F.lit(0.0))
    low, high = F.least("head_y", other), F.greatest("head_y", other)
    return rows.withColumns({"body_bottom": F.when(hold, high), "body_top": F.when(hold, high - F.greatest(high - low, F.lit(BODY)))})
