"""Nearest-in-time joins and the dense evaluation of offsets.

Time is cut into buckets of a few tolerances. In a bucket rows stand in order of
time, so the last reference row before a query row and the first one after it
are all that can be nearest: the work grows with the rows, not with how many
pairs lie within the tolerance.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import clamp


#: Width of a bucket in tolerances; wider ones need fewer rows of their neighbours.
WIDTH = 8


def nearest(query: DataFrame, reference: DataFrame, on: list[str], id_cols: list[str], time: str, tolerance: int, unique: bool = False) -> DataFrame:
    """Each query row with the reference row nearest in time within ``tolerance``.

    On equal distance the later reference row wins, then the greater of its
    other columns. Reference columns get the prefix ``r_``. Query rows without
    a partner are left out; a reference row may serve many. Query rows of equal
    ids are one row, unless they are known to be ``unique``.
    """
    columns = [c for c in reference.columns if c not in on]
    others = [c for c in columns if c != time]
    known = " AND ".join(f"`{c}` IS NOT NULL" for c in [*on, time])
    bucket = F.floor(F.col(time) / (tolerance * WIDTH)).alias("bucket")
    right = reference.where(known).select(*on, bucket, F.struct(time, *others).alias("r"))
    # What a bucket lends its neighbours: its last row to the next one, its first row to the one before.
    first = F.max_by("r", F.struct((-F.col(f"r.{time}")).alias("t"), *[F.col(f"r.{c}") for c in others]))
    edges = right.groupBy(*on, "bucket").agg(F.array(F.struct(F.lit(1).alias("to"), F.max("r").alias("r")), F.struct(F.lit(-1).alias("to"), first.alias("r"))).alias("lent"))
    lent = edges.select(*on, "bucket", F.inline("lent")).select(*on, (F.col("bucket") + F.col("to")).alias("bucket"), "r")
    left = query.where(known).select(*on, bucket, F.col(time).alias("at"), F.struct(*query.columns).alias("q"))
    rows = left.unionByName(right.unionByName(lent).withColumn("at", F.col(f"r.{time}")), allowMissingColumns=True)
    # At one time reference rows come first, the greatest of them last.
    of, asks = Window.partitionBy(*on, "bucket"), F.col("q").isNotNull()
    seen = lambda at: F.last("r", ignorenulls=True).over(of.orderBy(at, asks, "r").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = rows.withColumn("before", seen(F.asc("at"))).withColumn("after", seen(F.desc("at"))).where(asks)
    offer = lambda r: F.struct(F.abs(r[time] - F.col("at")).alias("distance"), r.alias("r"))
    ahead, behind = offer(F.col("after")), offer(F.col("before"))
    best = F.when(F.col("after").isNull(), behind).when(F.col("before").isNull() | (ahead["distance"] <= behind["distance"]), ahead).otherwise(behind)
    found = found.where("before IS NOT NULL OR after IS NOT NULL").select("q", best.alias("x")).where(F.col("x.distance") <= tolerance)
    if not unique:
        order = F.struct((-F.col("x.distance")).alias("d"), F.col("x.r"))
        found = found.groupBy(*[F.col(f"q.{c}").alias(c) for c in id_cols]).agg(F.max_by(F.struct("q", "x"), order).alias("p")).select("p.*")
    return found.select(*[F.col(f"q.{c}").alias(c) for c in query.columns], *[F.col(f"x.r.{c}").alias(f"r_{c}") for c in columns], F.col("x.distance").alias("distance"))


def nearest_of_few(query: DataFrame, reference: DataFrame, on: list[str], id_cols: list[str], time: str, tolerance: int) -> DataFrame:
    """``nearest`` by all pairs in buckets as wide as the tolerance, for series that have a few rows within it.

    Ids and times of a query row are all that is shuffled, three times over, and
    its pairs are few; in a crowd they are too many, so use ``nearest`` there.
    """
    columns = [c for c in reference.columns if c not in on]
    near = F.explode(F.array(*[F.floor(F.col(time) / tolerance) + k for k in (-1, 0, 1)]))
    right = reference.select(*on, F.struct(F.col(time), *[F.col(c) for c in columns if c != time]).alias("r"), F.floor(F.col(time) / tolerance).alias("bucket"))
    pairs = query.withColumn("bucket", near).join(right, [*on, "bucket"])
    pairs = pairs.withColumn("distance", F.abs(F.col(f"r.{time}") - F.col(time))).where(F.col("distance") <= tolerance)
    best = F.max_by("r", F.struct(-F.col("distance"), "r"))
    carried = [c for c in query.columns if c not in id_cols]
    found = pairs.groupBy(*id_cols).agg(*[F.first(c).alias(c) for c in carried], best.alias("r"), F.min("distance").alias("distance"))
    return found.select(*query.columns, *[F.col(f"r.{c}").alias(f"r_{c}") for c in columns], "distance")


@dataclass(frozen=True)
class Dense:
    """Settings of the dense evaluation; weights are for onset, subband, pcen, chroma, cens."""

    weights: tuple[float, float, float, float, float] = (0.45, 0.0, 0.30, 0.05, 0.20)
    min_frames: int = 48
    min_duration: int = 1_000_000
    min_coverage: float = 0.80
    agree: float = 0.55
    tolerance: int = 15_000


FEATURES = ("onset", "subband", "pcen", "chroma", "cens")


def weighted_cosine(w: Column, x: Column, y: Column) -> Column:
    """Aggregate over pairs of equal-sized arrays; 0 for no pair, a zero norm or any unequal or empty pair."""
    terms = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    clean = F.bool_and((F.size(x) == F.size(y)) & (F.size(x) > 0))
    norm = F.sqrt(F.sum(w * terms(x, x)) * F.sum(w * terms(y, y)))
    return F.when(clean & (norm > 0), clamp(F.sum(w * terms(x, y)) / norm, 0.0, 1.0)).otherwise(F.lit(0.0))


def rise(now: Column, before: Column) -> Column:
    return F.zip_with(now, before, lambda x, y: F.greatest(x - y, F.lit(0).cast("double")))


def offset_features(query: DataFrame, reference: DataFrame, offsets: DataFrame, tolerance: int, few: bool = False) -> DataFrame:
    """What the frames say for each (key, offset), whatever a gate makes of it.

    Adds frames, usable_frames and usable_us of the query, matched, comparable,
    coverage, mean_error_us and a score for each feature. A query may name its
    reference in a column ``ref``; else that is its key. Frame ids are unique in
    their key. Frames carry their arrays to their partners, so moved frames are
    shuffled twice: to the times of the reference, and together by offset. With
    ``few``, where a frame has a few within the tolerance, only ids and times
    meet the offsets and arrays are fetched once the partner is known.
    """
    if "ref" not in query.columns:
        query, reference = query.withColumn("ref", F.col("key")), reference.withColumnRenamed("key", "ref")
    evidence = query.groupBy("key").agg(
        F.count("*").alias("frames"), F.count_if("usable").alias("usable_frames"),
        (F.max(F.when(F.col("usable"), F.col("t_us"))) - F.min(F.when(F.col("usable"), F.col("t_us")))).alias("usable_us"),
    )
    carried = ["usable", "weight", *FEATURES]
    carried = ["usable", "weight", *FEATURES]
    own = [] if few else carried
    moved = query.select("key", "ref", "frame_id", "t_us", *own).join(offsets, "key").withColumn("t_us", F.col("t_us") + F.col("offset_us"))
    on, known = (["ref"], ["key", "offset_us", "frame_id"], "t_us", tolerance), reference.select("ref", "frame_id", "t_us", *own)
    if few:
        pairs = (
            nearest_of_few(moved, known, *on).join(query.select("key", "frame_id", *carried), ["key", "frame_id"])
            .join(reference.select("ref", F.col("frame_id").alias("r_frame_id"), *[F.col(c).alias(f"r_{c}") for c in carried]), ["ref", "r_frame_id"])
        )
    else:
        pairs = nearest(moved, known, *on, unique=True).select("key", "offset_us", "t_us", "frame_id", "distance", *carried, *[f"r_{c}" for c in carried])
    # Pairs of one offset are those of one query window: a bounded group.
    order = Window.partitionBy("key", "offset_us").orderBy("t_us", "frame_id")
    w = F.least("weight", "r_weight")
    pairs = (
        pairs.withColumn("w", w)
        .withColumn("w_before", F.lag("w").over(order))
        .withColumn("w_rise", F.when(F.col("w_before").isNotNull(), F.least("w", "w_before")))
        .withColumn("rise", rise(F.col("chroma"), F.lag("chroma").over(order)))
        .withColumn("r_rise", rise(F.col("r_chroma"), F.lag("r_chroma").over(order)))
    )
    later = F.col("w_rise").isNotNull()
    none = F.array().cast("array<double>")
    scores = {f: weighted_cosine(F.col("w"), F.col(f), F.col(f"r_{f}")) for f in FEATURES if f != "chroma"}
    moves = F.when(later, F.col("w_rise")).otherwise(F.lit(0.0))
    one = F.array(F.lit(0.0))
    scores["chroma"] = weighted_cosine(moves, F.when(later, F.coalesce("rise", none)).otherwise(one), F.when(later, F.coalesce("r_rise", none)).otherwise(one))
    found = pairs.groupBy("key", "offset_us").agg(
        F.count("*").alias("matched"), F.count_if(F.col("usable") & F.col("r_usable")).alias("comparable"),
        F.sum("distance").alias("error_sum"), *[scores[f].alias(f) for f in FEATURES],
    )
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return (
        offsets.join(evidence, "key").join(found, ["key", "offset_us"], "left")
        .withColumn("mean_error_us", F.col("error_sum") / F.col("matched").cast("double"))
        .withColumns({"matched": count("matched"), "comparable": count("comparable"), **{f: F.coalesce(f, F.lit(0.0)) for f in FEATURES}})
        .withColumn("coverage", F.col("matched") / F.col("frames").cast("double"))
        .select("key", "offset_us", "frames", "usable_frames", "usable_us", "matched", "comparable", "coverage", "mean_error_us", *FEATURES)
    )


def judged(settings: Dense) -> dict[str, Column]:
    """Of a row of ``offset_features``: whether the evidence suffices, the scores (0 if not), their blend and how many agree."""
    enough = (
        (F.col("usable_frames") >= settings.min_frames) & (F.coalesce("usable_us", F.lit(0)) >= settings.min_duration)
        & (F.col("comparable") >= settings.min_frames) & (F.col("coverage") >= settings.min_coverage)
    )
    scores = {f: F.when(enough, F.col(f)).otherwise(F.lit(0.0)) for f in FEATURES}
    combined = sum((scores[f] * w for f, w in zip(FEATURES, settings.weights)), F.lit(0.0)) / sum(settings.weights)
    agreement = sum((F.when(scores[f] >= settings.agree, 1).otherwise(0) for f in FEATURES), F.lit(0))
    return {"sufficient": enough, **scores, "combined": combined, "agreement": F.when(enough, agreement).otherwise(F.lit(0))}


def evaluate_offsets(query: DataFrame, reference: DataFrame, offsets: DataFrame, settings: Dense = Dense()) -> DataFrame:
    """Scores of each (key, offset): reference time is query time plus offset.

    Frames: key, frame_id, t_us, usable, weight, and the arrays onset (one
    value), subband, pcen, chroma, cens. offsets: key, offset_us. Frames whose
    partner is within the tolerance count as matched; of these, pairs usable on
    both sides are comparable. Chroma is compared by its rise since the matched
    pair before. Scores are 0 unless the evidence suffices.
    """
    raw = offset_features(query, reference, offsets, settings.tolerance)
    columns = judged(settings)
    return raw.select("key", "offset_us", "matched", "comparable", "coverage", "mean_error_us", *[columns[n].alias(n) for n in ("sufficient", *FEATURES, "combined", "agreement")])


def refinement_grid(coarse: DataFrame, radius: int, step: int) -> DataFrame:
    """Offsets around each coarse one: coarse - radius to coarse + radius by step."""
    moves = F.sequence(F.lit(-(radius // step) * step), F.lit((radius // step) * step), F.lit(step))
    return coarse.withColumn("coarse_us", F.col("offset_us")).withColumn("offset_us", F.explode(F.transform(moves, lambda m: F.col("coarse_us") + m)))


def best_offset(evaluated: DataFrame, coarse: DataFrame) -> DataFrame:
    """The winner around each coarse offset (key, coarse_us, offset_us): evidence, score, comparable pairs, small time error, nearness to the coarse offset, small offset.

    ``coarse`` comes from ``refinement_grid``; an offset that several coarse
    ones share was evaluated once and competes in each.
    """
    order = F.struct(
        F.col("sufficient"), F.col("combined"), F.col("comparable"), -F.coalesce("mean_error_us", F.lit(float("inf"))),
        -F.abs(F.col("offset_us") - F.col("coarse_us")), -F.col("offset_us"),
    )
    names = [c for c in evaluated.columns if c != "key"]
    rows = coarse.select("key", "coarse_us", "offset_us").join(evaluated, ["key", "offset_us"])
    return rows.groupBy("key", "coarse_us").agg(F.max_by(F.struct(*names), order).alias("x")).select("key", "coarse_us", "x.*")


def top_with_ties(scored: DataFrame, key: str, score: str, k: int, margin: float) -> DataFrame:
    """Rows among the k best of their key, or within ``margin`` of the best."""
    w = Window.partitionBy(key)
    ranked = scored.withColumn("rank", F.rank().over(w.orderBy(F.desc(score)))).withColumn("behind", F.max(score).over(w) - F.col(score))
    return ranked.where((F.col("rank") <= k) | (F.col("behind") <= margin))
