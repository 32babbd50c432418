"""The landmark chain: from landmarks and frames to the windows that ``landmark_lock`` folds.

A live recording is cut into windows, which are rows from then on. Their
landmarks vote for offsets against the recording's own reference, votes are
thinned to candidates, and every candidate's coarse offset is evaluated
densely. Only the candidates that lead then, or come close to the lead, are
refined on a grid of offsets; the others keep their coarse evaluation. Scores
do not depend on a gate's settings, so the first and the last gate share one
evaluation. Reasons and confidences are columns; the tracker's fold comes last.

Windows overlap and are searched at many offsets, so what is dealt are
recordings: landmarks are shuffled once, by recording, and put into windows
behind the shuffle; frames are shuffled by blocks of windows, beside the pieces
of the reference that the block's candidates reach (``dense``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import MILLI, as_milli, idf, match_weight
from tidemark.operators import dense, landmark_lock, nearest, voting
from tidemark.operators import gates as G
from tidemark.session import cut, spread


@dataclass(frozen=True)
class Chain:
    """Settings; times in microseconds. The defaults are those of 20 ms frames."""

    window_us: int = 5_000_000
    hop_us: int = 500_000
    long_us: int = 4_500_000
    ready_us: int = 2_500_000
    bin_us: int = 20_000
    most: int = 8
    apart_us: int = 750_000
    coarse_votes: int = 8
    coarse_density: float = 0.08
    coarse_spread_us: int = 900_000
    coarse_ratio: float = 1.35
    coarse_margin: float = 4.0
    radius_us: int = 60_000
    step_us: int = 5_000
    refined: int = 2
    refined_margin: float = 0.08
    reference_landmarks: int = 8
    timing: nearest.Dense = nearest.Dense()
    robust: nearest.Dense = nearest.Dense(weights=(0.30, 0.0, 0.35, 0.05, 0.30), min_frames=96, min_duration=2_500_000, min_coverage=0.85, agree=0.50)


def windowed(rows: DataFrame, s: Chain) -> DataFrame:
    """Rows (key, t_us) in each window that holds them: adds ``end_us``; windows end at whole hops and reach back ``window_us``."""
    first, last = F.ceil(F.col("t_us") / s.hop_us), F.floor((F.col("t_us") + s.window_us) / s.hop_us)
    return rows.withColumn("end_us", F.explode(F.transform(F.sequence(first, last), lambda n: n * s.hop_us)))


def window_id(rows: DataFrame) -> DataFrame:
    return rows.withColumn("window", F.concat_ws("@", F.col("key"), F.col("end_us").cast("string")))


def coarse_candidates(landmarks: DataFrame, reference: DataFrame, s: Chain) -> DataFrame:
    """Candidates of each window: window, key, place, offset_us, the votes' figures and, of the window, ``coarse`` (why it stops here) and ``ambiguous``.

    landmarks: window, key, hash, t_us; reference: key, hash, t_us.
    """
    query = landmarks.withColumnRenamed("window", "query_id")
    bins = voting.keyed_histogram(query, reference, s.bin_us, by=["key"])
    return _told_coarse(voting.independent(bins, s.most, -(-s.apart_us // s.bin_us)), s)


def marks_of_windows(marks: DataFrame, s: Chain) -> DataFrame:
    """window and how many ``landmarks`` (key, t_us) it has."""
    return window_id(windowed(spread(marks.select("key", "t_us"), "key"), s).groupBy("key", "end_us").agg(F.count("*").alias("landmarks"))).select("window", "landmarks")


def recorded_candidates(marks: DataFrame, reference: DataFrame, sizes: DataFrame, s: Chain) -> DataFrame:
    """``coarse_candidates`` of landmarks that are not yet in windows: (key, hash, t_us), all known.

    Both sides are shuffled once, by recording; there all times of a hash meet
    in one row, and every sum by window is one of a recording. sizes: ``marks_of_windows``.
    """
    side = lambda rows, asks: rows.select("key", "hash", "t_us", F.lit(asks).alias("asks"))
    rows = spread(side(marks, True).unionByName(side(reference, False)), "key")
    times = lambda asks, name: F.collect_list(F.when(F.col("asks") == asks, F.col("t_us"))).alias(name)
    hashes = rows.groupBy("key", "hash").agg(times(True, "asked"), times(False, "known")).withColumn("postings", F.size("known").cast("long"))
    hashes = hashes.withColumn("idf", idf(F.sum("postings").over(Window.partitionBy("key")).cast("double"), F.col("postings"))).where("postings > 0 AND size(asked) > 0")
    met = hashes.select("key", "hash", "postings", "idf", "known", F.explode("asked").alias("t_us")).select("key", "hash", "postings", "idf", "t_us", F.explode("known").alias("r_us"))
    met = windowed(met.withColumn("bin", F.round((F.col("r_us") - F.col("t_us")) / F.lit(float(s.bin_us))).cast("long")), s)
    votes = met.groupBy("key", "end_us", "bin", "hash").agg(
        F.count("*").alias("votes"), F.sum(F.col("r_us") - F.col("t_us") - F.col("bin") * s.bin_us).alias("beside"), F.min("t_us").alias("q_first"),
        F.max("t_us").alias("q_last"), F.max("postings").alias("postings"), F.max("idf").alias("idf"),
    )
    # each of a window's landmarks of a hash meets all its postings
    landmarks = F.sum("votes").over(Window.partitionBy("key", "end_us", "hash")) / F.col("postings")
    votes = votes.withColumn("weight", as_milli(match_weight(F.col("idf"), landmarks)))
    sums = votes.groupBy("key", "end_us", "bin").agg(
        F.sum("votes").alias("votes"), F.sum(F.col("votes") * F.col("weight")).alias("weight"), F.sum(F.col("weight") * F.col("beside")).alias("moment"),
        F.count("*").alias("unique_hashes"), F.min("q_first").alias("q_first"), F.max("q_last").alias("q_last"),
    )
    bins = window_id(sums).select(
        F.col("window").alias("query_id"), "key", "bin", "votes", (F.col("weight") / F.lit(float(MILLI))).alias("score"),
        (F.col("bin") * F.lit(float(s.bin_us)) + F.col("moment") / F.col("weight").cast("double")).alias("offset_us"), "unique_hashes",
        (F.col("q_last") - F.col("q_first")).alias("spread_us"),
    )
    found = voting.independent(bins, s.most, -(-s.apart_us // s.bin_us)).join(sizes.withColumnRenamed("window", "query_id"), "query_id")
    return _told_coarse(found.withColumn("density", F.col("votes") / F.col("landmarks").cast("double")), s)


def _told_coarse(found: DataFrame, s: Chain) -> DataFrame:
    # the lead over the second is told beside its window's candidates, which are together already
    at = lambda place, c: F.max(F.when(F.col("place") == place, F.col(c))).over(Window.partitionBy("query_id"))
    found = found.withColumns({"first": at(0, "score"), "second": at(1, "score"), **{f"first_{c}": at(0, c) for c in ("votes", "density", "spread_us")}})
    enough = (F.col("first_votes") >= s.coarse_votes) & (F.col("first_density") >= s.coarse_density) & (F.col("first_spread_us") >= s.coarse_spread_us)
    ratio, margin = F.coalesce(F.try_divide("first", "second"), F.col("first")), F.greatest(F.lit(0.0), F.col("first") - F.coalesce("second", F.lit(0.0)))
    rivalled = F.coalesce(F.col("second") > 0, F.lit(False)) & ((ratio < s.coarse_ratio) | (margin < s.coarse_margin))
    return found.select(
        F.col("query_id").alias("window"), "key", "place", F.round("offset_us").cast("long").alias("coarse_us"), "votes", F.col("score").alias("weighted"),
        F.col("unique_hashes").alias("hashes"), F.least(F.lit(1.0), "density").alias("landmark"), F.when(enough, "none").otherwise("insufficient_landmarks").alias("coarse"),
        (enough & rivalled).alias("ambiguous"),
    )


GATES = ("timing", "robust")

#: Windows of a block, whose frames are in one task; width of a piece of the reference in windows.
BLOCK, PIECE = 256, 4


def scored(candidates: DataFrame, query: DataFrame, reference: DataFrame, s: Chain, prune: bool = True) -> DataFrame:
    """Candidates with their evaluation by each gate (``timing`` and ``robust``).

    All coarse offsets are evaluated. By each gate's ranking the first
    ``refined`` candidates, and all whose score is within ``refined_margin`` of
    the first one's, get the best offset of their grid; the rest keep the coarse
    one. With ``prune`` only the grids of candidates that a gate refines are
    evaluated; without, all are, to the same result.

    query: frames by window (key is the window, ref the reference's key).
    """
    spans = query.groupBy(F.col("key").alias("window")).agg(F.min("t_us").alias("since_us"), F.max("t_us").alias("until_us"))
    asked = candidates.join(spans, "window").select(F.col("window").alias("unit"), F.col("key").alias("ref"), "since_us", "until_us", F.struct(*candidates.columns).alias("c"))
    return evaluated(asked, query.withColumnRenamed("key", "unit"), reference, s, prune)


def evaluated(asked: DataFrame, live: DataFrame, reference: DataFrame, s: Chain, prune: bool = True) -> DataFrame:
    """Candidates with their evaluation by each gate, as ``scored`` says.

    asked: ``c``, a candidate as a struct, with the closed span since_us to
    until_us of its window's frames, the ``unit`` these are in and the key
    ``ref`` of its reference; live: frames by ``unit``. A task holds a unit's
    frames and what its candidates reach of the reference.
    """
    piece = s.window_us * PIECE
    around = s.radius_us + s.timing.tolerance
    at = lambda span, by: F.floor((F.col(span) + F.col("c.coarse_us") + by) / piece)
    reached = asked.select("unit", "ref", F.explode(F.sequence(at("since_us", -around), at("until_us", around))).alias("piece")).distinct()
    carried = ["usable", F.col("weight").cast("double").alias("weight"), *[F.col(f).cast("array<double>").alias(f) for f in nearest.FEATURES]]
    frames = lambda rows, kind: rows.select("unit", F.lit(kind).alias("kind"), "t_us", "frame_id", *carried)
    known = frames(reference.withColumn("piece", F.floor(F.col("t_us") / piece)).join(reached, ["ref", "piece"]), dense.REFERENCE)
    rows = known.unionByName(frames(live, dense.LIVE)).unionByName(asked.withColumn("kind", F.lit(dense.CANDIDATE)).drop("ref"), allowMissingColumns=True)
    rows = spread(rows, "unit").sortWithinPartitions("unit", "kind", "t_us", "frame_id").drop("frame_id")
    kinds = ", ".join(f"{name}: {kind}" for name, kind in dense.EVALUATION.items())
    shown = ", ".join([f"c {asked.schema['c'].dataType.simpleString()}", *[f"{g} struct<{kinds}>" for g in GATES]])
    run = dense.task({g: getattr(s, g) for g in GATES}, s.radius_us, s.step_us, s.refined, s.refined_margin, prune)
    return rows.mapInArrow(run, shown).select("c.*", *GATES)


def _told(of: str) -> list[Column]:
    """The columns that the gates of ``gates`` read, of one gate's evaluation."""
    e = lambda c: F.col(f"{of}.{c}")
    return [
        "window", "key", (e("offset_us") / 1000.0).alias("offset_ms"), (F.col("coarse_us") / 1000.0).alias("coarse_ms"), e("sufficient").alias("sufficient"),
        F.col("votes"), "landmark", "weighted", "hashes", e("combined").alias("combined"), e("agreement").alias("agreement"), e("coverage").alias("coverage"),
        e("onset").alias("onset"), e("pcen").alias("pcen"), e("chroma").alias("chroma"), e("cens").alias("cens"), "coarse", "ambiguous",
    ]


def _ranked(rows: DataFrame, of: str) -> DataFrame:
    """One gate's candidates in order: rank, and of the window margin (lead over the second, at least 0; a lone one's score) and candidates."""
    rows = G.dense_rank(rows.select(*_told(of)), ["window"])
    whole = Window.partitionBy("window")
    score = lambda k: F.max(F.when(F.col("rank") == k, F.col("combined"))).over(whole)
    return rows.withColumn("margin", F.greatest(F.lit(0.0), score(1) - F.coalesce(score(2), F.lit(0.0)))).withColumn("candidates", F.count("*").over(whole))


def gated_windows(found: DataFrame, readiness: DataFrame, s: Chain) -> DataFrame:
    """Windows as ``landmark_lock.align`` takes them: key, at_ms, ready, long and candidates in order.

    readiness: window, key, end_us, ready, duration_us for every window. The
    tracker is fed the first gate's candidates, or the last gate's where a long
    window passes the first.
    """
    steady = found.withColumn("stability_ms", F.lit(G.STABLE_MS))  # the fold adds the part for steadiness
    of = {g: _ranked(steady, g).withColumn("stability_ms", F.lit(G.STABLE_MS)) for g in GATES}
    timing = of["timing"].withColumns({"reason": G.timing_reason(), "provisional": G.provisional_confidence(), "confidence": G.measurement_confidence()})
    robust = of["robust"].withColumns({"reason": G.final_reason(), "final": G.final_confidence(), "confidence": G.measurement_confidence()})
    lists = lambda rows, name, *more: rows.groupBy("window").agg(
        F.array_sort(F.collect_list(F.struct("rank", "offset_ms", "confidence"))).alias(name), *[F.max_by(c, -F.col("rank")).alias(f"{name}_{c}") for c in more]
    )
    both = (
        readiness.join(lists(timing, "timing", "reason", "provisional", "coarse"), "window", "left")
        .join(lists(robust, "robust", "reason", "final"), "window", "left").withColumn("long", F.col("duration_us") >= s.long_us)
    )
    stage = landmark_lock.gated(F.col("timing_coarse"), F.col("timing_reason"), F.col("robust_reason"), F.col("long"))
    last = F.col("long") & (F.col("timing_coarse") == "none") & (F.col("timing_reason") == "none")
    shown = F.transform(
        F.when(last, F.col("robust")).otherwise(F.col("timing")),
        lambda c: F.struct(
            c["offset_ms"].alias("offset_ms"), F.col("gate.stage").alias("stage"), F.col("gate.reason").alias("reason"), c["confidence"].alias("confidence"),
            F.col("timing_provisional").alias("provisional"), F.col("robust_final").alias("final"),
        ),
    )
    return both.withColumn("gate", stage).select("key", (F.col("end_us") / 1000.0).alias("at_ms"), "ready", "long", shown.alias("candidates"))


def ready_windows(frames: DataFrame, sizes: DataFrame, reference: DataFrame, s: Chain) -> DataFrame:
    """Every window with a frame: window, key, end_us, duration_us and ``ready``, the first thing it lacks or ``none``.

    frames: key, t_us, energy_db; sizes: ``marks_of_windows``.
    """
    own = windowed(spread(frames.select("key", "t_us", "energy_db"), "key"), s).withColumn("t_ms", F.col("t_us") / 1000.0).withColumn("no_marks", F.lit(0))
    facts = window_id(G.readiness(own, ["key", "end_us"], "t_ms", "energy_db", "no_marks"))
    known = reference.groupBy("key").agg((F.count("*") >= s.reference_landmarks).alias("indexed"))
    return (
        facts.drop("landmarks").join(sizes, "window", "left").join(known, "key", "left")
        .withColumn("ready", F.when(F.coalesce("indexed", F.lit(False)), G.readiness_reason(s.ready_us / 1000)).otherwise("no_reference"))
        .select("window", "key", "end_us", (F.col("duration_ms") * 1000).cast("long").alias("duration_us"), "ready")
    )


def chain(frames: DataFrame, landmarks: DataFrame, reference_frames: DataFrame, reference_landmarks: DataFrame, s: Chain = Chain(), prune: bool = True) -> DataFrame:
    """The windows of every recording, gated, for ``landmark_lock.align``.

    frames: key, frame_id, t_us, energy_db, usable, weight and the feature
    arrays of ``nearest``; landmarks: key, hash, t_us; the same for the
    references, one for each key. Rows without key or time have no part. A
    recording without a reference fails at readiness. A frame is shuffled once
    for each block of windows that holds it, one of the reference once for each
    block that reaches its piece; windows and offsets multiply neither.
    """
    timed = lambda rows: rows.where("key IS NOT NULL AND t_us IS NOT NULL")
    frames, marks = timed(frames), timed(landmarks).where("hash IS NOT NULL")
    sizes = cut(marks_of_windows(marks, s), "chain-marks")
    ready = ready_windows(frames, sizes, reference_landmarks, s)
    candidates = cut(recorded_candidates(marks, timed(reference_landmarks).where("hash IS NOT NULL"), sizes, s), "chain-candidates")
    wide = s.hop_us * BLOCK
    unit = lambda block: F.concat_ws("@", F.col("key"), block.cast("string")).alias("unit")
    end = F.substring_index("window", "@", -1).cast("long")
    asked = candidates.select(unit(F.floor(end / wide)), F.col("key").alias("ref"), (end - s.window_us).alias("since_us"), end.alias("until_us"), F.struct(*candidates.columns).alias("c"))
    first, last = F.ceil(F.col("t_us") / s.hop_us) * s.hop_us, F.floor((F.col("t_us") + s.window_us) / s.hop_us) * s.hop_us
    blocks = F.explode(F.sequence(F.floor(first / wide), F.floor(last / wide))).alias("block")
    live = frames.select("*", blocks).withColumn("unit", unit(F.col("block")))
    found = cut(evaluated(asked, live, timed(reference_frames).withColumnRenamed("key", "ref"), s, prune), "chain-evaluated")
    return gated_windows(found, ready, s)
