"""Queries of landmark votes, nearest frames and dense evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.numbers import landmark_hash
from tidemark.operators import nearest as N
from tidemark.operators import landmark_chain, landmark_lock, lock, spectra, tracker, voting
from tidemark.plans.adapters import E, L, events, landmarks
from tidemark.plans.registry import query
from tidemark.session import spread, table

BIN, REACH = 1_200_000_000, 21_600_000_000  # 20 minutes, 6 hours

HISTOGRAM = L + f""",
df AS (SELECT hash, COUNT(*) AS postings, ln(1 + (SELECT COUNT(*) FROM r) / (COUNT(*) + 1)::DOUBLE) AS idf FROM r GROUP BY hash),
tf AS (SELECT query_id, hash, COUNT(*) AS tf FROM q GROUP BY ALL),
w AS (SELECT query_id, hash, postings, round(greatest(0.05e0, least(3.0e0, idf / sqrt(tf::DOUBLE))) * 1000)::BIGINT AS weight FROM tf JOIN df USING (hash)),
m AS (
  SELECT query_id, hash, postings, weight, q.t_us AS q_us, r.t_us - q.t_us AS d, round((r.t_us - q.t_us) / {BIN}.0e0)::BIGINT AS bin
  FROM q JOIN w USING (query_id, hash) JOIN r USING (hash) WHERE TRUE /*RANGE*/),
h AS (
  SELECT query_id, bin, COUNT(*) AS votes, SUM(weight)::BIGINT / 1000.0e0 AS score,
         bin * {BIN}.0e0 + SUM(weight * (d - bin * {BIN}))::BIGINT::DOUBLE / SUM(weight)::BIGINT::DOUBLE AS offset_us,
         COUNT(DISTINCT hash) AS unique_hashes, COUNT(*) FILTER (postings > 1) AS common_votes,
         SUM(postings)::BIGINT / COUNT(*)::DOUBLE AS mean_postings, MAX(q_us) - MIN(q_us) AS spread_us,
         COUNT(*) / MAX(n.landmarks)::DOUBLE AS density
  FROM m JOIN (SELECT query_id, COUNT(*) AS landmarks FROM q GROUP BY query_id) n USING (query_id) GROUP BY query_id, bin)"""
RANGED = HISTOGRAM.replace("TRUE /*RANGE*/", f"r.t_us - q.t_us BETWEEN -{REACH} AND {REACH}")


@query("WITH " + L + """ SELECT hash, COUNT(*) AS postings, MIN(t_us) AS first_us, MAX(t_us) AS last_us,
round(ln(1 + (SELECT COUNT(*) FROM r) / (COUNT(*) + 1)::DOUBLE), 9) AS idf FROM r GROUP BY hash""")
def posting_stats(spark, sf_dir):
    return voting.posting_stats(landmarks(spark, sf_dir)[1]).withColumn("idf", F.round("idf", 9))


@query("WITH " + L + """ SELECT hash, t_us // 86400000000 AS block, list_sort(list(t_us))::VARCHAR AS anchors FROM r GROUP BY ALL""")
def posting_lists(spark, sf_dir):
    rows = voting.postings(landmarks(spark, sf_dir)[1], 86_400_000_000)
    return rows.withColumn("anchors", F.concat(F.lit("["), F.concat_ws(", ", F.col("anchors").cast("array<string>")), F.lit("]")))


@query("WITH " + L + " SELECT query_id, hash, COUNT(*) AS tf FROM q GROUP BY ALL")
def query_tf(spark, sf_dir):
    return voting.term_frequency(landmarks(spark, sf_dir)[0])


@query("WITH " + HISTOGRAM + " SELECT * FROM h")
def offset_vote_histogram(spark, sf_dir):
    return voting.vote_histogram(*landmarks(spark, sf_dir), BIN)


@query("WITH " + RANGED + " SELECT * FROM h")
def offset_vote_range(spark, sf_dir):
    return voting.vote_histogram(*landmarks(spark, sf_dir), BIN, REACH)


MOST, APART = 3, 3
_BEST = "ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, unique_hashes DESC, spread_us DESC, votes DESC, bin)"


def _thinned(h: str) -> str:
    parts = [h, f"k0 AS (SELECT *, 0::BIGINT AS place FROM h QUALIFY {_BEST} = 1)"]
    for k in range(1, MOST):
        far = " ".join(f"AND NOT EXISTS (SELECT 1 FROM k{j} x WHERE x.query_id = h.query_id AND abs(x.bin - h.bin) < {APART})" for j in range(k))
        parts.append(f"k{k} AS (SELECT *, {k}::BIGINT AS place FROM h WHERE TRUE {far} QUALIFY {_BEST} = 1)")
    return ", ".join(parts) + ", c AS (" + " UNION ALL ".join(f"SELECT * FROM k{k}" for k in range(MOST)) + ")"


@query("WITH " + _thinned(RANGED) + " SELECT query_id, place, bin, votes, score, offset_us, unique_hashes FROM c")
def offset_candidates(spark, sf_dir):
    bins = voting.vote_histogram(*landmarks(spark, sf_dir), BIN, REACH)
    return voting.independent(bins, MOST, APART).select("query_id", "place", "bin", "votes", "score", "offset_us", "unique_hashes")


_LEAD = _thinned(RANGED) + """, lead AS (
  SELECT query_id, MAX(score) FILTER (place = 0) AS score, MAX(score) FILTER (place = 1) AS second, MAX(bin) FILTER (place = 0) AS bin,
         MAX(votes) FILTER (place = 0) AS votes, MAX(density) FILTER (place = 0) AS density, MAX(spread_us) FILTER (place = 0) AS spread_us
  FROM c GROUP BY query_id), led AS (
  SELECT *, CASE WHEN second IS NULL OR second = 0 THEN score ELSE score / second END AS ratio, greatest(0.0e0, score - COALESCE(second, 0.0e0)) AS margin FROM lead)"""


def _lead(spark, sf_dir):
    bins = voting.vote_histogram(*landmarks(spark, sf_dir), BIN, REACH)
    return voting.lead_over_second(voting.independent(bins, MOST, APART))


@query("WITH " + _LEAD + " SELECT * FROM led")
def offset_top2_margin(spark, sf_dir):
    return _lead(spark, sf_dir)


@query("WITH " + _LEAD + """ SELECT query_id, votes, CASE WHEN votes < 3 THEN 'too_few_votes' WHEN density < 0.08e0 THEN 'low_density'
WHEN spread_us < 900000 THEN 'narrow_spread' WHEN second IS NOT NULL AND (ratio < 1.35e0 OR margin < 4) THEN 'ambiguous' ELSE 'none' END AS reason FROM led""")
def coarse_gate(spark, sf_dir):
    return voting.coarse_gate(_lead(spark, sf_dir), votes=3).select("query_id", "votes", "reason")


TOLERANCE = 600_000_000


@query("WITH " + E + f""", x AS (
  SELECT q.event_id, q.event_type, q.t_us, r.event_id AS r_event_id, r.t_us AS r_t_us, abs(r.t_us - q.t_us) AS distance
  FROM e q JOIN e r ON q.event_type = r.event_type AND r.t_us BETWEEN q.t_us - {TOLERANCE} AND q.t_us + {TOLERANCE}
  WHERE q.event_id % 2 = 1 AND r.event_id % 2 = 0)
SELECT event_id, r_event_id, distance FROM x QUALIFY ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY distance, r_t_us DESC, r_event_id DESC) = 1""")
def nearest_frame_join(spark, sf_dir):
    e = events(spark, sf_dir).select("event_type", "event_id", "t_us")
    found = N.nearest(e.where("event_id % 2 = 1"), e.where("event_id % 2 = 0"), ["event_type"], ["event_id"], "t_us", TOLERANCE)
    return found.select("event_id", "r_event_id", "distance")


def _frames(spark, sf_dir, odd: int):
    e = events(spark, sf_dir).where(f"event_id % 2 = {odd}")
    part = lambda *m: F.array(*[(F.col("k") % x).cast("double") for x in m])
    return e.select(
        F.concat_ws("/", "event_type", F.floor(F.col("t_us") / 86_400_000_000).cast("string")).alias("key"), F.col("event_id").alias("frame_id"), "t_us",
        (F.col("value") >= 5).alias("usable"), F.when(F.col("value") >= 5, 1.0).otherwise(0.25).alias("weight"),
        F.array(F.floor("value").cast("double")).alias("onset"), part(2, 3, 5).alias("subband"), part(7, 11, 13).alias("pcen"),
        part(4, 6, 9, 12).alias("chroma"), part(8, 10).alias("cens"),
    )


DENSE = N.Dense(min_frames=4, min_duration=3_600_000_000, min_coverage=0.3, tolerance=TOLERANCE, agree=0.7)
OFFSETS = (-600_000_000, 0, -1_200_000_000, 600_000_000)


def _grid(query_frames):
    """Offsets a step of 600 s around one of -600 s and one of 0."""
    coarse = query_frames.select("key").distinct().withColumn("offset_us", F.explode(F.array(*[F.lit(x).cast("long") for x in OFFSETS[:2]])))
    return N.refinement_grid(coarse, TOLERANCE, TOLERANCE)


def _evaluated(spark, sf_dir):
    query_frames = _frames(spark, sf_dir, 1)
    offsets = _grid(query_frames).select("key", "offset_us").distinct()
    return N.evaluate_offsets(query_frames, _frames(spark, sf_dir, 0), offsets, DENSE)


def _cos(a: list[str], b: list[str], w: str = "w") -> str:
    term = lambda x, y: "SUM(" + w + " * (" + " + ".join(f"{p} * {q}" for p, q in zip(x, y)) + "))"
    norm = f"sqrt({term(a, a)} * {term(b, b)})"
    return f"COALESCE(CASE WHEN {norm} > 0 THEN least(1.0e0, greatest(0.0e0, {term(a, b)} / {norm})) ELSE 0.0e0 END, 0.0e0)"


def _mods(side: str, *m: int) -> list[str]:
    return [f"({side}k % {x})::DOUBLE" for x in m]


_RISE = lambda s: [f"greatest(COALESCE({s}k % {m} - lag({s}k % {m}) OVER o, 0), 0)::DOUBLE AS {s}rise{m}" for m in (4, 6, 9, 12)]
DENSE_SQL = "WITH " + E + f""", f AS (
  SELECT event_type || '/' || (t_us // 86400000000) AS key, event_id, t_us, value >= 5 AS usable, CASE WHEN value >= 5 THEN 1.0e0 ELSE 0.25e0 END AS weight,
         floor(value) AS onset, k FROM e),
q AS (SELECT * FROM f WHERE event_id % 2 = 1), r AS (SELECT * FROM f WHERE event_id % 2 = 0),
ev AS (SELECT key, COUNT(*) AS frames, COUNT(*) FILTER (usable) AS usable_frames, MAX(t_us) FILTER (usable) - MIN(t_us) FILTER (usable) AS usable_us FROM q GROUP BY key),
offs AS (SELECT DISTINCT key, u.offset_us FROM q, (SELECT unnest([{", ".join(f"{x}::BIGINT" for x in OFFSETS)}]) AS offset_us) u),
p AS (
  SELECT q.key, o.offset_us, q.event_id, q.t_us + o.offset_us AS t_us, q.usable, r.usable AS r_usable, least(q.weight, r.weight) AS w,
         q.onset, r.onset AS r_onset, q.k, r.k AS r_k, abs(r.t_us - q.t_us - o.offset_us) AS distance
  FROM q JOIN offs o USING (key) JOIN r ON q.key = r.key AND abs(r.t_us - q.t_us - o.offset_us) <= {TOLERANCE}
  QUALIFY ROW_NUMBER() OVER (PARTITION BY q.key, o.offset_us, q.event_id ORDER BY abs(r.t_us - q.t_us - o.offset_us), r.t_us DESC, r.event_id DESC) = 1),
l AS (
  SELECT *, COALESCE(least(w, lag(w) OVER o), 0.0e0) AS w_rise, {", ".join(_RISE(""))}, {", ".join(_RISE("r_"))}
  FROM p WINDOW o AS (PARTITION BY key, offset_us ORDER BY t_us, event_id)),
g AS (
  SELECT key, offset_us, COUNT(*) AS matched, COUNT(*) FILTER (usable AND r_usable) AS comparable, SUM(distance)::BIGINT AS error_sum,
         {_cos(["onset"], ["r_onset"])} AS onset, {_cos(_mods("", 2, 3, 5), _mods("r_", 2, 3, 5))} AS subband,
         {_cos(_mods("", 7, 11, 13), _mods("r_", 7, 11, 13))} AS pcen, {_cos(_mods("", 8, 10), _mods("r_", 8, 10))} AS cens,
         {_cos([f"rise{m}" for m in (4, 6, 9, 12)], [f"r_rise{m}" for m in (4, 6, 9, 12)], "w_rise")} AS chroma
  FROM l GROUP BY key, offset_us),
s AS (
  SELECT o.key, o.offset_us, COALESCE(matched, 0) AS matched, COALESCE(comparable, 0) AS comparable, COALESCE(matched, 0) / frames::DOUBLE AS coverage,
         error_sum / matched::DOUBLE AS mean_error_us,
         usable_frames >= 4 AND COALESCE(usable_us, 0) >= 3600000000 AND COALESCE(comparable, 0) >= 4 AND COALESCE(matched, 0) / frames::DOUBLE >= 0.3e0 AS sufficient,
         onset, subband, pcen, chroma, cens
  FROM offs o JOIN ev USING (key) LEFT JOIN g USING (key, offset_us)),
z AS (
  SELECT key, offset_us, matched, comparable, coverage, mean_error_us, sufficient, {", ".join(f"CASE WHEN sufficient THEN {f} ELSE 0.0e0 END AS {f}" for f in N.FEATURES)} FROM s),
d AS (
  SELECT key, offset_us, matched, comparable, coverage, mean_error_us, sufficient, {", ".join(f"round({f}, 6) AS {f}" for f in N.FEATURES)},
         round(onset * 0.45e0 + pcen * 0.30e0 + chroma * 0.05e0 + cens * 0.20e0, 6) AS combined,
         CASE WHEN sufficient THEN {" + ".join(f"(CASE WHEN {f} >= 0.7e0 THEN 1 ELSE 0 END)" for f in N.FEATURES)} ELSE 0 END AS agreement
  FROM z)"""


def _rounded(evaluated):
    return evaluated.withColumns({c: F.round(c, 6) for c in (*N.FEATURES, "combined")})


@query(DENSE_SQL + " SELECT * FROM d")
def dense_offsets(spark, sf_dir):
    return _rounded(_evaluated(spark, sf_dir))


@query(DENSE_SQL + """, c AS (SELECT d.*, u.coarse_us FROM d JOIN (SELECT unnest([-600000000::BIGINT, 0::BIGINT]) AS coarse_us) u ON abs(offset_us - coarse_us) <= 600000000)
SELECT key, coarse_us, offset_us, matched, sufficient, combined FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY key, coarse_us
ORDER BY sufficient DESC, combined DESC, comparable DESC, COALESCE(mean_error_us, 'inf'::DOUBLE), abs(offset_us - coarse_us), offset_us) = 1""")
def dense_best(spark, sf_dir):
    """The best refined offset around each coarse one."""
    best = N.best_offset(_rounded(_evaluated(spark, sf_dir)), _grid(_frames(spark, sf_dir, 1)))
    return best.select("key", "coarse_us", "offset_us", "matched", "sufficient", "combined")


@query("""WITH x AS (SELECT p_partkey, p_brand, p_retailprice, RANK() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS rank,
MAX(p_retailprice) OVER (PARTITION BY p_brand) - p_retailprice AS behind FROM part)
SELECT p_partkey, p_brand, rank::INTEGER AS rank FROM x WHERE rank <= 3 OR behind <= 2.5e0""")
def topk_with_margin(spark, sf_dir):
    return N.top_with_ties(table(spark, sf_dir, "part"), "p_brand", "p_retailprice", 3, 2.5).select("p_partkey", "p_brand", "rank")


@query()
def spectral_alignment(spark, sf_dir):
    """Every supplier's synthetic recording (97 kinds of signal) against its reference, entered 4 s in, and how far each got."""
    seeds = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("key"), (F.col("s_suppkey") % 97).alias("seed"))

    def signal(frames: int, shift: int):
        rows = spread(seeds, "key").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))))
        return rows.select("key", (F.col("i") * 20.0).alias("t_ms"), "seed", (F.col("i") + shift).alias("t")).mapInArrow(spectra.synthetic_bands, "key string, t_ms double, bands array<double>")

    found = lock.align(signal(400, 200), signal(1000, 0), 20.0)
    return found.withColumns({c: F.round(c, 3) for c in ("offset_ms", "confidence")})


@query()
def offset_tracker(spark, sf_dir):
    """The tracker over events as offset measurements, a key for each user."""
    e = events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("key"), (F.floor(F.col("t_us") / 3_600_000_000) * 1000.0).alias("at_ms"),
        (F.col("k") % 7 * 20.0).alias("offset_ms"), (F.col("code") / 5.0).alias("confidence"),
    )
    return tracker.track(e).withColumns({c: F.round(c, 6) for c in ("offset_ms", "log_odds")})


@query("""WITH p AS (SELECT vec_id AS frame, embedding, generate_subscripts(embedding, 1) - 1 AS bin, unnest(embedding) AS m FROM embeddings),
n AS (SELECT *, COALESCE(lag(m) OVER w, 0) AS l, COALESCE(lead(m) OVER w, 0) AS r, MAX(m) OVER (PARTITION BY frame) AS top FROM p WINDOW w AS (PARTITION BY frame ORDER BY bin)),
k AS (SELECT frame, bin, m FROM n WHERE m >= l AND m >= r AND m >= 0.1e0 * top::DOUBLE AND m > 0 QUALIFY ROW_NUMBER() OVER (PARTITION BY frame ORDER BY m DESC, bin) <= 4)
SELECT a.frame AS anchor_frame, b.frame AS emitted_frame, a.bin::INTEGER AS anchor_bin, b.bin::INTEGER AS target_bin, (b.frame - a.frame)::INTEGER AS delta
FROM k a JOIN k b ON b.frame - a.frame BETWEEN 1 AND 5
QUALIFY ROW_NUMBER() OVER (PARTITION BY a.frame, a.bin ORDER BY b.frame, b.m DESC, b.bin) <= 2""")
def landmark_pairs(spark, sf_dir):
    """Peaks of every vector as a spectrum, and their landmark pairs over time."""
    from tidemark.operators.series import local_peaks

    long = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("bin", "m"))
    long = long.withColumn("m", F.col("m").cast("double"))
    peaks = local_peaks(long, "frame", ["bin"], "m", 0.1, 4)
    frames = peaks.groupBy("frame").agg(F.collect_list(F.struct("bin", F.col("m").alias("magnitude"))).alias("peaks")).withColumn("source", F.lit("all"))
    return spectra.landmarks(frames, "source", "frame").drop("source")


# A user's events on a clock 250,000 times as fast are the reference of about ten seconds; four fifths of them, some 0 to 4.9 s earlier, are the live recording.
CHAIN = landmark_chain.Chain(
    hop_us=1_000_000, long_us=4_000_000, most=4, radius_us=60_000, step_us=20_000, timing=N.Dense(min_frames=8, min_duration=1_000_000, min_coverage=0.5),
    robust=N.Dense(weights=(0.30, 0.0, 0.35, 0.05, 0.30), min_frames=16, min_duration=2_500_000, min_coverage=0.6, agree=0.50),
)


def _recordings(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("hash", landmark_hash(F.col("k"), F.col("code"), F.floor("value") % 5 + 1))
    part = lambda *m: F.array(*[(F.col("k") % x).cast("double") + F.col("off") for x in m])
    frames = lambda rows: rows.select(
        "key", F.col("event_id").alias("frame_id"), "t_us", "hash", (F.lit(-40.0) - F.col("code") * 8).alias("energy_db"), (F.col("value") >= 5).alias("usable"),
        F.when(F.col("value") >= 5, 1.0).otherwise(0.25).alias("weight"), F.array(F.floor("value") + F.col("off")).alias("onset"), part(2, 3, 5).alias("subband"),
        part(7, 11, 13).alias("pcen"), part(4, 6, 9, 12).alias("chroma"), part(8, 10).alias("cens"),
    )
    known = e.select("*", F.col("user_id").cast("string").alias("key"), F.lit(0.0).alias("off")).withColumn("t_us", F.floor(F.col("t_us") / 250_000))
    live = known.where("event_id % 5 <> 0").withColumn("t_us", F.col("t_us") - F.col("user_id") % 50 * 100_000).withColumn("off", (F.col("event_id") % 3).cast("double"))
    return frames(live), frames(known)


_APART = -(-CHAIN.apart_us // CHAIN.bin_us)


def _chain_candidates() -> str:
    votes = L.split("q AS (")[0].rstrip().rstrip(",") + f""",
known AS (SELECT user_id, event_id, user_id::VARCHAR AS key, hash, t_us // 250000 AS t_us FROM l),
r AS (SELECT key, hash, t_us FROM known),
w AS (SELECT key, hash, t_us - user_id % 50 * 100000 AS t_us FROM known WHERE event_id % 5 <> 0),
q AS (
  SELECT key || '@' || (n * {CHAIN.hop_us})::VARCHAR AS query_id, key, hash, t_us
  FROM (SELECT *, unnest(generate_series(ceil(t_us / {CHAIN.hop_us}.0e0)::BIGINT, floor((t_us + {CHAIN.window_us}) / {CHAIN.hop_us}.0e0)::BIGINT)) AS n FROM w)),
df AS (SELECT key, hash, COUNT(*) AS postings, ln(1 + MAX(n.total) / (COUNT(*) + 1)::DOUBLE) AS idf FROM r JOIN (SELECT key, COUNT(*) AS total FROM r GROUP BY key) n USING (key) GROUP BY key, hash),
tf AS (SELECT query_id, key, hash, COUNT(*) AS tf FROM q GROUP BY ALL),
v AS (SELECT query_id, key, hash, postings, round(greatest(0.05e0, least(3.0e0, idf / sqrt(tf::DOUBLE))) * 1000)::BIGINT AS weight FROM tf JOIN df USING (key, hash)),
m AS (
  SELECT query_id, hash, postings, weight, q.t_us AS q_us, r.t_us - q.t_us AS d, round((r.t_us - q.t_us) / {CHAIN.bin_us}.0e0)::BIGINT AS bin
  FROM q JOIN v USING (query_id, key, hash) JOIN r USING (key, hash)),
h AS (
  SELECT query_id, bin, COUNT(*) AS votes, SUM(weight)::BIGINT / 1000.0e0 AS score,
         bin * {CHAIN.bin_us}.0e0 + SUM(weight * (d - bin * {CHAIN.bin_us}))::BIGINT::DOUBLE / SUM(weight)::BIGINT::DOUBLE AS offset_us,
         COUNT(DISTINCT hash) AS unique_hashes, MAX(q_us) - MIN(q_us) AS spread_us, COUNT(*) / MAX(n.landmarks)::DOUBLE AS density
  FROM m JOIN (SELECT query_id, COUNT(*) AS landmarks FROM q GROUP BY query_id) n USING (query_id) GROUP BY query_id, bin)"""
    parts = [votes, f"k0 AS (SELECT *, 0::BIGINT AS place FROM h QUALIFY {_BEST} = 1)"]
    for k in range(1, CHAIN.most):
        far = " ".join(f"AND NOT EXISTS (SELECT 1 FROM k{j} x WHERE x.query_id = h.query_id AND abs(x.bin - h.bin) < {_APART})" for j in range(k))
        parts.append(f"k{k} AS (SELECT *, {k}::BIGINT AS place FROM h WHERE TRUE {far} QUALIFY {_BEST} = 1)")
    every = " UNION ALL ".join(f"SELECT * FROM k{k}" for k in range(CHAIN.most))
    return ", ".join(parts) + f""", c AS ({every}), led AS (
  SELECT query_id, MAX(score) FILTER (place = 0) AS first, MAX(score) FILTER (place = 1) AS second, MAX(votes) FILTER (place = 0) AS votes,
         MAX(density) FILTER (place = 0) AS density, MAX(spread_us) FILTER (place = 0) AS spread_us FROM c GROUP BY query_id)"""


@query("WITH " + _chain_candidates() + f""" SELECT c.query_id AS "window", place, round(offset_us)::BIGINT AS coarse_us, c.votes, score AS weighted, unique_hashes AS hashes, least(1.0e0, c.density) AS landmark,
CASE WHEN led.votes >= {CHAIN.coarse_votes} AND led.density >= {CHAIN.coarse_density}e0 AND led.spread_us >= {CHAIN.coarse_spread_us} THEN 'none' ELSE 'insufficient_landmarks' END AS coarse,
led.votes >= {CHAIN.coarse_votes} AND led.density >= {CHAIN.coarse_density}e0 AND led.spread_us >= {CHAIN.coarse_spread_us} AND COALESCE(second > 0 AND (first / second < {CHAIN.coarse_ratio}e0 OR greatest(0, first - second) < {CHAIN.coarse_margin}e0), FALSE) AS ambiguous
FROM c JOIN led USING (query_id)""")
def landmark_chain_candidates(spark, sf_dir):
    """Thinned votes of every window of every user's recording, with the coarse gate."""
    live, known = _recordings(spark, sf_dir)
    marks = lambda rows: rows.where("key IS NOT NULL AND hash IS NOT NULL AND t_us IS NOT NULL").select("key", "hash", "t_us")
    sizes = landmark_chain.marks_of_windows(marks(live), CHAIN)
    return landmark_chain.recorded_candidates(marks(live), marks(known), sizes, CHAIN).drop("key")


@query()
def landmark_lock_chain(spark, sf_dir):
    """Every user's recording from postings and frames to states."""
    live, known = _recordings(spark, sf_dir)
    marks = lambda rows: rows.select("key", "hash", "t_us")
    windows = landmark_chain.chain(live.drop("hash"), marks(live), known.drop("hash", "energy_db"), marks(known), CHAIN)
    return landmark_lock.align(windows).withColumns({c: F.round(c, 6) for c in ("offset_ms", "confidence")})
