"""Queries of gates, confidences, dense ranks and projections over candidates made of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import gates as G
from tidemark.operators import landmark_lock
from tidemark.plans.adapters import E, events
from tidemark.plans.registry import query

SESSION_US = 86_400_000_000


def _candidates(spark, sf_dir):
    """Every event as an offset candidate of its user."""
    k, code, cents = F.col("k"), F.col("code"), F.floor(F.col("value") * 100)
    share = lambda c, m: (c % m) / F.lit(float(m))
    return events(spark, sf_dir).select(
        "event_id", "user_id", (k % 9 * 30).alias("offset_ms"), (k % 5 * 40).alias("coarse_ms"), (F.col("value") >= 1).alias("sufficient"),
        (code * 5 + k % 7).alias("votes"), share(k, 50).alias("landmark"), (F.lit(0.4) + share(cents, 60)).alias("combined"), (k % 6).alias("agreement"),
        share(k + code, 11).alias("onset"), share(k * 3, 17).alias("pcen"), share(k * 5, 13).alias("chroma"), share(k * 7, 19).alias("cens"),
        (share(cents, 12) / 10).alias("margin"), (1 + k % 3).alias("candidates"), (k % 4 == 0).alias("ambiguous"), (k % 13).alias("hashes"), (k % 17 + code).alias("weighted"),
        share(k, 23).alias("coverage"), F.when(k % 3 > 0, k % 200).alias("stability_ms"), F.when(k % 8 > 0, k % 9 * 25).alias("track_ms"),
        (code != 2).alias("confirmed"), (k % 5 != 0).alias("stable"), (k % 2 == 0).alias("can_coast"), F.when(k % 7 > 0, share(k, 10) * 6 - 1).alias("log_odds"), share(cents, 40).alias("lead"),
    )


CAND = E + """, x AS (
  SELECT event_id, user_id, k % 9 * 30 AS offset_ms, k % 5 * 40 AS coarse_ms, value >= 1 AS sufficient, code * 5 + k % 7 AS votes, (k % 50) / 50.0e0 AS landmark,
    0.4e0 + (floor(value * 100)::BIGINT % 60) / 60.0e0 AS combined, k % 6 AS agreement, ((k + code) % 11) / 11.0e0 AS onset, (k * 3 % 17) / 17.0e0 AS pcen,
    (k * 5 % 13) / 13.0e0 AS chroma, (k * 7 % 19) / 19.0e0 AS cens, (floor(value * 100)::BIGINT % 12) / 12.0e0 / 10 AS margin, 1 + k % 3 AS candidates, k % 4 = 0 AS ambiguous,
    k % 13 AS hashes, k % 17 + code AS weighted, (k % 23) / 23.0e0 AS coverage, CASE WHEN k % 3 > 0 THEN k % 200 END AS stability_ms, CASE WHEN k % 8 > 0 THEN k % 9 * 25 END AS track_ms,
    code <> 2 AS confirmed, k % 5 <> 0 AS stable, k % 2 = 0 AS can_coast, CASE WHEN k % 7 > 0 THEN (k % 10) / 10.0e0 * 6 - 1 END AS log_odds, (floor(value * 100)::BIGINT % 40) / 40.0e0 AS lead
  FROM e)"""


def _windows(spark, sf_dir):
    e = events(spark, sf_dir).select(
        "user_id", F.floor(F.col("t_us") / SESSION_US).alias("day"), (F.col("t_us") / 1000).alias("time_ms"), (F.lit(-90.0) + F.col("k") % 40).alias("energy_db"), (F.col("code") - 1).alias("marks"),
    )
    return G.readiness(e, ["user_id", "day"], "time_ms", "energy_db", "marks")


READY = E + f""", w AS (
  SELECT user_id, t_us // {SESSION_US} AS day, MAX(t_us / 1000.0e0) - MIN(t_us / 1000.0e0) AS duration_ms, 10 * log10(AVG(pow(10.0e0, (-90.0e0 + k % 40) / 10))) AS energy,
         AVG(CASE WHEN -90 + k % 40 >= -70 THEN 1.0e0 ELSE 0.0e0 END) AS active, SUM(code - 1)::BIGINT AS landmarks
  FROM e GROUP BY user_id, t_us // {SESSION_US})"""


@query("WITH " + READY + """ SELECT user_id, day, landmarks, round(active, 6) AS active, CASE WHEN duration_ms < 2500 THEN 'insufficient_duration' WHEN energy < -62 THEN 'insufficient_energy'
WHEN active < 0.35e0 THEN 'insufficient_active_frames' WHEN landmarks < 8 THEN 'insufficient_landmarks' ELSE 'none' END AS reason FROM w""")
def readiness_gate(spark, sf_dir):
    return _windows(spark, sf_dir).select("user_id", "day", "landmarks", F.round("active", 6).alias("active"), G.readiness_reason().alias("reason"))


_TIMING = """CASE WHEN NOT (sufficient AND votes >= 8 AND landmark >= 0.08e0 AND combined >= 0.55e0 AND agreement >= 2) THEN 'weak_peak'
WHEN candidates > 1 AND margin < CASE WHEN ambiguous THEN 0.04e0 ELSE 0.02e0 END THEN 'ambiguous' WHEN abs(offset_ms - coarse_ms) > 100 THEN 'weak_peak' ELSE 'none' END"""
_FINAL = """CASE WHEN NOT (combined >= 0.55e0 AND agreement >= 2 AND pcen >= 0.65e0 AND cens >= 0.65e0) THEN 'weak_peak'
WHEN candidates > 1 AND margin < CASE WHEN ambiguous THEN 0.04e0 ELSE 0.02e0 END THEN 'ambiguous' ELSE 'none' END"""


@query("WITH " + CAND + f" SELECT event_id, {_TIMING} AS reason FROM x")
def timing_gate(spark, sf_dir):
    return _candidates(spark, sf_dir).select("event_id", G.timing_reason().alias("reason"))


@query("WITH " + CAND + f" SELECT event_id, {_FINAL} AS reason FROM x")
def final_gate(spark, sf_dir):
    return _candidates(spark, sf_dir).select("event_id", G.final_reason().alias("reason"))


@query("WITH " + CAND + " SELECT event_id, CASE WHEN COALESCE(confirmed AND stable AND abs(offset_ms - track_ms) <= 80, FALSE) THEN 'none' ELSE 'unstable' END AS reason FROM x")
def tracker_gate(spark, sf_dir):
    return _candidates(spark, sf_dir).select("event_id", G.tracker_reason().alias("reason"))


_DENSE = "sufficient AND votes >= {0} AND landmark >= 0.08e0 AND combined >= 0.55e0 AND margin >= 0.02e0 AND agreement >= 2 AND abs(offset_ms - coarse_ms) <= {1} AND greatest(onset, pcen, chroma, cens) >= {2} AND greatest(pcen, cens) >= {3}"


@query("WITH " + CAND + f" SELECT event_id, {_DENSE.format(8, 100, '0.50e0', '0.55e0')} AS provisional, {_DENSE.format(10, 180, '0.52e0', '0.50e0')} AS final FROM x")
def dense_gate(spark, sf_dir):
    return _candidates(spark, sf_dir).select("event_id", G.dense_gate().alias("provisional"), G.dense_gate(G.FINAL).alias("final"))


@query("WITH " + CAND + f""", p AS (SELECT event_id, CASE WHEN confirmed AND stable THEN 'final' WHEN stable THEN 'confirmed' WHEN confirmed THEN 'provisional' ELSE 'none' END AS phase,
  {_TIMING} AS timing, {_FINAL} AS final FROM x)
SELECT event_id, phase, CASE WHEN phase = 'final' THEN CASE WHEN timing = 'ambiguous' THEN 'drifting' ELSE 'relocking' END WHEN phase = 'confirmed' THEN 'confirmed' ELSE 'locking' END AS timing_state,
CASE WHEN phase = 'final' THEN CASE WHEN final = 'ambiguous' THEN 'drifting' ELSE 'relocking' END WHEN phase = 'confirmed' THEN 'relocking' ELSE 'locking' END AS final_state,
CASE WHEN phase = 'none' THEN 'listening' WHEN event_id % 3 = 0 THEN 'lost' ELSE 'relocking' END AS ready_state FROM p""")
def lock_states(spark, sf_dir):
    """What a held back candidate shows, by how far its session got."""
    when = lambda c: F.when(c, F.lit(1.0))
    x = _candidates(spark, sf_dir).withColumns({"final_ms": when(F.col("confirmed") & F.col("stable")), "confirmed_ms": when(F.col("stable")), "provisional_ms": when(F.col("confirmed"))})
    x, phase = x.withColumn("phase", G.lock_phase()), F.col("phase")
    ready = F.when(F.col("event_id") % 3 == 0, "insufficient_energy").otherwise("insufficient_landmarks")
    state = lambda stage, reason: G.held_state(F.lit(stage), phase, reason)
    return x.select("event_id", "phase", state("timing", G.timing_reason()).alias("timing_state"), state("final", G.final_reason()).alias("final_state"), state("readiness", ready).alias("ready_state"))


_VOTE = "least(1.0e0, weighted / 16.0e0)"
_BLENDS = {
    "provisional": f"{_VOTE} * 0.25e0 + least(1.0e0, landmark / 0.16e0) * 0.20e0 + combined * 0.40e0 + least(1.0e0, margin / 0.08e0) * 0.15e0",
    "final": f"{_VOTE} * 0.20e0 + combined * 0.35e0 + least(pcen, cens) * 0.20e0 + least(1.0e0, margin / 0.08e0) * 0.15e0 + COALESCE(1 - least(1.0e0, stability_ms / 180.0e0), 0.5e0) * 0.10e0",
    "measurement": f"combined * 0.45e0 + landmark * 0.20e0 + coverage * 0.15e0 + least(1.0e0, agreement / 2.0e0) * 0.10e0 + {_VOTE} * 0.10e0",
    "track": "COALESCE(1 / (1 + exp(-log_odds)) * 0.65e0 + least(1.0e0, lead / 2.0e0) * 0.20e0 + CASE WHEN stable THEN 1.0e0 WHEN can_coast THEN 0.65e0 ELSE 0.25e0 END * 0.15e0, 0.0e0)",
}


@query("WITH " + CAND + " SELECT event_id, " + ", ".join(f"round(least(1.0e0, greatest(0.0e0, {x})), 6) AS {n}" for n, x in _BLENDS.items()) + " FROM x")
def confidences(spark, sf_dir):
    parts = {"provisional": G.provisional_confidence(), "final": G.final_confidence(), "measurement": G.measurement_confidence(), "track": G.track_confidence()}
    return _candidates(spark, sf_dir).select("event_id", *[F.round(c, 6).alias(n) for n, c in parts.items()])


@query("WITH " + CAND + """ SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, ROW_NUMBER() OVER (PARTITION BY user_id
ORDER BY sufficient DESC, combined DESC, agreement DESC, weighted DESC, hashes DESC, landmark DESC, offset_ms)::INTEGER AS rank FROM (SELECT * REPLACE (combined + event_id / 1000000000.0e0 AS combined) FROM x)) WHERE rank <= 3""")
def dense_rank(spark, sf_dir):
    """The three best candidates of every user; scores are told apart by the event."""
    x = _candidates(spark, sf_dir).withColumn("combined", F.col("combined") + F.col("event_id") / F.lit(1e9))
    return G.dense_rank(x, ["user_id"], 3).select("user_id", "event_id", "rank")


@query("""SELECT o_orderkey, o_custkey - (o_orderkey % 700) AS offset_ms, o_orderkey % 5000 + o_custkey - (o_orderkey % 700) AS reference_end_ms,
greatest(0, least(o_orderkey % 9000 + o_custkey - (o_orderkey % 700) - 3000, 4000)) AS reference_now_ms FROM orders""")
def clock_projection(spark, sf_dir):
    """Matches carried to the window's end and to the session's clock, within 4 s of track."""
    from tidemark.session import table

    key = F.col("o_orderkey")
    shown = G.projected(F.col("o_custkey"), key % 700, key % 5000, key % 9000 - 3000, F.lit(4000))
    return table(spark, sf_dir, "orders").select("o_orderkey", *[c.cast("long").alias(n) for n, c in shown.items()])


@query()
def landmark_alignment(spark, sf_dir):
    """The alignment by landmark candidates: a window for every hour of a user, its events as candidates."""
    hour = F.floor(F.col("t_us") / 3_600_000_000)
    when = events(spark, sf_dir).select("event_id", hour.alias("hour"))
    x = _candidates(spark, sf_dir).join(when, "event_id").withColumn("long", F.col("hour") % 3 > 0)
    none = F.lit("none")
    coarse = F.when(F.col("hashes") == 0, "insufficient_landmarks").otherwise(none)
    # scores leave no gate shut for good, so that all states occur
    strong = {"combined": F.lit(0.7) + F.col("coverage") / 4, "landmark": F.lit(0.3), "agreement": F.lit(4), "pcen": F.col("pcen") / 4 + 0.7, "cens": F.col("cens") / 4 + 0.7, "votes": F.lit(12), "sufficient": F.lit(True), "coarse_ms": F.col("offset_ms")}
    x = x.withColumn("offset_ms", (F.col("user_id") % 50 * 100 + F.col("event_id") % 3 * 15).cast("double")).withColumns(strong)
    steady = G.final_confidence().alias("final")
    candidate = F.struct(
        (-F.col("combined")).alias("rank"), F.col("event_id"), F.col("offset_ms"), landmark_lock.gated(coarse, G.timing_reason(), G.final_reason(), F.col("long")).alias("gate"),
        G.measurement_confidence().alias("confidence"), G.provisional_confidence().alias("provisional"), steady,
    )
    windows = x.withColumn("stability_ms", F.lit(180.0)).groupBy(F.col("user_id").cast("string").alias("key"), "hour").agg(F.first("long").alias("long"), F.array_sort(F.collect_list(candidate)).alias("all"))
    flat = F.transform("all", lambda c: F.struct(c["offset_ms"].alias("offset_ms"), c["gate"]["stage"].alias("stage"), c["gate"]["reason"].alias("reason"), c["confidence"].alias("confidence"), c["provisional"].alias("provisional"), c["final"].alias("final")))
    ready = F.when(F.col("hour") % 11 == 0, "insufficient_energy").otherwise(none)
    found = landmark_lock.align(windows.select("key", (F.col("hour") * 500.0).alias("at_ms"), ready.alias("ready"), "long", flat.alias("candidates")))
    return found.withColumns({c: F.round(c, 6) for c in ("offset_ms", "confidence")})
