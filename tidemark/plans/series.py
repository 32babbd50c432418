"""Queries of series operators over each user's events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.numbers import cosine, l2_normalize, landmark_hash, mean_power_db, parabola_peak
from tidemark.operators import calibration
from tidemark.operators import series as S
from tidemark.plans.adapters import E, events
from tidemark.plans.registry import query
from tidemark.session import table
from tidemark.streaming import extractor

ORDER = ["t_us", "event_id"]
W = "WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id)"


@query("WITH " + E + f""", n AS (SELECT *, ROW_NUMBER() OVER w AS p, COUNT(*) OVER (PARTITION BY user_id) AS c, first_value(k) OVER (PARTITION BY user_id ORDER BY t_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f,
last_value(k) OVER (PARTITION BY user_id ORDER BY t_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l,
SUM(k) OVER (PARTITION BY user_id ORDER BY t_us, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS s FROM e {W})
SELECT event_id, (s + greatest(0, 4 - p) * f + greatest(0, 3 - (c - p)) * l)::BIGINT / 7.0e0 AS mean FROM n""")
def centered_mean(spark, sf_dir):
    return S.centered_mean(events(spark, sf_dir), "user_id", ORDER, "k", 3).select("event_id", "mean")


@query("WITH " + E + f" SELECT event_id, greatest(0, COALESCE(k - lag(k) OVER w, 0)) AS rise FROM e {W}")
def positive_diff(spark, sf_dir):
    return S.positive_difference(events(spark, sf_dir), "user_id", ORDER, "k").select("event_id", "rise")


GAP = 21_600_000_000


@query("WITH " + E + f""", g AS (SELECT *, (COALESCE(t_us - lag(t_us) OVER w > {GAP}, FALSE))::INTEGER AS gap FROM e {W}),
s AS (SELECT *, SUM(gap) OVER (PARTITION BY user_id ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM g)
SELECT user_id, segment::BIGINT AS segment, COUNT(*) AS n, MIN(t_us) AS first_us, MAX(t_us) AS last_us FROM s GROUP BY user_id, segment""")
def gap_segments(spark, sf_dir):
    rows = S.gap_segments(events(spark, sf_dir), "user_id", ORDER, GAP)
    return rows.groupBy("user_id", "segment").agg(F.count("*").alias("n"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"))


@query("WITH " + E + """ SELECT event_id, COUNT(*) OVER w AS n, MAX(k) OVER w AS top, (SUM(k) OVER w)::BIGINT AS total FROM e
WINDOW w AS (PARTITION BY user_id ORDER BY t_us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)""")
def trailing_window(spark, sf_dir):
    found = S.trailing(events(spark, sf_dir), "user_id", "t_us", 86_400_000_000, n=F.count("*"), top=F.max("k"), total=F.sum("k"))
    return found.select("event_id", "n", "top", "total")


@query("WITH " + E + " SELECT event_id, (SUM(k * k) OVER (PARTITION BY user_id ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS energy FROM e")
def prefix_energy(spark, sf_dir):
    return S.prefix_energy(events(spark, sf_dir), "user_id", ORDER, "k").select("event_id", "energy")


@query("WITH " + E + f""", p AS (SELECT user_id, k, (ROW_NUMBER() OVER w - 1) // 4 AS slot FROM e {W})
SELECT user_id, slot, SUM(k)::BIGINT / 4.0e0 AS mean FROM p GROUP BY user_id, slot HAVING COUNT(*) = 4""")
def decimate(spark, sf_dir):
    return S.decimate(events(spark, sf_dir), "user_id", ORDER, "k", 4)


@query("WITH " + E + f""", n AS (SELECT *, COALESCE(lag(k) OVER w, 0) AS l, COALESCE(lead(k) OVER w, 0) AS r, MAX(k) OVER (PARTITION BY user_id) AS top FROM e {W})
SELECT user_id, event_id, k FROM n WHERE k >= l AND k >= r AND k >= 0.1e0 * top AND k > 0 QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY k DESC, t_us, event_id) <= 4""")
def local_peaks(spark, sf_dir):
    return S.local_peaks(events(spark, sf_dir), "user_id", ORDER, "k", 0.1, 4).select("user_id", "event_id", "k")


@query("WITH " + E + f""", n AS (SELECT *, lag(k) OVER w AS l, lead(k) OVER w AS r FROM e {W})
SELECT event_id, round(CASE WHEN l - 2 * k + r < -0.000001e0 THEN greatest(-0.5e0, least(0.5e0, 0.5e0 * (l - r) / (l - 2 * k + r))) ELSE 0.0e0 END, 9) AS shift
FROM n WHERE l IS NOT NULL AND r IS NOT NULL AND k >= l AND k >= r""")
def parabolic_peak(spark, sf_dir):
    w = S.along("user_id", *ORDER)
    rows = events(spark, sf_dir).withColumn("l", F.lag("k").over(w)).withColumn("r", F.lead("k").over(w)).where("l is not null and r is not null and k >= l and k >= r")
    return rows.select("event_id", F.round(parabola_peak(F.col("l"), F.col("k"), F.col("r")), 9).alias("shift"))


@query("WITH " + E + f""", p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY t_us) AS place FROM e)
SELECT user_id, event_type, MIN(t_us) AS first, MIN(place) AS place, COUNT(*) AS rows FROM p GROUP BY user_id, event_type""")
def milestones(spark, sf_dir):
    return S.milestones(events(spark, sf_dir), "user_id", "t_us", "event_type")


@query("WITH " + E + " SELECT user_id, round(10 * log10(AVG(pow(10.0e0, (k - 100) / 10.0e0))), 6) AS level FROM e GROUP BY user_id")
def mean_power(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id").agg(F.round(mean_power_db(F.col("k") - 100), 6).alias("level"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)
SELECT vec_id, round(sqrt(list_sum(list_transform(x, lambda a: a * a))), 6) AS norm, round(x[1] / sqrt(list_sum(list_transform(x, lambda a: a * a))), 6) AS first FROM v""")
def l2_normalized(spark, sf_dir):
    from tidemark.functions.numbers import norm

    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(norm("embedding"), 6).alias("norm"), F.round(F.get(l2_normalize(F.col("embedding")), F.lit(0)), 6).alias("first"))


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings), c AS (SELECT label, x AS c FROM v QUALIFY ROW_NUMBER() OVER (PARTITION BY label ORDER BY vec_id) = 1)
SELECT vec_id, round(greatest(0.0e0, least(1.0e0, list_dot_product(x, c) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(c, c))))), 6) AS cosine FROM v JOIN c USING (label)""")
def vector_cosine(spark, sf_dir):
    """Cosine of every vector with the first one of its label."""
    v = table(spark, sf_dir, "embeddings")
    first = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("c"))  # one row for each label
    return v.join(first, "label").select("vec_id", F.round(cosine(F.col("embedding"), F.col("c")), 6).alias("cosine"))


@query("WITH " + E + """ SELECT event_id, COUNT(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY t_us, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS "left" FROM e""")
def reverse_count(spark, sf_dir):
    return S.reverse_count(events(spark, sf_dir), "user_id", ORDER, F.col("event_type") == "error").select("event_id", "left")


@query("WITH " + E + f""", h AS (SELECT user_id, t_us // 1000000 AS s FROM e), c AS (SELECT user_id, s, s - lag(s) OVER w AS d, s - first_value(s) OVER w - (ROW_NUMBER() OVER w - 1) * 3600 AS p FROM h WINDOW w AS (PARTITION BY user_id ORDER BY s))
SELECT user_id, bool_and(COALESCE(abs(d - 3600), 0) <= 180 AND abs(p) <= 180) AS regular, COUNT(*) AS rows FROM c GROUP BY user_id""")
def regular_grid(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", F.floor(F.col("t_us") / 1_000_000).alias("s"))
    return S.is_regular(rows, "user_id", "s", 3600.0)


@query("""WITH RECURSIVE """ + E + """, n AS (SELECT user_id, event_id, k, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS p FROM e),
z AS (SELECT user_id, event_id, p, k::DOUBLE AS s FROM n WHERE p = 1
UNION ALL SELECT n.user_id, n.event_id, n.p, z.s * 0.75e0 + n.k * 0.25e0 FROM z JOIN n ON n.user_id = z.user_id AND n.p = z.p + 1)
SELECT event_id, round(s, 6) AS smooth FROM z""")
def ewma_series(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_id", "t_us", "k")
    return S.ewma(rows, "user_id", ORDER, "k", 0.25).select("event_id", F.round("smooth", 6).alias("smooth"))


@query()
def pcen_series(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_id", "t_us", "value")
    return S.pcen(rows, "user_id", ORDER, "value").select("event_id", F.round("pcen", 6).alias("pcen"))


@query()
def noise_floor_series(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_id", "t_us", "k")
    return S.noise_floor(rows, "user_id", ORDER, "k").select("event_id", F.round("floor", 6).alias("floor"), F.round("snr", 6).alias("snr"))


@query()
def cadence_samples(spark, sf_dir):
    """Each user's events, at least a day apart, and the last."""
    return S.cadence(events(spark, sf_dir).select("user_id", "event_id", "t_us"), "user_id", "t_us", 86_400_000_000)


@query("WITH " + E + """, n AS (SELECT user_id, event_id, k, COALESCE(SUM(k) OVER (PARTITION BY user_id ORDER BY t_us DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later FROM e)
SELECT user_id, event_id, least(k, 300 - later)::BIGINT AS k FROM n WHERE later < 300""")
def trimmed_cache(spark, sf_dir):
    """The newest events of every user that hold 300 of k."""
    return S.trim_oldest(events(spark, sf_dir), "user_id", ORDER, "k", 300).select("user_id", "event_id", F.col("k").cast("long").alias("k"))


@query("WITH " + E + " SELECT event_id FROM (SELECT event_id, t_us, MAX(t_us) OVER (PARTITION BY user_id) AS newest FROM e) WHERE t_us >= newest - 86400000000")
def retained_frames(spark, sf_dir):
    """Events of every user's last day."""
    return S.expire(events(spark, sf_dir), "user_id", "t_us", 86_400_000_000).select("event_id")


_CALIBRATED = E + """, t AS (SELECT user_id::VARCHAR AS key, event_id, (t_us // 100000000 - 17000000)::DOUBLE AS ms, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY t_us // 100000000, event_id) AS i FROM e),
b AS (SELECT key, min(ms) AS first FROM t GROUP BY key),
n AS (SELECT t.*, t.ms - b.first + 1000 AS raw FROM t JOIN b USING (key)),
w AS (SELECT key, 0::BIGINT AS i, NULL::BIGINT AS event_id, []::BIGINT[] AS taken, NULL::BIGINT AS beat, NULL::DOUBLE AS error FROM b
  UNION ALL SELECT key, i, event_id, CASE WHEN abs(off) <= 120 THEN list_append(left_, pick) ELSE left_ END, CASE WHEN abs(off) <= 120 THEN pick END, CASE WHEN abs(off) <= 120 THEN off END
  FROM (SELECT *, raw - (1000 + pick * 500) AS off FROM (
    SELECT *, COALESCE(list_min(list_transform(list_filter([0, near - 1, near, near + 1], lambda x: x >= 0 AND NOT list_contains(left_, x)), lambda x: {'d': abs(raw - (1000 + x * 500)), 'b': x})).b, greatest(0, near)) AS pick
    FROM (SELECT n.key, n.i, n.event_id, n.raw, round((n.raw - 1000) / 500.0e0)::BIGINT AS near, list_filter(w.taken, lambda x: 1000 + x * 500 >= n.raw - 620) AS left_ FROM w JOIN n ON n.key = w.key AND n.i = w.i + 1))))"""


@query("WITH RECURSIVE " + _CALIBRATED + " SELECT event_id, beat, error AS error_ms, greatest(-500, least(500, round(-error)::INTEGER)) AS suggested_ms FROM w WHERE beat IS NOT NULL")
def calibration_offsets(spark, sf_dir):
    """Every user's events as taps on a fast clock, each with the nearest beat that is still open."""
    e = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), (F.floor(F.col("t_us") / 100_000_000) - 17_000_000).cast("double").alias("at"))
    first = e.groupBy("key").agg(F.min("at").alias("first"))
    taps = e.join(first, "key").select("key", "id", (F.col("at") - F.col("first") + 1000).alias("at_ms"), F.lit("tap").alias("kind"), F.lit(None).cast("double").alias("value"))
    return calibration.calibrate(taps).select(F.col("id").alias("event_id"), "beat", "error_ms", "suggested_ms")


@query("WITH " + E + """ SELECT event_id, (k << 32) | (code << 16) | 1 AS hash, t_us / 1000.0e0 - 20 AS anchor_ms, k::INTEGER AS anchor_bin, code::INTEGER AS target_bin, 1 AS delta FROM e WHERE event_id % 3 = 0
UNION ALL SELECT event_id, unnest(CASE WHEN event_id % 3 = 1 THEN [k, code] ELSE []::BIGINT[] END), t_us / 1000.0e0, 0, 1, 1 FROM e WHERE event_id % 3 > 0""")
def flattened_landmarks(spark, sf_dir):
    """Events as frames: a third with landmarks, a third with hashes alone, a third with neither."""
    e, k, code, third = events(spark, sf_dir), F.col("k"), F.col("code"), F.col("event_id") % 3
    one = F.struct(
        landmark_hash(k, code, F.lit(1)).alias("hash"), (F.col("t_us") / 1000.0 - 20).alias("anchor_ms"), k.cast("int").alias("anchor_bin"),
        code.cast("int").alias("target_bin"), F.lit(1).alias("delta"),
    )
    frames = e.select("event_id", (F.col("t_us") / 1000.0).alias("recorded_ms"), F.when(third == 0, F.array(one)).alias("landmarks"), F.when(third < 2, F.array(k, code)).alias("landmark_hashes"))
    return extractor.flat_landmarks(frames, ["event_id"])
