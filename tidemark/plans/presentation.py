"""Queries of what a player is shown, of chart headers, and of the smaller reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.numbers import scroll_time_ms
from tidemark.operators import catalog as C
from tidemark.operators import chart, presentation, replay
from tidemark.operators import series as S
from tidemark.plans.adapters import A, E, J, O, assets, events, judged, objects
from tidemark.plans.registry import query
from tidemark.session import table


def _smooth(x: str) -> str:
    c = f"greatest(0.0e0, least(1.0e0, {x}))"
    return f"({c} * {c} * (3 - 2 * {c}))"


def _rounded(df, *names):
    return df.withColumns({c: F.round(c, 6) for c in names})


@query("WITH " + J + f""", r AS (SELECT event_id, CASE WHEN tier <= 1 THEN 0 WHEN tier <= 4 THEN 1 ELSE 2 END AS judgement, (error_ms + 100)::DOUBLE AS age FROM j),
p AS (SELECT *, [60.0e0, 70, 70][judgement + 1] AS pulse, [180.0e0, 200, 260][judgement + 1] AS fade, [280.0e0, 320, 400][judgement + 1] AS stop, [0.9e0, 0.9e0, 1.08e0][judgement + 1] AS s0, [0, 0, 6.0e0][judgement + 1] AS l0, greatest(0, age) AS old FROM r),
f AS (SELECT *, {_smooth("(old - fade) / (stop - fade)")} AS fading FROM p)
SELECT event_id, CASE WHEN age < stop THEN round(1 - fading, 6) END AS opacity, CASE WHEN age < stop THEN round(CASE WHEN old < pulse THEN s0 + (1 - s0) * {_smooth("old / pulse")} ELSE 1 + (0.98e0 - 1) * fading END, 6) END AS scale,
CASE WHEN age < stop THEN round(l0 * {_smooth("old / stop")}, 6) END AS lift FROM f""")
def popup_curves(spark, sf_dir):
    """Popups of every judged event at some age, before and after their end."""
    rows = judged(spark, sf_dir).select("event_id", F.when(F.col("tier") <= 1, 0).when(F.col("tier") <= 4, 1).otherwise(2).alias("judgement"), (F.col("error_ms") + 100).cast("double").alias("age"))
    return _rounded(presentation.popup(rows, "judgement", "age"), "opacity", "scale", "lift").select("event_id", "opacity", "scale", "lift")


@query("WITH RECURSIVE " + E + f""", i AS (SELECT event_id, user_id, k % 4 AS lane, (t_us // 1000000 % 1000000 * 40 // 3600)::DOUBLE AS ms, CASE WHEN code <= 2 THEN 'press' ELSE 'release' END AS phase, t_us FROM e),
n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, lane ORDER BY t_us, event_id) AS p FROM i),
w AS (SELECT user_id, lane, event_id, p, phase, ms, 0.0e0 AS light, CASE phase WHEN 'press' THEN 0.52e0 ELSE 0.0e0 END AS start FROM n WHERE p = 1
UNION ALL SELECT user_id, lane, event_id, p, phase, ms, light, CASE phase WHEN 'press' THEN 0.52e0 ELSE light END FROM (
  SELECT n.*, CASE w.phase WHEN 'press' THEN 0.52e0 + (0.24e0 - 0.52e0) * {_smooth("greatest(0, n.ms - w.ms) / 85.0e0")} ELSE w.start * (1 - {_smooth("greatest(0, n.ms - w.ms) / 110.0e0")}) END AS light
  FROM w JOIN n ON n.user_id = w.user_id AND n.lane = w.lane AND n.p = w.p + 1))
SELECT event_id, round(light, 6) AS receptor, round(start, 6) AS start_receptor FROM w""")
def lane_brightness(spark, sf_dir):
    """Every user's events as presses and releases on a fast clock: the light of the lane that each finds and leaves."""
    phase = F.when(F.col("code") <= 2, "press").otherwise("release")
    ms = F.floor(F.floor(F.col("t_us") / 1_000_000) % 1_000_000 * 40 / 3600).cast("double")
    rows = events(spark, sf_dir).select("event_id", "user_id", (F.col("k") % 4).alias("lane"), ms.alias("ms"), phase.alias("phase"), "t_us")
    found = presentation.brightness(rows, ["user_id", "lane"], ["t_us", "event_id"], "ms")
    return _rounded(found, "receptor", "start_receptor").select("event_id", "receptor", "start_receptor")


_LAYOUT = """, v AS (SELECT event_id, kind, (time_ms // 1000 % 1000)::DOUBLE AS s, CASE WHEN kind = 'holdStart' AND event_id % 3 > 0 THEN (time_ms // 1000 % 1000 + event_id % 5)::DOUBLE END AS t,
CASE event_id % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'holding' ELSE 'waiting' END AS own, event_id % 6 AS tier FROM o WHERE kind <> 'holdEnd'),
x AS (SELECT *, CASE WHEN own = 'waiting' AND kind = 'holdStart' AND t IS NULL THEN 'openEnded' WHEN own = 'resolved' AND tier = 5 THEN 'missedButVisible' ELSE own END AS state FROM v),
y AS (SELECT event_id, state, t, CASE WHEN state = 'holding' THEN least(600.0e0, 600 - (s - 500) / (11485 / 25.0e0) * 582) ELSE 600 - (s - 500) / (11485 / 25.0e0) * 582 END AS head,
CASE WHEN state = 'holding' THEN least(600.0e0, 600 - (t - 500) / (11485 / 25.0e0) * 582) ELSE 600 - (t - 500) / (11485 / 25.0e0) * 582 END AS tail0 FROM x),
z AS (SELECT *, CASE WHEN t IS NOT NULL THEN tail0 END AS tail, t IS NOT NULL OR state IN ('holding', 'openEnded') AS hold FROM y)"""


@query("WITH " + O + _LAYOUT + """ SELECT event_id, state, round(head, 6) AS head_y, round(tail, 6) AS tail_y, CASE WHEN hold THEN round(greatest(head, COALESCE(tail, 0)), 6) END AS body_bottom,
CASE WHEN hold THEN round(greatest(head, COALESCE(tail, 0)) - greatest(greatest(head, COALESCE(tail, 0)) - least(head, COALESCE(tail, 0)), 12), 6) END AS body_top FROM z""")
def note_layout(spark, sf_dir):
    """Places of all taps and holds at 500 ms of a fast clock, with a speed of 25."""
    rows, key = objects(spark, sf_dir).where("kind <> 'holdEnd'"), F.col("event_id")
    at = (F.floor(F.col("time_ms") / 1000) % 1000).cast("double")
    rows = rows.select("event_id", "kind", at.alias("s"), F.when((F.col("kind") == "holdStart") & (key % 3 > 0), at + key % 5).alias("t"), F.when(key % 4 == 0, "resolved").when(key % 4 == 1, "holding").otherwise("waiting").alias("own"))
    rows = rows.withColumn("state", presentation.visible_state(F.col("kind"), F.col("own"), key % 6, F.col("t")))
    placed = presentation.layout(rows, "s", "t", "state", F.lit(500.0), scroll_time_ms(F.lit(25.0)), 600.0)
    return _rounded(placed, "head_y", "tail_y", "body_bottom", "body_top").select("event_id", "state", "head_y", "tail_y", "body_bottom", "body_top")


@query("WITH " + O + """ SELECT event_id, time_ms + 30 AS gameplay_ms, time_ms + 18 AS render_ms, round(time_ms + 30 + 11485 / 25.0e0 + 250, 6) AS read_through_ms FROM o""")
def frame_times(spark, sf_dir):
    timed = chart.frame_timing(objects(spark, sf_dir), "time_ms", 30, -12, scroll_time_ms(F.lit(25.0)))
    return _rounded(timed, "read_through_ms").select("event_id", "gameplay_ms", "render_ms", "read_through_ms")


@query("""SELECT 'lib/' || p_partkey || '.osu' AS chart_id, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) WHEN p_partkey % 3 = 1 THEN p_name ELSE p_partkey::VARCHAR END AS title, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS artist,
CASE WHEN p_size % 5 = 0 THEN 'unsupportedMode' WHEN p_size % 7 = 0 OR p_size % 7 = 1 THEN 'unsupportedKeyCount' END AS problem FROM part""")
def chart_headers(spark, sf_dir):
    """Parts as text charts, some of another mode, some with another number of lanes or none."""
    p, key, size = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    lines = [
        F.lit("[General]"), F.when(size % 5 == 0, F.when(size % 2 == 0, F.lit("Mode: 0"))).otherwise(F.lit("Mode: 1\nMode:3")), F.lit("[Difficulty]\n// size"),
        F.when(size % 7 == 0, F.lit("CircleSize: 7")).when(size % 7 == 1, F.lit("Circle: 4")).otherwise(F.lit("CircleSize:4.0")),
        F.lit("[Metadata]"), F.when(key % 3 < 2, F.concat(F.lit("Title: "), "p_name")), F.when(key % 3 == 0, F.concat(F.lit("TitleUnicode:"), F.upper("p_name"))), F.when(key % 2 == 0, F.concat(F.lit("Artist : "), "p_brand")),
    ]
    charts = p.select(F.concat(F.lit("lib/"), key.cast("string"), F.lit(".osu")).alias("chart_id"), F.concat_ws("\n", *lines).alias("text"))
    return chart.chart_headers(charts, chart.parse_pairs(chart.parse_sections(charts)))


@query("WITH " + O + " SELECT user_id AS chart_id, COUNT(*) FILTER (kind <> 'holdEnd') AS objects, MAX(time_ms) AS duration_ms FROM o GROUP BY user_id")
def chart_summaries(spark, sf_dir):
    return chart.chart_summary(objects(spark, sf_dir).withColumnRenamed("user_id", "chart_id"))


@query("""WITH r AS (SELECT l_returnflag, l_extendedprice::DOUBLE AS ms, ROW_NUMBER() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS i, COUNT(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, COUNT(*) AS calls, round(SUM(ms), 2) AS total, MAX(ms) FILTER (i = (n - 1) // 2 + 1) AS p50, MAX(ms) FILTER (i = ceil(n * 0.95)::BIGINT) AS p95, MAX(ms) AS most FROM r GROUP BY l_returnflag""")
def call_timing(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("ms"))
    return replay.timing(rows, "l_returnflag", "ms").withColumn("total", F.round("total", 2))


@query("""SELECT o_orderkey, key, verdict FROM (SELECT o_orderkey, unnest([
 {'key': 'price', 'verdict': CASE WHEN o_orderkey % 11 = 0 THEN 'missing' WHEN o_orderkey % 5 = 0 THEN 'differs' END},
 {'key': 'estimate', 'verdict': CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 2 = 0 THEN 'differs' END},
 {'key': 'clerk', 'verdict': CASE WHEN o_orderkey % 13 = 0 THEN 'missing' END}], recursive := true) FROM orders) WHERE verdict IS NOT NULL""")
def key_differences(spark, sf_dir):
    """Orders as JSON objects on two sides: prices a little or much off, keys that only one side has, one of them optional."""
    o, key, price = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_totalprice").cast("double")
    much = F.when(key % 5 == 0, price + 1).otherwise(price + F.lit(1e-6))
    some = F.when(key % 2 == 0, F.lit(1.5))  # null is left out of the object, and so absent
    ours = F.to_json(F.struct(price.alias("price"), F.when(key % 7 == 0, some).alias("estimate"), F.when(key % 13 != 0, F.col("o_orderpriority")).alias("clerk")))
    golden = F.to_json(F.struct(F.when(key % 11 != 0, much).alias("price"), F.col("o_orderpriority").alias("clerk")))
    return replay.key_diff(o.select("o_orderkey", ours.alias("ours"), golden.alias("golden")), "ours", "golden", ("estimate",)).select("o_orderkey", "key", "verdict")


_CODES = "CASE asset_id % 9 WHEN 0 THEN 'ready' WHEN 1 THEN 'failed' WHEN 2 THEN 'failed' WHEN 3 THEN 'lost' WHEN 4 THEN 'unreadable' WHEN 5 THEN NULL ELSE 'metadataPartial' END"
_NOTES = "CASE WHEN asset_id % 9 IN (0, 1, 3) THEN 'note ' || asset_id END"


@query("WITH " + A + f""", s AS (SELECT asset_id, {_CODES} AS c, {_NOTES} AS m, last_seen_us FROM a)
SELECT asset_id, CASE WHEN c IN ('ready', 'unreadable', 'metadataPartial') THEN c ELSE 'failed' END AS code, CASE WHEN c = 'failed' THEN COALESCE(m, 'Unknown indexing failure.') WHEN c = 'lost' OR c IS NULL THEN 'Unknown indexing status: ' || COALESCE(c, '') END AS message,
last_seen_us / 1000000.0e0 AS seen_s FROM s""")
def index_statuses(spark, sf_dir):
    """Stored codes and messages as statuses, and times as seconds since the epoch, there and back."""
    rows = assets(spark, sf_dir).select("asset_id", T.index_status(F.expr(_CODES), F.expr(_NOTES)).alias("x"), F.timestamp_seconds(F.col("last_seen_us") / 1_000_000.0).alias("seen"))
    return rows.select("asset_id", "x.*", (F.unix_micros("seen") / 1_000_000.0).alias("seen_s"))


@query("""SELECT p_partkey, trim(p_name) AS title, CASE WHEN p_partkey % 3 = 0 THEN p_brand || '|' || p_type WHEN p_partkey % 3 = 1 THEN p_brand ELSE '' END AS artists, CASE WHEN p_size % 2 = 0 THEN p_type END AS album,
CASE WHEN p_size % 3 = 0 THEN p_size::BIGINT END AS duration_ms, 'manual' AS provider FROM part""")
def manual_queries(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    artist = F.when(key % 3 == 0, F.concat("p_brand", F.lit(" ;& "), "p_type", F.lit(","))).when(key % 3 == 1, F.concat(F.lit(","), "p_brand"))
    duration = F.when(size % 3 == 0, F.concat(F.lit(" "), size.cast("string"), F.lit(" "))).when(size % 3 == 1, F.concat(size.cast("string"), F.lit(".5")))
    typed = T.manual_query(F.concat(F.lit(" "), "p_name"), artist, F.when(size % 2 == 0, F.col("p_type")).otherwise(F.lit("  ")), duration, F.lit(None).cast("string"))
    rows = table(spark, sf_dir, "part").select("p_partkey", typed.alias("x")).select("p_partkey", "x.*")
    return rows.withColumn("artists", F.array_join("artists", "|")).drop("isrc")


@query("WITH " + J + """, r AS (SELECT *, MAX(t_us) OVER (PARTITION BY user_id) AS newest FROM j)
SELECT user_id, tier, event_id FROM r WHERE newest - t_us <= 172800000000 QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY tier DESC, event_id DESC) = 1""")
def recent_feedback(spark, sf_dir):
    """Of every user's last two days the judgement to show."""
    return replay.most_severe(S.expire(judged(spark, sf_dir), "user_id", "t_us", 172_800_000_000), "user_id", "tier", "event_id")


@query("WITH " + A + """ SELECT n.asset_id, COALESCE(CASE WHEN n.asset_id % 3 > 0 THEN n.title END, CASE WHEN n.asset_id % 5 > 0 THEN n.artist END) AS title, n.size_bytes FROM a n""")
def identities_kept(spark, sf_dir):
    """Files read again without a title keep the one of their identity, where there is one."""
    now, key = assets(spark, sf_dir).select("asset_id", "title", "artist", "size_bytes"), F.col("asset_id")
    prior = now.where(key % 5 > 0).select("asset_id", F.col("artist").alias("title"))
    fresh = now.select("asset_id", F.when(key % 3 > 0, F.col("title")).alias("title"), "size_bytes")
    return C.identity_fallback(fresh, prior, "asset_id", ["title"])


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 5 = 0 THEN p_type END AS title FROM part""")
def merged_tags(spark, sf_dir):
    """Titles from the tag lists that a file has under three forms, put one after the other; forms may be absent."""
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    form = lambda divisor, value: F.when(key % divisor == 0, F.array(F.struct(F.lit("a/1").alias("id"), F.lit("other").alias("name"), value.alias("value"))))
    forms = [form(2, F.col("p_name")), form(3, F.col("p_brand")), form(5, F.col("p_type"))]
    return p.select("p_partkey", T.tag(T.all_tags(*forms), ["a/1"], "title").alias("title"))
