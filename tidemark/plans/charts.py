"""Queries of timed objects, tokens and judgements."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import tier_label
from tidemark.operators import chart, judge
from tidemark.plans.adapters import E, J, O, events, judged, objects
from tidemark.plans.registry import query

ORDER = ["event_id"]
_LANE = "WINDOW w AS (PARTITION BY user_id, lane ORDER BY time_ms, event_id)"


@query("WITH " + O + f""", m AS (
SELECT user_id, lane, event_id, kind, time_ms AS start, CASE WHEN lead(kind) OVER w = 'holdEnd' THEN lead(time_ms) OVER w END AS "end" FROM o WHERE kind <> 'tap' {_LANE})
SELECT user_id, lane, event_id, start, "end" FROM m WHERE kind = 'holdStart'""")
def hold_pairing(spark, sf_dir):
    return chart.pair_holds(objects(spark, sf_dir), "user_id", "time_ms", ORDER)


@query("WITH " + O + f""", m AS (
SELECT *, last_value(CASE WHEN kind <> 'tap' THEN kind END IGNORE NULLS) OVER (PARTITION BY user_id, lane ORDER BY time_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
lag(kind) OVER w AS kind_before, lag(time_ms) OVER w AS time_before FROM o {_LANE}),
b AS (SELECT *, CASE WHEN time_ms < 0 THEN 'negative_time' WHEN kind <> 'holdEnd' AND kind_before <> 'holdEnd' AND time_before = time_ms THEN 'overlap'
WHEN kind <> 'holdEnd' AND before = 'holdStart' THEN 'start_in_hold' WHEN kind = 'holdEnd' AND before IS DISTINCT FROM 'holdStart' THEN 'end_without_start' END AS rule FROM m)
SELECT user_id, time_ms, lane, rule, COUNT(*) OVER (PARTITION BY user_id) AS broken FROM b WHERE rule IS NOT NULL
QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY time_ms, event_id) = 1""")
def ordering_violations(spark, sf_dir):
    return chart.violations(objects(spark, sf_dir), "user_id", "time_ms", ORDER)


def _ready(minimum: bool) -> str:
    start = "time_ms >= 1704412800000 AND open = change" if minimum else "TRUE"
    return "WITH " + O + f""", s AS (
SELECT user_id, time_ms, COALESCE(last_value(h IGNORE NULLS) OVER (PARTITION BY user_id, lane ORDER BY time_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)
 - COALESCE(last_value(h IGNORE NULLS) OVER (PARTITION BY user_id, lane ORDER BY time_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS change
FROM (SELECT *, CASE kind WHEN 'holdStart' THEN 1 WHEN 'holdEnd' THEN 0 END AS h FROM o)),
t AS (SELECT user_id, time_ms, SUM(change) AS change FROM s GROUP BY ALL),
u AS (SELECT *, SUM(change) OVER (PARTITION BY user_id ORDER BY time_ms) AS open FROM t),
b AS (SELECT user_id, MIN(time_ms) FILTER ({start}) AS start, MAX(time_ms) FILTER (open = 0) AS last_closed FROM u GROUP BY user_id)
SELECT user_id, CASE WHEN last_closed >= start THEN start END AS start, CASE WHEN last_closed >= start THEN last_closed END AS "end" FROM b"""


@query(_ready(False))
def ready_window(spark, sf_dir):
    return chart.ready_window(objects(spark, sf_dir), "user_id", "time_ms", ORDER)


@query(_ready(True))
def ready_window_from(spark, sf_dir):
    """The ready window that starts on 5 January 2024 or later."""
    return chart.ready_window(objects(spark, sf_dir), "user_id", "time_ms", ORDER, F.lit(1704412800000))


@query("WITH " + O + f" SELECT user_id, lane, event_id, time_ms, lead(time_ms) OVER w AS locked_at FROM o WHERE kind <> 'holdEnd' {_LANE}")
def note_lock_next(spark, sf_dir):
    return chart.next_start(objects(spark, sf_dir), "user_id", "time_ms", ORDER).select("user_id", "lane", "event_id", "time_ms", "locked_at")


@query("WITH " + O + """ SELECT user_id, event_id, CASE WHEN kind <> 'holdEnd' THEN COUNT(*) FILTER (kind <> 'holdEnd') OVER (PARTITION BY user_id ORDER BY time_ms, event_id
ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 END AS ordinal FROM o""")
def object_ordinals(spark, sf_dir):
    return chart.with_ordinal(objects(spark, sf_dir), "user_id", "time_ms", ORDER).select("user_id", "event_id", "ordinal")


@query("WITH " + O + """, n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY time_ms, event_id) AS position FROM o),
b AS (SELECT * FROM n WHERE position > 2 AND time_ms <= 1705276800000),
p AS (SELECT *, lead(time_ms) OVER (PARTITION BY user_id ORDER BY time_ms, event_id) AS next_ms FROM b)
SELECT user_id, event_id, position::INTEGER AS position,
CASE WHEN MAX(position) OVER (PARTITION BY user_id) = 7 THEN MAX(next_ms) FILTER (position = 7) OVER (PARTITION BY user_id) END AS complete_before
FROM p WHERE position <= 7""")
def cursor_page(spark, sf_dir):
    """Each user's objects 3 to 7, up to 15 January 2024."""
    rows = chart.page(objects(spark, sf_dir), "user_id", ["time_ms", "event_id"], 2, 5, F.col("time_ms") <= 1705276800000)
    return rows.select("user_id", "event_id", "position", "complete_before")


@query("""WITH t AS (SELECT event_id, user_id, 25 + event_id % 255 AS token_id FROM events),
d AS (SELECT t.*, l.lane, (((token_id - 24) // (4 ** l.lane)::BIGINT) % 4) AS action FROM t, (SELECT unnest([0, 1, 2, 3]) AS lane) l)
SELECT event_id, user_id, lane::INTEGER AS lane, CASE action WHEN 1 THEN 'tap' WHEN 2 THEN 'holdStart' ELSE 'holdEnd' END AS kind FROM d WHERE action > 0""")
def token_decode(spark, sf_dir):
    tokens = events(spark, sf_dir).select("event_id", "user_id", (F.col("event_id") % 255 + 25).alias("token_id"))
    return chart.decode_tokens(tokens).select("event_id", "user_id", "lane", "kind")


@query("WITH " + J + """ SELECT event_id, error_ms, tier, ['big_perfect', 'perfect', 'great', 'good', 'poor', 'miss'][tier + 1] AS label FROM j""")
def tier_classify(spark, sf_dir):
    return judged(spark, sf_dir).select("event_id", "error_ms", "tier", tier_label(F.col("tier")).alias("label"))


@query("WITH " + J + f""" SELECT user_id, COUNT(*) AS judged, {", ".join(f"COUNT(*) FILTER (tier = {k}) AS tier_{k}" for k in range(6))},
round(AVG([1.0e0, 0.9e0, 0.85e0, 0.8e0, 0.4e0, 0.0e0][tier + 1]), 6) AS accuracy, round(AVG(error_ms) FILTER (tier < 5), 3) AS mean_error_ms,
round(-AVG(error_ms) FILTER (tier < 5), 3) AS suggested_offset_ms FROM j GROUP BY user_id""")
def score_summary(spark, sf_dir):
    return judge.score(judged(spark, sf_dir), "user_id")


@query("WITH " + J + """, i AS (SELECT *, SUM((tier = 5)::INTEGER) OVER (PARTITION BY user_id ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING) AS island FROM j)
SELECT user_id, event_id, tier, (SUM((tier <> 5)::INTEGER) OVER (PARTITION BY user_id, island ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS combo FROM i""")
def running_combo(spark, sf_dir):
    return judge.with_combo(judged(spark, sf_dir), "user_id", ["t_us", "event_id"]).select("user_id", "event_id", "tier", "combo")


_PROTECT, _VISIBLE = 40_000_000_000, 160_000_000_000


@query("WITH RECURSIVE " + J + f""", n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS i FROM j),
f AS (SELECT user_id, event_id, i, tier, TRUE AS shown, tier AS on_tier, t_us AS since FROM n WHERE i = 1 UNION ALL
SELECT user_id, event_id, i, tier, shown, CASE WHEN shown THEN tier ELSE on_tier END, CASE WHEN shown THEN t_us ELSE since END
FROM (SELECT n.*, f.on_tier, f.since, n.t_us >= f.since + {_VISIBLE} OR n.tier >= f.on_tier OR n.t_us >= f.since + {_PROTECT} AS shown FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1))
SELECT user_id, event_id, tier, shown FROM f""")
def feedback_shown(spark, sf_dir):
    return judge.feedback(judged(spark, sf_dir), "user_id", ["t_us", "event_id"], _PROTECT, _VISIBLE).select("user_id", "event_id", "tier", "shown")


@query("WITH " + E + """, i AS (SELECT event_id, user_id, k % 4 AS lane, t_us, CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'press' ELSE 'release' END AS phase FROM e),
b AS (SELECT *, lag(phase) OVER (PARTITION BY user_id, lane ORDER BY t_us, event_id) AS before FROM i)
SELECT user_id, event_id, lane, phase FROM b WHERE COALESCE(before <> phase, phase = 'press')""")
def key_routing(spark, sf_dir):
    phase = F.when(F.col("event_type").isin("click", "view", "signup"), "press").otherwise("release")
    rows = events(spark, sf_dir).select("event_id", "user_id", (F.col("k") % 4).alias("lane"), "t_us", phase.alias("phase"))
    return judge.clean_presses(rows, "user_id", ["t_us", "event_id"]).select("user_id", "event_id", "lane", "phase")


@query()
def judgement_engine(spark, sf_dir):
    """Every user's events as a session: clicks, views and purchases are objects, the rest presses and releases.

    Times are shrunk so that inputs meet objects: ten minutes count as 100 ms.
    """
    kind = F.create_map(*[F.lit(x) for pair in {"click": "tap", "view": "holdStart", "purchase": "holdEnd", "error": "press", "signup": "release"}.items() for x in pair])
    rows = events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("session_id"), (F.floor(F.col("t_us") / 6_000_000) % 100_000_000 * 1.0).alias("time_ms"),
        F.try_element_at(kind, F.col("event_type")).alias("kind"), (F.col("k") % 4).cast("int").alias("lane"), F.col("event_id").alias("id"),
    )
    return judge.judge(rows)


@query("WITH " + O + """, t AS (SELECT user_id, 'HitObjects' AS section, event_id, lane, kind, time_ms % 1000000 AS time_ms FROM o WHERE kind <> 'holdEnd')
SELECT user_id::VARCHAR AS chart_id, lane, 'tap' AS kind, time_ms::DOUBLE AS time_ms, COUNT(*) AS n FROM t WHERE kind = 'tap' GROUP BY ALL
UNION ALL SELECT user_id::VARCHAR, lane, x, (time_ms + CASE x WHEN 'holdEnd' THEN 500 ELSE 0 END)::DOUBLE, COUNT(*) FROM t, (SELECT unnest(['holdStart', 'holdEnd']) AS x) u WHERE kind = 'holdStart' GROUP BY ALL""")
def chart_parse(spark, sf_dir):
    """Every user's objects are written as a text chart, in parts of a day, and parsed again."""
    rows = objects(spark, sf_dir).where("kind <> 'holdEnd'").withColumn("at", F.col("time_ms") % 1_000_000)
    x = (F.col("lane") * 128 + 64).cast("string")
    line = F.when(F.col("kind") == "tap", F.concat_ws(",", x, F.lit("192"), F.col("at").cast("string"), F.lit("1,0,0:0:0:0:"))).otherwise(
        F.concat_ws(",", x, F.lit("192"), F.col("at").cast("string"), F.lit("128,0"), F.concat((F.col("at") + 500).cast("string"), F.lit(":0:0:0:0:")))
    )
    texts = rows.groupBy(F.col("user_id").cast("string").alias("user"), F.floor(F.col("time_ms") / 86_400_000).alias("day")).agg(
        F.concat(F.lit("[General]\nMode: 3\n\n[HitObjects]\n// objects\n"), F.array_join(F.collect_list(line), "\r\n")).alias("text")
    )
    charts = texts.select(F.concat_ws("/", "user", "day").alias("chart_id"), "text")
    parsed = chart.parse_objects(chart.parse_sections(charts)).where("problem is null")
    return parsed.groupBy(F.split("chart_id", "/")[0].alias("chart_id"), "lane", "kind", "time_ms").agg(F.count("*").alias("n"))


@query("WITH " + O + """, v AS (SELECT *, time_ms + 40000000 AS until, CASE WHEN event_id % 2 = 0 THEN time_ms + 90000000 END AS resolved_at FROM o)
SELECT event_id FROM v WHERE (time_ms <= 1704499200000 AND CASE WHEN kind = 'tap' THEN time_ms ELSE until END >= 1704412800000)
OR COALESCE(resolved_at + 300 >= 1704412800000 AND resolved_at <= 1704499200000, FALSE)""")
def visible_objects(spark, sf_dir):
    """Objects to draw on 5 January 2024; those that are no tap last 40 000 s, half are resolved 90 000 s after their start."""
    rows = objects(spark, sf_dir).withColumns({"until": F.when(F.col("kind") != "tap", F.col("time_ms") + 40_000_000), "resolved_at": F.when(F.col("event_id") % 2 == 0, F.col("time_ms") + 90_000_000)})
    return chart.visible(rows, "time_ms", "until", F.lit(1704412800000), F.lit(1704499200000)).select("event_id")


@query(_ready(True).replace("SELECT user_id, CASE WHEN last_closed", "SELECT user_id, COALESCE(last_closed - start >= 5000, FALSE) AS ready, CASE WHEN last_closed"))
def start_gate(spark, sf_dir):
    """Whether five seconds are buffered from 5 January 2024 on."""
    return chart.start_gate(objects(spark, sf_dir), "user_id", "time_ms", ORDER, F.lit(1704412799000))


@query("WITH " + O + """, b AS (SELECT user_id, MIN(time_ms) FILTER (kind = 'holdEnd') AS end_ms FROM o WHERE event_id % 3 = 0 GROUP BY user_id)
SELECT o.user_id, event_id FROM o LEFT JOIN b USING (user_id) WHERE time_ms >= 1704067200000 + user_id * 1000000 AND time_ms <= COALESCE(end_ms + 864000000, 9e18::DOUBLE)""")
def accepted_objects(spark, sf_dir):
    """Objects from a bound of their user on, to ten days after the end that user's stream declares."""
    rows = objects(spark, sf_dir)
    ends = chart.ended(rows.where("event_id % 3 = 0 and kind = 'holdEnd'"), "user_id", "time_ms")
    bounded = rows.join(ends, "user_id", "left")
    return chart.accepted(bounded, "time_ms", F.lit(1704067200000) + F.col("user_id") * 1_000_000, F.col("end_ms") + 864_000_000).select("user_id", "event_id")
