"""Queries of replay reports, recognition outcomes and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import replay as P
from tidemark.plans.adapters import E, J, events, judged
from tidemark.plans.registry import query
from tidemark.session import table


@query("WITH " + E + """ SELECT user_id, event_type, COUNT(*) AS n, COUNT(*) / (SUM(COUNT(*)) OVER (PARTITION BY user_id))::DOUBLE AS share FROM e GROUP BY user_id, event_type""")
def state_counts(spark, sf_dir):
    return P.state_counts(events(spark, sf_dir), "user_id", "event_type")


@query("WITH " + E + """ SELECT user_id, COUNT(*) AS samples, COUNT(*) FILTER (event_type = 'purchase') AS locked, MIN(t_us) FILTER (event_type = 'purchase') AS first_locked,
COUNT(*) FILTER (event_type = 'purchase') / COUNT(*)::DOUBLE AS share FROM e GROUP BY user_id""")
def locked_summary(spark, sf_dir):
    return P.locked_summary(events(spark, sf_dir), "user_id", "t_us", F.col("event_type") == "purchase")


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type")
def percentile_disc(spark, sf_dir):
    return P.percentiles(events(spark, sf_dir), "event_type", "value", [0.5, 0.95, 0.99])


@query("""WITH a AS (SELECT o_orderkey, o_totalprice AS price, o_custkey::DOUBLE AS customer FROM orders WHERE o_orderkey % 13 <> 0),
b AS (SELECT o_orderkey, o_totalprice + CASE WHEN o_orderkey % 7 = 0 THEN 0.5e0 ELSE 0.0e0 END AS price, o_custkey::DOUBLE AS customer FROM orders WHERE o_orderkey % 11 <> 0),
j AS (SELECT a.o_orderkey AS ka, b.o_orderkey AS kb, a.price AS pa, b.price AS pb, a.customer AS ca, b.customer AS cb FROM a FULL JOIN b USING (o_orderkey)),
l AS (SELECT 'price' AS field, ka, kb, pa AS x, pb AS y FROM j UNION ALL SELECT 'customer', ka, kb, ca, cb FROM j)
SELECT field, COUNT(*) FILTER (ka IS NOT NULL AND kb IS NOT NULL) AS compared, COUNT(*) FILTER (ka IS NULL) AS only_golden, COUNT(*) FILTER (kb IS NULL) AS only_ours,
round(MAX(abs(x - y)), 6) AS max_delta, COUNT(*) FILTER (abs(x - y) > 0.1e0) AS beyond FROM l GROUP BY field""")
def golden_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("customer"))
    golden = o.where("o_orderkey % 11 <> 0").withColumn("price", F.col("price") + F.when(F.col("o_orderkey") % 7 == 0, 0.5).otherwise(0.0))
    found = P.golden_diff(o.where("o_orderkey % 13 <> 0"), golden, ["o_orderkey"], ["price", "customer"], 0.1)
    return found.withColumn("max_delta", F.round("max_delta", 6))


@query(r"""SELECT event_id, CAST(regexp_extract(props, '"k": *(\d+)', 1) AS INTEGER) AS k, CAST(regexp_extract(props, '"k": *(\d+)', 1) AS INTEGER) AS as_text,
CAST(regexp_extract(props, '"k": *(\d+)', 1) AS INTEGER) AS as_fraction, NULL::INTEGER AS absent FROM events""")
def json_flex_decode(spark, sf_dir):
    """A number as it is, as text and with a fraction, and one that is not there."""
    e = table(spark, sf_dir, "events")
    text, fraction = F.regexp_replace("props", r"(\d+)", '"$1"'), F.regexp_replace("props", r"(\d+)", "$1.7")
    number = lambda c, path="$.k": T.flexible_number(c, path)
    return e.select("event_id", number(F.col("props")).alias("k"), number(text).alias("as_text"), number(fraction).alias("as_fraction"), number(F.col("props"), "$.z").alias("absent"))


@query(r"""SELECT event_id, CAST(regexp_extract(props, '"k": *(\d+)', 1) AS INTEGER) AS k FROM events""")
def json_after_text(spark, sf_dir):
    """The JSON object that ends a text of progress lines."""
    e = table(spark, sf_dir, "events")
    mixed = F.concat(F.lit("progress {10%}\n{ not json\n"), "props")
    return e.select("event_id", T.flexible_number(T.last_json_object(mixed), "$.k").alias("k"))


_ATTEMPTS = """t AS (SELECT user_id, event_id AS place, CASE WHEN event_type = 'purchase' THEN 'match' WHEN event_type = 'error' AND k % 5 = 0 THEN 'terminal' WHEN event_type = 'error' THEN 'soft_failure' ELSE 'no_match' END AS outcome FROM e)"""


@query("WITH " + E + ", " + _ATTEMPTS + """, b AS (SELECT *, MAX((outcome IN ('match', 'terminal'))::INTEGER) OVER (PARTITION BY user_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM t)
SELECT user_id, arg_max(outcome, place) AS outcome, MAX(place) AS place, COUNT(*) AS attempts FROM b WHERE COALESCE(before, 0) = 0 GROUP BY user_id""")
def provider_cascade(spark, sf_dir):
    e = events(spark, sf_dir)
    outcome = F.when(F.col("event_type") == "purchase", "match").when((F.col("event_type") == "error") & (F.col("k") % 5 == 0), "terminal")
    outcome = outcome.when(F.col("event_type") == "error", "soft_failure").otherwise("no_match")
    return P.cascade(e.select("user_id", F.col("event_id").alias("place"), outcome.alias("outcome")), "user_id")


@query("WITH " + E + """, s AS (SELECT user_id, t_us // 86400000000 AS day, t_us AS completed_ms, event_id AS duration_ms, CASE event_type WHEN 'purchase' THEN 'match' WHEN 'error' THEN 'failure' ELSE 'no_match' END AS outcome FROM e),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, day ORDER BY CASE outcome WHEN 'match' THEN 0 WHEN 'no_match' THEN 1 ELSE 2 END,
CASE WHEN outcome = 'no_match' THEN -completed_ms ELSE completed_ms END, CASE WHEN outcome = 'no_match' THEN -duration_ms ELSE duration_ms END) AS n FROM s)
SELECT user_id || '/' || day AS key, outcome, duration_ms FROM r WHERE n = 1""")
def earliest_match(spark, sf_dir):
    outcome = F.when(F.col("event_type") == "purchase", "match").when(F.col("event_type") == "error", "failure").otherwise("no_match")
    key = F.concat_ws("/", F.col("user_id").cast("string"), F.floor(F.col("t_us") / 86_400_000_000).cast("string"))
    scans = events(spark, sf_dir).select(key.alias("key"), F.col("t_us").alias("completed_ms"), F.col("event_id").alias("duration_ms"), outcome.alias("outcome"))
    return P.earliest_match(scans, "key")


@query("WITH " + J + """, l AS (SELECT user_id, error_ms FROM j QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY t_us DESC, event_id DESC) <= 16)
SELECT user_id, greatest(-500.0e0, least(500.0e0, round(quantile_cont(error_ms, 0.5)::DOUBLE))) AS median, COUNT(*) AS samples FROM l GROUP BY user_id""")
def median_offset(spark, sf_dir):
    return P.median_offset(judged(spark, sf_dir), "user_id", "error_ms", ["t_us", "event_id"])


@query("WITH " + J + " SELECT user_id, tier, event_id FROM j QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY tier DESC, event_id DESC) = 1")
def argmax_severity(spark, sf_dir):
    return P.most_severe(judged(spark, sf_dir), "user_id", "tier", "event_id")


@query("WITH " + E + """, b AS (SELECT event_id, (t_us // 1000) % 600000 AS ms FROM e)
SELECT event_id, greatest(0, CASE WHEN (ms - 1000) / 500.0e0 - floor((ms - 1000) / 500.0e0) > 0.5e0 THEN floor((ms - 1000) / 500.0e0) + 1 ELSE floor((ms - 1000) / 500.0e0) END)::BIGINT AS beat FROM b""")
def nearest_beat(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", (F.floor(F.col("t_us") / 1000) % 600_000).alias("ms"))
    return P.nearest_beat(rows, "ms", 500.0, 1000.0).select("event_id", "beat")


_KEYS = "p_brand || chr(9) || ' ' || upper(p_name) || chr(9) || CASE WHEN p_partkey % 3 = 0 THEN lower(p_brand) WHEN p_partkey % 3 = 1 THEN '' ELSE p_type END || chr(9) || p_partkey"


@query(f"""WITH k AS (SELECT p_partkey, list_transform(string_split({_KEYS}, chr(9)), lambda x: lower(trim(x))) AS k FROM part)
SELECT p_partkey, CASE WHEN len(k) = 4 AND len(list_distinct(k)) = 4 AND NOT list_contains(k, '') THEN array_to_string(k, '|') END AS keys FROM k""")
def key_bindings(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.array_join(T.key_bindings(F.expr(_KEYS)), "|").alias("keys"))


_SLUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"


@query(f"""SELECT event_id, COALESCE(nullif({_SLUG.format("CASE WHEN event_id % 3 > 0 THEN event_type || ' of user ' || user_id || '!' ELSE '--' END")}, ''), nullif({_SLUG.format("CASE WHEN event_id % 2 > 0 THEN 'Some Name' ELSE '' END")}, ''), 'ambient-sync')
|| '-' || COALESCE(nullif({_SLUG.format("CASE WHEN event_id % 5 > 0 THEN 'Take ' || event_id % 5 ELSE ' ' END")}, ''), 'take') || '-' || strftime(ts, '%Y%m%d-%H%M%S') AS recording_id,
'clip-' || COALESCE(nullif({_SLUG.format("CASE WHEN event_id % 7 > 0 THEN event_type || '.' || user_id ELSE '???' END")}, ''), 'fixture') || '-' || strftime(ts, '%Y%m%d-%H%M%S') AS clip_id, epoch_us(ts) // 1000000 AS seconds FROM events""")
def clip_ids(spark, sf_dir):
    """Both forms of ids of recordings, from names that may be blank."""
    e, at, id_ = table(spark, sf_dir, "events"), F.col("ts").cast("timestamp"), F.col("event_id")
    group = F.when(id_ % 3 > 0, F.concat("event_type", F.lit(" of user "), F.col("user_id").cast("string"), F.lit("!"))).otherwise(F.lit("--"))
    take = F.when(id_ % 5 > 0, F.concat(F.lit("Take "), (id_ % 5).cast("string"))).otherwise(F.lit(" "))
    name = F.when(id_ % 7 > 0, F.concat("event_type", F.lit("."), F.col("user_id").cast("string"), F.lit(".wav"))).otherwise(F.lit("???.wav"))
    return e.select(
        "event_id", T.recording_id(group, take, F.when(id_ % 2 > 0, F.lit("Some Name")).otherwise(F.lit("")), at).alias("recording_id"),
        T.clip_id("clip", name, at).alias("clip_id"), F.unix_seconds(at).alias("seconds"),
    )


@query("""SELECT p_partkey, trim(CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 AND p_size % 2 = 0 THEN ' ' || p_brand || ' ' WHEN p_size % 5 > 0 THEN p_type END) AS title FROM part""")
def tag_titles(spark, sf_dir):
    """Titles of tag lists: by two identifiers in order, else by a name that holds ``title``."""
    row = lambda id_, name, value: F.struct(F.lit(id_).alias("id"), F.lit(name).alias("name"), value.alias("value"))
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    tags = F.array(
        row("x/9", "Song Title", F.when(F.col("p_size") % 5 > 0, F.col("p_type"))), row("b/2", "other", F.when((key % 3 == 1) & (F.col("p_size") % 2 == 0), F.concat(F.lit(" "), "p_brand", F.lit(" ")))),
        row("a/1", "other", F.when(key % 3 == 0, F.col("p_name")).otherwise(F.lit("  "))),
    )
    return p.select("p_partkey", T.tag(tags, ["a/1", "b/2"], "title").alias("title"))
