"""Views of the domain over the Parquet tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numbers import landmark_hash
from tidemark.session import table

TYPES = ("click", "error", "purchase", "signup", "view")
KINDS = {"click": "tap", "view": "holdStart", "purchase": "holdEnd"}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, event_type, code, value, k, t_us."""
    code = F.array_position(F.array(*[F.lit(x) for x in TYPES]), F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", code.cast("long").alias("code"), "value",
        F.regexp_extract("props", r'"k": *(\d+)', 1).cast("long").alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"),
    )


E = r"""e AS (
  SELECT event_id, user_id, event_type, value, CAST(regexp_extract(props, '"k": *(\d+)', 1) AS BIGINT) AS k, epoch_us(ts) AS t_us,
         (CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 WHEN 'view' THEN 5 END)::BIGINT AS code
  FROM events)"""


def landmarks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Query landmarks (odd events, by user) and reference landmarks (even events)."""
    e = events(spark, sf_dir).withColumn("hash", landmark_hash(F.col("k"), F.col("code"), F.floor("value") % 5 + 1))
    query = e.where("event_id % 2 = 1").select(F.col("user_id").alias("query_id"), "hash", "t_us")
    return query, e.where("event_id % 2 = 0").select("hash", "t_us")


L = E + r""", l AS (SELECT *, (k << 32) | (code << 16) | (floor(value)::BIGINT % 5 + 1) AS hash FROM e),
q AS (SELECT user_id AS query_id, hash, t_us FROM l WHERE event_id % 2 = 1),
r AS (SELECT hash, t_us FROM l WHERE event_id % 2 = 0)"""


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed objects: user_id, lane, kind, time_ms, event_id."""
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    e = events(spark, sf_dir).withColumn("kind", F.try_element_at(kind, F.col("event_type"))).where("kind is not null")
    return e.select("user_id", (F.col("k") % 4).cast("int").alias("lane"), "kind", F.floor(F.col("t_us") / 1000).alias("time_ms"), "event_id")


O = E + """, o AS (
  SELECT user_id, (k % 4)::INTEGER AS lane, CASE event_type WHEN 'click' THEN 'tap' WHEN 'view' THEN 'holdStart' ELSE 'holdEnd' END AS kind,
         t_us // 1000 AS time_ms, event_id
  FROM e WHERE event_type IN ('click', 'view', 'purchase'))"""  # noqa: E741


def judged(spark: SparkSession, sf_dir: str, label: str = "B") -> DataFrame:
    """Judged hits: user_id, event_id, t_us, error_ms (whole, -250 to 249), tier."""
    from tidemark.functions.numbers import tier

    e = events(spark, sf_dir).withColumn("error_ms", (F.floor("value") * 7 + F.col("k") * 13) % 500 - 250)
    return e.select("user_id", "event_id", "t_us", "error_ms", tier(F.col("error_ms"), label).alias("tier"))


J = E + """, j AS (
  SELECT user_id, event_id, t_us, error_ms,
         CASE WHEN abs(error_ms) <= 47 THEN 0 WHEN abs(error_ms) <= 63 THEN 1 WHEN abs(error_ms) <= 88 THEN 2
              WHEN abs(error_ms) <= 118 THEN 3 WHEN abs(error_ms) <= 200 THEN 4 ELSE 5 END AS tier
  FROM (SELECT *, (floor(value)::BIGINT * 7 + k * 13) % 500 - 250 AS error_ms FROM e))"""


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog: parts as audio files in 25 directories."""
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    status = F.when(F.col("p_size") % 10 == 0, "missingFile").when(F.col("p_size") % 7 == 0, "metadataPartial").when(F.col("p_size") % 11 == 0, "failed").otherwise("ready")
    return p.select(
        key.alias("asset_id"), (key % 25).cast("int").alias("directory_id"), F.concat("p_brand", F.lit("/"), key.cast("string")).alias("path"),
        F.concat("p_name", F.lit(".mp3")).alias("file_name"), F.sha2(F.concat("p_name", "p_type"), 256).alias("sha256"),
        F.col("p_size").cast("long").alias("size_bytes"), (F.col("p_size") * 1000).alias("duration_ms"), F.col("p_name").alias("title"),
        F.col("p_brand").alias("artist"), F.col("p_type").alias("album"), F.concat(F.lit("PT"), key.cast("string")).alias("isrc"),
        status.alias("status"), (key * 1000).alias("last_seen_us"),
    )


A = """a AS (
  SELECT p_partkey AS asset_id, (p_partkey % 25)::INTEGER AS directory_id, p_brand || '/' || p_partkey AS path, p_name || '.mp3' AS file_name,
         sha256(p_name || p_type) AS sha256, p_size::BIGINT AS size_bytes, p_size * 1000 AS duration_ms, p_name AS title, p_brand AS artist,
         p_type AS album, 'PT' || p_partkey AS isrc,
         CASE WHEN p_size % 10 = 0 THEN 'missingFile' WHEN p_size % 7 = 0 THEN 'metadataPartial' WHEN p_size % 11 = 0 THEN 'failed' ELSE 'ready' END AS status,
         p_partkey * 1000 AS last_seen_us
  FROM part)"""
