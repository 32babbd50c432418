"""Queries of recognition results over responses made of parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import recognition as R
from tidemark.plans.registry import query
from tidemark.session import table

# The same expression in Spark and in DuckDB.
_MUSIC = """'{"acrid": "' || CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE p_brand END || '", "title": " ' || p_name || ' ", "artists": [' ||
CASE p_partkey % 3 WHEN 0 THEN '"' || p_type || '", " "' WHEN 1 THEN '{"name": " x "}, {"name": ""}' ELSE '{"langs": [{"name": "' || p_brand || '"}]}' END || '], "album": ' ||
CASE p_partkey % 2 WHEN 0 THEN '{"name": "' || p_type || '"}' ELSE '"' || p_type || '"' END || ', "duration_ms": ' || CAST(p_size AS VARCHAR(9)) || '000, "play_offset_ms": ' ||
CAST(p_size AS VARCHAR(9)) || '0, "played_duration": ' || CAST(p_partkey % 4 AS VARCHAR(9)) || ', "external_ids": {"isrc": "PT' || CAST(p_partkey AS VARCHAR(9)) || '"}}'"""
_JSON = f"""'{{"status": {{"code": ' || CAST(p_partkey % 6 - 3 AS VARCHAR(9)) || ', "message": "m"}}, "metadata": {{"music": ' ||
CASE p_partkey % 7 WHEN 0 THEN 'null' WHEN 1 THEN '[]' WHEN 2 THEN '[' || {_MUSIC} || ', {{}}]' ELSE {_MUSIC} END || '}}}}'"""


@query(f"""WITH j AS (SELECT p_partkey, ({_JSON})::JSON AS j FROM part),
m AS (SELECT p_partkey, (j->>'$.status.code')::INTEGER AS code, CASE WHEN json_type(j, '$.metadata.music') = 'ARRAY' THEN j->'$.metadata.music[0]' ELSE j->'$.metadata.music' END AS m FROM j),
f AS (SELECT p_partkey, code, nullif(trim(m->>'$.acrid'), '') AS acrid, nullif(trim(m->>'$.title'), '') AS title,
  list_filter(list_transform((m->'$.artists')::JSON[], lambda x: nullif(trim(CASE WHEN json_type(x) = 'VARCHAR' THEN x->>'$' ELSE COALESCE(x->>'$.name', x->>'$.langs[0].name') END), '')), lambda x: x IS NOT NULL) AS artists,
  CASE WHEN json_type(m, '$.album') = 'VARCHAR' THEN m->>'$.album' ELSE m->>'$.album.name' END AS album, (m->>'$.duration_ms')::BIGINT AS duration_ms, m->>'$.external_ids.isrc' AS isrc,
  (m->>'$.play_offset_ms')::DOUBLE / 1000 AS offset_s, (m->>'$.played_duration')::DOUBLE AS played FROM m)
SELECT p_partkey, CASE code WHEN 0 THEN 'Processing' WHEN 1 THEN 'Ready' WHEN -1 THEN 'No results' WHEN -2 THEN 'Error' WHEN -3 THEN 'Error' ELSE 'Unknown(' || code || ')' END AS state,
CASE WHEN ok THEN 'scan:' || acrid END AS track_id, CASE WHEN ok THEN title END AS title, CASE WHEN ok THEN COALESCE(array_to_string(artists, ', '), '') END AS artist, CASE WHEN ok THEN album END AS album,
CASE WHEN ok THEN duration_ms END AS duration_ms, CASE WHEN ok THEN isrc END AS isrc, CASE WHEN ok AND played > 0 THEN offset_s END AS from_s, CASE WHEN ok AND played > 0 THEN offset_s + played END AS to_s
FROM (SELECT *, acrid IS NOT NULL AND title IS NOT NULL AS ok FROM f)""")
def recognition_matches(spark, sf_dir):
    """Responses of every form, as tracks."""
    found = R.matches(table(spark, sf_dir, "part").select("p_partkey", F.expr(_JSON).alias("json")), "json")
    shown = found.withColumn("track", R.snapshot(F.col("match"), "scan"))
    return shown.select(
        "p_partkey", R.state_label(F.col("code")).alias("state"), *[f"track.{c}" for c in ("track_id", "title", "artist")], F.col("match.album").alias("album"),
        F.col("match.duration_ms").alias("duration_ms"), "track.isrc", "track.from_s", "track.to_s",
    )
