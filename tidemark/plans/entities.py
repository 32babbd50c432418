"""Queries of the catalog and of entity resolution."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import catalog as C
from tidemark.operators import resolve as R
from tidemark.plans.adapters import A, assets
from tidemark.plans.registry import query
from tidemark.session import shared_dir, table
from tidemark.sources import index_cache, snapshots


def _tracks(spark, sf_dir):
    """Query tracks: every part whose id is divisible by 100, with titles, albums and durations off."""
    p, key = table(spark, sf_dir, "part").where("p_partkey % 100 = 0"), F.col("p_partkey")
    return p.select(
        key.alias("query_id"), F.when(key % 300 == 0, F.upper("p_name")).when(key % 300 == 100, F.concat("p_name", F.lit("s"))).otherwise(F.concat("p_name", F.lit("  (live)"))).alias("title"),
        F.col("p_brand").alias("artist"), F.when(key % 200 == 0, F.col("p_type")).alias("album"), (F.col("p_size") * 1000 + key % 7 * 600).alias("duration_ms"),
        F.when(key % 500 == 0, F.concat(F.lit("pt-"), key.cast("string"))).alias("isrc"), F.when(key % 400 == 0, "manual").otherwise("live").alias("provider"),
    )


def _fuzzy(a: str, b: str) -> str:
    x, y = f"list_distinct(string_split({a}, ' '))", f"list_distinct(string_split({b}, ' '))"
    shared = f"len(list_intersect({x}, {y}))"
    jaccard = f"{shared} / (len({x}) + len({y}) - {shared})::DOUBLE"
    inside = f"(contains(' ' || {a} || ' ', ' ' || {b} || ' ') OR contains(' ' || {b} || ' ', ' ' || {a} || ' '))"
    short = f"least(len(string_split({a}, ' ')), len(string_split({b}, ' ')))"
    edits = f"1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}), 1)::DOUBLE"
    covered = f"0.92e0 * ({shared} / least(len({x}), len({y}))::DOUBLE)"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0e0 WHEN {a} = {b} THEN 1.0e0 ELSE greatest({jaccard}, {covered}, CASE WHEN {inside} THEN CASE WHEN {short} = 1 THEN 0.86e0 ELSE 0.94e0 END ELSE 0.0e0 END, {edits}) END"


def _key(c: str) -> str:
    return f"trim(regexp_replace(lower(COALESCE({c}, '')), '[^a-z0-9]+', ' ', 'g'))"


_KNOTS = """CASE WHEN d <= 250 THEN 0.24e0 WHEN d <= 2000 THEN 0.24e0 + (d - 250) * ((0.16e0 - 0.24e0) / 1750) WHEN d <= 8000 THEN 0.16e0 + (d - 2000) * ((0.02e0 - 0.16e0) / 6000)
 WHEN d <= 30000 THEN 0.02e0 + (d - 8000) * ((-0.24e0 - 0.02e0) / 22000) ELSE -0.24e0 END"""
RESOLVED = "WITH " + A + f""", t AS (
  SELECT p_partkey AS query_id, CASE WHEN p_partkey % 300 = 0 THEN upper(p_name) WHEN p_partkey % 300 = 100 THEN p_name || 's' ELSE p_name || '  (live)' END AS title,
         p_brand AS artist, CASE WHEN p_partkey % 200 = 0 THEN p_type END AS album, p_size * 1000 + p_partkey % 7 * 600 AS duration_ms,
         CASE WHEN p_partkey % 500 = 0 THEN 'pt-' || p_partkey END AS isrc, CASE WHEN p_partkey % 400 = 0 THEN 'manual' ELSE 'live' END AS provider
  FROM part WHERE p_partkey % 100 = 0),
tk AS (SELECT query_id, {_key("title")} AS qt, {_key("artist")} AS qa, {_key("album")} AS ql, replace({_key("isrc")}, ' ', '') AS qi, duration_ms AS q_ms, provider FROM t),
ak AS (SELECT asset_id, path, {_key("title")} AS xt, {_key("artist")} AS xa, {_key("album")} AS xl, {_key("regexp_replace(file_name, '[.][^.]*$', '')")} AS xf,
         replace({_key("isrc")}, ' ', '') AS xi, duration_ms AS a_ms FROM a WHERE status IN ('ready', 'metadataPartial')),
fuzz AS (SELECT x, y, {_fuzzy("x", "y")} AS sim FROM (SELECT DISTINCT qt AS x FROM tk UNION SELECT DISTINCT qa FROM tk UNION SELECT DISTINCT ql FROM tk) CROSS JOIN
         (SELECT DISTINCT xt AS y FROM ak UNION SELECT DISTINCT xa FROM ak UNION SELECT DISTINCT xl FROM ak UNION SELECT DISTINCT xf FROM ak)),
s AS (SELECT query_id, asset_id, path, provider, abs(q_ms - a_ms) AS d, qi <> '' AND qi = xi AS isrc, xt = '' AS untitled,
       qt <> '' AND qt = xt AS title1, qa <> '' AND qa = xa AS artist1, ql <> '' AND ql = xl AS album1,
       CASE WHEN f1.sim >= 0.82e0 THEN f1.sim END AS title, CASE WHEN f2.sim >= 0.82e0 THEN f2.sim END AS artist,
       CASE WHEN f3.sim >= 0.82e0 THEN f3.sim END AS album,
       CASE WHEN qt <> '' AND contains(' ' || xf || ' ', ' ' || qt || ' ') THEN 1.0e0 WHEN f4.sim >= 0.86e0 THEN f4.sim END AS file
  FROM tk CROSS JOIN ak JOIN fuzz f1 ON f1.x = qt AND f1.y = xt JOIN fuzz f2 ON f2.x = qa AND f2.y = xa JOIN fuzz f3 ON f3.x = ql AND f3.y = xl JOIN fuzz f4 ON f4.x = qt AND f4.y = xf),
c AS (SELECT *, round(greatest(0.0e0, least(1.0e0, CASE WHEN isrc THEN 0.98e0 ELSE 0.0e0 END
       + ((CASE WHEN title1 THEN 0.38e0 WHEN title >= 0.82e0 THEN title * 0.28e0 ELSE 0.0e0 END + CASE WHEN artist1 THEN 0.34e0 WHEN artist >= 0.82e0 THEN artist * 0.24e0 ELSE 0.0e0 END)
       + CASE WHEN album1 THEN 0.12e0 WHEN album >= 0.82e0 THEN album * 0.09e0 ELSE 0.0e0 END) + {_KNOTS}
       + COALESCE(CASE WHEN untitled AND d <= 8000 THEN 0.62e0 ELSE 0.08e0 END * file, 0.0e0))), 6) AS confidence
  FROM s WHERE isrc OR title IS NOT NULL OR artist IS NOT NULL OR album IS NOT NULL OR file IS NOT NULL OR round({_KNOTS}, 6) > 0),
z AS (SELECT *, CASE WHEN d BETWEEN 2001 AND 8000 AND confidence >= 0.70e0 THEN 'confirm' WHEN confidence >= 0.90e0 THEN 'accept' WHEN confidence >= 0.70e0 THEN 'confirm' ELSE 'reject' END AS decision,
       ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY confidence DESC, path, asset_id) AS rank FROM c),
f AS (SELECT query_id, MAX(confidence) FILTER (decision = 'accept' AND rank = 1) AS first_accepted, bool_and(decision = 'reject') AS all_rejected, MAX(confidence) AS best FROM z GROUP BY query_id),
n AS (SELECT z.query_id, COUNT(*) AS near FROM z JOIN f USING (query_id) WHERE decision = 'accept' AND round(first_accepted - confidence, 6) <= 0.03e0 GROUP BY z.query_id),
out AS (SELECT z.query_id, z.rank::INTEGER AS rank, asset_id, path, confidence,
       CASE WHEN decision = 'accept' AND COALESCE(near, 0) > 1 AND round(first_accepted - confidence, 6) <= 0.03e0 THEN 'confirm'
            WHEN provider = 'manual' AND all_rejected AND best > 0 AND z.rank = 1 THEN 'confirm' ELSE decision END AS decision
  FROM z JOIN f USING (query_id) LEFT JOIN n USING (query_id) WHERE z.rank <= 5)"""


@query(RESOLVED + " SELECT * FROM out")
def resolver_results(spark, sf_dir):
    return R.resolve(_tracks(spark, sf_dir), assets(spark, sf_dir), 5).drop("evidence")


@query(RESOLVED + """ SELECT query_id, asset_id, confidence, decision FROM out WHERE rank = 1
UNION ALL SELECT query_id, (SELECT asset_id FROM ak ORDER BY path, asset_id LIMIT 1), 0.0e0, 'reject' FROM t WHERE query_id NOT IN (SELECT query_id FROM out)""")
def resolver_history(spark, sf_dir):
    tracks, catalog = _tracks(spark, sf_dir), assets(spark, sf_dir)
    return R.history(R.resolve(tracks, catalog, 5), tracks, catalog)


@query(f"""WITH n AS (SELECT DISTINCT p_name AS key FROM part), q AS (SELECT DISTINCT p_name AS key FROM part WHERE p_partkey % 100 = 0)
SELECT a, b, round(sim, 6) AS sim FROM (SELECT x.key AS a, y.key AS b, {_fuzzy("x.key", "y.key")} AS sim FROM q x CROSS JOIN n y) s WHERE sim >= 0.6e0""")
def similar_names(spark, sf_dir):
    """Names like those of the parts whose key is divisible by 100."""
    p = table(spark, sf_dir, "part").select(F.lit("name").alias("kind"), F.col("p_name").alias("key"), F.lit(0.6).alias("least"), "p_partkey")
    return R.similar(p.where("p_partkey % 100 = 0"), p).select("a", "b", F.round("sim", 6).alias("sim"))


@query("WITH " + A + """ SELECT n_nationkey AS directory_id, COUNT(asset_id) AS discovered, COUNT(*) FILTER (status IN ('ready', 'metadataPartial')) AS indexed,
COUNT(*) FILTER (status = 'failed') AS failed, COUNT(*) FILTER (status = 'missingFile') AS missing, n_nationkey * 1000000 AS last_scan_us
FROM nation LEFT JOIN a ON directory_id = n_nationkey GROUP BY n_nationkey""")
def library_status(spark, sf_dir):
    folders = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("directory_id"), (F.col("n_nationkey") * 1_000_000).alias("last_scan_us"))
    return C.library_status(assets(spark, sf_dir), folders)


_SEEN = "seen AS (SELECT directory_id, path FROM a WHERE directory_id BETWEEN 1 AND 14 AND size_bytes % 4 <> 0)"


@query("WITH " + A + ", " + _SEEN + """ SELECT asset_id, path, CASE WHEN directory_id < 15 AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.directory_id = a.directory_id AND s.path = a.path)
THEN 'missingFile' ELSE status END AS status FROM a""")
def missing_assets(spark, sf_dir):
    """Directories 0 to 14 are scanned; files of a size divisible by 4 and all of directory 0 are gone."""
    a = assets(spark, sf_dir)
    scanned = table(spark, sf_dir, "nation").where("n_nationkey < 15").select(F.col("n_nationkey").alias("directory_id"))
    return C.mark_missing(a, a.where("directory_id between 1 and 14 and size_bytes % 4 <> 0").select("directory_id", "path"), scanned).select("asset_id", "path", "status")


def _files(a):
    """What a scan of directories 0 to 21 finds: every third file has moved, some cannot be read, directories 20 and 21 are empty."""
    path = F.when(F.col("asset_id") % 3 == 0, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    return a.withColumns({"path": path, "title": F.when(F.col("asset_id") % 5 != 0, F.col("title")), "supported": F.col("asset_id") % 7 != 0, "readable": F.col("asset_id") % 11 != 0}).where("directory_id < 20").drop("asset_id", "status")


_MOVED = """files AS (SELECT * EXCLUDE (asset_id, status, path, title), CASE WHEN asset_id % 3 = 0 THEN 'moved/' || path ELSE path END AS path, CASE WHEN asset_id % 5 <> 0 THEN title END AS title,
  asset_id % 7 <> 0 AS supported, asset_id % 11 <> 0 AS readable FROM a WHERE directory_id < 20),
new AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY directory_id, sha256, size_bytes, duration_ms ORDER BY path) AS k FROM files f
  WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.directory_id = f.directory_id AND a.path = f.path)),
lost AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY directory_id, sha256, size_bytes, duration_ms ORDER BY last_seen_us DESC, asset_id) AS k FROM a
  WHERE NOT EXISTS (SELECT 1 FROM files f WHERE a.directory_id = f.directory_id AND a.path = f.path)),
m AS (SELECT directory_id, new.path, lost.asset_id, lost.path AS old_path FROM new JOIN lost USING (directory_id, sha256, size_bytes, duration_ms, k))"""


@query("WITH " + A + ", " + _MOVED + " SELECT * FROM m")
def moved_assets(spark, sf_dir):
    a = assets(spark, sf_dir)
    return C.moved(a, _files(a))


@query("WITH " + A + ", " + _MOVED + """, same AS (SELECT a.* FROM a JOIN files f USING (directory_id, path, sha256, size_bytes, duration_ms) WHERE status <> 'missingFile'),
now AS (SELECT f.path, f.directory_id, COALESCE(a.asset_id, m.asset_id) AS asset_id,
  CASE WHEN s.asset_id IS NOT NULL THEN s.status WHEN NOT supported THEN 'unsupported' WHEN NOT readable THEN 'unreadable' WHEN f.title IS NULL THEN 'metadataPartial' ELSE 'ready' END AS status
  FROM files f LEFT JOIN a ON a.directory_id = f.directory_id AND a.path = f.path LEFT JOIN m ON m.directory_id = f.directory_id AND m.path = f.path
  LEFT JOIN same s ON s.directory_id = f.directory_id AND s.path = f.path)
SELECT path, directory_id, status FROM now UNION ALL
SELECT path, directory_id, CASE WHEN directory_id < 22 THEN 'missingFile' ELSE status END FROM a WHERE asset_id NOT IN (SELECT asset_id FROM now WHERE asset_id IS NOT NULL)""")
def rescan_catalog(spark, sf_dir):
    a = assets(spark, sf_dir)
    scanned = table(spark, sf_dir, "nation").where("n_nationkey < 22").select(F.col("n_nationkey").alias("directory_id"))
    return C.rescan(a, _files(a), scanned).select("path", "directory_id", "status")


@query("WITH " + A + """ SELECT path, asset_id, status FROM (SELECT split_part(path, '/', 1) AS path, asset_id, status, last_seen_us FROM a)
QUALIFY ROW_NUMBER() OVER (PARTITION BY path ORDER BY CASE WHEN status IN ('ready', 'metadataPartial') THEN 0 ELSE 1 END, last_seen_us DESC, asset_id) = 1""")
def assets_at_path(spark, sf_dir):
    """The asset to show of each first folder."""
    a = assets(spark, sf_dir).withColumn("path", F.split("path", "/")[0])
    return C.at_path(a, a).select("path", "asset_id", "status")


@query("""SELECT n_nationkey AS directory_id, greatest(n_nationkey * 1000000, s.at_us) AS last_scan_us
FROM nation LEFT JOIN (SELECT c_nationkey, MAX(c_custkey * 1000) AS at_us FROM customer WHERE c_nationkey < 9 GROUP BY c_nationkey) s ON n_nationkey = c_nationkey""")
def scan_times(spark, sf_dir):
    folders = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("directory_id"), (F.col("n_nationkey") * 1_000_000).cast("long").alias("last_scan_us"))
    scans = table(spark, sf_dir, "customer").where("c_nationkey < 9").select(F.col("c_nationkey").alias("directory_id"), (F.col("c_custkey") * 1000).alias("at_us"))
    return C.scanned_at(folders, scans)


@query("WITH " + A + """, u AS (SELECT asset_id + 1 AS asset_id, directory_id, path FROM a WHERE asset_id % 9 = 0)
SELECT a.asset_id, a.path FROM a JOIN u ON a.directory_id = u.directory_id AND a.path = u.path WHERE a.asset_id <> u.asset_id AND a.status <> 'missingFile'""")
def path_conflicts(spark, sf_dir):
    a = assets(spark, sf_dir)
    taken = a.where("asset_id % 9 = 0").withColumn("asset_id", F.col("asset_id") + 1)
    return C.conflicts(a, taken).select("asset_id", "path")


@query("""WITH n AS (SELECT CASE WHEN o_orderkey % 20 = 0 THEN -1 - o_orderkey ELSE o_orderkey END AS o_orderkey, 'U' AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 10 = 0)
SELECT COALESCE(n.o_orderkey, o.o_orderkey) AS o_orderkey, COALESCE(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus, COALESCE(n.o_totalprice, o.o_totalprice) AS o_totalprice
FROM (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders) o FULL JOIN n ON n.o_orderkey = o.o_orderkey""")
def upsert_assets(spark, sf_dir):
    """Every tenth order is updated or, under a new key, inserted."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    key = F.when(F.col("o_orderkey") % 20 == 0, -1 - F.col("o_orderkey")).otherwise(F.col("o_orderkey"))
    new = o.where("o_orderkey % 10 = 0").select(key.alias("o_orderkey"), F.lit("U").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return C.upsert(o, new, "o_orderkey")


@query("""SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey <> 2))""")
def cascade_delete(spark, sf_dir):
    """Customers left when a region goes with its nations."""
    left = table(spark, sf_dir, "region").where("r_regionkey <> 2")
    levels = [(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), "n_regionkey"), (table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey")]
    return C.cascade(left, "r_regionkey", levels)[1]


@query("SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text)) AS size_bytes FROM documents")
def sha_identity(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size_bytes"))


@query("""SELECT p_partkey, trim(left(trim(regexp_replace(lower(p_brand || ' - ' || p_name || '/' || p_type), '[^a-z0-9]+', '-', 'g'), '-'), 20), '-') AS slug,
CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS number FROM part""")
def slugs(spark, sf_dir):
    name = F.concat("p_brand", F.lit(" - "), "p_name", F.lit("/"), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(name, 20).alias("slug"), T.first_integer(F.col("p_brand")).alias("number"))


@query("WITH " + A + """, n AS (SELECT asset_id + CASE WHEN asset_id % 14 = 0 THEN 100000000 ELSE 0 END AS asset_id, directory_id, path, upper(title) AS title, sha256, size_bytes + 1 AS size_bytes, duration_ms, artist FROM a WHERE asset_id % 7 = 0),
o AS (SELECT a.asset_id, CASE WHEN asset_id % 14 = 0 AND status <> 'missingFile' THEN 'missingFile' ELSE status END AS status, path, title, artist, sha256, size_bytes FROM a WHERE asset_id NOT IN (SELECT asset_id FROM n))
SELECT asset_id, status, path, title, artist, sha256, size_bytes FROM o UNION ALL SELECT asset_id, 'ready', path, title, artist, sha256, size_bytes FROM n""")
def published_catalog(spark, sf_dir):
    """The catalog as three tables of one snapshot, after a second version: every seventh asset read again, half of them under a new id."""
    a, root, key = assets(spark, sf_dir), f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex}", F.col("asset_id")
    C.store_assets(spark, root, a)
    again = a.where(key % 7 == 0).withColumns({"asset_id": F.when(key % 14 == 0, key + 100_000_000).otherwise(key), "title": F.upper("title"), "size_bytes": F.col("size_bytes") + 1, "status": F.lit("ready")})
    C.store_assets(spark, root, again)
    now = snapshots.read(spark, root)
    return now["assets"].select("asset_id", "status", "path").join(now["metadata"].select("asset_id", "title", "artist"), "asset_id").join(now["hashes"], "asset_id")


_SOURCES = """s AS (SELECT p_partkey AS k, 'parts/' || p_partkey AS path, p_size AS size FROM part)"""


@query("WITH " + _SOURCES + """, t AS (SELECT CASE WHEN k % 10 = 9 THEN 'gone' WHEN k % 10 = 3 AND size % 2 = 0 THEN 'failed' WHEN k % 10 = 3 THEN 'built' ELSE 'kept' END AS status, size FROM s)
SELECT st AS status, (SELECT COUNT(*) FROM t WHERE t.status = st) AS sources, CASE st WHEN 'kept' THEN (SELECT SUM(size) FROM t WHERE t.status = 'kept') WHEN 'built' THEN (SELECT SUM(size + 1) FROM t WHERE t.status = 'built') ELSE 0 END::BIGINT AS frames
FROM (SELECT unnest(['kept', 'built', 'failed', 'gone']) AS st)""")
def index_cache_refresh(spark, sf_dir):
    """A cache of one index for each part, refreshed after some have changed, some cannot be read and some are gone."""
    root, key, size = f"{shared_dir(spark)}/indexes-{uuid.uuid4().hex}", F.col("p_partkey"), F.col("p_size")
    part = table(spark, sf_dir, "part")

    def sources(rows, more):
        return rows.select(F.concat(F.lit("parts/"), key.cast("string")).alias("path"), (size + more).cast("long").alias("size_bytes"), F.timestamp_seconds(key).alias("modified"), F.sha2("p_name", 256).alias("sha256"))

    def build(broken):
        problem = F.when(broken, "not readable")
        return lambda rows: rows.select("path", F.explode(F.sequence(F.lit(1), "size_bytes")).alias("place"), problem.alias("problem"))

    index_cache.refresh(spark, root, sources(part, 0), build(F.lit(False)), 1, "hop 20")
    changed = sources(part.where(key % 10 != 9), F.when(key % 10 == 3, 1).otherwise(0))
    broken = F.col("path").endswith("3") & (F.col("size_bytes") % 2 == 1)
    counts = index_cache.refresh(spark, root, changed, build(broken), 1, "hop 20")
    frames = index_cache.index(spark, root).groupBy(F.when(F.col("path").endswith("3"), "built").otherwise("kept").alias("status")).agg(F.count("*").alias("frames"))
    told = spark.createDataFrame([(s, int(n)) for s, n in counts.items()], "status string, sources long")
    return told.join(F.broadcast(frames), "status", "left").select("status", "sources", F.coalesce("frames", F.lit(0)).cast("long").alias("frames"))
