"""Cache of reference indexes: only what has changed is built again, and JSON indexes are converted once.

The cache is two tables of one snapshot: ``manifest``, one row for each source
with what its index was made from, and ``frames``, which new parts are added to.
A manifest row names the part that holds its frames, so frames of an older
build are out of sight at once and no file is written again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import cut
from tidemark.sources import snapshots
from tidemark.sources.files import stale

IDENTITY = "path string, size_bytes long, modified timestamp, sha256 string, config string"
MANIFEST = f"{IDENTITY}, version int, part string"
# Fixed value: the version of the JSON layout that is understood.
JSON_VERSION = 2
SUFFIX = ".reference-index.json"


def _held(spark: SparkSession, root: str) -> tuple[int, dict[str, DataFrame]]:
    now = snapshots.latest(spark, root)
    return now, snapshots.read(spark, root, now)


def index(spark: SparkSession, root: str) -> DataFrame:
    """Frames of all sources in the cache, each from the build that its manifest row names."""
    tables = snapshots.read(spark, root)
    return tables["frames"].join(tables["manifest"].select("path", "part").hint("merge"), ["path", "part"], "left_semi").drop("part")


def refresh(spark: SparkSession, root: str, sources: DataFrame, build, version: int, config: str) -> dict[str, int]:
    """Build what is stale, forget what is gone, publish both at once; counts of kept, built, failed and gone.

    sources: path, size_bytes, modified and sha256, one row for each path.
    ``build`` takes the stale rows and returns frames: path, any columns, and a
    text ``problem``, null but for sources that cannot be read. A failed source
    has no entry, so the next run tries it again. A source with a null hash is
    always built. Where nothing has changed nothing is written.
    """
    now, held = _held(spark, root)
    wanted = sources.select("path", "size_bytes", F.col("modified").cast("timestamp").alias("modified"), "sha256", F.lit(config).alias("config"))
    old = held.get("manifest", spark.createDataFrame([], MANIFEST))
    todo = cut(stale(old, wanted, version), "stale")
    same = ["path", "size_bytes", "modified", "sha256", "config"]
    kept = old.where(F.col("version") == version).join(wanted.hint("merge"), same, "left_semi").select(*old.columns)
    n_kept, n_todo = kept.count(), todo.count()
    gone = old.join(wanted.select("path").hint("merge"), "path", "left_anti").count()
    counts = {"kept": n_kept, "built": 0, "failed": 0, "gone": gone}
    if not n_todo and not gone:
        return counts
    # joins by source go by a shuffle: Parquet holds many paths in few bytes, so what Spark takes for small would fill the driver
    part = uuid.uuid4().hex
    frames = cut(build(todo).withColumn("part", F.lit(part)), "frames")
    bad = frames.where("problem is not null").select("path").distinct().hint("merge")
    good = todo.join(bad, "path", "left_anti")
    entries = good.select(*same, F.lit(version).alias("version"), F.lit(part).alias("part"))
    fresh = frames.join(bad, "path", "left_anti").drop("problem")
    snapshots.publish(spark, root, {"manifest": kept.unionByName(entries)}, now, {"frames": fresh})
    counts["failed"] = bad.count()
    counts["built"] = n_todo - counts["failed"]
    return counts


def read_json(spark: SparkSession, root: str, frame: str, suffix: str = SUFFIX) -> DataFrame:
    """JSON indexes below ``root``: file, path, size_bytes, modified, sha256, config, frames and problem.

    ``frame`` is the type of one frame. ``problem`` says why a file is no index:
    it is not whole JSON, of another version, or lacks a required field.
    """
    identity = "standardizedPath: string, fileSizeBytes: long, modificationTimeSince1970: double, sha256: string"
    schema = f"schemaVersion int, sourceDisplayPath string, sourceFileIdentity struct<{identity}>, featureConfiguration string, frames array<struct<{frame}>>, broken string"
    rows = (
        spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}")
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(root)
    )
    problem = (
        F.when(F.col("broken").isNotNull(), "no whole JSON").when(F.col("schemaVersion").isNull() | (F.col("schemaVersion") != JSON_VERSION), "another version")
        .when(F.col("sourceDisplayPath").isNull() | F.col("frames").isNull() | F.col("featureConfiguration").isNull(), "a field is missing")
    )
    who = F.col("sourceFileIdentity")
    return rows.select(
        F.col("_metadata.file_path").alias("file"), F.col("sourceDisplayPath").alias("path"), who["fileSizeBytes"].alias("size_bytes"),
        F.timestamp_micros((who["modificationTimeSince1970"] * 1_000_000).cast("long")).alias("modified"), who["sha256"].alias("sha256"),
        F.col("featureConfiguration").alias("config"), "frames", problem.alias("problem"),
    )


def convert(spark: SparkSession, json_root: str, root: str, frame: str, overwrite: bool = False, suffix: str = SUFFIX) -> DataFrame:
    """Take JSON indexes into the cache; the rows say what became of each file: file, status and problem.

    A file whose source is in the cache is skipped unless ``overwrite``; a broken
    one is failed and holds up no other; of files for one source the last by name
    is taken and the others are skipped. Nothing converted publishes nothing.
    """
    now, held = _held(spark, root)
    found = cut(read_json(spark, json_root, frame, suffix), "json")
    old = held.get("manifest", spark.createDataFrame([], MANIFEST))
    there = old.select("path", F.lit(True).alias("there")).distinct().hint("merge")
    rank = F.row_number().over(Window.partitionBy("path", F.col("problem").isNull()).orderBy(F.desc("file")))
    judged = found.withColumn("rank", rank).join(there, "path", "left")
    skip = (F.col("rank") > 1) | (F.lit(not overwrite) & F.col("there").isNotNull())
    status = F.when(F.col("problem").isNotNull(), "failed").when(skip, "skipped").otherwise("converted")
    judged = cut(judged.withColumn("status", status).drop("rank", "there"), "judged")
    taken = judged.where("status = 'converted'")
    if not taken.isEmpty():
        part = F.lit(uuid.uuid4().hex)
        entries = taken.select("path", "size_bytes", "modified", "sha256", "config", F.lit(JSON_VERSION).alias("version"), part.alias("part"))
        frames = taken.select("path", F.inline("frames")).withColumn("part", part)
        rest = old.join(entries.select("path").hint("merge"), "path", "left_anti").select(*entries.columns)
        snapshots.publish(spark, root, {"manifest": rest.unionByName(entries)}, now, {"frames": frames})
    return judged.select("file", "status", "problem")
