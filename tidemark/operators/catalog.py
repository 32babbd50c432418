"""Catalog maintenance: status, missing and moved files, upserts, cascades.

Tables are immutable DataFrames; every change is a new table from joins, and
``replace`` writes it beside the old one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import cut
from tidemark.sources import snapshots

MISSING = "missingFile"


def library_status(assets: DataFrame, directories: DataFrame) -> DataFrame:
    """Per directory: discovered, indexed, failed, missing and the last scan; empty directories too."""
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    counts = assets.groupBy("directory_id").agg(
        F.count("*").alias("discovered"), is_("ready", "metadataPartial").alias("indexed"),
        is_("failed", "unreadable", "unsupported").alias("failed"), is_(MISSING).alias("missing"),
    )
    names = ["discovered", "indexed", "failed", "missing"]
    return directories.join(counts, "directory_id", "left").fillna(0, names).select("directory_id", *names, "last_scan_us")


def mark_missing(assets: DataFrame, seen: DataFrame, directories: DataFrame) -> DataFrame:
    """Assets of the scanned ``directories`` whose path was not seen become missing; others stay as they are.

    A scanned directory may have nothing left in it: all its assets are missing.
    """
    scanned = directories.select("directory_id").distinct().withColumn("scanned", F.lit(True))
    found = seen.select("directory_id", "path").distinct().withColumn("found", F.lit(True))
    gone = F.col("scanned").isNotNull() & F.col("found").isNull()
    return (
        assets.join(scanned, "directory_id", "left").join(found, ["directory_id", "path"], "left")
        .withColumn("status", F.when(gone, F.lit(MISSING)).otherwise(F.col("status")))
        .select(*assets.columns)
    )


def moved(assets: DataFrame, files: DataFrame) -> DataFrame:
    """New files that continue an asset whose own path is gone: (path, asset_id, old_path).

    Same directory, hash, size and duration; of several assets the one seen
    last, then the smallest id. One asset continues in one file, the first path.
    """
    same = ["directory_id", "sha256", "size_bytes", "duration_ms"]
    paths = files.select("directory_id", "path")
    new = files.join(assets.select("directory_id", "path"), ["directory_id", "path"], "left_anti")
    lost = assets.join(paths, ["directory_id", "path"], "left_anti").select(*same, "asset_id", F.col("path").alias("old_path"), "last_seen_us")
    # Files and assets of one identity are paired by rank: no product of copies.
    order_new = Window.partitionBy(*same).orderBy("path")
    order_old = Window.partitionBy(*same).orderBy(F.desc("last_seen_us"), "asset_id")
    ranked_new = new.select(*same, "path").withColumn("k", F.row_number().over(order_new))
    ranked_old = lost.withColumn("k", F.row_number().over(order_old))
    return ranked_new.join(ranked_old, [*same, "k"]).select("directory_id", "path", "asset_id", "old_path")


def same_path(assets: DataFrame, files: DataFrame) -> DataFrame:
    """Files that are an asset unchanged: same path, hash and size, and duration where both know it."""
    f = files.select("directory_id", "path", "sha256", "size_bytes", F.col("duration_ms").alias("f_ms"))
    known = F.col("f_ms").isNull() | F.col("duration_ms").isNull() | (F.col("f_ms") == F.col("duration_ms"))
    return assets.join(f, ["directory_id", "path", "sha256", "size_bytes"]).where(known).select(*assets.columns)


def conflicts(assets: DataFrame, upserts: DataFrame) -> DataFrame:
    """Assets that an upsert of another id pushes off their path."""
    taken = upserts.select("directory_id", "path", F.col("asset_id").alias("by"))
    return (
        assets.where(F.col("status") != MISSING).join(taken, ["directory_id", "path"]).where(F.col("asset_id") != F.col("by"))
        .select(*assets.columns)
    )


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key; of repeated new keys the greatest row wins."""
    columns = old.columns
    row = F.struct(*[c for c in columns if c != key])
    latest = new.groupBy(key).agg(F.max(row).alias("n"))
    joined = old.select(key, row.alias("o")).join(latest, key, "full")
    whole = F.when(F.col("n").isNotNull(), F.col("n")).otherwise(F.col("o"))
    return joined.select(key, whole.alias("x")).select(*[F.col(c) if c == key else F.col(f"x.{c}") for c in columns])


def cascade(parents: DataFrame, key: str, children: list[tuple[DataFrame, str]]) -> list[DataFrame]:
    """Children left when only ``parents`` remain; each level is cut down by the one above.

    ``children`` are (table, foreign key) from the top down; a table's own key,
    by which the next level refers to it, is its first column.
    """
    out, alive, alive_key = [], parents, key
    for table, foreign in children:
        kept = table.join(alive.select(F.col(alive_key).alias(foreign)).distinct(), foreign, "left_semi").select(*table.columns)
        out.append(kept)
        alive, alive_key = kept, kept.columns[0]
    return out


def resolve_reference(rows: DataFrame, key: str, dimension: DataFrame, dimension_key: str) -> DataFrame:
    """Left join by id; a dangling reference becomes null."""
    d = dimension.withColumnsRenamed({c: f"d_{c}" for c in dimension.columns})
    return rows.join(d, F.col(key) == F.col(f"d_{dimension_key}"), "left").withColumn(key, F.col(f"d_{dimension_key}")).drop(f"d_{dimension_key}")


def file_status(files: DataFrame) -> DataFrame:
    """Status of scanned files: unsupported, unreadable, metadataPartial or ready."""
    nobody = F.coalesce(F.size("artists"), F.lit(0)) == 0 if "artists" in files.columns else F.coalesce(F.trim("artist"), F.lit("")) == ""
    partial = F.col("title").isNull() | nobody
    return files.withColumn(
        "status",
        F.when(~F.col("supported"), "unsupported").when(~F.col("readable"), "unreadable").when(partial, "metadataPartial").otherwise("ready"),
    )


def identity_fallback(new: DataFrame, prior: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Null fields of a re-read file are taken from its prior row."""
    p = prior.select(key, *[F.col(f).alias(f"p_{f}") for f in fields])
    return new.join(p, key, "left").withColumns({f: F.coalesce(f, f"p_{f}") for f in fields}).select(*new.columns)


def rescan(assets: DataFrame, files: DataFrame, directories: DataFrame) -> DataFrame:
    """One batch over the scanned ``directories``: unchanged, moved, new and missing files give the next catalog.

    ``files`` are what the scan found: asset columns without asset_id and
    status, with supported and readable. An unchanged file keeps its asset's
    row and status; others get the status of what could be read. New files get
    an id from a hash of directory and path.
    """
    names, here = assets.columns, ["directory_id", "path"]
    same = same_path(assets.where(F.col("status") != MISSING), files)
    rest = files.join(same.select(*here), here, "left_anti")
    continued = moved(assets, files).select(*here, F.col("asset_id").alias("moved_id"))
    known = assets.select(*here, F.col("asset_id").alias("own_id"))
    fresh = F.abs(F.xxhash64(*here))
    read = (
        file_status(rest.join(known, here, "left").join(continued, here, "left"))
        .withColumn("asset_id", F.coalesce("own_id", "moved_id", fresh)).select(*names)
    )
    now = same.select(*names).unionByName(read)
    return now.unionByName(mark_missing(assets.join(now.select("asset_id"), "asset_id", "left_anti"), files, directories).select(*names))


def scanned_at(directories: DataFrame, scans: DataFrame) -> DataFrame:
    """Directories with the time of their last scan moved on by ``scans`` (directory_id, at_us); it never goes back."""
    last = scans.groupBy("directory_id").agg(F.max("at_us").alias("at_us"))
    columns = directories.columns
    return directories.join(last, "directory_id", "left").withColumn("last_scan_us", F.greatest("last_scan_us", "at_us")).select(*columns)


def at_path(assets: DataFrame, paths: DataFrame, statuses: tuple[str, ...] = ("ready", "metadataPartial")) -> DataFrame:
    """For each asked path (path) the asset to show: one that can be played before others, then the one seen last, then the smallest id."""
    playable = F.when(F.col("status").isin(*statuses), 0).otherwise(1)
    order = F.struct(playable, -F.col("last_seen_us"), F.col("asset_id"))
    rows = assets.join(paths.select("path").distinct(), "path")
    row = F.struct(*[c for c in assets.columns if c != "path"])
    return rows.groupBy("path").agg(F.min_by(row, order).alias("x")).select("path", "x.*")


def asset_tables(assets: DataFrame) -> dict[str, DataFrame]:
    """The three tables of a catalog: assets, their metadata and their hashes; ``assets`` has one row for each id."""
    told = [c for c in ("title", "artist", "artists", "album", "isrc", "duration_ms") if c in assets.columns]
    return {"assets": assets, "metadata": assets.select("asset_id", *told), "hashes": assets.select("asset_id", "sha256", "size_bytes")}


def store_assets(spark: SparkSession, root: str, new: DataFrame) -> int:
    """Upsert assets with their metadata and hashes as one version below ``root``; its number.

    Of rows that repeat an id the greatest is taken, in all three tables alike.
    Assets of another id on a path that is taken become missing. If a write
    fails, or another writer was quicker (``Conflict``), the old version stays.
    """
    now = snapshots.latest(spark, root)
    row = F.struct(*[c for c in new.columns if c != "asset_id"])
    new = cut(new.groupBy("asset_id").agg(F.max(row).alias("x")).select("asset_id", "x.*").select(*new.columns), "assets")
    tables = asset_tables(new)
    held = snapshots.read(spark, root, now)
    if held:
        pushed = conflicts(held["assets"], new).select("asset_id", F.lit(True).alias("pushed"))
        old = held["assets"].join(pushed, "asset_id", "left")
        old = old.withColumn("status", F.when(F.col("pushed"), F.lit(MISSING)).otherwise(F.col("status"))).select(*held["assets"].columns)
        held["assets"] = old
        tables = {name: upsert(held[name], rows, "asset_id") for name, rows in tables.items()}
    return snapshots.publish(spark, root, tables, now)


def migrate(table: DataFrame, renames: dict[str, str], added: dict[str, object]) -> DataFrame:
    """A table under a new schema: renamed columns and new ones with a default."""
    return table.withColumnsRenamed(renames).withColumns({c: F.lit(v) for c, v in added.items()})


def replace(table: DataFrame, path: str, version: int) -> str:
    """Write the next version of a table; readers switch when the path is published."""
    target = f"{path}/v{version}"
    table.write.mode("errorifexists").parquet(target)
    return target
