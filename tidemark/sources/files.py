"""File sources and sinks: directory scans, raw arrays, charts, sidecars, traces. Audio lies in ``audio``."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scan_directory(spark: SparkSession, root: str, recursive: bool = True, hidden: bool = False) -> DataFrame:
    """path, name, extension, size_bytes and modified of regular files; a missing root raises."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root).drop("content")
    name = F.element_at(F.split("path", "/"), -1)
    files = files.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("extension"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))
    return files if hidden else files.where(~F.startswith("name", F.lit(".")))


def file_hashes(spark: SparkSession, root: str) -> DataFrame:
    """path, sha256 and size of every file below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))


def mix_down(samples, channels: int):
    """Mean over interleaved channels of an array column."""
    n = F.floor(F.size(samples) / channels).cast("int")
    at = lambda i: F.slice(samples, i * channels + 1, F.lit(channels))
    mean = lambda i: F.aggregate(at(i), F.lit(0.0), lambda s, x: s + x) / F.lit(float(channels))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), mean)).otherwise(F.array().cast("array<double>"))


def read_raw(spark: SparkSession, root: str, kind: str = "f8") -> DataFrame:
    """path and values of files of little-endian numbers (f8 or f4); a size that does not fit raises."""
    size = int(kind[1])
    files = spark.read.format("binaryFile").load(root)

    def run(batches):
        for p in batches:
            for path, content in zip(p["path"], p["content"]):
                if len(content) % size:
                    raise ValueError(f"{path}: {len(content)} bytes are no whole numbers")
                yield pd.DataFrame({"path": [path], "values": [np.frombuffer(content, f"<{kind}").astype(float)]})

    return files.select("path", "content").mapInPandas(run, "path string, values array<double>")


def read_charts(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """chart_id (path) and whole text of chart files."""
    return spark.read.option("wholetext", "true").option("pathGlobFilter", glob).text(root).select(F.input_file_name().alias("chart_id"), F.col("value").alias("text"))


SIDECAR = "recordingID string, createdAt string, durationMS double, audioFileName string, sampleRate double, channelCount int"


def read_sidecars(spark: SparkSession, root: str, suffix: str, audio: DataFrame) -> DataFrame:
    """Sidecars whose audio file lies beside them; only bare file names count, so none can leave its folder.

    audio: path. Rows are in order of path.
    """
    rows = spark.read.schema(SIDECAR).option("multiLine", "true").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").json(root)
    folder = lambda c: F.regexp_replace(c, r"/[^/]*$", "")
    # Metadata quotes what ``binaryFile`` does not.
    rows = rows.withColumn("path", F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))).withColumn("folder", folder(F.col("path")))
    bare = rows.where(F.col("audioFileName").rlike(r"^[^/\\]+$") & ~F.col("audioFileName").isin(".", ".."))
    there = audio.select(folder(F.col("path")).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("audioFileName"))
    return bare.join(there, ["folder", "audioFileName"], "left_semi").orderBy("path")


def write_trace(rows: DataFrame, path: str) -> None:
    """JSON lines with sorted keys; infinite and undefined numbers are texts, as Spark writes them."""
    rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value")).write.mode("errorifexists").text(path)


FEATURES = "struct<name: string, hopMS: double, timesPath: string, pcenPath: string, energyPath: string>"
CASES = f"id string, reference {FEATURES}, query {FEATURES}, calls array<struct<startIndex: long, endIndex: long, elapsedMS: double>>, bands int, energyDBFS double"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Replay cases, one JSON object a line; a line that is none, or lacks a required field, raises."""
    rows = spark.read.schema(CASES).option("mode", "FAILFAST").json(path)
    whole = F.col("id").isNotNull() & F.col("calls").isNotNull()
    for side in ("reference", "query"):
        whole &= F.col(side)["timesPath"].isNotNull() & F.col(side)["pcenPath"].isNotNull()
    return rows.withColumn("id", F.when(whole, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("case without a required field: "), F.coalesce("id", F.lit("?"))))))


def stale(manifest: DataFrame, sources: DataFrame, version: int) -> DataFrame:
    """Sources whose cached index is absent or made from another version, size, time or content."""
    same = ["path", "size_bytes", "modified", "sha256", "config"]
    # by a shuffle: a manifest has a row for each source, of which small files hold many
    return sources.join(manifest.where(F.col("version") == version).hint("merge"), same, "left_anti")


def read_env(paths: list[str]) -> dict[str, str]:
    """Settings of the first file that exists: ``key=value`` lines, ``export``, comments and quotes."""
    for path in paths:
        if not os.path.isfile(path):
            continue
        out = {}
        with open(path, encoding="utf-8") as f:
            for line in f:
                line = line.strip().removeprefix("export ").lstrip()
                key, found, value = line.partition("=")
                if not found or line.startswith("#"):
                    continue
                value = value.strip()
                if value[:1] in "\"'" and value[:1]:
                    end = value.find(value[0], 1)
                    value = value[1:end] if end > 0 else value[1:]
                else:
                    value = value.partition(" #")[0].rstrip()
                out.setdefault(key.strip(), value)
        return out
    return {}


def clip(samples: DataFrame, rate: float, start_s: float, duration_s: float) -> DataFrame:
    """Samples (position, ...) of a clip; cut at the end of what there is."""
    first, n = int(start_s * rate), round(duration_s * rate)
    return samples.where(F.col("position").between(first, first + n - 1))


def growing_clip(blocks: DataFrame, key: str, order: str, samples: str, most: int) -> DataFrame:
    """The first ``most`` samples of each key's blocks; the last block is cut."""
    before = F.coalesce(F.sum(F.size(samples)).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = blocks.withColumn("before", before).where(F.col("before") < most)
    return rows.withColumn(samples, F.slice(samples, F.lit(1), F.least(F.size(samples), (F.lit(most) - F.col("before")).cast("int")))).drop("before")
