"""Several tables published at once: staged files and one pointer that every reader resolves.

A version is a small file that names the folders of all its tables. It is put in
place by one rename that never overwrites, after the folders are complete: a
reader sees all tables of a version or none, and of two writers that start from
one version the second fails. Folders are never changed once written.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has published since the version that this one started from."""


def _hadoop(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    return hadoop, where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def latest(spark: SparkSession, root: str) -> int:
    """The newest version below ``root``; 0 before the first."""
    _, where, fs = _hadoop(spark, f"{root}/versions")
    if not fs.exists(where):
        return 0
    names = [f.getPath().getName() for f in fs.listStatus(where)]
    return max((int(n) for n in names if n.isdigit()), default=0)


def _pointer(spark: SparkSession, root: str, version: int) -> dict:
    text = spark.read.option("wholetext", "true").text(f"{root}/versions/{version:010d}").first()
    return json.loads(text[0])


def read(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """All tables of one version, the newest by default; none before the first version."""
    version = latest(spark, root) if version is None else version
    if not version:
        return {}
    found = _pointer(spark, root, version)
    return {name: spark.read.schema(StructType.fromJson(t["schema"])).parquet(*t["paths"]) for name, t in found.items()}


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], after: int, append: dict[str, DataFrame] | None = None) -> int:
    """Write ``tables`` and publish them as version ``after`` + 1; raise Conflict if it exists.

    ``append`` holds rows that are added to a table of version ``after``, whose
    files stay as they are; tables not named are carried over. Nothing is
    published, and what was staged is removed, if any write fails.
    """
    append = append or {}
    if both := tables.keys() & append.keys():
        raise ValueError(f"tables both replaced and appended to: {sorted(both)}")
    stage, number = f"{root}/data/{uuid.uuid4().hex}", after + 1
    pointer = _pointer(spark, root, after) if after else {}
    try:
        for name, rows in {**tables, **append}.items():
            old = pointer.get(name, {}).get("paths", []) if name in append else []
            rows.write.parquet(f"{stage}/{name}")
            pointer[name] = {"paths": [*old, f"{stage}/{name}"], "schema": json.loads(rows.schema.json())}
        _put(spark, root, number, json.dumps(pointer))
    except BaseException:
        _, where, fs = _hadoop(spark, stage)
        fs.delete(where, True)
        raise
    return number


def _put(spark: SparkSession, root: str, number: int, text: str) -> None:
    hadoop, draft, fs = _hadoop(spark, f"{root}/drafts/{uuid.uuid4().hex}")
    target = hadoop.Path(f"{root}/versions/{number:010d}")
    fs.mkdirs(target.getParent())
    out = fs.create(draft, False)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    if fs.exists(target):
        fs.delete(draft, False)
        raise Conflict(f"version {number} exists")
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        context.rename(draft, target, no_options)  # fails, and does not overwrite, if another was quicker
    except Exception as e:
        if fs.exists(target) and fs.exists(draft):
            fs.delete(draft, False)
            raise Conflict(f"version {number} exists") from e
        raise
