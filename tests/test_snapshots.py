"""Snapshots of several tables, the index cache and its conversion job."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import catalog
from tidemark.sources import index_cache, snapshots

ASSET = "asset_id long, directory_id int, path string, sha256 string, size_bytes long, duration_ms long, title string, artist string, album string, isrc string, status string"


def asset(n, path, title="t", sha="s"):
    return (n, 1, path, sha, 10, 1000, title, "a", "l", None, "ready")


def fails(spark, schema):
    return spark.range(3).select(*[F.raise_error(F.lit("no")).cast(f.dataType).alias(f.name) for f in schema])


def test_three_tables_or_none(spark, tmp_path):
    root = str(tmp_path / "catalog")
    assert snapshots.latest(spark, root) == 0 and snapshots.read(spark, root) == {}
    rows = spark.createDataFrame([asset(1, "x"), asset(2, "y"), asset(2, "y", "u")], ASSET)
    assert catalog.store_assets(spark, root, rows) == 1
    first = snapshots.read(spark, root)
    assert {n: t.count() for n, t in first.items()} == {"assets": 2, "metadata": 2, "hashes": 2}
    assert first["metadata"].where("asset_id = 2").first().title == "u"

    bad = catalog.asset_tables(rows)
    bad["hashes"] = fails(spark, bad["hashes"].schema)
    with pytest.raises(Exception, match="no"):
        snapshots.publish(spark, root, bad, 1)
    assert snapshots.latest(spark, root) == 1 and len(list((tmp_path / "catalog/data").iterdir())) == 1

    assert catalog.store_assets(spark, root, spark.createDataFrame([asset(3, "x", sha="z")], ASSET)) == 2
    second = snapshots.read(spark, root)
    assert {r.asset_id: r.status for r in second["assets"].collect()} == {1: "missingFile", 2: "ready", 3: "ready"}
    joined = second["assets"].join(second["metadata"].drop("duration_ms"), "asset_id").join(second["hashes"].withColumnRenamed("sha256", "h"), "asset_id")
    assert joined.where("sha256 = h").count() == 3
    assert {r.asset_id: r.status for r in snapshots.read(spark, root, 1)["assets"].collect()} == {1: "ready", 2: "ready"}
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(spark, root, catalog.asset_tables(rows), 1)
    assert snapshots.latest(spark, root) == 2
    assert not list((tmp_path / "catalog/drafts").glob("[!.]*"))


def test_appended_rows_keep_the_files(spark, tmp_path):
    root = str(tmp_path / "s")
    one = spark.range(2)
    snapshots.publish(spark, root, {"a": one, "b": one}, 0)
    snapshots.publish(spark, root, {}, 1, {"a": spark.range(5, 6)})
    now = snapshots.read(spark, root)
    assert sorted(r.id for r in now["a"].collect()) == [0, 1, 5] and now["b"].count() == 2
    with pytest.raises(ValueError):
        snapshots.publish(spark, root, {"a": one}, 2, {"a": one})


SOURCE = "path string, size_bytes long, modified timestamp, sha256 string"


def source(path, size=1, sha="s", day=1):
    return (path, size, datetime(2024, 1, day), sha)


def test_only_stale_sources_are_built(spark, tmp_path):
    root, built = str(tmp_path / "cache"), []

    def build(rows):
        built.append(sorted(r.path for r in rows.collect()))
        return rows.select("path", F.col("size_bytes").alias("frame"), F.when(F.col("path") == "bad", "broken file").alias("problem"))

    def refresh(rows, version=1, config="c"):
        return index_cache.refresh(spark, root, spark.createDataFrame(rows, SOURCE), build, version, config)

    def frames():
        return sorted((r.path, r.frame) for r in index_cache.index(spark, root).collect())

    assert refresh([source("a"), source("b"), source("bad")]) == {"kept": 0, "built": 2, "failed": 1, "gone": 0}
    assert frames() == [("a", 1), ("b", 1)]
    assert refresh([source("a"), source("b")]) == {"kept": 2, "built": 0, "failed": 0, "gone": 0}
    assert len(built) == 1 and snapshots.latest(spark, root) == 1
    assert refresh([source("a", 7), source("b")]) == {"kept": 1, "built": 1, "failed": 0, "gone": 0}
    assert built[-1] == ["a"] and frames() == [("a", 7), ("b", 1)]
    for changed in (source("b", sha="t"), source("b", day=2)):
        assert refresh([source("a", 7), changed])["built"] == 1 and built[-1] == ["b"]
    assert refresh([source("a", 7)]) == {"kept": 1, "built": 0, "failed": 0, "gone": 1}
    assert frames() == [("a", 7)]
    assert refresh([source("a", 7)], version=2)["built"] == 1
    assert refresh([source("a", 7)], version=2, config="d")["built"] == 1
    assert refresh([source("a", 7, None)], version=2, config="d")["built"] == 1
    assert refresh([source("a", 7, None)], version=2, config="d")["built"] == 1


def test_conversion_counts(spark, tmp_path):
    folder, root = tmp_path / "json", str(tmp_path / "cache")
    folder.mkdir()

    def put(name, **changes):
        whole = {"schemaVersion": 2, "sourceDisplayPath": f"/m/{name}", "sourceFileIdentity": {"standardizedPath": f"/m/{name}", "fileSizeBytes": 4, "modificationTimeSince1970": 1.5, "sha256": "s"}, "featureConfiguration": {"hop": 20}, "frames": [{"at": 0.0}, {"at": 20.0}]}
        (folder / f"{name}.reference-index.json").write_text(json.dumps({**whole, **changes}, indent=1))

    put("a")
    put("b")
    put("old", schemaVersion=1)
    put("bare", frames=None)
    put("z", sourceDisplayPath="/m/a")
    (folder / "torn.reference-index.json").write_text('{"schemaVersion": 2, "frames": [')
    (folder / "other.json").write_text("{}")

    def run(**how):
        rows = index_cache.convert(spark, str(folder), root, "at: double", **how).collect()
        return {r.file.rsplit("/", 1)[1].split(".")[0]: r.status for r in rows}

    failed = {"old": "failed", "bare": "failed", "torn": "failed"}
    assert run() == {"a": "skipped", "b": "converted", "z": "converted", **failed}
    assert sorted((r.path, r.at) for r in index_cache.index(spark, root).collect()) == [("/m/a", 0.0), ("/m/a", 20.0), ("/m/b", 0.0), ("/m/b", 20.0)]
    assert run() == {"a": "skipped", "b": "skipped", "z": "skipped", **failed}
    assert snapshots.latest(spark, root) == 1
    put("b", frames=[{"at": 5.0}])
    assert run(overwrite=True)["b"] == "converted"
    assert sorted((r.path, r.at) for r in index_cache.index(spark, root).collect()) == [("/m/a", 0.0), ("/m/a", 20.0), ("/m/b", 5.0)]
    # What was converted is valid for the source it names, and for no other.
    held = snapshots.read(spark, root)["manifest"].where("path = '/m/b'")
    assert index_cache.stale(held, held.drop("version", "part"), 2).count() == 0 and index_cache.stale(held, held.drop("version", "part"), 3).count() == 1


def test_local_folders_are_refused_on_a_cluster():
    from tidemark.session import check_shared

    for folder, master in (("file:/tmp/w", "local[4]"), ("/tmp/w", "local"), ("hdfs://n/w", "yarn"), ("s3a://b/w", "spark://h:7077")):
        check_shared(folder, master)
    for folder, master in (("file:/tmp/w", "spark://h:7077"), ("/tmp/w", "yarn"), ("/tmp/w", "local-cluster[2,1,1024]")):
        with pytest.raises(ValueError, match="checkpoint.dir"):
            check_shared(folder, master)


def test_replay_cases(spark, tmp_path):
    from tidemark.sources import files

    side = {"name": "n", "timesPath": "t", "pcenPath": "p"}
    case = {"id": "a", "reference": side, "query": side, "calls": [{"startIndex": 0, "endIndex": 4, "elapsedMS": 80.0}], "bands": 8}
    (tmp_path / "good.jsonl").write_text(json.dumps(case) + "\n" + json.dumps({**case, "id": "b", "bands": None}) + "\n")
    rows = {r.id: r for r in files.read_cases(spark, str(tmp_path / "good.jsonl")).collect()}
    assert rows["a"].calls[0].endIndex == 4 and rows["a"].bands == 8 and rows["b"].bands is None and rows["a"].query.energyPath is None
    (tmp_path / "lacks.jsonl").write_text(json.dumps({**case, "query": {"timesPath": "t"}}) + "\n")
    with pytest.raises(Exception, match="without a required field: a"):
        files.read_cases(spark, str(tmp_path / "lacks.jsonl")).collect()
    (tmp_path / "torn.jsonl").write_text('{"id": ')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        files.read_cases(spark, str(tmp_path / "torn.jsonl")).collect()
