import zlib

import pytest
import xxhash

from tidemark.llm import shard


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute(rows, shards=8, whole_share=0.05):
    """(id, shard, slot range of its equal rows) by one plain walk of all pieces in order."""
    size = lambda t: len((t or "").encode()) + 1
    key = lambda t: 42 if t is None else signed(xxhash.xxh64_intdigest(t.encode(), 42))
    total, groups = sum(size(t) for _, t, *_ in rows), {}
    for d, t, *_ in rows:
        groups.setdefault(key(t), []).append((d, t))
    most, units = whole_share * total / shards, []
    for k, own in sorted(groups.items()):
        sized, seen, parts = sum(size(t) for _, t in own), {}, {}
        pieces = -int(-sized // (most / 4)) if sized > most else 1
        for d, t in own:
            n = seen[d] = seen.get(d, -1) + 1
            h = xxhash.xxh64_intdigest(n.to_bytes(8, "little"), xxhash.xxh64_intdigest(str(d).encode(), 42) if d is not None else 42)
            parts.setdefault(signed(h) % pieces, []).append((d is not None, d or 0, size(t), t))
        units += [(k, p, sorted(x, key=lambda r: r[:3])) for p, x in sorted(parts.items())]
    out, before, slots = [], 0, [0] * shards
    for _, _, own in units:
        took = sum(r[2] for r in own)
        at = min(shards - 1, int(shards * (before + took / 2) / total))
        before += took
        for named, d, n, t in own:
            out.append((d if named else None, n, zlib.crc32((t or "").encode()), at, slots[at]))
            slots[at] += 1
    return sorted(out, key=str)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, size long, shard string")


def verify(rows, got, shards):
    assert len(got) == len(rows)
    want = sorted((r[0] if r[0] is not None else -1, len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert want == sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in got)
    for k in range(shards):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got), key=str) == brute(rows, shards)
    assert {r.law for r in got} <= {"bytes"} and all(r.grown_shard is None for r in got)


def test_sizes_are_near_equal_and_groups_whole(spark):
    rows = [(i, f"text {i % 700} " + "x" * (i % 700 % 97), 1, "a") for i in range(2000)]
    got = shard.assign(docs(spark, rows), shards=4).collect()
    verify(rows, got, 4)
    sizes = [sum(r.size for r in got if r.shard == k) for k in range(4)]
    assert max(sizes) - min(sizes) < 0.05 * sum(sizes) / 4
    of = {}
    for r in got:
        of.setdefault(rows[r.doc_id][1], set()).add(r.shard)
    assert all(len(x) == 1 for x in of.values())


def test_hot_group_is_subdivided(spark):
    rows = [(i, "copy" * 5 if i % 3 else f"own {i}", 1, "a") for i in range(1500)]
    got = shard.assign(docs(spark, rows)).collect()
    verify(rows, got, 8)
    sizes = [sum(r.size for r in got if r.shard == k) for k in range(8)]
    assert max(sizes) < 1.1 * sum(sizes) / 8 and min(sizes) > 0.9 * sum(sizes) / 8


def test_one_id_with_one_text_is_subdivided(spark):
    rows = [(None, "copy" * 4, 1, "a")] * 3000 + [(i, f"own {i}", 1, "a") for i in range(300)]
    got = shard.assign(docs(spark, rows).repartition(5)).collect()
    verify(rows, got, 8)
    sizes = [sum(r.size for r in got if r.shard == k) for k in range(8)]
    assert max(sizes) < 1.15 * sum(sizes) / 8 and min(sizes) > 0.85 * sum(sizes) / 8


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    monkeypatch.setattr(shard, "RANGES", 3)
    monkeypatch.setattr(shard, "RANGE_UNITS", 40)
    monkeypatch.setattr(shard, "PIECE_ROWS", 50)
    rows = [(i, f"text {i} " + "x" * (9000 if i == 5 else i % 40), 1, "a") for i in range(900)]
    verify(rows, shard.assign(docs(spark, rows), shards=5).collect(), 5)


@pytest.mark.parametrize("rows", [[], [(1, None, 0, "x")], [(1, "", 0, "x"), (1, "", 0, "x"), (None, None, 0, None), (2, "é" * 50_000, 0, "x")]])
def test_edge_cases(spark, rows):
    verify(rows, shard.assign(docs(spark, rows)).collect(), 8)


def test_reruns_agree_and_shards_are_written(spark, tmp_path):
    rows = [(i, f"t{i}", 1, "a") for i in range(200)] + [(7, "t7", 1, "a"), (None, None, 1, "b"), (7, "other", 2, "c")]
    d = docs(spark, rows)
    a, b = (sorted(map(tuple, shard.assign(x).collect()), key=str) for x in (d, d.repartition(7)))
    assert a == b
    shard.write_shards(d, f"{tmp_path}/out", files=2)
    back = spark.read.parquet(f"{tmp_path}/out").collect()
    crc = lambda t: zlib.crc32((t or "").encode())
    assert sorted(((r.doc_id, crc(r.text), r.shard, r.slot) for r in back), key=str) == sorted(((r[0], r[2], r[4], r[5]) for r in a), key=str)
