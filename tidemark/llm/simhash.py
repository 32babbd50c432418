"""SimHash near-duplicates by tiled exact comparison.

Every document gets a 64-bit fingerprint of its word shingles. Equal
fingerprints form a class and only classes are compared. Classes are put into
tiles by the population counts of the fingerprint's four quarters; two
fingerprints that differ in at most ``radius`` bits have quarter counts that
differ by at most ``radius`` in sum, so all other pairs of tiles are skipped.
The rest are compared in full with numpy: exclusive or, then bit counts. A pair
of tiles reports a minimum spanning forest of its links, never all pairs of a
group. A component of such links can be held against the similarity of the
texts themselves: all its pairs are compared, and the true links alone count.
For that, fingerprints are made of the set of shingles, may have several times
64 bits, and their tiles go by the number of shingles, as sets whose sizes are
too far apart cannot reach the similarity.
"""

from __future__ import annotations

import math
from itertools import accumulate, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow
from tidemark.llm.components import components
from tidemark.session import cut

SEED = 42
#: Shingles hashed at once, and the fingerprints of a tile.
CHUNK, TILE = 50_000, 2048
QUARTERS = 4
#: Texts, and shingles, of a part of a component whose texts are compared.
PART, PART_SHINGLES = 512, 65_536
#: Left parts that meet a right part in one key.
RUN = 8


def fingerprint(text: str | None, words: int = 3) -> int:
    """Bits set in over half the XXH64 values of the text's word shingles."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    ends = list(accumulate(parts, lambda at, w: at + 1 + len(w), initial=-1))[1:]
    if len(parts) <= words:
        spans = [(0, len(joined))]
    else:
        spans = list(zip([0, *[e + 1 for e in ends]], ends[words - 1 :]))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(spans), CHUNK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans[at : at + CHUNK]], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(spans), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, keep: list[str] | None = None) -> DataFrame:
    """``id`` and ``fp``, the fingerprint as a signed 64-bit integer, of every row, and the long columns ``keep``."""
    kind, keep = docs.schema[id_col].dataType.simpleString(), keep or []

    def step(t: pa.Table) -> pa.Table:
        found = np.array([fingerprint(x, words) for x in t.column(1).to_pylist()], np.uint64)
        return pa.table({"id": t.column(0), "fp": pa.array(found.view(np.int64)), **{c: t.column(2 + i) for i, c in enumerate(keep)}})

    return map_arrow(docs.select(id_col, text_col, *keep), step, ", ".join([f"id {kind}, fp long", *(f"{c} long" for c in keep)]))


def forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool = False) -> list[tuple[int, int, int]]:
    """Minimum spanning forest of the close pairs of two tiles: (bits apart, position in a, in b).

    Whatever pairs of at most some number of bits join, its links of at most as
    many bits join too; forests of parts of a graph hold the forest of the
    whole. ``same`` says that the tiles are one.
    """
    offset = 0 if same else len(a)
    kept: list[tuple[int, int, int]] = []
    for at in range(0, len(a), 256):
        apart = np.bitwise_count(a[at : at + 256, None] ^ b[None, :])
        i, j = np.nonzero(apart <= radius)
        bits = apart[i, j]
        i = i + at
        if same:
            i, j, bits = i[i < j], j[i < j], bits[i < j]
        if not len(i):
            continue
        root = list(range(offset + len(b)))
        links, kept = sorted([*kept, *zip(bits.tolist(), i.tolist(), (j + offset).tolist())]), []
        for link in links:
            u, v = link[1], link[2]
            while root[u] != u:
                root[u] = root[root[u]]
                u = root[u]
            while root[v] != v:
                root[v] = root[root[v]]
                v = root[v]
            if u != v:
                root[u] = v
                kept.append(link)
    return [(d, i, j - offset) for d, i, j in kept]


def runs(reached: DataFrame, *keys: str) -> DataFrame:
    """For each place ``to`` that left parts (``part``) reach, beyond one run of RUN of them: ``runs``, the numbers of all.

    A right part is sent once for each run, so that however many parts meet it
    no key has more than RUN of each kind.
    """
    last = F.floor(F.max("part") / RUN).cast("int")
    return reached.groupBy(*keys, "to").agg(last.alias("last")).where("last > 0").select(*keys, "to", F.sequence(F.lit(0), "last").alias("runs"))


def _run() -> Column:
    return F.floor(F.col("part") / RUN).cast("int").alias("run")


def _by_run(right: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    return right.join(known, [*keys, "to"], "left").withColumn("run", F.explode(F.coalesce("runs", F.array(F.lit(0))))).drop("runs")


def tile_links(classes: DataFrame, radius: int, blocks: int, tile: int) -> DataFrame:
    """Links (u, v) between the fingerprints of all pairs of tiles that can hold any."""
    bits = 64 // blocks
    mask = (1 << bits) - 1
    blocked = [F.shiftrightunsigned("fp", bits * k).bitwiseAND(mask) if blocks > 1 else F.col("fp") for k in range(blocks)]
    counted = classes.select("fp", F.array(*[F.bit_count(x) for x in blocked]).alias("counts"))
    # The counts take (bits + 1) ** blocks values at most, whatever the input: a proven bound for both broadcasts.
    sizes = counted.groupBy("counts").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    tiles = cut(
        counted.join(F.broadcast(sizes), "counts")
        .groupBy("counts", F.pmod(F.hash("fp"), F.col("parts")).alias("part"))
        .agg(F.collect_list("fp").alias("fps")),
        "simhash-tiles",
    )
    steps = [d for d in product(range(-radius, radius + 1), repeat=blocks) if sum(map(abs, d)) <= radius and d >= (0,) * blocks]
    ways = F.array(*[F.array(*[F.lit(x) for x in d]) for d in steps])
    known = tiles.groupBy("counts").agg(F.max("part").alias("parts"))
    known = known.select(F.col("counts").alias("to"), F.sequence(F.lit(0), F.col("parts")).alias("to_parts"))
    left = (
        tiles.select("counts", "part", F.col("fps").alias("a"), F.explode(ways).alias("way"))
        .withColumn("to", F.zip_with("counts", "way", lambda x, y: x + y))
        .join(F.broadcast(known), "to")
        .select("counts", "part", "a", "to", F.explode("to_parts").alias("to_part"))
        .where((F.col("counts") != F.col("to")) | (F.col("part") <= F.col("to_part")))
        .withColumn("same", (F.col("counts") == F.col("to")) & (F.col("part") == F.col("to_part")))
    )
    right = tiles.select(F.col("counts").alias("to"), F.col("part").alias("to_part"), F.col("fps").alias("b"))
    reached = tiles.select("part", F.explode(F.transform(ways, lambda way: F.zip_with("counts", way, lambda x, y: x + y))).alias("to"))
    right = _by_run(right, F.broadcast(runs(reached)))

    def step(t: pa.Table) -> pa.Table:
        us, vs = [], []
        for a, b, same in zip(t.column(0), t.column(1), t.column(2).to_pylist()):
            a, b = a.values.to_numpy(), b.values.to_numpy()
            for _, i, j in forest(a.view(np.uint64), b.view(np.uint64), radius, same):
                us.append(int(a[i]))
                vs.append(int(b[j]))
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return map_arrow(left.withColumn("run", _run()).join(right, ["to", "to_part", "run"]).select("a", "b", "same"), step, "u long, v long")


def resemblance(a: str, b: str, words: int) -> float:
    """Jaccard similarity of the texts' sets of word shingles."""

    def shingles(text):
        parts = text.encode().lower().split()
        return {b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """The distinct XXH64 values of the text's word shingles, in order."""
    parts = text.encode().lower().split()
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(parts[i : i + words]), SEED) for i in range(max(1, len(parts) - words + 1))], np.uint64))


def alike(a: pa.ListScalar, b: pa.ListScalar, similarity: float, same: bool) -> list[tuple[int, int]]:
    """Spanning forest (position in a, in b) of all pairs whose sets of hashes have this Jaccard similarity.

    Every pair is compared: the values of ``b`` that are in each set of ``a`` are counted.
    """
    a, b = a.values, b.values
    from_a, from_b = a.offsets.to_numpy(), b.offsets.to_numpy()
    x, y = (v.values.to_numpy()[at[0] : at[-1]] for v, at in ((a, from_a), (b, from_b)))
    from_a, from_b = from_a - from_a[0], from_b - from_b[0]
    _, code = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y = code[: len(x)], code[len(x) :]
    size_a, size_b = np.diff(from_a), np.diff(from_b)
    mark = np.zeros(len(code), np.int32)
    offset = 0 if same else len(size_a)
    label = np.arange(offset + len(size_b))
    kept = []
    for i in range(len(size_a)):
        own = x[from_a[i] : from_a[i + 1]]
        mark[own] = 1
        shared = np.add.reduceat(mark[y], from_b[:-1])
        mark[own] = 0
        near = np.nonzero(shared / (size_a[i] + size_b - shared) >= similarity)[0]
        kept += [(i, j) for j in merge(label, i, near + offset, offset)]
    return kept


def merge(label: np.ndarray, i: int, near: np.ndarray, offset: int) -> list[int]:
    """Join node i with its near nodes in ``label``; the positions of those that were apart from it."""
    joined = []
    for j in near[label[near] != label[i]].tolist():
        if label[j] != label[i]:
            label[label == label[j]] = label[i]
            joined.append(j - offset)
    return joined


def wide_print(hashes: np.ndarray, seeds: int) -> np.ndarray:
    """``seeds`` words of 64 bits, each the majority of the hashes mixed anew with a seed of its own."""
    out = np.empty(seeds, np.uint64)
    for k in range(seeds):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(hashes), CHUNK):
            x = hashes[at : at + CHUNK] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            x = x ^ x >> np.uint64(31)
            counts += np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0]
    return out


def wide_prints(docs: DataFrame, words: int, seeds: int, id_col: str, text_col: str, keep: list[str] | None = None) -> DataFrame:
    """``id``, ``fp``, a digest of the set of shingles, ``sample``, a hash of the text, ``size``, the number of distinct shingles, and ``bits`` of every row, and the long columns ``keep``."""
    kind, keep = docs.schema[id_col].dataType.simpleString(), keep or []

    def step(t: pa.Table) -> pa.Table:
        sets = [shingle_hashes(x, words) for x in t.column(1).to_pylist()]
        digests = np.array([xxhash.xxh64_intdigest(x.astype("<u8").tobytes(), SEED) for x in sets], np.uint64)
        bits = pa.array([wide_print(x, seeds).view(np.int64) for x in sets], pa.list_(pa.int64()))
        size = pa.array([len(x) for x in sets], pa.int32())
        return pa.table({"id": t.column(0), "fp": pa.array(digests.view(np.int64)), "sample": t.column(2), "size": size, "bits": bits, **{c: t.column(3 + i) for i, c in enumerate(keep)}})

    text = F.coalesce(F.col(text_col), F.lit(""))
    schema = ", ".join([f"id {kind}, fp long, sample long, size int, bits array<long>", *(f"{c} long" for c in keep)])
    return map_arrow(docs.select(id_col, text, F.xxhash64(text).alias("sample"), *keep), step, schema)


def band(similarity: float) -> Column:
    """Sets whose sizes are further apart than the similarity lie two bands apart or more. The margin is for rounding."""
    width = -math.log(similarity) * (1 + 1e-9) if similarity < 1 else 1e-12
    return F.floor(F.log("size") / width)


def close(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> list[tuple[int, int]]:
    """Spanning forest (position in a, in b) of all pairs of wide prints, words by texts, that differ in at most ``radius`` bits."""
    offset = 0 if same else a.shape[1]
    label = np.arange(offset + b.shape[1])
    kept = []
    for at in range(0, a.shape[1], 64):
        apart = np.zeros((min(64, a.shape[1] - at), b.shape[1]), np.uint16)
        for x, y in zip(a, b):
            apart += np.bitwise_count(x[at : at + 64, None] ^ y[None, :])
        hit = apart <= radius
        for i in np.nonzero(hit.any(axis=1))[0].tolist():
            kept += [(at + i, j) for j in merge(label, at + i, np.nonzero(hit[i])[0] + offset, offset)]
    return kept


def wide_links(classes: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Candidate links (u, v): all pairs of tiles whose sizes allow the similarity are compared in full."""
    banded = classes.select("fp", "bits", band(similarity).alias("band"))
    # One row for each step of the size by the similarity: a proven bound for both broadcasts.
    sizes = banded.groupBy("band").agg(F.ceil(F.count("*") / (2 * TILE)).cast("int").alias("parts"))
    tiles = cut(
        banded.join(F.broadcast(sizes), "band")
        .groupBy("band", F.pmod(F.hash("fp"), F.col("parts")).alias("part"))
        .agg(F.collect_list(F.struct("fp", "bits")).alias("all"))
        .select("band", "part", F.col("all.fp").alias("fps"), F.flatten("all.bits").alias("bits")),
        "simhash-tiles",
    )
    known = sizes.select(F.col("band").alias("to"), F.sequence(F.lit(0), F.col("parts") - 1).alias("to_parts"))
    left = (
        tiles.select("band", "part", F.col("fps").alias("u"), F.col("bits").alias("a"), F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("to"))
        .join(F.broadcast(known), "to")
        .select("band", "part", "u", "a", "to", F.explode("to_parts").alias("to_part"))
        .where((F.col("band") != F.col("to")) | (F.col("part") <= F.col("to_part")))
        .withColumn("same", (F.col("band") == F.col("to")) & (F.col("part") == F.col("to_part")))
    )
    right = tiles.select(F.col("band").alias("to"), F.col("part").alias("to_part"), F.col("fps").alias("v"), F.col("bits").alias("b"))
    reached = tiles.select("part", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("to"))
    right = _by_run(right, F.broadcast(runs(reached)))

    def step(t: pa.Table) -> pa.Table:
        us, vs = [], []
        for u, v, a, b, same in zip(*t.columns[:4], t.column(4).to_pylist()):
            u, v = u.values.to_numpy(), v.values.to_numpy()
            a, b = (np.ascontiguousarray(x.values.to_numpy().view(np.uint64).reshape(len(n), -1).T) for x, n in ((a, u), (b, v)))
            for i, j in close(a, b, radius, same):
                us.append(int(u[i]))
                vs.append(int(v[j]))
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return map_arrow(left.withColumn("run", _run()).join(right, ["to", "to_part", "run"]).select("u", "v", "a", "b", "same"), step, "u long, v long")


def verified(roots: DataFrame, classes: DataFrame, docs: DataFrame, words: int, similarity: float, text_col: str) -> DataFrame:
    """Links (u, v) between classes whose texts resemble each other enough.

    All pairs of a component of candidate links (fp, root) are compared, so no
    link is missed for another that joined the same classes and failed. A
    component is cut into parts of bounded size. Of two parts only those are
    met whose numbers of shingles allow the similarity, and each meeting
    reports a spanning forest of its true links, never all pairs.
    """
    named = roots.join(classes, "fp").select("fp", "root", "sample")
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(text.alias("text"), F.xxhash64(text).alias("sample")).join(named, "sample").dropDuplicates(["fp"]).select("fp", "root", "text")

    def shingle(t: pa.Table) -> pa.Table:
        sets = [shingle_hashes(x, words) for x in t.column(2).to_pylist()]
        hashes = pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))
        return pa.table({"fp": t.column(0), "root": t.column(1), "size": pa.array([len(x) for x in sets], pa.int32()), "hashes": hashes})

    sets = cut(map_arrow(texts, shingle, "fp long, root long, size int, hashes array<long>").withColumn("band", band(similarity)), "simhash-texts")
    sizes = sets.groupBy("root", "band").agg(F.ceil(F.greatest(F.count("*") / PART, F.sum("size") / PART_SHINGLES)).cast("int").alias("parts"))
    # few are larger than a part: written, so that Spark sees whether they are small enough to be broadcast
    large = cut(sizes.where("parts > 1"), "simhash-large")
    parts = cut(
        sets.join(large, ["root", "band"], "left")
        .groupBy("root", "band", F.pmod(F.hash("fp"), F.coalesce("parts", F.lit(1))).alias("part"))
        .agg(F.collect_list(F.struct("fp", "hashes")).alias("all"))
        .select("root", "band", "part", F.col("all.fp").alias("fps"), F.col("all.hashes").alias("sets")),
        "simhash-parts",
    )
    known = sizes.select("root", F.col("band").alias("to"), F.sequence(F.lit(0), F.col("parts") - 1).alias("to_parts"))
    left = (
        parts.select("root", "band", "part", F.col("fps").alias("u"), F.col("sets").alias("a"), F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("to"))
        .join(known, ["root", "to"])
        .select("root", "band", "part", "u", "a", "to", F.explode("to_parts").alias("to_part"))
        .where((F.col("band") != F.col("to")) | (F.col("part") <= F.col("to_part")))
        .withColumn("same", (F.col("band") == F.col("to")) & (F.col("part") == F.col("to_part")))
        .where(~F.col("same") | (F.size("u") > 1))
    )
    right = parts.select("root", F.col("band").alias("to"), F.col("part").alias("to_part"), F.col("fps").alias("v"), F.col("sets").alias("b"))
    reached = large.select("root", (F.col("parts") - 1).alias("part"), F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("to"))
    right = _by_run(right, runs(reached, "root"), "root")

    def step(t: pa.Table) -> pa.Table:
        us, vs = [], []
        for u, v, a, b, same in zip(*t.columns[:4], t.column(4).to_pylist()):
            for i, j in alike(a, b, similarity, same):
                us.append(u[i].as_py())
                vs.append(v[j].as_py())
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return map_arrow(left.withColumn("run", _run()).join(right, ["root", "to", "to_part", "run"]).select("u", "v", "a", "b", "same"), step, "u long, v long")


def _classes(docs: DataFrame, radius: int, words: int, similarity: float | None, seeds: int, id_col: str, text_col: str, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The fingerprinted rows (id, fp and the columns ``keep``), and each class with its component's root and smallest id."""
    if similarity is None:
        rows = cut(fingerprints(docs, id_col, text_col, words, keep), "simhash-rows")
        classes = cut(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-classes")
        # Quarters prune best at a small radius; at a large one few but larger tiles are sent about.
        links = tile_links(classes, radius, *((QUARTERS, TILE) if radius <= QUARTERS else (1, 4 * TILE)))
        roots = components(links).withColumnRenamed("u", "fp")
    else:
        rows = cut(wide_prints(docs, words, seeds, id_col, text_col, keep), "simhash-rows")
        classes = cut(rows.groupBy("fp").agg(F.min("id").alias("least"), F.min("sample").alias("sample"), F.first("size").alias("size"), F.first("bits").alias("bits")), "simhash-classes")
        roots = components(wide_links(classes, radius, similarity)).withColumnRenamed("u", "fp")
        roots = components(verified(roots, classes, docs, words, similarity, text_col)).withColumnRenamed("u", "fp")
    linked = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows, cut(linked.select("fp", "root").join(ids, "root"), "simhash-components")


def near_duplicates(docs: DataFrame, radius: int = 2, words: int = 3, similarity: float | None = None, id_col: str = "doc_id", text_col: str = "text", seeds: int = 1) -> DataFrame:
    """The fingerprint and the component of every document.

    Returns id_col, fingerprint (16 hex digits) and component_id, the smallest
    id that links of at most ``radius`` differing bits reach, the document's
    own included. A text of fewer words than a shingle is one shingle; null,
    empty and white texts have fingerprint zero and are linked like any other.
    Repeated rows are kept. Rows without an id take part; a component without
    any id gets a null component_id. Other columns are left out. An empty
    table gives no rows.

    With ``similarity``, sets of shingles count: fingerprint is a digest of the
    text's set, ``radius`` counts over ``seeds`` times 64 bits made from it,
    and of the pairs so near those of that Jaccard similarity are the links.
    """
    rows, classes = _classes(docs, radius, words, similarity, seeds, id_col, text_col)
    return rows.join(classes, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def deduplicate(docs: DataFrame, radius: int = 2, words: int = 3, similarity: float | None = None, id_col: str = "doc_id", text_col: str = "text", seeds: int = 1) -> DataFrame:
    """One row of each component, with all its columns.

    The row with the smallest id stays; ids may repeat, so of several rows with
    that id one of the smallest fingerprint stays, and of rows equal in both,
    copies of one text by fingerprint, the one with the smallest hash of text
    and other columns. Very long texts are compared whole. Rows without an id are components' rows like any other
    and stay only where no row has an id. Null, empty and white texts are
    alike. An empty table gives no rows.
    """
    names = docs.columns
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    whole = F.xxhash64(*[x for c in names for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`").cast("string"))])
    # the row is one column, so that no name of its own can clash
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.xxhash64(text).alias("text"), whole.alias("whole"))
    keys = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("text"), whole.alias("whole"), text.alias("t"))
    rows, classes = _classes(keys, radius, words, similarity, seeds, "id", "t", ["text", "whole"])
    # of each class first, so that no component's rows meet in one task
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "fp", "text", "whole"))
    best = rows.groupBy("fp").agg(first.alias("first")).join(classes, "fp").groupBy("root").agg(F.min("first").alias("first"))
    best = cut(best.select("first.text", "first.whole"), "simhash-kept")
    kept = marked.join(best, ["text", "whole"], "left_semi")
    if not rows.groupBy("text", "whole").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["text", "whole"])  # rows equal in all columns share both hashes
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in names])
