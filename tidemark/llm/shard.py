"""Sharding by sampled splitters.

Records are keyed by a hash of their text, so equal texts form one group. A
size-weighted sample of the groups gives quantile boundaries; these splitters
range-partition the groups. The ranges are measured and overfull ones are
subdivided by the key. Running totals over the ranges say where in the byte
line each group lies, and the line is cut into shards of equal bytes. A group
larger than ``whole_share`` of a shard, or of more than PIECE_ROWS rows, is
dealt into pieces by a hash of id and a counter among equal rows first, so no
group and no task stays large. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import numbered
from tidemark.session import cut

#: Least number of ranges, groups of a range (expected) beyond it, and sampled groups for each range.
RANGES, RANGE_UNITS, SAMPLES = 1024, 1 << 20, 16
#: Rows from which a group of equal texts is dealt into pieces; a piece is sorted in one task.
PIECE_ROWS = 1 << 20


def _range_of(key: Column, splitters: list[int]) -> Column:
    """How many of the sorted splitters are at most ``key``, by bisection."""
    if not splitters:
        return F.lit(0)
    marks = F.split(F.lit(",".join(map(str, splitters))), ",").cast("array<bigint>")
    steps = [1 << k for k in reversed(range(len(splitters).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(x) for x in steps]),
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= len(splitters)) & (F.get(marks, at + step - 1) <= key), at + step
        ).otherwise(at),
    )


def _pieced(base: DataFrame, total: int, shards: int, whole_share: float) -> DataFrame:
    """Add ``piece`` to the records: from 0 within a large group, else 0.

    Large groups are at most shards / whole_share + rows / PIECE_ROWS many, one
    small row each: a proven bound for the broadcast.
    """
    most = whole_share * total / shards
    large = cut(
        base.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        .where((F.col("bytes") > most) | (F.col("rows") > PIECE_ROWS))
        .select("key", F.ceil(F.greatest(F.col("bytes") / F.lit(most / 4), F.col("rows") / F.lit(PIECE_ROWS / 4))).cast("int").alias("pieces")),
        "shard-large",
    )
    whole = base.join(F.broadcast(large), "key", "left_anti").withColumn("piece", F.lit(0))
    if large.isEmpty():
        return whole
    dealt = cut(base.join(F.broadcast(large), "key").withColumn("same", F.struct("key", "id")).withColumn("row", F.monotonically_increasing_id()), "shard-dealt")
    piece = F.pmod(F.xxhash64(F.col("id").cast("string"), "k"), F.col("pieces")).cast("int")
    return whole.unionByName(numbered(dealt).withColumn("piece", piece).select(*whole.columns))


def _ranged(units: DataFrame, total: int) -> DataFrame:
    """Add ``range`` and ``sub``: together they follow the order of the keys, and none holds much more than its share."""
    ranges = max(RANGES, units.count() // RANGE_UNITS)
    drawn = F.pmod(F.xxhash64("key", "piece", F.lit("draw")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = sorted(
        r.key for r in units.where(drawn < F.col("bytes") * F.lit(ranges * SAMPLES / total)).select("key").collect()
    )  # SAMPLES keys for each range are expected, whatever the input
    splitters = sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)}) if sample else []
    ranged = units.withColumn("range", _range_of(F.col("key"), splitters))
    # one row for each overfull range, so fewer than the ranges
    over = (
        ranged.groupBy("range").agg(F.sum("bytes").alias("b"), F.count("*").alias("n"), F.min("key").cast("double").alias("low"), F.max("key").cast("double").alias("high"))
        .withColumn("parts", F.ceil(F.greatest(F.col("b") * F.lit(ranges / total), F.col("n") / F.lit(RANGE_UNITS))))
        .where("parts > 2").select("range", "low", "high", "parts")
    )
    at = F.floor((F.col("key").cast("double") - F.col("low")) / (F.col("high") - F.col("low") + 1) * F.col("parts"))
    return ranged.join(F.broadcast(over), "range", "left").withColumn("sub", F.coalesce(F.least(at, F.col("parts") - 1), F.lit(0)).cast("int")).drop("low", "high", "parts")


def assign(
    docs: DataFrame,
    shards: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    whole_share: float = 0.05,
) -> DataFrame:
    """Shard and slot of every record, under the law ``bytes``.

    Size is the UTF-8 bytes of the text plus one; a null text counts as empty
    (size 1, text_crc32 0) and all null texts form one group. Returns id_col,
    size, text_crc32, law, shard, slot and grown_shard (null: this law moves
    records when shards are added). Shard sizes differ by about ``whole_share``
    of a shard at most, if no record is larger than that. A group of equal
    texts stays in one shard unless it is dealt into pieces. Repeated rows and
    null ids are kept, each row with its own slot; ties are ordered by id, then
    size, and rows equal in both may swap slots. Other columns of ``docs`` are
    left out. An empty table gives no rows.
    """
    return _assigned(docs, shards, id_col, text_col, whole_share).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def _assigned(docs: DataFrame, shards: int, id_col: str, text_col: str, whole_share: float) -> DataFrame:
    """id, size, crc, key (of the text), shard and slot of every record."""
    text = F.col(f"`{text_col}`")
    base = cut(
        docs.select(
            F.col(f"`{id_col}`").alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("crc"),
            F.xxhash64(text).alias("key"),
        ),
        "shard-base",
    )
    total = base.agg(F.sum("size")).first()[0] or 1
    rows = cut(_pieced(base, total, shards, whole_share), "shard-rows")
    units = cut(
        rows.groupBy("key", "piece").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "shard-units"
    )
    ranged = cut(_ranged(units, total), "shard-ranged")
    line = Window.orderBy("range", "sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = (  # one row for each range and each part of an overfull one: at most three times the ranges
        ranged.groupBy("range", "sub")
        .agg(F.sum("bytes").alias("b"), F.sum("rows").alias("r"))
        .select(
            "range",
            "sub",
            F.coalesce(F.sum("b").over(line), F.lit(0)).alias("range_bytes"),
            F.coalesce(F.sum("r").over(line), F.lit(0)).alias("range_rows"),
        )
    )
    inside = Window.partitionBy("range", "sub").orderBy("key", "piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut(
        ranged.join(F.broadcast(starts), ["range", "sub"])
        .withColumn("before", F.col("range_bytes") + F.coalesce(F.sum("bytes").over(inside), F.lit(0)))
        .withColumn("first_row", F.col("range_rows") + F.coalesce(F.sum("rows").over(inside), F.lit(0)))
        .select(
            "key", "piece", "first_row",
            F.least(
                F.lit(shards - 1),
                F.floor(F.lit(shards) * (F.col("before") + F.col("bytes") / 2) / F.lit(float(total))),
            ).cast("int").alias("shard"),
        ),
        "shard-placed",
    )
    shard_starts = placed.groupBy("shard").agg(F.min("first_row").alias("shard_row"))  # one row for each shard
    order = Window.partitionBy("key", "piece").orderBy("id", "crc", "size")
    return (
        rows.join(placed.join(F.broadcast(shard_starts), "shard"), ["key", "piece"])
        .withColumn("slot", F.col("first_row") - F.col("shard_row") + F.row_number().over(order) - 1)
        .select("id", "size", "crc", "key", "shard", "slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", files: int = 16) -> None:
    """Write all records below ``path``, a folder for each shard, in slot order within a file.

    Rows equal in id and text take the slots of their group in any order, each
    its own, so ids may repeat or be null. Each shard is dealt over ``files``
    tasks by slot. ``shard`` and ``slot`` are added and replace columns of
    these names. An empty table writes nothing.
    """
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    same = F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("key"))
    whole = cut(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row_"), same.alias("same"), F.monotonically_increasing_id().alias("row")), "shard-texts")
    slots = _assigned(docs, shards, id_col, text_col, 0.05).select(F.struct("id", "key").alias("same"), "shard", "slot")
    slots = cut(slots.withColumn("row", F.monotonically_increasing_id()), "shard-slots")
    placed = numbered(whole).join(numbered(slots).drop("row"), ["same", "k"]).select("row_.*", "shard", "slot")
    (
        placed.repartition("shard", F.pmod(F.col("slot"), F.lit(files)))
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
