"""Replay reports: state counts, percentiles, golden differences, cascades and calibration."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut


def state_counts(rows: DataFrame, key: str, state: str) -> DataFrame:
    """Rows by key and state, with the share of the key's rows."""
    counts = rows.groupBy(key, state).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(key)).cast("double"))


def locked_summary(rows: DataFrame, key: str, time: str, locked: Column) -> DataFrame:
    """Locked rows, their share and the first time."""
    return rows.groupBy(key).agg(
        F.count("*").alias("samples"), F.count_if(locked).alias("locked"), F.min(F.when(locked, F.col(time))).alias("first_locked")
    ).withColumn("share", F.col("locked") / F.col("samples").cast("double"))


def nearest_ranks(rows: DataFrame, key: str, value: str, at: list[float]) -> DataFrame:
    """Nearest-rank percentiles of each key in long form: key, ``share`` and ``found``; null values do not count.

    Equal values are counted first; these counts are dealt by range over all
    partitions, sums by partition tell which one holds a rank, and only its rows
    are put in order. So a key with many values is many tasks.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("k"), F.col(value).alias("v")).agg(F.count("*").alias("n"))
    dealt = cut(counts.repartitionByRange(parts, "k", "v").withColumn("part", F.spark_partition_id()), "ranks")
    whole = Window.partitionBy("k")
    sums = dealt.groupBy("k", "part").agg(F.sum("n").alias("own"))
    sums = sums.select("k", "part", F.sum("own").over(whole).alias("total"), F.sum("own").over(whole.orderBy("part")).alias("upto"), "own")
    share = F.explode(F.array(*[F.lit(Decimal(str(p))).cast("decimal(18,9)") for p in at]))
    sought = sums.withColumn("share", share).withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("total"))))
    sought = sought.where((F.col("rank") > F.col("upto") - F.col("own")) & (F.col("rank") <= F.col("upto"))).select(F.col("k").alias("own_k"), F.col("part").alias("own_part"), "share", "rank", (F.col("upto") - F.col("own")).alias("before"))
    near = dealt.join(sought.hint("merge"), F.col("k").eqNullSafe(F.col("own_k")) & (F.col("part") == F.col("own_part")))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("k", "part", "share").orderBy("v"))
    return near.withColumn("upto", upto).where(F.col("upto") >= F.col("rank")).groupBy(F.col("k").alias(key), F.col("share").cast("double").alias("share")).agg(F.min("v").alias("found"))


def percentiles(rows: DataFrame, key: str, value: str, at: list[float]) -> DataFrame:
    """Nearest-rank percentiles: the smallest value with at least that share at or below it; null for a key without values."""
    found = nearest_ranks(rows, key, value, at).unionByName(rows.select(key).distinct().select(key, F.lit(-1.0).alias("share"), F.lit(None).cast(rows.schema[value].dataType).alias("found")))
    return found.groupBy(key).agg(*[F.max(F.when(F.col("share") == p, F.col("found"))).alias(f"p{round(100 * p)}") for p in at])


def timing(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Calls, their total, lower median, 95th percentile by nearest rank and maximum."""
    sums = rows.groupBy(key).agg(F.count("*").alias("calls"), F.sum(value).alias("total"), F.max(value).alias("most"))
    found = nearest_ranks(rows, key, value, [0.5, 0.95]).groupBy(F.col(key).alias("of")).agg(*[F.max(F.when(F.col("share") == p, F.col("found"))).alias(name) for p, name in ((0.5, "p50"), (0.95, "p95"))])
    return sums.join(found, F.col(key).eqNullSafe(F.col("of")), "left").select(key, "calls", "total", "p50", "p95", "most")


def key_diff(rows: DataFrame, ours: str, golden: str, optional: tuple[str, ...], tolerance: float = 1e-5) -> DataFrame:
    """The keys of two JSON objects that do not agree: the row's columns, key, ours, golden and verdict.

    The union of the keys is compared. A key that only one side has is
    ``missing``, unless it is optional: then it counts as null. Numbers agree
    within ``tolerance``, all else as text; null agrees with null alone.
    """
    names = [c for c in rows.columns if c not in (ours, golden)]
    table = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    both = rows.select(*names, table(ours).alias("a"), table(golden).alias("b"))
    long = both.select(*names, "a", "b", F.explode(F.array_union(F.map_keys("a"), F.map_keys("b"))).alias("key"))
    x, y = F.try_element_at("a", F.col("key")), F.try_element_at("b", F.col("key"))
    absent = F.map_contains_key("a", F.col("key")) != F.map_contains_key("b", F.col("key"))
    near = F.abs(F.col("ours").try_cast("double") - F.col("golden").try_cast("double")) <= tolerance
    verdict = F.when(F.col("absent") & ~F.col("key").isin(*optional), "missing").when(~(F.col("ours").eqNullSafe(F.col("golden")) | F.coalesce(near, F.lit(False))), "differs")
    return long.select(*names, "key", x.alias("ours"), y.alias("golden"), absent.alias("absent")).withColumn("verdict", verdict).drop("absent").where("verdict is not null")


def golden_diff(ours: DataFrame, golden: DataFrame, keys: list[str], fields: list[str], tolerance: float) -> DataFrame:
    """Per field: compared rows, rows on one side only, the largest difference and how many exceed the tolerance."""
    wide = lambda df, side: df.select(*keys, F.struct(*[F.col(f).cast("double").alias(f) for f in fields]).alias(side))
    both = wide(ours, "a").join(wide(golden, "b"), keys, "full")
    long = both.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a.{f}").alias("x"), F.col(f"b.{f}").alias("y"), F.col("a").isNull().alias("no_a"), F.col("b").isNull().alias("no_b")) for f in fields])).alias("r")).select("r.*")
    delta = F.abs(F.col("x") - F.col("y"))
    return long.groupBy("field").agg(
        F.count_if(~F.col("no_a") & ~F.col("no_b")).alias("compared"), F.count_if("no_a").alias("only_golden"), F.count_if("no_b").alias("only_ours"),
        F.max(delta).alias("max_delta"), F.count_if(delta > tolerance).alias("beyond"),
    )


def cascade(attempts: DataFrame, key: str) -> DataFrame:
    """First match in provider order; a terminal failure stops the cascade.

    attempts: key, place, outcome (match, no_match, soft_failure, terminal).
    Without a match the last attempt made is the outcome.
    """
    w = Window.partitionBy(key).orderBy("place")
    stop = F.col("outcome").isin("match", "terminal")
    before = F.max(stop.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    made = attempts.withColumn("before", F.coalesce(before, F.lit(0))).where("before = 0")
    return made.groupBy(key).agg(F.max_by("outcome", "place").alias("outcome"), F.max("place").alias("place"), F.count("*").alias("attempts"))


def earliest_match(scans: DataFrame, key: str) -> DataFrame:
    """Of growing windows: the match completed first (then the shortest), else the last no-match, else the first failure."""
    pick = lambda kind, fn, *by: fn(F.struct("outcome", "duration_ms"), F.when(F.col("outcome") == kind, F.struct(*by)))
    return scans.groupBy(key).agg(
        F.coalesce(
            pick("match", F.min_by, "completed_ms", "duration_ms"), pick("no_match", F.max_by, "completed_ms", "duration_ms"),
            pick("failure", F.min_by, "completed_ms", "duration_ms"),
        ).alias("x")
    ).select(key, "x.*")


def median_offset(samples: DataFrame, key: str, value: str, order: list[str], last: int = 16, most: int = 500) -> DataFrame:
    """Rounded median of the last samples, within +/- ``most``."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    kept = samples.withColumn("rank", rank).where(F.col("rank") <= last)
    median = F.round(F.percentile(value, F.lit(0.5)))
    return kept.groupBy(key).agg(F.greatest(F.lit(float(-most)), F.least(F.lit(float(most)), median)).alias("median"), F.count("*").alias("samples"))


def most_severe(rows: DataFrame, key: str, severity: str, id_col: str) -> DataFrame:
    """The row of the highest severity, then the greatest id."""
    return rows.groupBy(key).agg(F.max(F.struct(severity, id_col)).alias("x")).select(key, "x.*")


def nearest_beat(rows: DataFrame, time: str, period: float, start: float) -> DataFrame:
    """Index of the nearest beat from 0 on; the lower one on a tie."""
    at = (F.col(time) - start) / period
    below = F.floor(at)
    index = F.greatest(F.lit(0), F.when(at - below > 0.5, below + 1).otherwise(below))
    return rows.withColumn("beat", index).withColumn("error", F.col(time) - (F.lit(start) + F.col("beat") * period))
