"""Landmark index and offset votes.

Query landmarks meet reference landmarks of the same hash; every meeting votes
for the bin of its time difference. Bins are weighted by inverse frequency,
ranked, thinned by distance and gated. Weights are whole thousandths and times
whole microseconds, so all sums are exact and independent of row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numbers import MILLI, as_milli, idf, match_weight
from tidemark.operators import tiles
from tidemark.session import spread


def postings(landmarks: DataFrame, span_us: int) -> DataFrame:
    """The inverted index: sorted anchor times of each hash, in blocks of ``span_us``.

    A block holds one span of time, so that a frequent hash makes many rows.
    """
    return (
        landmarks.groupBy("hash", F.floor(F.col("t_us") / span_us).alias("block"))
        .agg(F.array_sort(F.collect_list("t_us")).alias("anchors"))
    )


def posting_stats(landmarks: DataFrame, by: list[str] = []) -> DataFrame:
    """hash, postings, first and last anchor, idf; ``by`` are columns that tell several references apart."""
    counts = landmarks.groupBy(*by, "hash").agg(F.count("*").alias("postings"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"))
    if by:
        totals = landmarks.groupBy(*by).agg(F.count("*").alias("total"))
        return counts.join(totals, by).withColumn("idf", idf(F.col("total").cast("double"), F.col("postings"))).drop("total")
    total = landmarks.agg(F.count("*").alias("n")).scalar()
    return counts.withColumn("idf", idf(total.cast("double"), F.col("postings")))


def term_frequency(query: DataFrame) -> DataFrame:
    return query.groupBy("query_id", "hash").agg(F.count("*").alias("tf"))


def weighted_query(query: DataFrame, reference: DataFrame, by: list[str] = []) -> DataFrame:
    """Query landmarks that the index knows, with posting count and weight.

    Weights are global: they do not depend on a later search range.
    """
    stats = posting_stats(reference, by).select(*by, "hash", "postings", "idf")
    counts = query.groupBy(*by, "query_id", "hash").agg(F.count("*").alias("tf")) if by else term_frequency(query)
    weights = counts.join(stats, [*by, "hash"]).select(
        *by, "query_id", "hash", "postings", as_milli(match_weight(F.col("idf"), F.col("tf"))).alias("weight")
    )
    return query.join(weights, [*by, "query_id", "hash"])


#: Postings of a hash from which they are dealt in parts; the query side goes to each part.
HOT_POSTINGS = 65_536


def _dealt(weighted: DataFrame, anchors: DataFrame, reference: DataFrame, on: list[str]) -> DataFrame:
    """All meetings of equal hashes; a frequent hash is many keys, so no task meets all its postings."""
    parts = F.ceil(F.col("postings") / HOT_POSTINGS).cast("int")
    hot = reference.groupBy(*on).agg(F.count("*").alias("postings")).where(F.col("postings") > HOT_POSTINGS).select(*on, parts.alias("parts"))
    dealt = anchors.join(hot, on, "left").withColumn("salt", F.pmod(F.hash("r_us"), F.coalesce("parts", F.lit(1)))).drop("parts")
    return weighted.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).join(dealt, [*on, "salt"])


def meetings(query: DataFrame, reference: DataFrame, bin_us: int, reach_us: int | None = None, by: list[str] = []) -> DataFrame:
    """Votes by query, bin and hash, by joins.

    With ``reach_us`` only differences within the closed range count; both sides
    are then also joined on spans of time, which keeps a frequent hash from
    meeting all of its postings. Sums are taken per hash first: the shuffle
    carries counts, not meetings.
    """
    on = [*by, "hash"]
    weighted = weighted_query(query, reference, by).withColumnRenamed("t_us", "q_us")
    anchors = reference.select(*on, F.col("t_us").alias("r_us"))
    if reach_us is None:
        pairs = _dealt(weighted, anchors, reference, on)
    else:
        near = F.explode(F.array(*[F.floor(F.col("q_us") / reach_us) + k for k in (-1, 0, 1)]))
        pairs = weighted.withColumn("span", near).join(anchors.withColumn("span", F.floor(F.col("r_us") / reach_us)), [*on, "span"])
        pairs = pairs.where((F.col("r_us") - F.col("q_us")).between(-reach_us, reach_us))
    return (
        pairs.withColumn("bin", F.round((F.col("r_us") - F.col("q_us")) / F.lit(float(bin_us))).cast("long"))
        .withColumn("beside", F.col("r_us") - F.col("q_us") - F.col("bin") * bin_us)
        .groupBy("query_id", "bin", "hash", "postings")
        .agg(
            F.count("*").alias("votes"), F.sum("weight").alias("weight"), F.sum(F.col("weight") * F.col("beside")).alias("moment"),
            F.min("q_us").alias("q_first"), F.max("q_us").alias("q_last"),
        )
    )


def _by_joins(query: DataFrame, reference: DataFrame, bin_us: int, reach_us: int | None, by: list[str]) -> DataFrame:
    return (
        meetings(query, reference, bin_us, reach_us, by)
        .groupBy("query_id", "bin")
        .agg(
            F.sum("votes").alias("votes"), F.sum("weight").alias("weight"), F.sum("moment").alias("moment"),
            F.count("*").alias("unique_hashes"), F.sum(F.when(F.col("postings") > 1, F.col("votes")).otherwise(F.lit(0))).alias("common_votes"),
            F.sum(F.col("postings") * F.col("votes")).alias("posting_sum"), F.min("q_first").alias("q_first"), F.max("q_last").alias("q_last"),
        )
    )


#: Query landmarks of a block, and of a small one where there are few; blocks for each core at most; postings of a tile that a task holds in memory and of a list;
#: landmarks and meetings that a task holds at once.
BLOCK, LEAST_BLOCK, LEAST_BLOCKS, CORE_BLOCKS, TILE_POSTINGS, LISTED, TAKEN, MET = 1 << 18, 1 << 12, 16, 4, 1 << 25, 1 << 20, 1 << 14, 1 << 18
TALLIED = ("votes", "weight", "moment", "unique_hashes", "common_votes", "posting_sum", "q_first", "q_last")


def by_tiles(query: DataFrame, reference: DataFrame, bin_us: int, reach_us: int | None) -> DataFrame:
    """Sums of each query and bin: query_id, bin, landmarks and ``TALLIED``.

    Queries are dealt in blocks; each meets all postings in one tile, whose
    task sums up whole queries at once. What is shuffled are landmarks and, once
    for each block, lists of postings: never meetings, and never sums. Blocks
    are a few for each core at most, so what is shuffled grows as the input
    does. A task holds a query's landmarks and, up to TILE_POSTINGS, the tile's
    postings; where they are more they lie in a file while it runs.
    """
    sizes = query.groupBy("query_id").agg(F.count("*").alias("landmarks"))
    weighted = weighted_query(query, reference).join(sizes, "query_id")
    anchors = reference.where("hash IS NOT NULL AND t_us IS NOT NULL")
    counts = lambda rows: rows.agg(F.count("*"), F.count_if(F.col("t_us").isNull()))
    n, q_untimed, m, r_untimed = counts(query).crossJoin(counts(reference)).first()
    cores = query.sparkSession.sparkContext.defaultParallelism
    blocks = max(min(-(-n // BLOCK), CORE_BLOCKS * cores), min(LEAST_BLOCKS, -(-n // LEAST_BLOCK)), 1)
    asks = weighted.where("t_us IS NOT NULL").select(
        F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("tile"), F.lit(True).alias("asks"), "query_id", "hash",
        *[F.col(c).cast("long").alias(c) for c in ("t_us", "weight", "postings", "landmarks")],
    )
    lists = anchors.groupBy("hash", F.pmod(F.xxhash64("t_us"), F.lit(-(-m // LISTED) or 1))).agg(F.collect_list("t_us").alias("times"))
    known = lists.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("tile"), F.lit(False).alias("asks"), "hash", "times")
    # a tile for each task: hashes of so few numbers would leave some tasks several, others none
    rows = asks.unionByName(known, allowMissingColumns=True).repartitionById(blocks, F.col("tile").cast("int")).sortWithinPartitions("tile", "asks", "query_id", "hash", "t_us")
    shown = T.StructType([query.schema["query_id"], *[T.StructField(c, T.LongType()) for c in ("bin", *TALLIED, "landmarks")]])

    taken, most, held = TAKEN, MET, TILE_POSTINGS

    def run(batches):
        yield from tiles.tally(batches, bin_us, reach_us, taken, most, held)

    found = rows.mapInArrow(run, shown)
    if reach_us is None and (q_untimed or r_untimed):
        found = found.unionByName(_untimed(weighted, reference))
    return found


def _untimed(weighted: DataFrame, reference: DataFrame) -> DataFrame:
    """The sums of meetings in which a time is unknown, which are in no bin."""
    lost = reference.where("hash IS NOT NULL AND t_us IS NULL").groupBy("hash").agg(F.count("*").alias("lost"))
    votes = F.when(F.col("t_us").isNull(), F.col("postings")).otherwise(F.coalesce("lost", F.lit(0)))
    rows = weighted.join(lost, "hash", "left").withColumn("votes", votes).where("votes > 0")
    of = F.col("votes") * F.col("postings")
    return rows.groupBy("query_id").agg(
        F.lit(None).cast("long").alias("bin"), F.sum("votes").alias("votes"), F.sum(F.col("weight") * F.col("votes")).alias("weight"), F.lit(None).cast("long").alias("moment"),
        F.count_distinct("hash").alias("unique_hashes"), F.sum(F.when(F.col("postings") > 1, F.col("votes")).otherwise(F.lit(0))).alias("common_votes"),
        F.sum(of).alias("posting_sum"), F.min("t_us").alias("q_first"), F.max("t_us").alias("q_last"), F.max("landmarks").alias("landmarks"),
    )


def vote_histogram(query: DataFrame, reference: DataFrame, bin_us: int, reach_us: int | None = None, by: list[str] = []) -> DataFrame:
    """One row for each query and bin: votes, score, refined offset and evidence.

    query: query_id, hash, t_us; reference: hash, t_us; offset is reference
    minus query time. With ``by``, columns of both sides, a query meets its own
    reference only. Rows with a null hash have no part; meetings with a null
    time are in a null bin, or out of reach. Empty inputs give no rows.
    """
    return keyed_histogram(query, reference, bin_us, reach_us, by).drop(*by)


def keyed_histogram(query: DataFrame, reference: DataFrame, bin_us: int, reach_us: int | None = None, by: list[str] = []) -> DataFrame:
    """``vote_histogram`` with the columns ``by`` of each query."""
    if by:
        sizes = query.groupBy("query_id").agg(F.count("*").alias("landmarks"), *[F.min(c).alias(c) for c in by])
        sums = _by_joins(query, reference, bin_us, reach_us, by).join(sizes, "query_id")
    else:
        sums = by_tiles(query, reference, bin_us, reach_us)
    return (
        sums.withColumn("spread_us", F.col("q_last") - F.col("q_first"))
        .select(
            "query_id", *by, "bin", "votes", (F.col("weight") / F.lit(float(MILLI))).alias("score"),
            (F.col("bin") * F.lit(float(bin_us)) + F.col("moment") / F.col("weight").cast("double")).alias("offset_us"),
            "unique_hashes", "common_votes", (F.col("posting_sum") / F.col("votes").cast("double")).alias("mean_postings"),
            "spread_us", (F.col("votes") / F.col("landmarks").cast("double")).alias("density"),
        )
    )


def rank_order() -> list[Column]:
    """Best first: score, distinct hashes, spread, votes, then the smaller bin."""
    return [F.desc("score"), F.desc("unique_hashes"), F.desc("spread_us"), F.desc("votes"), F.asc("bin")]


def ranked(bins: DataFrame) -> DataFrame:
    return bins.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*rank_order())))


def independent(bins: DataFrame, most: int, apart: int) -> DataFrame:
    """Greedy thinning: by rank, keep a bin at least ``apart`` bins from all kept, ``most`` at most.

    A kept bin rules out 2 * apart - 2 others, so the first most * (2 * apart - 1)
    ranks hold the whole answer: groups are bounded without losing a row.
    """
    enough = most * (2 * apart - 1)
    best = ranked(bins).where(F.col("rank") <= enough)
    # whole rows are thinned, so that the bins are made once and not joined to what is left of them
    item = F.struct("rank", *[c for c in best.columns if c not in ("rank", "query_id")])
    kept = F.aggregate(
        F.array_sort(F.collect_list(item)),
        F.array().cast(best.select(F.array(item)).schema[0].dataType.simpleString()),
        lambda acc, x: F.when(
            (F.size(acc) < most) & F.forall(acc, lambda y: F.abs(y["bin"] - x["bin"]) >= apart), F.concat(acc, F.array(x))
        ).otherwise(acc),
    )
    chosen = best.groupBy("query_id").agg(kept.alias("kept")).select("query_id", F.posexplode("kept").alias("place", "one")).where("one.bin IS NOT NULL")
    return chosen.select("query_id", *[F.col(f"one.{c}").alias(c) for c in best.columns if c != "query_id"], F.col("place").cast("long").alias("place"))


def lead_over_second(candidates: DataFrame) -> DataFrame:
    """The best candidate of each query with ratio and margin over the second.

    Without a second, ``ratio`` is the best score itself (the finite form of
    infinity) and so is the margin.
    """
    top = F.max_by("score", -F.col("place"))
    second = F.max(F.when(F.col("place") == 1, F.col("score")))
    return (
        candidates.groupBy("query_id")
        .agg(
            top.alias("score"), second.alias("second"), F.min_by("bin", "place").alias("bin"), F.min_by("votes", "place").alias("votes"),
            F.min_by("density", "place").alias("density"), F.min_by("spread_us", "place").alias("spread_us"),
        )
        .withColumn("ratio", F.coalesce(F.try_divide("score", "second"), F.col("score")))
        .withColumn("margin", F.greatest(F.lit(0.0), F.col("score") - F.coalesce("second", F.lit(0.0))))
    )


def coarse_gate(lead: DataFrame, votes: int = 8, density: float = 0.08, spread_us: int = 900_000, ratio: float = 1.35, margin: float = 4.0) -> DataFrame:
    """``reason``: why the best candidate is held back, in this order, or ``none``."""
    ambiguous = F.col("second").isNotNull() & ((F.col("ratio") < ratio) | (F.col("margin") < margin))
    reason = (
        F.when(F.col("votes") < votes, "too_few_votes").when(F.col("density") < density, "low_density")
        .when(F.col("spread_us") < spread_us, "narrow_spread").when(ambiguous, "ambiguous").otherwise("none")
    )
    return lead.withColumn("reason", reason)
