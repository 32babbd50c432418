"""Connected components of a table of links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut


#: A node with more than this share of all links is a hub; there are fewer than 1 / HUB of them, or 2 / HUB ends.
HUB = 1 / 1000


def _least(links: DataFrame) -> DataFrame:
    """Each u's smallest neighbour or itself and its number of links; sums up before the shuffle."""
    return links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))


def _met(links: DataFrame, n_links: int) -> DataFrame:
    """Each link (u, v) with m, the smallest neighbour of u among these links.

    Hubs are few by their share of all links, a proven bound: they are
    broadcast and their links stay where they are. The rest is joined.
    """
    least = _least(links)
    hubs = least.where(F.col("n") > F.lit(2 * HUB * n_links)).select("u", "m")
    marked = links.join(F.broadcast(hubs), "u", "left")
    rest = marked.where("m is null").drop("m").join(least.where(F.col("n") <= F.lit(2 * HUB * n_links)).select("u", "m"), "u")
    return marked.where("m is not null").unionByName(rest)


def _large_star(links: DataFrame, n_links: int) -> DataFrame:
    """Tie every larger neighbour of a node to the smallest of its neighbourhood."""
    both = links.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.*")
    return _met(both, 2 * n_links).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame, n_links: int) -> DataFrame:
    """Tie a node and its smaller neighbours to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    tied = _met(down, n_links)
    return tied.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``u`` and ``root`` for every node of the links (u, v), roots included.

    Root is the smallest node that can be reached. Each step of a round is
    written to the shared folder: a plan of both would name the links some
    fifty times, and such plans fill the driver. Only counts reach the driver.
    It is done when every node has one link, or, as a root, none but those to
    it.
    """
    now = cut(links.select("u", "v").where("u <> v").distinct(), "links")
    n_links = now.count()
    for _ in range(rounds):
        large = cut(_large_star(now, n_links).where("u <> v"), "large-stars")
        now = cut(_small_star(large, n_links).where("u <> v").distinct(), "stars")
        down, up = F.struct("u", F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("v").alias("u"), F.lit(0).alias("down"), F.lit(1).alias("up"))
        ends = now.select(F.explode(F.array(down, up)).alias("x")).select("x.*")
        nodes = ends.groupBy("u").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
        open_, n_links = nodes.agg(F.count_if((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0))), F.coalesce(F.sum("down"), F.lit(0))).first()
        if not open_:
            break
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    return now.select("u", F.col("v").alias("root")).union(now.select("v", "v").distinct())
