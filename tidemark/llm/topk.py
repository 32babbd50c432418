"""Exact top-k search with vector-approximation files.

Vectors are dealt into blocks. Each block keeps, beside its exact vectors, an
approximation: the number of the cell, of CELLS in each dimension, in which a
component lies. Queries are dealt into groups. First a group meets the cells of
a run of blocks alone, which bound the inner products; a candidate is left when
k others are certain to come before it. Then exact vectors are read by position,
from the highest upper bound down: FIRST times k for each query, and then those
whose bound still reaches the kth score found, so that the result is certain.
Exact vectors leave their blocks only for these positions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, per_task
from tidemark.session import cut

#: Rows of a block, and queries of a group (both expected); cells of a dimension, as a byte tells apart.
BLOCK, CELLS = 2048, 256
#: Blocks that follow each other in one task, where each narrows the next, and queries bounded at once.
RUN, QUERIES = 4, 256
#: How many times k exact vectors are read before the bounds are looked at again.
FIRST = 2

PACKED = "block int, dim int, ids binary, exact binary, places binary, cells binary, low binary, width binary"
ASKED = "dim int, grp int, queries binary, vectors binary, homes binary"
BOUNDS = "dim int, grp int, q int, block int, place int, vec long, upper double, lower double"
FETCHED = "dim int, grp int, q binary, at binary, vec binary, exact binary"
SCORED = "dim int, grp int, q int, query long, vec long, score long"


def copies_within(exact: np.ndarray, most: int) -> np.ndarray:
    """Places of the rows that have fewer than ``most`` equal rows before them."""
    _, kind = np.unique(exact, axis=0, return_inverse=True)
    kind = kind.ravel()
    order = np.argsort(kind, kind="stable")
    first = np.flatnonzero(np.r_[True, kind[order][1:] != kind[order][:-1]])
    rank = np.arange(len(kind)) - np.repeat(first, np.diff(np.r_[first, len(kind)]))
    return np.sort(order[rank < most])


def pack(ids: np.ndarray, exact: np.ndarray, k: int) -> dict[str, bytes]:
    """A block's ids and exact vectors, and the places and cells of its candidates.

    Rows are in order of id. Of equal vectors only the first k + 1 are
    candidates: k of them are not the query itself and come before the rest.
    Cells are equally wide within a dimension.
    """
    places = copies_within(exact, k + 1)
    low = exact.min(axis=0)
    width = (exact.max(axis=0) - low) // CELLS + 1
    cells = ((exact[places] - low) // width).astype(np.uint8)
    return {"ids": ids.tobytes(), "exact": exact.tobytes(), "places": places.tobytes(), "cells": cells.tobytes(), "low": low.tobytes(), "width": width.tobytes()}


def numbers(b: bytes, dim: int | None = None) -> np.ndarray:
    found = np.frombuffer(b, np.int64)
    return found if dim is None else found.reshape(-1, dim)


def bound(queries: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds, whole numbers, of the inner products of queries and cells."""
    half = (width - 1) / 2
    middle = low + cells * width + half
    q = queries.astype(np.float64)
    score = q @ middle.T
    reach = np.abs(q) @ half + 1e-9 * (np.abs(q) @ np.abs(middle).max(axis=0)) + 1e-6
    return np.ceil(score - reach[:, None]), np.floor(score + reach[:, None])


def narrow(lower: np.ndarray, upper: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which candidates can be among the k best, and the k best lower bounds held so far.

    ``held`` has k columns, those of candidates met before; a candidate whose
    upper bound is below the least of the new ones has k others before it.
    """
    k = held.shape[1]
    best = np.partition(lower, -k, axis=1)[:, -k:] if lower.shape[1] > k else lower
    held = np.partition(np.concatenate([held, best], axis=1), -k, axis=1)[:, -k:]
    return upper >= held.min(axis=1)[:, None], held


def scan_cells(k: int) -> Callable:
    """A step over rows of a group and a block: bounds of the pairs that can still matter."""

    def make() -> Callable[[pa.Table], pa.Table]:
        seen = {"key": None, "held": None}

        def scan(t: pa.Table) -> pa.Table:
            out: dict[str, list] = {c: [] for c in ("dim", "grp", "q", "block", "place", "vec", "upper", "lower")}
            for r in t.to_pylist():
                dim = r["dim"]
                ids, places, low, width = (numbers(r[c]) for c in ("ids", "places", "low", "width"))
                cells = np.frombuffer(r["cells"], np.uint8).reshape(-1, dim)
                vectors, homes = numbers(r["vectors"], dim), numbers(r["homes"], 2)
                if seen["key"] != (dim, r["grp"]):
                    seen.update(key=(dim, r["grp"]), held=np.full((len(vectors), k), -np.inf))
                for at in range(0, len(vectors), QUERIES):
                    part = slice(at, at + QUERIES)
                    lower, upper = bound(vectors[part], cells, low, width)
                    own = np.where(homes[part, :1] == r["block"], homes[part, 1:], -1) == places  # a query is no candidate of its own
                    lower[own] = upper[own] = -np.inf
                    keep, seen["held"][part] = narrow(lower, upper, seen["held"][part])
                    i, j = np.nonzero(keep & ~own)
                    for c, v in (("q", i + at), ("place", places[j]), ("vec", ids[places[j]]), ("upper", upper[i, j]), ("lower", lower[i, j])):
                        out[c].append(v)
                    for c in ("dim", "grp", "block"):
                        out[c].append(np.full(len(i), r[c]))
            whole = {c: np.concatenate(v) if v else np.empty(0) for c, v in out.items()}
            kinds = {"vec": np.int64, "upper": np.float64, "lower": np.float64}
            return pa.table({c: v.astype(kinds.get(c, np.int32)) for c, v in whole.items()})

        return scan

    return per_task(make)


def fetch(t: pa.Table) -> pa.Table:
    """The exact vectors of a block that a group asks for, each once."""
    out: dict[str, list] = {c: [] for c in ("dim", "grp", "q", "at", "vec", "exact")}
    for r in t.to_pylist():
        pairs = np.array(r["pairs"], np.int64)
        places, at = np.unique(pairs & 0xFFFFFFFF, return_inverse=True)
        found = (r["dim"], r["grp"], (pairs >> 32).tobytes(), at.astype(np.int64).tobytes(), numbers(r["ids"])[places].tobytes(), numbers(r["exact"], r["dim"])[places].tobytes())
        for c, v in zip(out, found):
            out[c].append(v)
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return pa.table({c: pa.array(v, kind) for (c, v), kind in zip(out.items(), kinds)})


def multiply(t: pa.Table) -> pa.Table:
    """Exact scores of fetched vectors and the queries that asked for them."""
    out: dict[str, list] = {c: [np.empty(0, np.int64)] for c in ("dim", "grp", "q", "query", "vec", "score")}
    for r in t.to_pylist():
        q, at = numbers(r["q"]), numbers(r["at"])
        score = np.einsum("ij,ij->i", numbers(r["vectors"], r["dim"])[q], numbers(r["exact"], r["dim"])[at])
        found = (np.full(len(q), r["dim"]), np.full(len(q), r["grp"]), q, numbers(r["queries"])[q], numbers(r["vec"])[at], score)
        for c, v in zip(out, found):
            out[c].append(v)
    return pa.table({c: np.concatenate(v).astype(np.int32 if c in ("dim", "grp", "q") else np.int64) for c, v in out.items()})


def _reaches(value: str, least: Column) -> Column:
    """Whether a candidate of this value may come no later than one with ``least`` (value, vec)."""
    return least.isNull() | (F.col(value) > least["value"]) | ((F.col(value) == least["value"]) & (F.col("vec") <= least["vec"]))


def top_k(
    vectors: DataFrame,
    k: int = 20,
    scale: int = 64,
    every: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The k highest inner products of every query among all other rows.

    Components become floor(scale * x) as integers. Queries are the rows whose
    id is divisible by ``every``; candidates are all rows but the query's own.
    Returns query_id, rank (from 1), vec_id and score; ties go to the smaller
    id, equal rows keep separate places. Rows without an id, and vectors that
    are null, empty or hold null or non-finite components, take no part.
    Vectors meet only those of their own length. A query with fewer than k
    candidates returns all. Other columns are left out; an empty table gives
    no rows. Scores and components must fit 64-bit integers.
    """
    x = F.col(vector_col)
    usable = F.col(id_col).isNotNull() & (F.size(x) > 0) & F.forall(
        x, lambda v: F.coalesce(~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")), F.lit(False))
    )
    rows = vectors.where(usable).select(F.col(id_col).cast("long").alias("id"), x.cast("array<double>").alias("x"))
    counted = rows.agg(F.count("*").alias("rows"), F.count_if(F.col("id") % every == 0).alias("queries")).first()
    blocks, groups = (max(1, -(-n // BLOCK)) for n in (counted["rows"], counted["queries"]))
    dealt = cut(rows.select("id", "x", F.size("x").alias("dim"), F.floor(F.rand(7) * blocks).cast("int").alias("block")), "topk-dealt")

    def to_block(t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy()
        dim = t.column("dim")[0].as_py()
        flat = t.column("x").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        order = np.argsort(ids, kind="stable")
        packed = pack(ids[order], np.floor(scale * flat[order]).astype(np.int64), k)
        return pa.table({"block": t.column("block")[:1], "dim": t.column("dim")[:1], **{c: pa.array([v], pa.binary()) for c, v in packed.items()}})

    packed = cut(dealt.groupBy("block", "dim").applyInArrow(to_block, PACKED), "topk-blocks")

    def to_queries(t: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("dim", "query", "vector", "block", "place")}
        for r in t.to_pylist():
            ids, exact = numbers(r["ids"]), numbers(r["exact"], r["dim"])
            for p in np.flatnonzero(ids % every == 0).tolist():
                for c, v in zip(out, (r["dim"], int(ids[p]), exact[p].tobytes(), r["block"], p)):
                    out[c].append(v)
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int32()]
        return pa.table({c: pa.array(v, kind) for (c, v), kind in zip(out.items(), kinds)})

    def to_group(t: pa.Table) -> pa.Table:
        homes = np.column_stack([t.column(c).to_numpy() for c in ("block", "place")]).astype(np.int64)
        values = {"queries": t.column("query").to_numpy().tobytes(), "vectors": b"".join(t.column("vector").to_pylist()), "homes": homes.tobytes()}
        return pa.table({"dim": t.column("dim")[:1], "grp": t.column("grp")[:1], **{c: pa.array([v], pa.binary()) for c, v in values.items()}})

    asked = map_arrow(packed.select("block", "dim", "ids", "exact"), to_queries, "dim int, query long, vector binary, block int, place int", rows=1)
    asked = asked.withColumn("grp", F.pmod(F.hash("block", "place"), F.lit(groups)))
    asked = cut(asked.groupBy("dim", "grp").applyInArrow(to_group, ASKED), "topk-queries")

    runs = -(-blocks // RUN)
    tasks = min(200_000, 2 * runs * groups)  # a task holds one pair at a time, however many it gets
    meet = ["dim", "grp", "run"]
    cells = packed.select("block", "dim", "ids", "places", "cells", "low", "width", F.floor(F.col("block") / RUN).cast("int").alias("run"))
    left = cells.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(tasks, *meet)
    right = asked.drop("queries").withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).repartition(tasks, *meet)
    bounds = map_arrow(left.join(right, meet).drop("run"), scan_cells(k), BOUNDS, rows=1)

    key = ["dim", "grp", "q"]
    of = Window.partitionBy(*key)
    kth = F.max(F.when(F.col("n") == k, F.struct(F.col("lower").alias("value"), "vec"))).over(of)
    ranked = bounds.withColumn("n", F.row_number().over(of.orderBy(F.desc("lower"), "vec"))).withColumn("least", kth).where(_reaches("upper", F.col("least")))
    ordered = cut(ranked.select(*key, "block", "place", "vec", "upper", F.row_number().over(of.orderBy(F.desc("upper"), "vec")).alias("turn")), "topk-bounds")

    def read(pairs: DataFrame) -> DataFrame:
        pair = F.shiftleft(F.col("q").cast("long"), 32).bitwiseOR(F.col("place").cast("long"))
        wanted = pairs.groupBy("dim", "block", "grp").agg(F.collect_list(pair).alias("pairs"))
        fetched = map_arrow(wanted.join(packed.select("dim", "block", "ids", "exact"), ["dim", "block"]).drop("block"), fetch, FETCHED, rows=1)
        return map_arrow(fetched.join(asked.drop("homes"), ["dim", "grp"]), multiply, SCORED, rows=1)

    best = F.row_number().over(of.orderBy(F.desc("score"), "vec"))
    first = cut(read(ordered.where(F.col("turn") <= FIRST * k)), "topk-first")
    found = first.withColumn("n", best).where(F.col("n") == k).select(*key, F.struct(F.col("score").cast("double").alias("value"), "vec").alias("least"))
    rest = ordered.where(F.col("turn") > FIRST * k).join(found, key).where(_reaches("upper", F.col("least")))
    return (
        first.unionByName(read(rest)).withColumn("rank", best).where(F.col("rank") <= k)
        .select(F.col("query").alias("query_id"), "rank", F.col("vec").alias("vec_id"), "score")
    )


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0),
r AS (
  SELECT query_id, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
