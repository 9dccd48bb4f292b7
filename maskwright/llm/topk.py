"""Exact top-k inner-product search with a pivot-distance index.

A vector of integers x gets one more component, sqrt(M - |x|^2) with M the
largest squared norm; a query gets a zero there. Then the squared distance of
the two is |q|^2 + M - 2 q.x, so the nearest vectors are those of highest
inner product. Vectors are keyed by their nearest pivot and their distance to
it, and each pivot's vectors are cut into annuli of sorted distance. A query
visits annuli in the order of the triangle-inequality bound on their distance
and stops where no annulus left can hold one of its k best.

Pivots grow with the root of the number of vectors. They and the annulus edges
come from a sample of some vectors a pivot and steer cost only. The annulus
directory has at most ``pivots * rings`` rows; each annulus's vectors are cut
into blocks of bounded size, so no annulus lands in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, slices, stored

#: Vectors and queries in a block; queries in a task that lists their visits.
VECTORS, QUERIES, LISTED = 1024, 256, 64
#: Scores up to this are exact in doubles; blocks that can exceed it are multiplied in whole numbers of any size.
EXACT = 1 << 53
#: Numbers in a matrix of distances at most.
CELLS = 4 << 20
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def quantised(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """id and v, floor(scale * component); rows with a null id, null or empty
    vector, or a null or non-finite component are left out."""
    finite = lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False))  # noqa: E731  false for NaN, which is the largest value
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("x"))
    rows = rows.where(F.col("id").isNotNull() & (F.size("x") > 0)).where(F.forall("x", finite))
    return rows.select("id", F.transform("x", lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def _pivots(sample: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Some rounds of k-means from random starts."""
    rng = np.random.default_rng(seed)
    pivots = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)]
    for _ in range(8):
        near = _distances(sample, pivots).argmin(axis=1)
        pivots = np.stack([sample[near == p].mean(axis=0) if (near == p).any() else pivots[p] for p in range(len(pivots))])
    return pivots


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers; those beyond 64 bits are the nearest that fit."""
    if np.abs(a.astype(np.float64)).max() * np.abs(b.astype(np.float64)).max() * a.shape[1] <= EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, _LEAST, _MOST).astype(np.int64)


def _lifted(v: np.ndarray, largest: float) -> np.ndarray:
    return np.hstack([v, np.sqrt(np.maximum(largest - (v * v).sum(1), 0))[:, None]])


def top_k(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5, scale: int = 256, pivots: int | None = None, rings: int = 8, sample: int = 4096, seed: int = 7, schedule: tuple[int, ...] = (1, 8)) -> DataFrame:
    """query_id, rank, the neighbour's id named as ``key``, and score: for every
    id divisible by ``every``, the k rows of other ids with the highest integer
    inner product, ties to smaller ids.

    ``schedule`` is the number of annuli a query visits in each round; a last
    round visits all annuli that the bounds then leave. ``pivots`` is by default
    an eighth of the root of the number of vectors, 32 at least; ``sample`` is
    the number of vectors that pivots are chosen from, 8 a pivot at least.

    Nulls: rows with a null id, a null or empty vector, or a null or non-finite
    component take no part. Every row with an id is a candidate, repeated ones
    each for themselves; of rows that share a query's id the least vector is
    the query, and none of them is its candidate. Vectors that lack components
    that others have are zero there. Components and scores beyond 64 bits are
    the nearest numbers that fit. A table without valid vectors gives an empty
    result. Extra columns are not read.
    """
    spark = vectors.sparkSession
    base = quantised(vectors, key, vector, scale)
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    facts = base.agg(F.count("*").alias("n"), F.max(square).alias("m"), F.max(F.size("v")).alias("w"), F.min(F.size("v")).alias("least")).first()
    if not facts["n"]:
        return spark.createDataFrame([], f"query_id long, rank int, `{key}` long, score long")
    largest, width = facts["m"], facts["w"]
    if width != facts["least"]:
        base = base.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v"))))
    pivots = pivots or max(32, math.isqrt(facts["n"]) // 8)
    sample = max(sample, 8 * pivots)
    buckets = max(1, facts["n"] // sample)
    picked = base.where(F.pmod(F.xxhash64("id"), F.lit(buckets)) == 0).select("v").limit(2 * sample).collect() or [base.select("v").first()]
    lifted = _lifted(np.array([r["v"] for r in picked], np.float64), largest)
    centres = _pivots(lifted, pivots, seed)
    d = _distances(lifted, centres)
    near, dist = d.argmin(axis=1), d.min(axis=1)
    edges = np.stack([np.quantile(dist[near == p], np.linspace(0, 1, rings + 1)[1:-1]) if (near == p).any() else np.zeros(rings - 1) for p in range(len(centres))])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, max(1, CELLS // len(centres))):
            dist = _distances(_lifted(_matrix(b.column(1)).astype(np.float64), largest), centres)
            p = dist.argmin(axis=1)
            own = dist[np.arange(len(p)), p]
            cell = p * rings + (edges[p] < own[:, None]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(own), b.column(0), b.column(1)], names=["cell", "d", "id", "v"])

    index = stored(base.mapInArrow(keyed, "cell int, d double, id long, v array<long>"), "index")
    directory = index.groupBy("cell").agg(F.count("*"), F.min("d"), F.max("d")).collect()  # pivots * rings rows at most
    cells = np.array(sorted(map(tuple, directory)), np.float64)
    # Numbered rows: copies of one row spread over their annulus's blocks.
    blocks = stored(_blocked(index.withColumn("at", F.monotonically_increasing_id()), "at", VECTORS, "id", "v"), "blocks")
    queries = index.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    queries = stored(queries.select("id", "v", F.lit(None).cast("array<struct<score:long,id:long>>").alias("best"), F.lit(0).alias("seen")), "queries")
    drop_stored(spark, index)
    spread = max(1, -(-queries.count() // LISTED))
    for most in (*schedule, None):
        visits = stored(_visits(queries.repartition(spread), cells, centres, largest, k, most, rings), "visits")
        found = _searched(visits, queries, blocks, k)
        old = queries.select(F.col("id").alias("q"), F.inline("best").alias("score", "id"))
        ranked = old.union(found).withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("r") <= k)
        best = ranked.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "score", "id"))).alias("b"))
        best = best.select("q", F.transform("b", lambda x: F.struct(x["score"].alias("score"), x["id"].alias("id"))).alias("b"))
        after = queries.join(best, queries["id"] == best["q"], "left").select("id", "v", F.coalesce("b", "best").alias("best"), (F.col("seen") + (most or 0)).alias("seen"))
        before, queries = queries, stored(after, "queries")
        for done in (before, visits):
            drop_stored(spark, done)
    drop_stored(spark, blocks)
    ranks = queries.select(F.col("id").alias("query_id"), F.posexplode("best").alias("p", "b"))
    return ranks.select("query_id", (F.col("p") + 1).alias("rank"), F.col("b.id").alias(key), F.col("b.score").alias("score"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Of a column of equally long lists of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _blocked(rows: DataFrame, spread: str, size: int, *columns: str) -> DataFrame:
    """The rows of each cell in blocks of about ``size``, dealt by a hash of ``spread``, as arrays."""
    number = rows.groupBy("cell").agg(F.ceil(F.count("*") / size).alias("nb"))  # a row for an annulus at most
    dealt = rows.join(F.broadcast(number), "cell").withColumn("block", F.pmod(F.xxhash64(spread), F.col("nb")))
    return dealt.groupBy("cell", "block").agg(F.collect_list(F.struct(*columns)).alias("rows"))


def _visits(queries: DataFrame, cells: np.ndarray, centres: np.ndarray, largest: float, k: int, most: int | None, rings: int) -> DataFrame:
    """A row for each query and annulus of this round: id, bar (its k-th score so far), cell."""
    pivot, lo, hi = (cells[:, 0] // rings).astype(int), cells[:, 2], cells[:, 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, max(1, CELLS // len(cells))):
            q = _matrix(b.column(1)).astype(np.float64)
            norm = (q * q).sum(axis=1)
            d = _distances(np.hstack([q, np.zeros((len(q), 1))]), centres)[:, pivot]
            bound = np.maximum(np.maximum(lo[None] - d, d - hi[None]), 0)
            order = np.argsort(bound, axis=1, kind="stable")
            place = np.argsort(order, axis=1, kind="stable")
            bars = [x[k - 1]["score"] if x is not None and len(x) >= k else None for x in b.column(2).to_pylist()]
            radius = np.array([np.inf if x is None else n + largest - 2 * x for x, n in zip(bars, norm, strict=True)])
            seen = b.column(3).to_numpy()[:, None]
            slack = 1e-7 * (norm + largest + 1)  # for rounding, so that ties are never lost
            go = (place >= seen) & (bound * bound <= (radius + slack)[:, None])
            if most is not None:
                go &= place < seen + most
            at, cell = np.nonzero(go)
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(bars, pa.int64()).take(at), pa.array(cells[cell, 0].astype(np.int32))], names=["id", "bar", "cell"])

    return queries.mapInArrow(run, "id long, bar long, cell int")


def _searched(visits: DataFrame, queries: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """q, score, id: each query's k best of each block that it visits, without those below its bar."""
    asked = _blocked(visits.join(queries.select("id", "v"), "id"), "id", QUERIES, "id", "v", "bar").select("cell", F.col("rows").alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            rows, asked = b.column(0).flatten(), b.column(1).flatten()
            ids, qs = rows.field("id").to_numpy(), asked.field("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            bars = np.array([_LEAST if x is None else x for x in asked.field("bar").to_pylist()], np.int64)
            scores = _products(_matrix(asked.field("v")), _matrix(rows.field("v"))[order])
            kept = (qs[:, None] != ids[None]) & (scores >= bars[:, None])
            top = np.argsort(np.where(kept, ~scores, _MOST), axis=1, kind="stable")[:, :k]  # stable: ties to smaller ids
            at, r = np.nonzero(np.take_along_axis(kept, top, axis=1))
            best = top[at, r]
            yield pa.RecordBatch.from_arrays([pa.array(qs[at]), pa.array(scores[at, best]), pa.array(ids[best])], names=["q", "score", "id"])

    return blocks.select("cell", "rows").join(asked, "cell").select("rows", "asked").mapInArrow(run, "q long, score long, id long")
