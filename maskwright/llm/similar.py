"""Links between all texts whose word-shingle sets have Jaccard similarity 0.8
or more.

Candidates come from two sources: SimHash components of few differing bits,
and prefixes of the shingle sets. Under one order of all shingles, two sets of
similarity 0.8 or more share one of the first n - ceil(0.8 n) + 1 shingles of
each, so the second source misses no pair. The order puts shingles that are
common in a bounded sample last; the sample steers cost only, never results.
Candidates whose sizes, places or bit maps rule the similarity out are left;
all others are verified on the whole sets, which are made for their texts only.

Texts known to be equal are one node. Candidates of three stars per shared
shingle are verified first, one around the text that holds the shingle earliest
(in a group of copies, the one least changed); only shingles that still join
different components are then compared pair by pair. A join makes those pairs
for few texts under a shingle; more are compared by their bit maps in a task,
which returns those that the maps don't rule out, so no group's pairs are rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_others, few, slices, stored
from .near_dups import components, near_duplicates

#: Texts sampled for the order of shingles, about, and common shingles known at most.
SAMPLE, COMMON = 20_000, 400_000
#: Longs of a set's bit map.
MAP = 32
#: Texts under one shingle whose pairs a join makes at most; more are compared in a task, in blocks of BLOCK (some 10 MB of maps), PAIRS at once.
HOT, BLOCK, PAIRS = 8, 32_768, 100_000


def shingles(text: str | None, k: int, seed: int = 42) -> np.ndarray:
    """Distinct 64-bit hashes of the k-word shingles, ascending (fewer words: of
    the whole sequence; none: of the empty one)."""
    ws = text.encode().lower().split() if text else []
    joined, digest = b" ".join(ws), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    n = max(1, len(ws) - k + 1)
    if n == 1:
        return np.array([digest(joined, seed)], np.uint64)
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, n))


def prefix(found: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles under the order: those not in ``common`` (ascending) by
    hash, then those in it by rank."""
    size = len(found) - -(-4 * len(found) // 5) + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        known = common[at] == found
        found = np.concatenate((found[~known], found[known][np.argsort(rank[at[known]])]))
    return found[:size]


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """node and s, the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others("similar")
        for b in slices(batches, 500, 1):
            yield pa.RecordBatch.from_pydict({"node": b.column(0), "s": _lists([shingles(t, words) for t in b.column(1).to_pylist()])})

    return texts.mapInArrow(run, "node long, s array<long>")


def _profiles(texts: DataFrame, words: int, common: np.ndarray, rank: np.ndarray) -> DataFrame:
    """node, n (size of its set), p (the set's prefix) and m (a map of the bits that the whole set hits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others("similar")
        for b in slices(batches, 500, 1):
            whole = [shingles(t, words) for t in b.column(1).to_pylist()]
            maps = np.zeros((len(whole), 64 * MAP), bool)
            for row, x in zip(maps, whole, strict=True):
                row[x % np.uint64(64 * MAP)] = True
            bits = np.packbits(maps, axis=1, bitorder="little").view("<u8")
            yield pa.RecordBatch.from_pydict({"node": b.column(0), "n": pa.array([len(x) for x in whole], pa.int32()), "p": _lists([prefix(x, common, rank) for x in whole]), "m": _lists(list(bits))})

    return texts.mapInArrow(run, "node long, n int, p array<long>, m array<long>")


def _rows_of(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _fits(na: Column, nb: Column, most: Column) -> Column:
    """Whether sets of these sizes that share ``most`` shingles are similar enough."""
    return 9 * most >= 4 * (na + nb)


def _placed(a: str, b: str) -> Column:
    """Whether sets whose first shared shingle is at places i can be: what follows is all they share."""
    na, nb = F.col("n" + a), F.col("n" + b)
    return _fits(na, nb, F.least(na - F.col("i" + a), nb - F.col("i" + b)))


def _mapped(n: np.ndarray, i: np.ndarray, root: np.ndarray, m: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the texts ``left`` with those ``right`` (one with itself: with later ones), pairs of
    different roots that neither places under their shingle nor bit maps rule out."""
    step = max(1, PAIRS // max(1, len(right)))
    for at in range(0, len(left), step):
        a, b = left[at : at + step, None], right[None]
        fit = (root[a] != root[b]) & (9 * np.minimum(n[a] - i[a], n[b] - i[b]) >= 4 * (n[a] + n[b]))
        if left is right:
            fit &= a < b
        x, y = np.nonzero(fit)
        x, y = left[at + x], right[y]
        lone = [np.bitwise_count(m[p] & ~m[q]).sum(axis=1, dtype=np.int64) for p, q in ((x, y), (y, x))]
        near = 9 * np.minimum(n[x] - lone[0], n[y] - lone[1]) >= 4 * (n[x] + n[y])
        if near.any():
            yield x[near], y[near]


def _within(rows: DataFrame) -> DataFrame:
    """Candidates a, b (repeated, if they share several shingles) among ``rows``
    (h, node, n, i, root, m and c, the count of rows of h). A task compares a
    shingle's texts, or two blocks of them, with no row for a pair that is ruled out."""
    nb = F.ceil(F.col("c") / BLOCK).cast("int")
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("node"), nb).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), nb - 1)))
    keys = ["h", "lo", "hi"]
    dealt = dealt.select("h", F.least("own", "o").alias("lo"), F.greatest("own", "o").alias("hi"), "own", "node", "n", "i", "root", "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others("similar")
        key, parts = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if not parts:
                return
            own, node, n, i, root, m = (np.concatenate(x) for x in zip(*parts, strict=True))
            left = np.flatnonzero(own == key[1])
            right = left if key[1] == key[2] else np.flatnonzero(own == key[2])
            for x, y in _mapped(n, i, root, m, left, right):
                yield pa.RecordBatch.from_pydict({"a": np.minimum(node[x], node[y]), "b": np.maximum(node[x], node[y])})

        for batch in batches:
            if not batch.num_rows:
                continue
            h, lo, hi, own, node, n, i, root = (batch.column(j).to_numpy() for j in range(8))
            m = batch.column(8).flatten().to_numpy().view(np.uint64).reshape(-1, MAP)
            cuts = np.flatnonzero((np.diff(h) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)) + 1
            for p, q in zip([0, *cuts.tolist()], [*cuts.tolist(), len(h)], strict=True):
                if key != (k := (h[p], lo[p], hi[p])):
                    yield from close()
                    key, parts = k, []
                parts.append((own[p:q], node[p:q], n[p:q].astype(np.int64), i[p:q].astype(np.int64), root[p:q], m[p:q]))
        yield from close()

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def _side(table: DataFrame, x: str, *columns: str) -> DataFrame:
    return table.select(F.col("node").alias(x), *[F.col(c).alias(c + x) for c in columns])


def once(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One of the rows of each key. Where few keys repeat, only rows of theirs are shuffled."""
    many = few(stored(rows.groupBy(*keys).count().where("count > 1").select(*keys), "repeated"))
    return rows.join(many, keys, "left_anti").unionByName(rows.join(many, keys, "left_semi").dropDuplicates(keys))


def _verified(pairs: DataFrame, profiles: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Those of the candidates a, b whose whole sets are similar."""
    na, nb = F.col("na"), F.col("nb")
    # A bit that one set hits and the other doesn't holds a shingle that isn't shared.
    lone = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda n, k: n + k)
    most = F.least(na - lone("ma", "mb"), nb - lone("mb", "ma"))
    of = lambda some, table: table.join(few(stored(some.select(F.col("a").alias("node")).union(some.select("b")).distinct(), "used")), "node", "left_semi")
    asked = of(pairs, profiles.select("node", "n", "m"))
    left = pairs.join(_side(asked, "a", "n", "m"), "a").join(_side(asked, "b", "n", "m"), "b").where(_fits(na, nb, most)).select("a", "b", "na", "nb")
    left = stored(left, "candidates")
    sets = stored(_sets(of(left, texts), words), "sets")
    return left.join(_side(sets, "a", "s"), "a").join(_side(sets, "b", "s"), "b").where(_fits(na, nb, F.size(F.array_intersect("sa", "sb")))).select("a", "b")


def similar(docs: DataFrame, *, text: str = "text", words: int = 5) -> DataFrame:
    """node and root for every text that is similar to another one; a node is
    ``xxhash64`` of the text.

    Wordless and null texts are similar to each other. Repeated rows don't
    matter; an empty table gives an empty result.
    """
    texts = once(docs.select(F.xxhash64(text).alias("node"), F.col(f"`{text}`").alias("text")), ["node"])  # copies are one text from here on
    buckets = max(1, docs.count() // SAMPLE)
    some = _sets(texts.where(F.pmod(F.xxhash64("node", F.lit(7)), F.lit(buckets)) == 0), words)
    often = some.select(F.explode("s").alias("h")).groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(COMMON).collect()
    held = sorted((r["h"] % (1 << 64), i) for i, r in enumerate(reversed(often)))
    common, rank = np.array([h for h, _ in held], np.uint64), np.array([i for _, i in held], np.int64)

    # Shingles of prefixes that different texts share.
    profiles = stored(_profiles(texts, words, common, rank), "profiles")
    # They are dealt out once, to be counted and kept: a shingle's rows are read in one task, which spills what is long.
    starts = profiles.select("node", "n", F.posexplode("p").alias("i", "h"))
    met = starts.withColumn("c", F.count("*").over(Window.partitionBy("h"))).where("c > 1")
    grouped = stored(met.select("h", "node", "n", "i"), "grouped")

    named = near_duplicates(texts, key="node", words=words)
    stars = _rows_of(named.select(F.col("node").alias("a"), F.col("component").alias("b")))
    for order in (F.xxhash64("node", F.lit(1)), F.xxhash64("node", F.lit(2)), F.col("i")):
        pivot = grouped.groupBy("h").agg(F.min(F.struct(order.alias("o"), "node", "n", "i")).alias("p"))
        rays = grouped.join(pivot, "h").select(F.col("node").alias("a"), F.col("p.node").alias("b"), "n", "i", F.col("p.n").alias("np"), F.col("p.i").alias("ip"))
        stars = stars.union(_rows_of(rays.where(_placed("", "p"))))
    stars = stored(stars.distinct(), "stars")
    first = stored(_verified(stars, profiles, texts, words), "similar")

    # Shingles that still join different components: every pair of theirs.
    found = components(first)
    open_ = grouped.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # Of shingles with the same texts the first one is kept: the order is one for all, so it is first in each of them.
    apart = open_.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c"), F.min("n").alias("least"), F.sum("i").alias("i"), F.sum(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1 << 32))).alias("s"), F.bit_xor(F.xxhash64("node", F.lit(4))).alias("x"))
    apart = apart.where("lo <> hi").groupBy("c", "least", "s", "x").agg(F.min(F.struct("i", "h")).alias("o")).select("o.h", "c", "least")
    open_ = stored(open_.join(apart, "h").where(_fits(F.col("n"), F.col("least"), F.col("n") - F.col("i"))).select("h", "node", "n", "i", "root", "c"), "open")
    cold = open_.where(F.col("c") <= HOT)
    a, b = (cold.select("h", F.col("node").alias(x), F.col("n").alias("n" + x), F.col("i").alias("i" + x), F.col("root").alias("r" + x)) for x in "ab")
    near = (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & _placed("a", "b")
    hot = open_.where(F.col("c") > HOT).join(profiles.select("node", "m"), "node")
    pairs = stored(a.join(b, "h").where(near).select("a", "b").union(_within(hot)).distinct(), "pairs")
    more = _verified(pairs.join(stars, ["a", "b"], "left_anti"), profiles, texts, words)
    return components(first.union(more))
