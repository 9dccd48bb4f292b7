"""SimHash near-duplicate groups by a generalised pigeonhole join.

Fingerprints within ``limit`` differing bits link. The 64 bits are cut into
partitions of correlated bits; partition i gets a threshold t_i with
sum(t_i) = limit - m + 1, so that every linked pair is within t_i bits in at
least one partition. Thresholds come from dynamic programming on candidate
counts estimated on a bounded sample of fingerprints; the sample steers cost
only, never results. Probes are the partition's bits with up to t_i flips;
candidates are verified on all 64 bits.

Only distinct fingerprints are joined, so copies never multiply. Within a probe
key that many fingerprints share, the other bits are cut into ``limit + 1``
parts, of which a linked pair has one in common, so that only such are compared;
what still shares a key is cut into blocks, compared block against block in
separate tasks; each comparison returns a spanning forest of its links, not the
pairs. Components are contracted by joins with shared-folder tables
between the rounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_others, drop_stored, slices, stored

#: Sampled fingerprints at most, and the largest share of them.
SAMPLE, SHARE = 4096, 0.1
#: Fingerprints under one probe key that one task compares with as many others; keys of more than HOT are cut by the other bits first.
BLOCK, HOT = 512, 4096
#: Shingles whose bits are counted at once.
CHUNK = 65_536


def fingerprint(text: str | None, k: int, seed: int) -> int:
    """64-bit SimHash of the k-word shingles (fewer words: of the whole sequence; none: 0)."""
    ws = text.encode().lower().split() if text else []
    if not ws:
        return 0
    joined = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(ws) - k + 1)
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    spans = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    for at in range(0, n, CHUNK):
        h = np.array([digest(joined[a:b], seed) for a, b in islice(spans, min(CHUNK, n - at))], np.uint64)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """key and fp, a signed long with the 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others("near_dups")
        for b in slices(batches, 2000, 1):
            made = np.array([fingerprint(t, words, seed) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made.view(np.int64))], names=[key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, f"`{key}` {kind}, fp long")


def partitions(sample: np.ndarray, n: int, limit: int) -> list[tuple[list[int], int]]:
    """Bits and threshold of each partition used, for n fingerprints."""
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    with np.errstate(all="ignore"):
        like = np.abs(np.nan_to_num(np.corrcoef(bits.T))) if len(sample) > 1 else np.eye(64)
    best: tuple[float, list] = (math.inf, [])
    for m in range(2, limit + 2):
        free, groups = set(range(64)), []
        for g in range(m):
            size = len(free) // (m - g)
            group = [min(free)]
            free.discard(group[0])
            while len(group) < size:
                nxt = max(free, key=lambda b: (like[b, group].mean(), -b))
                group.append(nxt)
                free.discard(nxt)
            groups.append(sorted(group))
        cost = _allocate(sample, groups, n, limit)
        best = min(best, cost, key=lambda x: x[0])
    return best[1]


def _allocate(sample: np.ndarray, groups: list[list[int]], n: int, limit: int) -> tuple[float, list]:
    """Thresholds of least estimated cost: rows to shuffle, and pairs to compare at a hundredth of that."""
    some = sample[:1500].astype(np.uint64)
    pairs = max(1, len(some) * (len(some) - 1))

    def cost(group: list[int], t: int) -> float:
        if t < 0:
            return 0.0
        mask = np.uint64(sum(1 << b for b in group))
        near = sum(int((np.bitwise_count((some[i : i + 250, None] ^ some[None, :]) & mask) <= t).sum()) for i in range(0, len(some), 250)) - len(some)
        share = max(near, 0) / pairs + sum(math.comb(len(group), j) for j in range(t + 1)) / 2.0 ** len(group)
        return n * sum(math.comb(len(group), j) for j in range(t + 1)) + 0.01 * n * n / 2 * share

    total = limit - len(groups) + 1
    table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group in groups:
        costs = {t: cost(group, t) for t in range(-1, min(limit, 2) + 1)}
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in table.items():
            for t, more in costs.items():
                step[s + t] = min(step.get(s + t, (math.inf, [])), (c + more, [*ts, t]))
        table = step
    c, ts = table.get(total, (math.inf, []))
    return c, [(g, t) for g, t in zip(groups, ts, strict=False) if t >= 0]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _forest(fps: list[int], own: list[bool], limit: int) -> list[tuple[int, int]]:
    """Spanning forest of the links between own entries and all entries."""
    if len(fps) == 2:
        return [(fps[0], fps[1])] if fps[0] != fps[1] and (own[0] or own[1]) and ((fps[0] ^ fps[1]) & (2**64 - 1)).bit_count() <= limit else []
    all_ = np.unique(np.array(fps, np.int64)).view(np.uint64)
    mine = np.unique(np.array([f for f, o in zip(fps, own, strict=True) if o], np.int64)).view(np.uint64)
    parent = list(range(len(all_)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    order = np.argsort(all_)
    place = order[np.searchsorted(all_, mine, sorter=order)].tolist()
    out = []
    for i in range(0, len(mine), 256):
        near = np.bitwise_count(mine[i : i + 256, None] ^ all_[None, :]) <= limit
        for a, b in np.argwhere(near).tolist():
            x, y = root(place[i + a]), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((place[i + a], b))
    signed = all_.view(np.int64).tolist()
    return [(signed[a], signed[b]) for a, b in out]


def _probes(p: int, mask: int, flips: list[int]) -> Column:
    """The keys of partition p that a fingerprint probes, and whether a key is its own."""
    own = F.col("fp").bitwiseAND(F.lit(mask))
    return F.transform(F.array(*[F.lit(f) for f in flips]), lambda x: F.struct(F.lit(p).alias("p"), own.bitwiseXOR(x).alias("k"), (x == 0).alias("own")))


def links(fps: DataFrame, n: int, sample: np.ndarray, limit: int) -> DataFrame:
    """Edges a < b between the distinct fingerprints ``fps`` (column fp) that
    connect exactly what linking all pairs within ``limit`` bits connects."""
    made, finer = [], []
    for p, (group, t) in enumerate(partitions(sample, n, limit)):
        flips = [_signed(sum(1 << b for b in c)) for k in range(t + 1) for c in combinations(group, k)]
        made.append(_probes(p, _signed(sum(1 << b for b in group)), flips))
        rest = [b for b in range(64) if b not in group]
        finer.append(F.array(*[F.lit(_signed(sum(1 << b for b in rest[j :: limit + 1]))) for j in range(limit + 1)]))
    probes = fps.select("fp", F.inline(F.concat(*made)))
    counts = probes.groupBy("p", "k").agg(F.count("*").alias("c"), F.max("own").alias("o")).where((F.col("c") > 1) & F.col("o")).select("p", "k", "c")
    met = probes.join(counts, ["p", "k"])
    cold = met.where(F.col("c") <= HOT).select("p", "k", F.lit(-1).alias("j"), F.lit(0).cast("long").alias("r"), "fp", "own", "c")
    parts = met.where(F.col("c") > HOT).select("p", "k", F.posexplode(F.get(F.array(*finer), F.col("p"))).alias("j", "mask"), "fp", "own").withColumn("r", F.col("fp").bitwiseAND(F.col("mask"))).drop("mask")
    again = parts.groupBy("p", "k", "j", "r").agg(F.count("*").alias("c"), F.max("own").alias("o")).where((F.col("c") > 1) & F.col("o")).drop("o")
    grouped = cold.unionByName(parts.join(again, ["p", "k", "j", "r"])).withColumn("nb", F.ceil(F.col("c") / BLOCK).cast("int"))
    block = F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int")
    paired = grouped.withColumn("b", block).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    paired = paired.select("p", "k", "j", "r", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), "fp", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, own = None, [], []
        a, b = [], []

        def close() -> None:
            if len(group) > 1:
                for x, y in _forest(group, own, limit):
                    a.append(min(x, y))
                    b.append(max(x, y))

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for *k, fp, o in zip(*cols, strict=True):
                if k != key:
                    close()
                    key, group, own = k, [], []
                group.append(fp)
                own.append(o)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        close()
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    keys = ["p", "k", "j", "r", "lo", "hi"]
    return paired.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root of every node of ``edges`` (a, b): one root per component.

    Each round every node moves to its neighbour of least random rank, then the
    moved edges are joined again; the count of nodes falls by a constant factor
    a round whatever the shape of the graph, and hubs are only ever the side of
    a join or aggregate that Spark can split or combine early.
    """
    spark = edges.sparkSession
    edges = stored(edges, "edges")
    moves: list[DataFrame] = []
    k = 0
    while not edges.isEmpty():
        k += 1
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c, k=k: F.struct(F.xxhash64(F.col(c), F.lit(k)), F.col(c).alias("n"))
        move = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select("a", F.least(F.col("m"), rank("a"))["n"].alias("to")).where("a <> to")
        move = stored(move, "moves")
        x = edges.join(move.select("a", F.col("to").alias("ta")), "a", "left").join(move.select(F.col("a").alias("b"), F.col("to").alias("tb")), "b", "left")
        x = x.select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        moves.append(move)
        before, edges = edges, stored(x, "edges")
        drop_stored(spark, before)
    drop_stored(spark, edges)
    if not moves:
        return spark.createDataFrame([], "node long, root long")
    # From the last round backwards: where each round's nodes stand in the end.
    # A component ends as one node, so a node met in several rounds has one root.
    final = moves[-1].select(F.col("a").alias("node"), F.col("to").alias("root"))
    for move in reversed(moves[:-1]):
        here = move.join(final, move["to"] == final["node"], "left").select(move["a"].alias("node"), F.coalesce("root", "to").alias("root"))
        final = stored(here.union(final).distinct(), "roots")
    out = stored(final.union(final.select("root", "root")).distinct(), "components")
    for done in moves:
        drop_stored(spark, done)
    return out


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 4, limit: int = 4, seed: int = 42) -> DataFrame:
    """key, fp (signed long), component: the least key reachable over links of
    ``limit`` differing bits or fewer; one row per row of ``docs``.

    Null, empty and wordless texts have fingerprint 0 and link like any other.
    Rows with a null key get their component too, but never name one. Repeated
    rows and extra columns don't matter; an empty table gives an empty result.
    """
    fps = stored(fingerprints(docs, key=key, text=text, words=words, seed=seed), "fingerprints")
    distinct = stored(fps.groupBy("fp").agg(F.min(key).alias("least")), "distinct")
    n = distinct.count()
    buckets = max(int(1 / SHARE), math.ceil(n / SAMPLE), 1)
    sample = np.array([r[0] for r in distinct.where(F.pmod(F.xxhash64("fp"), F.lit(buckets)) == 0).select("fp").limit(2 * SAMPLE).collect()], np.int64).view(np.uint64)
    edges = stored(links(distinct.select("fp"), n, sample, limit), "links")
    found = components(edges)
    drop_stored(docs.sparkSession, edges)
    placed = stored(found.join(distinct, found["node"] == distinct["fp"]).select("fp", "root", "least"), "placed")
    least = stored(placed.groupBy("root").agg(F.min("least").alias("component")), "least")
    named = stored(placed.join(least, "root").select("fp", "component"), "named")
    # Tables on both sides of the last join: Spark can split what a fingerprint of many rows reads.
    by_fp = stored(distinct.join(named, "fp", "left").select("fp", F.coalesce("component", "least").alias("component")), "classes")
    for done in (distinct, found, placed, least, named):
        drop_stored(docs.sparkSession, done)
    return fps.join(by_fp, "fp", "left").select(F.col(f"`{key}`"), "fp", "component")
