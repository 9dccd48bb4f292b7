"""Best-fit packing of token sequences by minimum bin slack.

Only lengths decide a packing, so the plan is made from the count of items of
each length: at most ``capacity - 1`` numbers, whatever the data. Each bin
starts with the longest length left; bitset subset-sum dynamic programming over
the lengths left, longer ones first, finds the fullest feasible rest; the
combination is taken as often as the counts allow, then removed. Items find
their bin by their rank among those of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored
from .tokens import encoder


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, end rank, first bin, items a bin, offset) for
    ``counts[length]`` items of each length up to ``capacity``."""
    left = {n: c for n, c in counts.items() if c > 0}
    ranks = dict.fromkeys(left, 0)
    slots, bins = [], 0
    while left:
        first = max(left)
        left[first] -= 1
        used = {first: 1}
        for n, c in _fullest(left, capacity - first):
            used[n] = used.get(n, 0) + c
        left[first] += 1
        times = min(left[n] // c for n, c in used.items())
        at = 0
        for n, c in sorted(used.items(), reverse=True):
            slots.append((n, ranks[n], ranks[n] + c * times, bins, c, at))
            ranks[n] += c * times
            left[n] -= c * times
            at += n * c
            if not left[n]:
                del left[n]
        bins += times
    return slots


def _fullest(left: dict[int, int], room: int) -> list[tuple[int, int]]:
    """Lengths and how many of each fill ``room`` best."""
    reach, steps, every = 1, [], (1 << (room + 1)) - 1
    for n in sorted((n for n, c in left.items() if c and n <= room), reverse=True):
        before, copies, k = reach, min(left[n], room // n), 1
        while copies:  # copies in powers of two, as sums of them give every number
            k = min(k, copies)
            reach |= (reach << (n * k)) & every
            copies -= k
            k *= 2
        steps.append((n, before))
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, []
    for n, before in reversed(steps):
        c = 0
        while not before >> total & 1:
            total -= n
            c += 1
        if c:
            out.append((n, c))
    return out


def pack(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """A row for each piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids end with ``end_id``. Those of more than ``capacity`` ids
    are cut from the end into full pieces, each a sequence of its own; the first
    piece, if shorter, is packed like whole documents are. Nulls: a null text
    counts as empty, a null key is kept. Repeated rows are packed each for
    itself. Extra columns are not read; an empty table gives an empty result.
    """
    tail = np.array([end_id], "<u2").tobytes()
    kind = docs.schema[key].dataType.simpleString()
    fields = f"`{key}` {kind}, n long, crcs array<long>, r int, part long, own long, lr long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own, seen = TaskContext.get().partitionId(), 0, {}
        for b in slices(batches, 512, 1):
            out: list[tuple] = []
            for ids in encoder(tokenizer).encode(b.column(1).to_pylist()):
                wide = np.frombuffer(ids + tail, "<u2").astype("<u4")
                n = len(wide)
                r = n % capacity
                cuts = [0] * (r > 0) + list(range(r, n, capacity))
                crcs = [zlib.crc32(wide[a:e]) for a, e in zip(cuts, [*cuts[1:], n], strict=True)]
                out.append((n, crcs, r, part, own, seen.get(r, 0)))
                own += len(cuts) - (r > 0)
                seen[r] = seen.get(r, 0) + 1
            n, crcs, *rest = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(rest[0], pa.int32()), *[pa.array(x, pa.int64()) for x in rest[1:]]], names=[key, "n", "crcs", "r", "part", "own", "lr"])

    items = stored(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, fields), "items")
    sizes = stored(items.where("r > 0").groupBy("r", "part").count(), "sizes")
    counts = {row["r"]: row["n"] for row in sizes.groupBy("r").agg(F.sum("count").alias("n")).collect()}  # capacity - 1 rows at most
    before = F.coalesce(F.sum("count").over(Window.partitionBy("r").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = items.join(sizes.select("r", "part", before.alias("before")), ["r", "part"], "left")
    slots = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 6)
    codes = slots[:, 0] << 48 | slots[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = b.column("r").to_numpy().astype(np.int64)
            rank = b.column("rank").to_numpy(zero_copy_only=False)
            bins, offset = np.zeros(len(r), np.int64), np.zeros(len(r), np.int64)
            some = r > 0
            if some.any():
                s = slots[np.searchsorted(codes, r[some] << 48 | rank[some].astype(np.int64), side="right") - 1]
                j = rank[some].astype(np.int64) - s[:, 1]
                bins[some], offset[some] = s[:, 3] + j // s[:, 4], s[:, 5] + j % s[:, 4] * r[some]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in (key, "n", "crcs", "r", "part", "own")], pa.array(bins), pa.array(offset)], names=[key, "n", "crcs", "r", "part", "own", "bin", "offset"])

    ranked = ranked.select(f"`{key}`", "n", "crcs", "r", "part", "own", F.coalesce(F.col("before") + F.col("lr"), F.lit(0)).alias("rank"))
    placed = ranked.mapInArrow(place, f"`{key}` {kind}, n long, crcs array<long>, r int, part long, own long, bin long, offset long")
    pieces = placed.select(f"`{key}`", "n", "r", "part", "own", "bin", "offset", F.posexplode("crcs").alias("piece", "ids_crc32"))
    full = F.col("piece") - (F.col("r") > 0).cast("int")  # a full piece's number in its document
    short = full < 0
    return pieces.select(
        f"`{key}`", "piece",
        F.when(short, F.lit(0)).otherwise(F.col("r") + full * capacity).cast("long").alias("start"),
        F.when(short, F.col("r")).otherwise(capacity).cast("long").alias("length"),
        "ids_crc32",
        F.when(short, F.col("bin") * 2).otherwise((F.shiftleft("part", 32) + F.col("own") + full) * 2 + 1).alias("sequence_id"),
        F.when(short, F.col("offset")).otherwise(F.lit(0)).cast("long").alias("offset"),
    )
