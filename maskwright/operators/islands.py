"""8-connected components of frames of any size.

A frame is cut into squares. In each square runs of tiles along a row are
joined to touching runs of the row above by union-find, in numpy; a square is
all that a task holds at once. Tiles on the squares' edges are then joined to
their neighbours across, which links the squares' labels, and labels that are
linked get their least one by rounds of joins, as many as the logarithm of the
longest chain of squares. Only edge tiles and labels are shuffled, and each
square once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import stored

#: Side of a square, in tiles.
SQUARE = 256


def run_labels(ty: np.ndarray, tx: np.ndarray) -> np.ndarray:
    """For tiles sorted by row and column, without repeats, the index of the first
    tile of each one's component."""
    n = len(ty)
    if not n:
        return np.zeros(0, "i8")
    starts = np.flatnonzero(np.r_[True, (ty[1:] != ty[:-1]) | (tx[1:] != tx[:-1] + 1)])
    ends = np.r_[starts[1:], n] - 1
    row, left, right = ty[starts], tx[starts], tx[ends]
    up = list(range(len(starts)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    # The runs of each row, and of the row above it; both are sorted, so one pass finds what touches.
    firsts = np.searchsorted(row, np.arange(row[0], row[-1] + 2)).tolist()
    for r in range(1, len(firsts) - 1):
        a, a_end, b, b_end = firsts[r - 1], firsts[r], firsts[r], firsts[r + 1]
        while a < a_end and b < b_end:
            if left[b] <= right[a] + 1 and left[a] <= right[b] + 1:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
            if right[a] < right[b]:
                a += 1
            else:
                b += 1
    roots = np.array([root(i) for i in range(len(starts))])
    return np.repeat(starts[roots], ends - starts + 1)


def _labelled(on: DataFrame, keys: list[str], square: int) -> DataFrame:
    """Tiles with (ly, lx), the first tile of their component within their square."""
    cell = [F.floor(F.col(c) / square).cast("int").alias(n) for c, n in (("ty", "_sy"), ("tx", "_sx"))]
    rows = on.select(*keys, "ty", "tx", "score", *cell).repartition(*keys, "_sy", "_sx").sortWithinPartitions(*keys, "_sy", "_sx", "ty", "tx")
    rows = rows.select(*keys, "_sy", "_sx", "ty", "tx", "score")
    n = len(keys) + 2

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def done() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            ty, tx = (whole.column(n + i).to_numpy(zero_copy_only=False) for i in (0, 1))
            first = run_labels(ty, tx)
            names = [*keys, "ty", "tx", "score", "ly", "lx"]
            return pa.RecordBatch.from_arrays([*[whole.column(i) for i in range(len(keys))], *[whole.column(n + i) for i in range(3)], pa.array(ty[first], pa.int32()), pa.array(tx[first], pa.int32())], names)

        for batch in batches:
            which = list(zip(*(batch.column(i).to_pylist() for i in range(n)), strict=True))
            cuts = [0, *[i for i in range(1, len(which)) if which[i] != which[i - 1]], len(which)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and which[a] != last:
                    yield done()
                    held = []
                held.append(batch.slice(a, b - a))
                last = which[a]
        if held:
            yield done()

    ints = [T.StructField(c, T.IntegerType()) for c in ("ly", "lx")]
    return rows.mapInArrow(label, T.StructType([*[on.schema[k] for k in keys], T.StructField("ty", T.IntegerType()), T.StructField("tx", T.IntegerType()), T.StructField("score", T.DoubleType()), *ints]))


def _least_of_links(links: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, root): of labels that ``links`` (keys, a, b; both ways) join, the least one."""
    root = stored(links.groupBy(*keys, F.col("a").alias("label")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        of = lambda c, name: root.select(*keys, F.col("label").alias(c), F.col("root").alias(name))
        # The least root among neighbours, handed to the label's root as well; then every root's own root.
        near = links.join(of("b", "_near"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("label")).agg(F.min("_near").alias("_near"))
        met = root.join(near, [*keys, "label"], "left").withColumn("_near", F.least("root", "_near"))
        told = met.groupBy(*keys, F.col("root").alias("label")).agg(F.min("_near").alias("_told"))
        met = met.join(told, [*keys, "label"], "left").withColumn("_best", F.least("_near", "_told")).select(*keys, "label", F.col("root").alias("_was"), F.col("_best").alias("_up"))
        over = met.select(*keys, F.col("label").alias("_up"), F.col("_up").alias("_top"))
        found = stored(met.join(over, [*keys, "_up"], "left").select(*keys, "label", F.least("_up", "_top").alias("root"), "_was"), "roots")
        if not found.where("root < _was").limit(1).count():
            return found.drop("_was")
        root = found.drop("_was")


def components(on: DataFrame, keys: list[str], *, square: int = SQUARE) -> DataFrame:
    """8-connected components of on tiles (keys, ty, tx, score; each tile once):
    component (from 0 in the order of their first tiles, by row, then column),
    x0, x1, y0, y1, tiles, mean_score. Results don't depend on ``square``. A frame
    without tiles has no rows; keys aren't null."""
    tiles = stored(_labelled(on.withColumns({"ty": F.col("ty").cast("int"), "tx": F.col("tx").cast("int"), "score": F.col("score").cast("double")}), keys, square), "tiles")
    label = F.struct("ly", "lx").alias("label")
    parts = stored(tiles.groupBy(*keys, "ly", "lx").agg(F.min("tx").alias("x0"), F.max("tx").alias("x1"), F.min("ty").alias("y0"), F.max("ty").alias("y1"), F.count("*").alias("tiles"), F.sum("score").alias("_sum")).withColumn("label", F.struct("ly", "lx")).drop("ly", "lx"), "parts")
    on_edge = F.expr(f"pmod(ty, {square}) IN (0, {square - 1}) OR pmod(tx, {square}) IN (0, {square - 1})")
    edge = tiles.where(on_edge).select(*keys, "ty", "tx", label)
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]
    near = edge.select(*keys, F.col("label").alias("a"), F.col("ty").alias("_y"), F.col("tx").alias("_x"), F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in steps])).alias("d"))
    away = F.expr(f"floor(ty / {square}) <> floor(_y / {square}) OR floor(tx / {square}) <> floor(_x / {square})")
    near = near.select(*keys, "a", "_y", "_x", (F.col("_y") + F.col("d.y")).alias("ty"), (F.col("_x") + F.col("d.x")).alias("tx")).where(away).drop("_y", "_x")
    links = stored(near.join(edge.withColumnRenamed("label", "b"), [*keys, "ty", "tx"]).where("a <> b").select(*keys, "a", "b").distinct(), "links")
    if links.limit(1).count():
        parts = parts.join(_least_of_links(links, keys), [*keys, "label"], "left").withColumn("label", F.coalesce("root", "label")).drop("root")
    whole = parts.groupBy(*keys, "label").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.sum("tiles").cast("int").alias("tiles"), F.sum("_sum").alias("_sum"))
    order = Window.partitionBy(*keys).orderBy("label")
    return whole.select(*keys, (F.row_number().over(order) - 1).alias("component"), "x0", "x1", "y0", "y1", "tiles", (F.col("_sum") / F.col("tiles")).alias("mean_score"))
