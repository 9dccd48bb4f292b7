"""Tiles of frames: text-likelihood features, closing, components."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# When a difference counts as an edge, and the score's gates and weights.
EDGE, CONTRAST, EDGES, CROSSINGS = 0.12, 0.20, 0.030, 0.015
WEIGHT_EDGES, WEIGHT_CROSSINGS, WEIGHT_CONTRAST, WEIGHT_ANISOTROPY, MOST_ANISOTROPY = 6, 9, 0.5, 0.15, 3


def luminance(r: Column, g: Column, b: Column) -> Column:
    """0 to 1 of 8-bit colours."""
    return (0.299 * r + 0.587 * g + 0.114 * b) / 255


def tile_features(pixels: DataFrame, keys: list[str], *, tile: int = 8) -> DataFrame:
    """Per tile (ty, tx) of the pixels (keys, y, x, lum): variance, contrast,
    edges, crossings and score. Neighbours to the right and below are those of
    the image, the border's own at the border; crossings count changes of sign
    along a tile's row among differences beyond ``EDGE``.

    Windows are over rows and columns of an image, never whole images."""
    row, column = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")
    p = pixels.withColumn("dh", F.coalesce(F.lead("lum").over(row), F.col("lum")) - F.col("lum")).withColumn("dv", F.coalesce(F.lead("lum").over(column), F.col("lum")) - F.col("lum"))
    p = p.withColumns({"ty": F.floor(F.col("y") / tile).cast("int"), "tx": F.floor(F.col("x") / tile).cast("int")}).withColumn("s", F.when(F.abs("dh") > EDGE, F.signum("dh")))
    before = F.last("s", ignorenulls=True).over(Window.partitionBy(*keys, "ty", "tx", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, -1))
    p = p.withColumn("crossed", (F.col("s").isNotNull() & (before != F.col("s"))).cast("int"))
    sums = p.groupBy(*keys, "ty", "tx").agg(F.count("*").alias("n"), F.sum("lum").alias("s1"), F.sum(F.col("lum") * F.col("lum")).alias("s2"), F.least(F.lit(1.0), F.min("lum")).alias("mn"), F.greatest(F.lit(0.0), F.max("lum")).alias("mx"), F.sum(F.abs("dh")).alias("he"), F.sum(F.abs("dv")).alias("ve"), F.sum(F.coalesce("crossed", F.lit(0))).alias("cr"))
    return scored(sums, keys)


def scored(sums: DataFrame, keys: list[str]) -> DataFrame:
    n = F.col("n")
    made = sums.withColumns({"variance": F.greatest(F.lit(0.0), F.col("s2") / n - (F.col("s1") / n) * (F.col("s1") / n)), "contrast": F.col("mx") - F.col("mn"), "edges": (F.col("he") + F.col("ve")) / n, "crossings": F.col("cr") / n, "anisotropy": F.col("he") / F.greatest(F.col("ve"), F.lit(1e-4))})
    score = F.col("edges") * WEIGHT_EDGES + F.col("crossings") * WEIGHT_CROSSINGS + F.col("contrast") * WEIGHT_CONTRAST + F.least(F.col("anisotropy"), F.lit(MOST_ANISOTROPY)) * WEIGHT_ANISOTROPY
    textual = (F.col("contrast") > CONTRAST) & (F.col("edges") > EDGES) & (F.col("crossings") > CROSSINGS)
    return made.select(*keys, "ty", "tx", "variance", "contrast", "edges", "crossings", F.when(textual, score).otherwise(F.lit(0.0)).alias("score"))


def closed(on: DataFrame, keys: list[str], *, run: int = 2) -> DataFrame:
    """On tiles (keys, ty, tx) and those off between two on ones of a row, in gaps of ``run`` or fewer."""
    before = F.lag("tx").over(Window.partitionBy(*keys, "ty").orderBy("tx"))
    gap = on.withColumn("b", before).withColumn("from", F.when(F.col("tx") - F.col("b") - 1 <= run, F.col("b") + 1).otherwise(F.col("tx")))
    return gap.select(*keys, "ty", F.explode(F.sequence("from", "tx")).alias("tx")).distinct()


def components(on: DataFrame, keys: list[str]) -> DataFrame:
    """8-connected components of on tiles (keys, ty, tx, score): component (from
    0 in raster order), x0, x1, y0, y1, tiles, mean_score. A frame's tiles are
    few and bounded by its size, so each frame is labelled in one call."""
    kinds = {f.name: f.dataType.simpleString() for f in on.schema.fields}
    out = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "component int, x0 int, x1 int, y0 int, y1 int, tiles int, mean_score double"])

    def label(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ty", "tx"]).reset_index(drop=True)
        place = {(y, x): i for i, (y, x) in enumerate(zip(frame["ty"], frame["tx"], strict=True))}
        mark = np.full(len(frame), -1)
        n = 0
        for at, i in place.items():
            if mark[i] < 0:
                todo = [at]
                mark[i] = n
                while todo:
                    y, x = todo.pop()
                    for near in ((y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)):
                        j = place.get(near)
                        if j is not None and mark[j] < 0:
                            mark[j] = n
                            todo.append(near)
                n += 1
        g = frame.assign(component=mark).groupby("component")
        made = pd.DataFrame({"component": range(n), "x0": g["tx"].min(), "x1": g["tx"].max(), "y0": g["ty"].min(), "y1": g["ty"].max(), "tiles": g.size(), "mean_score": g["score"].mean()})
        for k in keys:
            made[k] = frame[k].iloc[0]
        return made[[*keys, "component", "x0", "x1", "y0", "y1", "tiles", "mean_score"]]

    return on.groupBy(*keys).applyInPandas(label, out)


def text_like(found: DataFrame, *, width: int, height: int, tile: int = 8, least: int = 3) -> DataFrame:
    """Components shaped like text, with box, aspect, fill and score. ``width``
    and ``height`` are the frame's, in tiles."""
    w, h = (F.col("x1") - F.col("x0") + 1) * tile, (F.col("y1") - F.col("y0") + 1) * tile
    made = found.withColumns({"w": w, "h": h}).withColumns({"aspect_": F.col("w") / F.greatest(F.col("h"), F.lit(1)), "fill_": F.col("tiles") * tile * tile / (F.col("w") * F.col("h"))})
    kept = made.where((F.col("tiles") >= least) & (F.col("h") >= tile) & F.col("aspect_").between(1.2, 60) & (F.col("fill_") >= 0.35) & (F.col("w") * F.col("h") <= 0.35 * width * tile * height * tile))
    return kept.withColumns({"x": F.col("x0") * tile, "y": F.col("y0") * tile, "aspect": F.round("aspect_", 2), "fill": F.round("fill_", 2), "score": F.round("mean_score", 3)}).drop("aspect_", "fill_", "x0", "x1", "y0", "y1", "mean_score")


def best(found: DataFrame, keys: list[str], *, most: int = 120) -> DataFrame:
    """The ``most`` components of highest score of each frame, ties in raster order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "component"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most)


def heat(tiles: DataFrame, *, threshold: float = 1.05) -> DataFrame:
    """The diagnostic map as a table: shade 0 to 1, and whether a tile is hot."""
    return tiles.withColumns({"shade": F.least(F.lit(1.0), F.col("score") / F.greatest(F.lit(2.5), F.lit(threshold * 1.5))), "hot": F.col("score") >= threshold})


def pixels_of(vectors: DataFrame, key: str, vector: str, *, side: int = 8, low: float = -0.55, span: float = 1.1) -> DataFrame:
    """Vectors of side * side values as images: key, y, x, lum in 0 to 1."""
    p = vectors.select(key, F.posexplode(vector).alias("i", "v"))
    return p.select(key, F.floor(F.col("i") / side).cast("int").alias("y"), (F.col("i") % side).alias("x"), ((F.col("v").cast("double") - low) / span).alias("lum"))


