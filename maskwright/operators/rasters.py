"""Images as arrays: blocks of pixels, one block a row, row by row of the block.

A block holds any whole number of tiles, or what is left of one at the image's
right and lower border. What needs neighbours crosses blocks by a join of their
edges alone, and regions are proven by summed areas, so no pixel is shuffled
and none becomes a row.

Columns of a block: the image's keys, ``by`` and ``bx`` (the block's place among
the image's blocks, all but the last ones of one size), ``h`` and ``w`` (its
size in pixels) and its values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from .proof import FILL_PACKED, MOST_COLOURS
from .vision import EDGE, scored

_SUMS = ("n", "s1", "s2", "mn", "mx", "he", "ve", "cr")
#: What a tile says to its neighbours: its first and last column, first and last row, and the last sign of each of its rows.
_EDGES = ("left", "right", "top", "bottom", "sign")


def _tile_sums(lum: np.ndarray, tile: int) -> Iterator[tuple[int, int, list[float], list[np.ndarray | None]]]:
    """(ty, tx, sums, edges) of a block's tiles. Differences to the right and
    below are taken within the block; those at its right and lower edge come later."""
    height, width = lum.shape
    dh, dv = np.zeros_like(lum), np.zeros_like(lum)
    dh[:, :-1] = lum[:, 1:] - lum[:, :-1]
    dv[:-1] = lum[1:] - lum[:-1]
    sign = np.where(np.abs(dh) > EDGE, np.sign(dh), 0.0)
    for y in range(0, height, tile):
        for x in range(0, width, tile):
            at = np.s_[y : y + tile, x : x + tile]
            part, signs = lum[at], sign[at]
            # Along each row the last sign so far, nothing at the tile's start.
            place = np.where(signs != 0, np.arange(1, signs.shape[1] + 1), 0)
            last = np.maximum.accumulate(place, axis=1)
            held = np.take_along_axis(np.hstack([np.zeros((len(signs), 1)), signs]), last, axis=1)
            before = np.hstack([np.zeros((len(signs), 1)), held[:, :-1]])
            crossed = int(((signs != 0) & (before != 0) & (before != signs)).sum())
            sums = [part.size, part.sum(), (part * part).sum(), part.min(), part.max(), np.abs(dh[at]).sum(), np.abs(dv[at]).sum(), crossed]
            ends_right, ends_below = x + tile >= width, y + tile >= height
            edges = [part[:, 0] if x == 0 else None, part[:, -1] if ends_right else None, part[0] if y == 0 else None, part[-1] if ends_below else None, held[:, -1] if ends_right else None]
            yield y // tile, x // tile, sums, edges


def tile_features(images: DataFrame, keys: list[str], lum: str, *, tile: int = 8, size: tuple[int, int]) -> DataFrame:
    """What ``vision.tile_features`` gives, of images in blocks; ``size`` is the
    height and width of all blocks but an image's last ones, whole tiles. A null
    image or one without pixels has no tiles; a null value counts as 0."""
    if size[0] % tile or size[1] % tile:
        raise ValueError("blocks hold whole tiles")
    down, across = size[0] // tile, size[1] // tile
    fields = [images.schema[k] for k in keys]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, head, cols = [], [], {c: [] for c in (*_SUMS, *_EDGES)}
            by, bx, h, w, values = (batch.column(len(keys) + i).to_pylist() for i in range(5))
            for i, (y0, x0, height, width, v) in enumerate(zip(by, bx, h, w, values, strict=True)):
                if not v or not height or not width:
                    continue
                pixels = np.array([0.0 if p is None else p for p in v], dtype="f8").reshape(height, width)
                for ty, tx, found, edges in _tile_sums(pixels, tile):
                    own.append(i)
                    head.append((y0 * down + ty, x0 * across + tx))
                    for c, s in zip((*_SUMS, *_EDGES), (*found, *edges), strict=True):
                        cols[c].append(s)
            kept = [batch.column(k).take(pa.array(own, pa.int32())) for k in range(len(keys))]
            place = [pa.array([p[j] for p in head], pa.int32()) for j in (0, 1)]
            kinds = [pa.int64(), *[pa.float64()] * 6, pa.int64(), *[pa.list_(pa.float64())] * 5]
            yield pa.RecordBatch.from_arrays([*kept, *place, *[pa.array(cols[c], t) for c, t in zip(cols, kinds, strict=True)]], [*keys, "ty", "tx", *cols])

    doubles = T.ArrayType(T.DoubleType())
    schema = T.StructType([*fields, T.StructField("ty", T.IntegerType()), T.StructField("tx", T.IntegerType()), *[T.StructField(c, T.LongType() if c in ("n", "cr") else T.DoubleType()) for c in _SUMS], *[T.StructField(c, doubles) for c in _EDGES]])
    tiles = images.select(*keys, "by", "bx", "h", "w", F.col(lum).cast("array<double>")).mapInArrow(sums, schema)
    place = [*keys, "ty", "tx"]
    beside = tiles.where("left IS NOT NULL").select(*keys, "ty", (F.col("tx") - 1).alias("tx"), F.col("left").alias("_left"))
    below = tiles.where("top IS NOT NULL").select(*keys, (F.col("ty") - 1).alias("ty"), "tx", F.col("top").alias("_top"))
    inner = tiles.where("right IS NULL AND bottom IS NULL").select(*place, *_SUMS)
    rim = tiles.where("right IS NOT NULL OR bottom IS NOT NULL").join(beside, place, "left").join(below, place, "left")
    apart = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: F.abs(p - q)), F.lit(0.0), lambda s, d: s + d)
    over = F.col("right").isNotNull() & F.col("_left").isNotNull()
    under = F.col("bottom").isNotNull() & F.col("_top").isNotNull()
    steps = F.zip_with(F.zip_with("right", "_left", lambda p, q: q - p), "sign", lambda d, s: ((F.abs(d) > EDGE) & (s != 0) & (F.signum(d) != s)).cast("long"))
    rim = rim.withColumns({
        "he": F.col("he") + F.when(over, apart("right", "_left")).otherwise(0.0),
        "ve": F.col("ve") + F.when(under, apart("bottom", "_top")).otherwise(0.0),
        "cr": F.col("cr") + F.when(over, F.aggregate(steps, F.lit(0).cast("long"), lambda s, d: s + d)).otherwise(F.lit(0).cast("long")),
    })
    whole = inner.unionByName(rim.select(*place, *_SUMS))
    return scored(whole.withColumns({"mn": F.least(F.lit(1.0), "mn"), "mx": F.greatest(F.lit(0.0), "mx")}), keys)


# ---- destroying and proving ----


def _over_bands(regions: DataFrame, band: int) -> DataFrame:
    """A row for each band of rows that a region's box touches, at the least one."""
    b = F.col("box")
    top, low = F.floor(b["y"] / band), F.floor((b["y"] + F.greatest(b["h"], F.lit(1)) - 1) / band)
    return regions.withColumn("by", F.explode(F.sequence(top, low))).withColumn("by", F.col("by").cast("int"))


def masked(images: DataFrame, regions: DataFrame, keys: list[str], colours: str, *, band: int) -> DataFrame:
    """Images in bands (``bx`` 0, as wide as the image, ``band`` rows but for the
    last) with their regions' boxes filled: ``masked`` has the colours then, and
    ``clean`` the summed areas of what has the fill colour, (h + 1) * (w + 1)
    numbers. A band's boxes travel to its pixels; pixels stay where they are read."""
    boxes = _over_bands(regions.select(*keys, "box"), band).groupBy(*keys, "by").agg(F.collect_list("box").alias("_boxes"))
    names = [c for c in images.columns if c != colours]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index
            by, h, w = (batch.column(place(c)).to_pylist() for c in ("by", "h", "w"))
            out, sums = [], []
            for y0, height, width, pixels, inside in zip(by, h, w, batch.column(place(colours)), batch.column(place("_boxes")).to_pylist(), strict=True):
                flat = np.asarray(pixels.values, dtype="i4") if pixels.is_valid else np.zeros(0, "i4")
                plane = flat.reshape(height, width).copy()
                for b in inside or []:
                    top, left = b["y"] - y0 * band, b["x"]
                    plane[max(top, 0) : max(top + b["h"], 0), max(left, 0) : max(left + b["w"], 0)] = FILL_PACKED
                out.append(plane.ravel())
                table = np.zeros((height + 1, width + 1), "i4")
                table[1:, 1:] = (plane == FILL_PACKED).cumsum(axis=0).cumsum(axis=1)
                sums.append(table.ravel())
            made = [pa.array(x, pa.list_(pa.int32())) for x in (out, sums)]
            yield pa.RecordBatch.from_arrays([*[batch.column(place(c)) for c in names], *made], [*names, "masked", "clean"])

    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([*[images.schema[c] for c in names], T.StructField("masked", ints), T.StructField("clean", ints)])
    found = images.withColumn(colours, F.col(colours).cast("array<int>")).join(boxes, [*keys, "by"], "left")
    return found.select(*names, colours, "_boxes").mapInArrow(fill, schema)


def proofs(bands: DataFrame, regions: DataFrame, keys: list[str], *, band: int) -> DataFrame:
    """What ``proof.proofs`` gives, of bands made by ``masked``. In each band that
    a region's interior touches, its clean pixels are four look-ups in the summed
    areas; colours are counted only where a region isn't uniform. Pixels outside
    the image count as read and deviant."""
    b, one = F.col("box"), F.lit(1)
    inner = G.box(b["x"] + 1, b["y"] + 1, F.greatest(one, b["w"] - 2), F.greatest(one, b["h"] - 2))
    asked = _over_bands(regions.select(*keys, "index", "token", inner.alias("box")), band)
    at = asked.join(bands.select(*keys, "by", "h", "w", "masked", "clean"), [*keys, "by"], "left").fillna(0, ["h", "w"])  # no band: none of it is in the image
    keep = lambda v, most: F.greatest(F.lit(0), F.least(v, most))
    x0, x1 = keep(b["x"], F.col("w")), keep(b["x"] + b["w"], F.col("w"))
    y0, y1 = keep(b["y"] - F.col("by") * band, F.col("h")), keep(b["y"] + b["h"] - F.col("by") * band, F.col("h"))
    area = lambda y, x: F.get("clean", y * (F.col("w") + 1) + x)
    clean = F.coalesce(area(y1, x1) - area(y0, x1) - area(y1, x0) + area(y0, x0), F.lit(0))
    rows = F.sequence(y0, y1 - 1)
    seen = F.array_distinct(F.flatten(F.transform(rows, lambda y: F.slice("masked", y * F.col("w") + x0 + 1, x1 - x0))))
    # Rows of the interior in this band, in the image or not.
    high = F.least((F.col("by") + 1) * band, b["y"] + b["h"]) - F.greatest(F.col("by") * band, b["y"])
    odd = F.when((y1 > y0) & (x1 > x0) & (clean < (y1 - y0) * (x1 - x0)), seen).when(clean > 0, F.array(F.lit(FILL_PACKED))).otherwise(F.array().cast("array<int>"))
    inside = F.greatest(y1 - y0, F.lit(0)) * F.greatest(x1 - x0, F.lit(0))
    blank = F.when(inside < high * b["w"], F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    parts = at.select(*keys, "index", "token", (b["w"] * high).alias("pixels"), clean.alias("clean"), F.slice(F.array_union(odd, blank), 1, MOST_COLOURS).alias("colours"))
    total = parts.groupBy(*keys, "index").agg(F.first("token").alias("token"), F.sum("pixels").alias("pixels"), F.sum("clean").alias("_clean"), F.flatten(F.collect_set("colours")).alias("_colours"))
    found = total.withColumns({"deviant": F.col("pixels") - F.col("_clean"), "colours": F.least(F.lit(MOST_COLOURS), F.size(F.array_distinct("_colours"))).cast("int")})
    found = found.withColumn("uniform", F.col("deviant") == 0).withColumn("entropy", F.when(F.col("uniform"), 0.0))
    return found.select(*keys, "index", "token", "pixels", "deviant", "colours", "uniform", "entropy")


def luminances(colours: Column) -> Column:
    """Luminance 0 to 1 of each packed colour."""
    red, green, blue = (lambda p, k=k: F.shiftright(p, k).bitwiseAND(255) for k in (16, 8, 0))
    return F.transform(colours, lambda p: (0.299 * red(p) + 0.587 * green(p) + 0.114 * blue(p)) / 255)


def digest(bands: DataFrame, keys: list[str], colours: str) -> DataFrame:
    """keys, sha256, bytes: of an image's pixels the hash of its bands' hashes in
    order, each that of the comma-joined packed colours; three bytes a pixel. A
    task sees a band, an image's bands meet as hashes only."""
    one = F.struct("by", F.sha2(F.array_join(F.col(colours).cast("array<string>"), ","), 256).alias("s"))
    found = bands.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("_all"), F.sum(F.col("h") * F.col("w") * 3).cast("long").alias("bytes"))
    return found.select(*keys, F.sha2(F.array_join(F.transform("_all", lambda x: x["s"]), ""), 256).alias("sha256"), "bytes")
