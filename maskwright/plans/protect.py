"""Whole pipelines composed of the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.scan import cleared, fitted_label, scan_text
from ..operators import islands, proof, rasters, regions, vision
from ..sources.shared import stored
from .settings import Settings


def protect_texts(df: DataFrame, text: str, *, now, limit: int | None = None) -> DataFrame:
    """Scan, mask, re-scan and attest texts: adds hits (of the first scan), masked,
    remaining (hits left after masking) and attestation, whose count of masks
    includes those that a re-scan asked for. One projection, no shuffle.

    Texts of any length are scanned, unless a ``limit`` is given: longer ones,
    and nulls, are not, so their hits, masked and remaining are null and their
    attestation says neither sanitised nor uniform.
    """
    scanned = F.col(text).isNotNull() if limit is None else F.coalesce(F.length(text) <= limit, F.lit(False))
    found = df.withColumn("hits", F.when(scanned, scan_text(F.col(text))))
    left = cleared(found, text, "hits").withColumn("remaining", F.when(scanned, F.size("left")))
    masks = F.when(scanned, F.size("hits") + F.col("more"))
    return proof.attested(left, text, "masked", masks, F.coalesce(F.col("remaining") == 0, F.lit(False)), now, done=scanned).drop("left", "more")


@dataclass(frozen=True)
class Sanitised:
    """What ``sanitise`` gives: regions (keys, index, source, token, severity,
    label, surface, box, confidence), proofs, stamps (keys, index, at, label, size:
    what is drawn over a region once it is proven), bands (the masked images) and
    frames (keys, mask_count, all_uniform, scale, attestation)."""

    regions: DataFrame
    proofs: DataFrame
    stamps: DataFrame
    bands: DataFrame
    frames: DataFrame


def visual_regions(images: DataFrame, frames: DataFrame, keys: list[str], settings: Settings, *, band: int) -> DataFrame:
    """Text-like regions of images in bands: keys, id (rank by score), box, score, tiles, aspect, fill."""
    lit = images.select(*keys, "by", "bx", "h", "w", rasters.luminances(F.col("colours")).alias("lum"))
    tiles = rasters.tile_features(lit, keys, "lum", tile=settings.tile, size=(band, settings.tile)).where(F.col("score") >= settings.threshold)
    scores = stored(tiles.select(*keys, "ty", "tx", "score"), "scores")
    on = vision.closed(scores, keys).join(scores, [*keys, "ty", "tx"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    found = islands.components(on, keys).join(frames.select(*keys, F.ceil(F.col("width") / settings.tile).alias("_across"), F.ceil(F.col("height") / settings.tile).alias("_down")), keys)
    ranked = vision.best(vision.text_like(found, width=F.col("_across"), height=F.col("_down"), tile=settings.tile), keys)
    return ranked.select(*keys, F.col("rank").alias("id"), G.box(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("box"), "score", "tiles", "aspect", "fill")


def sanitise(images: DataFrame, dom: DataFrame, surfaces: DataFrame, keys: list[str], settings: Settings, *, band: int, now: Column) -> Sanitised:
    """Images through detection, fusion, scaling, clamping, destruction, proof,
    stamping and attestation.

    ``images`` come in bands (see ``operators.rasters``; ``bx`` 0, ``band`` a
    multiple of the tile) with colours (packed), width, height, and view, the
    viewport's width in the units of ``dom`` (keys, id, source, token, severity,
    label, box, confidence) and ``surfaces`` (keys, seq, kind, box); a null or
    zero view means a scale of 1. Mode ``dom-only`` looks at no pixels,
    ``paranoid`` masks text wherever it is seen. An image without regions is
    attested with none; regions of images that aren't there are dropped."""
    seen = F.coalesce(F.nullif("view", F.lit(0)), F.col("width"))
    frames = images.where("by = 0").select(*keys, "width", "height", (F.col("width") / F.greatest(F.lit(1), seen)).alias("scale"))
    scaled = lambda df: df.join(frames.select(*keys, "scale"), keys).withColumn("box", G.scaled(F.col("box"), F.col("scale"))).drop("scale")
    own, wide = scaled(dom), scaled(surfaces)
    if settings.mode == "dom-only":
        fused = own.select(*keys, "id", "source", "token", "severity", "label", F.lit(None).cast("string").alias("surface"), "box", "confidence")
    else:
        fused = regions.fuse(own, visual_regions(images, frames, keys, settings, band=band), wide, keys, paranoid=settings.mode == "paranoid")
    fitted = fused.join(frames.select(*keys, "width", "height"), keys).withColumn("box", G.clamped(F.col("box"), F.col("width"), F.col("height"))).where("box.w > 2 AND box.h > 2")
    order = Window.partitionBy(*keys).orderBy(F.col("source") == "gpu-visual", "id", "source", "token")
    kept = stored(fitted.select(*keys, (F.row_number().over(order) - 1).alias("index"), "source", "token", "severity", "label", "surface", "box", "confidence"), "regions")
    bands = stored(rasters.masked(images, kept, keys, "colours", band=band), "bands")
    proven = stored(rasters.proofs(bands, kept, keys, band=band), "proofs")
    b = F.col("box")
    labels = kept.join(proven.where("uniform").select(*keys, "index"), [*keys, "index"]).withColumn("_l", fitted_label(F.col("token"), b["w"], b["h"]))
    stamps = labels.where("_l IS NOT NULL").select(*keys, "index", F.struct((b["x"] + 4).alias("x"), (b["y"] + b["h"] / 2).alias("y")).alias("at"), "_l.label", "_l.size")
    raw, done = rasters.digest(images, keys, "colours"), rasters.digest(bands, keys, "masked")
    sums = raw.select(*keys, F.col("sha256").alias("_raw"), F.col("bytes").alias("_size")).join(done, keys).join(proof.verification(proven, keys), keys, "left")
    count, uniform = F.coalesce("regions", F.lit(0)), F.coalesce("all_uniform", F.lit(True))
    made = F.struct(F.lit(True).alias("sanitized"), F.col("_raw").alias("raw_sha256"), F.col("sha256").alias("sanitized_sha256"), F.col("_size").alias("raw_bytes"), F.col("bytes").alias("sanitized_bytes"), count.alias("mask_count"), uniform.alias("all_regions_uniform"), now.alias("produced_at"))
    attested = frames.join(sums, keys).select(*keys, count.alias("mask_count"), uniform.alias("all_uniform"), "scale", made.alias("attestation"))
    return Sanitised(kept, proven, stamps, bands, attested)
