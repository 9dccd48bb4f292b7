"""Destroying regions, proving it, and attesting the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the colour that masks are filled with.
FILL = (223, 242, 252)
FILL_PACKED = FILL[0] << 16 | FILL[1] << 8 | FILL[2]
#: Distinct colours are counted up to this many.
MOST_COLOURS = 8


def packed(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r, 16).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)


def region_pixels(regions: DataFrame, keys: list[str], *, inset: int = 0) -> DataFrame:
    """The (y, x) of every pixel of the regions' boxes, drawn in by ``inset``; at
    least one pixel wide and high. Rows grow with the boxes' areas, which the
    frame bounds; they are made in place, without a join."""
    b = F.col("box")
    side = lambda at, size: F.sequence(at + inset, at + inset + F.greatest(F.lit(1), size - 2 * inset) - 1)
    return regions.withColumn("y", F.explode(side(b["y"], b["h"]))).withColumn("x", F.explode(side(b["x"], b["w"])))


def destroyed(pixels: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels (keys, y, x, colour) with those inside a region filled."""
    inside = region_pixels(regions.select(*keys, "box"), keys).select(*keys, "y", "x").distinct().withColumn("masked", F.lit(True))
    return pixels.join(inside, [*keys, "y", "x"], "left").withColumn("colour", F.when(F.col("masked"), FILL_PACKED).otherwise(F.col("colour"))).withColumn("masked", F.coalesce("masked", F.lit(False)))


def proofs(pixels: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """Per region (keys, index, token, box): pixels read, deviant pixels, distinct
    colours (at most 8), uniform, and entropy (0 if uniform, else null). Pixels
    outside the image count as read and deviant, as a blank canvas reads."""
    inner = region_pixels(regions, keys, inset=1)
    read = inner.join(pixels.select(*keys, "y", "x", "colour"), [*keys, "y", "x"], "left").withColumn("colour", F.coalesce("colour", F.lit(0)))
    deviant = F.sum((F.col("colour") != FILL_PACKED).cast("int"))
    out = read.groupBy(*keys, "index").agg(F.first("token").alias("token"), F.count("*").alias("pixels"), deviant.alias("deviant"), F.least(F.lit(MOST_COLOURS), F.count_distinct("colour")).cast("int").alias("colours"))
    return out.withColumn("uniform", F.col("deviant") == 0).withColumn("entropy", F.when(F.col("uniform"), 0.0))


def verification(found: DataFrame, keys: list[str]) -> DataFrame:
    """Per frame: all_uniform, regions, failed. A frame without regions has no
    row; join with ``coalesce(all_uniform, true)`` where one is wanted."""
    return found.groupBy(*keys).agg(F.bool_and("uniform").alias("all_uniform"), F.count("*").alias("regions"), F.count_if(~F.col("uniform")).alias("failed"))


def attested(df: DataFrame, raw: str, sanitised: str, masks: Column, uniform: Column, now: Column, *, done: Column | None = None) -> DataFrame:
    """``df`` with a struct ``attestation`` over the raw and sanitised bytes or
    text; ``done`` says of a row whether it was sanitised at all."""
    size = lambda c: F.octet_length(F.col(c))
    made = F.struct(
        (F.lit(True) if done is None else done).alias("sanitized"), F.sha2(F.col(raw).cast("binary"), 256).alias("raw_sha256"), F.sha2(F.col(sanitised).cast("binary"), 256).alias("sanitized_sha256"),
        size(raw).alias("raw_bytes"), size(sanitised).alias("sanitized_bytes"), masks.alias("mask_count"), uniform.alias("all_regions_uniform"), now.alias("produced_at"),
    )
    return df.withColumn("attestation", made)


def compression(raw: Column, out: Column) -> Column:
    return F.round(raw / F.greatest(F.lit(1), out), 2)


def headline(count: Column, failed: Column, lens: Column) -> Column:
    """struct<state, title, text> shown for a frame: ``count`` regions proven (null:
    none were), ``failed`` of them not uniform, ``lens`` the detector used (null: none)."""
    # What is shown.
    said = lambda state, title, text: F.struct(F.lit(state).alias("state"), F.lit(title).alias("title"), text.alias("text"))
    by = F.coalesce(F.concat(F.lit("Lens B: "), lens), F.lit("DOM protection"))
    return (
        F.when(count.isNull(), said("idle", "No verification data", F.lit("Run a new protection scan.")))
        .when(failed == 0, said("ok", "Safe preview verified", F.format_string("%d regions overwritten locally, %s", count, by)))
        .otherwise(said("bad", "Preview blocked", F.format_string("%d region(s) failed verification; egress remains closed.", failed)))
    )
