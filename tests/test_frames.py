"""Array images, components of large frames, proofs by summed areas, nested frames, texts with many hits."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.functions import scan, text
from maskwright.functions.arrays import blocks, cut, folded
from maskwright.functions.rules import TEXT_RULES
from maskwright.operators import islands, proof, rasters, regions, vision
from maskwright.plans.protect import sanitise
from maskwright.plans.settings import Settings


def boxed(*rows):
    return [(f, i, "[T]", {"x": x, "y": y, "w": w, "h": h}) for f, i, x, y, w, h in rows]


BOX = "box struct<x:int,y:int,w:int,h:int>"


@pytest.mark.parametrize("tile", [4, 8])
def test_tiles_of_blocks_are_those_of_pixels(spark, tile):
    some = np.random.default_rng(3)
    pixels, images = [], []
    for frame, (height, width) in enumerate([(21, 30), (16, 16), (5, 40)]):
        lum = some.random((height, width)).round(2)
        pixels += [(frame, y, x, float(lum[y, x])) for y in range(height) for x in range(width)]
        for by in range(-(-height // 8)):
            for bx in range(-(-width // 16)):
                part = lum[8 * by : 8 * by + 8, 16 * bx : 16 * bx + 16]
                images.append((frame, by, bx, *part.shape, part.ravel().tolist()))
    images += [(7, 0, 0, 0, 0, []), (8, 0, 0, 2, 2, None)]
    plain = vision.tile_features(spark.createDataFrame(pixels, "frame int, y int, x int, lum double"), ["frame"], tile=tile)
    found = rasters.tile_features(spark.createDataFrame(images, "frame int, by int, bx int, h int, w int, lum array<double>"), ["frame"], "lum", tile=tile, size=(8, 16))
    rows = lambda df: {(r.frame, r.ty, r.tx): [r[c] for c in ("variance", "contrast", "edges", "crossings", "score")] for r in df.collect()}
    got, want = rows(found), rows(plain)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    with pytest.raises(ValueError):
        rasters.tile_features(spark.createDataFrame(images, "frame int, by int, bx int, h int, w int, lum array<double>"), ["frame"], "lum", tile=8, size=(12, 16))


@pytest.mark.parametrize("square", [3, 16, 256])
def test_components_of_squares_are_those_of_whole_frames(spark, square):
    some = random.Random(square)
    rows = {(f, y, x): round(some.random(), 2) for f in (1, 2, 3) for y in range(-3, 40) for x in range(50) if some.random() < 0.3 + 0.07 * f}
    rows |= {(4, 0, x): 1.0 for x in range(200)} | {(5, y, (y % 2) * 2 + 1): 1.0 for y in range(20)}
    on = spark.createDataFrame([(*k, v) for k, v in rows.items()], "frame int, ty int, tx int, score double")
    names = ["frame", "component", "x0", "x1", "y0", "y1", "tiles"]
    got = {tuple(r[n] for n in names): r.mean_score for r in islands.components(on, ["frame"], square=square).collect()}
    want = {tuple(r[n] for n in names): r.mean_score for r in vision.components(on, ["frame"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert islands.components(on.where("false"), ["frame"], square=square).collect() == []


def test_a_frame_of_millions_of_tiles_is_many_tasks_work(spark):
    # A comb: teeth of every second column hang on one row, beside single tiles.
    on = spark.range(1500 * 1000).select(F.lit(1).alias("frame"), F.expr("CAST(id div 1500 AS INT)").alias("ty"), F.expr("CAST(id % 1500 AS INT)").alias("tx"), F.lit(1.0).alias("score"))
    on = on.where("ty = 0 OR tx % 2 = 0 AND tx < 1200 OR (ty % 3 = 2 AND tx % 3 = 2 AND tx > 1202)")
    got = islands.components(on, ["frame"]).agg(F.count("*").alias("n"), F.max("tiles").alias("most")).first()
    assert got.most == 1500 + 999 * 600 and got.n == 1 + 333 * 99


def test_proofs_by_summed_areas_are_those_by_pixels(spark):
    some = np.random.default_rng(5)
    height, width, band = 37, 29, 8
    colour = some.choice([proof.FILL_PACKED, proof.FILL_PACKED, 1, 2, 3, 4, 5, 6, 7, 8, 9], (height, width))
    colour[10:20, 5:25] = proof.FILL_PACKED
    bands = spark.createDataFrame([(1, by, 0, len(p := colour[by * band : by * band + band]), width, p.ravel().tolist()) for by in range(-(-height // band))], "frame int, by int, bx int, h int, w int, colours array<int>")
    asked = boxed((1, 0, 4, 9, 20, 10), (1, 1, 0, 0, 29, 37), (1, 2, -4, -4, 12, 12), (1, 3, 25, 30, 20, 20), (1, 4, 60, 60, 9, 9), (1, 5, 3, 3, 1, 1), (1, 6, 2, 6, 9, 3), (9, 0, 0, 0, 5, 5))
    regions_ = spark.createDataFrame(asked, f"frame int, index int, token string, {BOX}")
    pixels = spark.createDataFrame([(1, y, x, int(colour[y, x])) for y in range(height) for x in range(width)], "frame int, y int, x int, colour int")
    names = ["frame", "index", "token", "pixels", "deviant", "colours", "uniform", "entropy"]
    rows = lambda df: sorted(tuple(r[n] for n in names) for r in df.collect())
    as_is = rasters.masked(bands, regions_.where("false"), ["frame"], "colours", band=band)
    assert rows(rasters.proofs(as_is, regions_, ["frame"], band=band)) == rows(proof.proofs(pixels, regions_, ["frame"]))
    done = rasters.masked(bands, regions_, ["frame"], "colours", band=band)
    filled = proof.destroyed(pixels, regions_, ["frame"])
    assert [x for r in sorted(done.collect(), key=lambda r: r.by) for x in r.masked] == [r.colour for r in sorted(filled.collect(), key=lambda r: (r.y, r.x))]
    assert rows(rasters.proofs(done, regions_, ["frame"], band=band)) == rows(proof.proofs(filled.drop("masked"), regions_, ["frame"]))


def test_sanitise_without_regions_and_with_unknown_frames(spark):
    bands = spark.createDataFrame([(1, 0, 0, 8, 8, [5] * 64, 8, 8, None), (2, 0, 0, 8, 8, [6] * 64, 8, 8, 4)], "frame int, by int, bx int, h int, w int, colours array<int>, width int, height int, view int")
    dom = spark.createDataFrame([(2, 1, "dom-field", "[MASK_PII]", 2, "x", {"x": 1, "y": 1, "w": 2, "h": 2}, 1.0), (3, 1, "dom-field", "[MASK_PII]", 2, "x", {"x": 1, "y": 1, "w": 2, "h": 2}, 1.0)], f"frame int, id int, source string, token string, severity int, label string, {BOX}, confidence double")
    none = spark.createDataFrame([], f"frame int, seq int, kind string, {BOX}")
    out = sanitise(bands, dom, none, ["frame"], Settings(mode="dom-only"), band=8, now=F.lit(None).cast("timestamp"))
    got = {r.frame: (r.mask_count, r.all_uniform, r.scale, r.attestation.raw_sha256 == r.attestation.sanitized_sha256) for r in out.frames.collect()}
    assert got == {1: (0, True, 1.0, True), 2: (1, True, 2.0, False)}
    assert [tuple(r.box) for r in out.regions.collect()] == [(2, 2, 4, 4)] and [(r.pixels, r.deviant) for r in out.proofs.collect()] == [(4, 0)]


def test_descent_stops_at_the_innermost_frame(spark):
    frames = spark.createDataFrame([("a", None, (0, 0, 100, 100)), ("b", None, (50, 50, 100, 100)), ("c", "b", (10, 10, 20, 20)), ("d", "c", (0, 0, 5, 5)), ("e", "gone", (0, 0, 999, 999))], f"id string, parent string, {BOX}")
    points = spark.createDataFrame([(1, 60, 60), (2, 63, 63), (3, 10, 10), (4, 500, 5), (5, None, 3), (6, 66, 66)], "point int, x int, y int")
    got = {r.point: (r.depth, r.frame, r.x, r.y) for r in regions.descended(points, frames, "point").collect()}
    assert got == {1: (3, "d", 0, 0), 2: (3, "d", 3, 3), 3: (1, "a", 10, 10), 4: (0, None, 500, 5), 5: (0, None, None, 3), 6: (2, "c", 6, 6)}
    assert {r.point: r.depth for r in regions.descended(points, frames, "point", levels=2).collect()}[1] == 2


def test_descent_through_many_frames_that_overlap(spark):
    rng = random.Random(8)
    side = lambda most: rng.randint(1, most)
    rows = [("t0", None, (-(1 << 29), -(1 << 29), 1 << 30, 1 << 30))] + [(f"t{i}", None, (rng.randint(-90, 90), rng.randint(-90, 90), side(120), side(99))) for i in range(1, 9)]
    rows += [(f"n{i}", f"t{i % 9}", (rng.randint(-20, 60), rng.randint(-20, 60), side(64), side(50))) for i in range(60)] + [(f"z{i}", f"n{i % 3}", (3, 3, 40, 30)) for i in range(3000)]
    points = [(i, rng.randint(-150, 150), rng.randint(-150, 150)) for i in range(300)] + [(i, 5, 5) for i in range(300, 400)]
    inside, want = {}, {}
    for name, parent, b in rows:
        inside.setdefault(parent, []).append((name, *b))
    for i, x, y in points:
        depth, frame = 0, None
        while held := [r for r in inside.get(frame, ()) if r[1] <= x < r[1] + r[3] and r[2] <= y < r[2] + r[4]]:
            frame, bx, by, _, _ = max(held)
            depth, x, y = depth + 1, x - bx, y - by
        want[i] = (depth, frame, x, y)
    frames = spark.createDataFrame(rows, f"id string, parent string, {BOX}")
    got = regions.descended(spark.createDataFrame(points, "point int, x int, y int"), frames, "point", levels=3).collect()
    assert {r.point: (r.depth, r.frame, r.x, r.y) for r in got} == want and len(got) == len(points)
    # Frames at one place are one; any other is a few blocks, however wide it is.
    assert regions._cover(frames.where("id LIKE 'z%'")).count() == regions._cover(frames.where("id IN ('z0', 'z1', 'z2')")).count()
    assert regions._cover(frames.where("id = 't0'")).count() == 4


# ---- many hits in one text ----


def took(spark, make, value):
    df = spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("x"))
    df.collect()
    began = time.perf_counter()
    got = df.first()["x"]
    return time.perf_counter() - began, got


MAIL = tuple(r for r in TEXT_RULES if r.id == "email")


def test_time_grows_with_the_hits_of_a_text(spark):
    many = lambda n: " ".join(f"text {i} ab{i}@mail.example" for i in range(n))
    make = lambda t: scan.redact(t, scan.scan_text(t))
    few, _ = took(spark, make, many(10_000))
    lots, got = took(spark, make, many(100_000))
    assert lots < 30 * max(few, 0.2)
    assert got == " ".join(f"text {i} [MASK_EMAIL]" for i in range(100_000))
    _, hits = took(spark, lambda t: scan.scan_text(t, rules=MAIL), many(100_000))
    whole = many(100_000)
    assert len(hits) == 100_000 and all(whole[h["index"] : h["index"] + h["length"]] == h["text"] for h in hits[::997])


def test_time_grows_with_the_braces_of_an_answer(spark):
    lots, got = took(spark, text.json_object, "{a} " * 30_000 + '{"op": 1}')
    assert got == '{"op": 1}' and lots < 30


def test_cuts_and_folds_over_their_edges(spark):
    t = "".join(chr(97 + i % 26) if i % 50 else "\U0001f600" for i in range(5000))
    some = random.Random(1)
    spans = [(0, 0), (0, 5000), (1023, 1025), (1024, 2048), (4999, 5000)] + [tuple(sorted((some.randrange(5001), some.randrange(5001)))) for _ in range(40)]
    df = spark.createDataFrame([(t, a, b) for a, b in spans], "t string, a int, b int")
    assert [r.x for r in df.select(cut(blocks(F.col("t")), F.col("a"), F.col("b")).alias("x")).collect()] == [t[a:b] for a, b in spans]
    rows = [(list(range(n)),) for n in (0, 1, 255, 256, 257, 600)] + [(None,)]
    sums = folded(F.col("v"), F.lit(0), lambda s, x: F.struct((s + x).alias("s"), F.when(x % 2 == 0, F.array(s)).otherwise(F.array().cast("array<int>")).alias("o")), "int")
    got = [r.x for r in spark.createDataFrame(rows, "v array<int>").select(sums.alias("x")).collect()]
    assert got == [[sum(range(i)) for i in v if i % 2 == 0] if v is not None else None for (v,) in rows]


def test_hits_of_different_rules_that_overlap(spark):
    value = "4111 1111 1111 1111 and 352741839170 9876543210@okaxis.com, a.b@mail.example"
    row = spark.createDataFrame([(value,)], "t string").select(scan.scan_text(F.col("t")).alias("h"), scan.redact(F.col("t"), scan.scan_text(F.col("t"))).alias("r")).first()
    assert {h.rule_id for h in row.h} >= {"card", "aadhaar", "phone_in", "email", "upi"}
    assert row.r == "[MASK_CARD]and [MASK_AADHAAR] [MASK_EMAIL], [MASK_EMAIL]"
