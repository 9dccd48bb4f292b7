"""Regions: coverage joins, greedy merging, fusion of lenses, frame offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.shared import stored

#: Side of the grid cells that turn box overlap into an equality join.
CELL = 128


def _celled(df: DataFrame, box: str, cell: int) -> DataFrame:
    """A row for each grid cell that a box touches."""
    b = F.col(box)
    span = lambda at, size: F.sequence(F.floor(at / cell), F.floor((at + F.greatest(size, F.lit(1)) - 1) / cell))
    return df.withColumn("_cx", F.explode(span(b["x"], b["w"]))).withColumn("_cy", F.explode(span(b["y"], b["h"])))


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], *, cell: int = CELL) -> DataFrame:
    """Pairs of rows with equal keys whose boxes (``box`` of ``a``, ``other`` of
    ``b``) overlap, with ``shared``, the overlap's area; each pair once. A pair
    is kept in the cell of its intersection's top left corner, so the join is on
    equal cells and a frame with many boxes spreads over its cells."""
    left, right = _celled(a, "box", cell), _celled(b, "other", cell)
    joined = left.join(right, [*keys, "_cx", "_cy"])
    x, y = F.greatest(F.col("box.x"), F.col("other.x")), F.greatest(F.col("box.y"), F.col("other.y"))
    mine = (F.floor(x / cell) == F.col("_cx")) & (F.floor(y / cell) == F.col("_cy"))
    return joined.withColumn("shared", G.overlap(F.col("box"), F.col("other"))).where(mine & (F.col("shared") > 0)).drop("_cx", "_cy")


def coverage(regions: DataFrame, others: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """``regions`` with ``covered``: the summed overlap with the others as a share
    of the region's area, at most 1; overlaps of the others count twice; 1 for a
    region without area."""
    pairs = overlapping(regions.select(*keys, id_, "box"), others.select(*keys, F.col("box").alias("other")), keys)
    sums = pairs.groupBy(*keys, id_).agg(F.sum("shared").alias("_sum"))
    whole = G.area(F.col("box"))
    share = F.when(whole == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.coalesce("_sum", F.lit(0)) / whole))
    return regions.join(sums, [*keys, id_], "left").withColumn("covered", share).drop("_sum")


def first_overlap(regions: DataFrame, surfaces: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """``regions`` with ``surface``, the kind of the first surface (by seq) that overlaps."""
    pairs = overlapping(regions.select(*keys, id_, "box"), surfaces.select(*keys, F.col("box").alias("other"), "kind", "seq"), keys)
    return regions.join(pairs.groupBy(*keys, id_).agg(F.min_by("kind", "seq").alias("surface")), [*keys, id_], "left")


def fuse(dom: DataFrame, visual: DataFrame, surfaces: DataFrame, keys: list[str], *, paranoid: bool = False) -> DataFrame:
    """Regions of the document and those visual ones that lie on a surface
    (covered 0.35 or more, unless ``paranoid``) and are not masked already
    (covered 0.55 or less), as source, token, severity, label, surface, box and
    confidence."""
    wide = surfaces.where("box.w >= 40 AND box.h >= 14").select(*keys, F.col("box").alias("other"), "kind", "seq", F.lit(True).alias("wide"))
    own = dom.select(*keys, F.col("box").alias("other"), F.lit(None).cast(surfaces.schema["kind"].dataType).alias("kind"), F.lit(None).cast(surfaces.schema["seq"].dataType).alias("seq"), F.lit(False).alias("wide"))
    # One overlap join against both; what lies under a region is summed by side.
    pairs = overlapping(visual.select(*keys, "id", "box"), wide.unionByName(own), keys)
    side = lambda on: F.sum(F.when(F.col("wide") == on, F.col("shared")))
    sums = pairs.groupBy(*keys, "id").agg(side(True).alias("_on"), side(False).alias("_masked"), F.min_by(F.when(F.col("wide"), F.col("kind")), F.when(F.col("wide"), F.col("seq"))).alias("surface"))
    whole = G.area(F.col("box"))
    share = lambda c: F.when(whole == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.coalesce(c, F.lit(0)) / whole))
    kept = visual.join(sums, [*keys, "id"], "left").where(share("_masked") <= 0.55)
    kept = kept if paranoid else kept.where(share("_on") >= 0.35)
    label = F.coalesce(F.concat(F.lit("Unreadable text on <"), F.col("surface"), F.lit(">")), F.lit("Unreadable on-screen text"))
    found = kept.select(*keys, "id", F.lit("gpu-visual").alias("source"), F.lit("[MASK_PII]").alias("token"), F.lit(2).alias("severity"), label.alias("label"), "surface", "box", F.least(F.lit(0.95), F.lit(0.45) + F.col("score") / 6).alias("confidence"))
    own = dom.select(*keys, "id", "source", "token", "severity", "label", F.lit(None).cast("string").alias("surface"), "box", "confidence")
    return own.unionByName(found)


def deduplicated(regions: Column) -> Column:
    """Greedy merging of an ordered array of regions (token, severity, label, box):
    one that overlaps an earlier kept one by more than 0.7 of the smaller area
    joins the first such; the higher severity's token and label win and the box
    grows."""
    near = lambda k, r: G.share_of_smaller(r["box"], k["box"]) > 0.7
    first = lambda kept, r: F.array_position(F.transform(kept, lambda k: near(k, r)), F.lit(True))
    wins = lambda k, r, f: F.when(r["severity"] > k["severity"], r[f]).otherwise(k[f]).alias(f)
    joined = lambda k, r: F.struct(wins(k, r, "token"), wins(k, r, "severity"), wins(k, r, "label"), G.merged(k["box"], r["box"]).alias("box"))
    step = lambda kept, r: F.when(F.exists(kept, lambda k: near(k, r)), F.transform(kept, lambda k, i: F.when(i + 1 == first(kept, r), joined(k, r)).otherwise(k))).otherwise(F.concat(kept, F.array(r)))
    return F.aggregate(regions, F.array().cast("array<struct<token:string,severity:int,label:string,box:struct<x:int,y:int,w:int,h:int>>>"), step)


def frame_offsets(frames: DataFrame, *, depth: int = 6) -> DataFrame:
    """Frames (id, parent null for tops, box in the parent) with their offset in
    the top frame, their visible window and depth; frames deeper than ``depth``
    and those whose window has no area are left out. A recursive query: each step
    joins the last level's frames with theirs on the parent's id."""
    flat = frames.select("id", "parent", "box.x", "box.y", "box.w", "box.h")
    x, y = "greatest(t.cx, t.ox + f.x)", "greatest(t.cy, t.oy + f.y)"
    w, h = f"least(t.cx + t.cw, t.ox + f.x + f.w) - {x}", f"least(t.cy + t.ch, t.oy + f.y + f.h) - {y}"
    found = frames.sparkSession.sql(
        f"""WITH RECURSIVE t(id, ox, oy, cx, cy, cw, ch, depth) AS (
          SELECT id, x, y, x, y, w, h, 0 FROM {{f}} WHERE parent IS NULL
          UNION ALL SELECT f.id, t.ox + f.x, t.oy + f.y, {x}, {y}, {w}, {h}, t.depth + 1
          FROM t JOIN {{f}} f ON f.parent = t.id WHERE t.depth < {depth} AND {w} > 0 AND {h} > 0)
        SELECT id, ox, oy, named_struct('x', cx, 'y', cy, 'w', cw, 'h', ch) AS clip, depth FROM t""",
        f=flat,
    )
    return found


def hit_test(points: DataFrame, boxes: DataFrame, keys: list[str], id_: str, *, cell: int = CELL) -> DataFrame:
    """``points`` (keys, id, px, py) with ``hit``: the topmost box (highest z,
    then seq) that holds the point, null if none."""
    # Of the boxes only what lies between a frame's outermost points is dealt to cells.
    x, y = F.floor("px"), F.floor("py")
    ends = points.groupBy(*keys).agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    within = G.box(F.col("_x0"), F.col("_y0"), F.col("_x1") - F.col("_x0") + 1, F.col("_y1") - F.col("_y0") + 1)
    near = boxes.withColumnRenamed(id_, "_id").join(ends, keys).withColumn("box", G.intersection(F.col("box"), within)).where("box.w > 0 AND box.h > 0").drop("_x0", "_x1", "_y0", "_y1")
    grid = points.withColumn("_cx", F.floor(F.col("px") / cell)).withColumn("_cy", F.floor(F.col("py") / cell))
    inside = grid.join(_celled(near, "box", cell), [*keys, "_cx", "_cy"]).where(G.holds(F.col("box"), F.col("px"), F.col("py")))
    top = inside.groupBy(*keys, id_).agg(F.max_by("_id", F.struct("z", "seq")).alias("hit"))
    return points.join(top, [*keys, id_], "left")


def _pieces(at: Column, size: Column) -> Column:
    """Array of (level l, number k): the blocks from k * 2**l to before (k + 1) * 2**l
    that make up a span, at most two of a level; none for a span without size."""

    def of_level(n: Column) -> Column:
        side = F.pow(F.lit(2.0), n)
        first, end = F.ceil(at / side), F.floor((at + size) / side)
        block = lambda k, odd: F.when((first < end) & (odd % 2 != 0), F.struct(n.alias("l"), k.alias("k")))
        return F.array_compact(F.array(block(first, first), block(end - 1, end)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double"))).cast("int")), of_level))


def _cover(frames: DataFrame) -> DataFrame:
    """The topmost frame (id, bx, by) of each block of each parent (_in, lx, kx, ly, ky); a box is cut
    into blocks, so rows grow with the frames and the logarithm of their sides, not with how they overlap."""
    tops = frames.groupBy(F.coalesce("parent", F.lit("")).alias("_in"), "box").agg(F.max("id").alias("id"))
    b = F.col("box")
    cut = tops.withColumn("_px", F.explode(_pieces(b["x"], b["w"]))).withColumn("_py", F.explode(_pieces(b["y"], b["h"])))
    blocks = cut.select("_in", F.col("_px.l").alias("lx"), F.col("_px.k").alias("kx"), F.col("_py.l").alias("ly"), F.col("_py.k").alias("ky"), F.struct("id", b["x"].alias("bx"), b["y"].alias("by")).alias("t"))
    return blocks.groupBy("_in", "lx", "kx", "ly", "ky").agg(F.max("t").alias("t"))


def descended(points: DataFrame, frames: DataFrame, point: str, *, levels: int = 6) -> DataFrame:
    """``points`` (point, x, y) followed through nested ``frames`` (id, parent
    null for tops, box in the parent; a later id lies above an earlier one): with
    depth, frame, x and y of the innermost frame that holds each point, x and y
    in its own coordinates. A point in no frame keeps depth 0 and a null frame,
    and a frame below ``levels`` isn't entered.

    Distinct places are followed, so points at one place are one row. At every
    level only places that were inside a frame go on; a place asks for the blocks
    that hold it, one for each pair of sides that its frame's blocks have, and
    each of those has one topmost frame."""
    cover = stored(_cover(frames), "cover")
    sides = cover.groupBy("_in").agg(F.collect_set(F.struct("lx", "ly")).alias("sides"))
    at = points.select(F.col("x").alias("x0"), F.col("y").alias("y0"), F.lit("").alias("_in"), "x", "y").distinct()
    found = None
    for level in range(1, levels + 1):
        asked = at.join(sides, "_in").select("x0", "y0", "_in", "x", "y", F.inline("sides"))
        asked = asked.withColumns({"kx": F.floor(F.col("x") / F.pow(F.lit(2.0), "lx")), "ky": F.floor(F.col("y") / F.pow(F.lit(2.0), "ly"))})
        top = asked.join(cover, ["_in", "lx", "kx", "ly", "ky"]).groupBy("x0", "y0", "x", "y").agg(F.max("t").alias("t"))
        inner = stored(top.select("x0", "y0", F.lit(level).alias("depth"), F.col("t.id").alias("frame"), (F.col("x") - F.col("t.bx")).alias("x"), (F.col("y") - F.col("t.by")).alias("y")), "inner")
        found = inner if found is None else found.unionByName(inner)
        at = inner.select("x0", "y0", F.col("frame").alias("_in"), "x", "y")
    last = found.groupBy("x0", "y0").agg(F.max(F.struct("depth", "frame", "x", "y")).alias("t"))
    met = points.select(point, "x", "y").join(last, (F.col("x") == F.col("x0")) & (F.col("y") == F.col("y0")), "left")
    return met.select(point, F.coalesce("t.depth", F.lit(0)).alias("depth"), F.col("t.frame").alias("frame"), F.coalesce("t.x", "x").alias("x"), F.coalesce("t.y", "y").alias("y"))


def gathered(*frames: DataFrame) -> DataFrame:
    """The regions of several frames or lenses as one table; columns that one lacks are null."""
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def counts(regions: DataFrame, keys: list[str]) -> DataFrame:
    """Per frame: regions, severe ones (severity 3), and by source."""
    by = [F.count_if(F.col("source") == s).alias(n) for s, n in (("dom-field", "fields"), ("dom-text", "texts"), ("gpu-visual", "visual"))]
    return regions.groupBy(*keys).agg(F.count("*").alias("regions"), F.count_if(F.col("severity") >= 3).alias("severe"), *by)


def found_elements(actions: DataFrame, elements: DataFrame, keys: list[str]) -> DataFrame:
    """Actions with the element that their ref names in their frame, ``owned``
    false where none does. Elements of a frame are few; refs are unique there."""
    return actions.join(elements.withColumn("owned", F.lit(True)), [*keys, "ref"], "left").withColumn("owned", F.coalesce("owned", F.lit(False)))


def with_proofs(regions: Column, proofs: Column) -> Column:
    """Array of (region, proof) by position: a region beyond the last proof has none."""
    return F.transform(regions, lambda r, i: F.struct(r.alias("region"), F.get(proofs, i).alias("proof")))
