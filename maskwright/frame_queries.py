"""Registered queries over images as arrays, nested frames and long texts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry, scan, text
from .functions.rules import TEXT_RULES
from .operators import islands, policy, proof, rasters, regions
from .plans.protect import Sanitised, sanitise
from .plans.settings import Settings
from .queries import _FRAMES, SQL, _all_counts, _found, _frame_tree, _grid, query
from .sources.tables import table

# ---- tiles and components ----


def _vector_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector an image of 8 by 8 pixels, as one array."""
    lum = F.transform("embedding", lambda v: (v.cast("double") + 0.55) / 1.1)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.lit(0).alias("by"), F.lit(0).alias("bx"), F.lit(8).alias("h"), F.lit(8).alias("w"), lum.alias("lum"))


@query(SQL["tile_features"])
def tile_features_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rasters.tile_features(_vector_tiles(spark, sf_dir), ["vec_id"], "lum", size=(8, 8))
    return found.select("vec_id", *[F.round(c, 6).alias(c) for c in ("variance", "contrast", "edges", "crossings", "score")])


@query(SQL["tile_borders"])
def tile_borders_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of two by two vectors, a block each: edges alone cross the blocks."""
    v = F.col("vec_id")
    blocks = _vector_tiles(spark, sf_dir).select(F.floor(v / 4).alias("frame"), F.floor(v % 4 / 2).cast("int").alias("by"), (v % 2).cast("int").alias("bx"), "h", "w", "lum")
    found = rasters.tile_features(blocks, ["frame"], "lum", size=(8, 8))
    return found.select("frame", "ty", "tx", F.round("edges", 6).alias("edges"), F.round("crossings", 6).alias("crossings"))


@query(SQL["components"])
def components_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of frames cut into squares of four tiles' side, so that most cross them."""
    return islands.components(_grid(spark, sf_dir), ["frame"], square=4).withColumn("mean_score", F.round("mean_score", 6))


_ORDER_TILES = "SELECT CAST(o_orderkey // 20000 AS INTEGER) AS frame, CAST(o_orderkey % 20000 // 200 AS INTEGER) AS ty, CAST(o_orderkey % 200 AS INTEGER) AS tx FROM orders WHERE o_custkey % 4 = 0"


@query(f"""WITH RECURSIVE m AS (SELECT DISTINCT * FROM ({_ORDER_TILES})),
r AS (SELECT frame, ty, tx, ty * 200 + tx AS root FROM m UNION SELECT m.frame, m.ty, m.tx, r.root FROM r JOIN m ON m.frame = r.frame AND abs(m.ty - r.ty) <= 1 AND abs(m.tx - r.tx) <= 1),
k AS (SELECT frame, ty, tx, min(root) AS root FROM r GROUP BY ALL)
SELECT frame, CAST(row_number() OVER (PARTITION BY frame ORDER BY root) - 1 AS INTEGER) AS component, min(tx) AS x0, max(tx) AS x1, min(ty) AS y0, max(ty) AS y1, CAST(count(*) AS INTEGER) AS tiles FROM k GROUP BY frame, root""")
def order_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of wide frames, a tile for one order in four."""
    k = F.col("o_orderkey")
    on = table(spark, sf_dir, "orders").where("o_custkey % 4 = 0").select(F.floor(k / 20000).cast("int").alias("frame"), F.floor(k % 20000 / 200).cast("int").alias("ty"), (k % 200).cast("int").alias("tx"), F.lit(1.0).alias("score"))
    return islands.components(on.distinct(), ["frame"], square=32).drop("mean_score")


# ---- destroying, proving, the whole pipeline ----


@query(SQL["verify_uniform"])
def verify_uniform_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``verify_uniform``, by summed areas of bands of 16 rows; one pixel in some is spoiled after the filling."""
    k = F.col("frame")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("frame"))
    g = nation.select("frame", F.lit(0).alias("index"), F.lit("[MASK_PII]").alias("token"), geometry.box(k % 30, k % 20, F.lit(24), F.lit(12)).alias("box"))
    bands = nation.withColumn("by", F.explode(F.array(*map(F.lit, range(3))))).withColumns({"bx": F.lit(0), "h": F.when(F.col("by") == 2, 8).otherwise(16), "w": F.lit(60)})
    filled = rasters.masked(bands.withColumn("colours", F.array_repeat(F.lit(7), F.col("h") * F.col("w"))), g, ["frame"], "colours", band=16)
    at = (k % 20 + 3 - F.col("by") * 16) * 60 + k % 30 + 4
    spoilt = (k % 5 == 0) & (F.floor((k % 20 + 3) / 16) == F.col("by"))
    colours = F.when(spoilt, F.transform("masked", lambda c, i: F.when(i == at, 1).otherwise(c))).otherwise(F.col("masked"))
    # Masking again with no regions makes the summed areas of what is there now.
    again = rasters.masked(filled.select("frame", "by", "bx", "h", "w", colours.alias("colours")), g.where("false"), ["frame"], "colours", band=16)
    return rasters.proofs(again, g, ["frame"], band=16).select("frame", "pixels", "deviant", "colours", "uniform")


#: Frames of ten by ten vectors, 80 by 80 pixels, in bands of 16 rows; the viewport is 64 wide.
_SIDE, _BAND, _VIEW = 80, 16, 64


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as grey tiles; those off some rows of tiles are faint, so text-like runs stand out."""
    v = F.col("vec_id")
    frame, q = F.floor(v / 100).cast("int"), v % 100
    loud = (F.floor(q / 10) % 3 == 1) & (q % 10 < 4 + frame % 5)
    grey = lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.coalesce(x.cast("double"), F.lit(0.0)) * F.when(loud, 1.0).otherwise(0.125) + 0.55) / 1.1 * 255))).cast("int")
    tiles = table(spark, sf_dir, "embeddings").where("vec_id IS NOT NULL").select(frame.alias("frame"), F.floor(q / 20).cast("int").alias("by"), F.struct((q % 20).cast("int").alias("at"), F.transform("embedding", lambda x: grey(x) * 65793).alias("px")).alias("t"))
    bands = tiles.select("frame").distinct().withColumn("by", F.explode(F.array(*map(F.lit, range(5)))))
    held = bands.join(tiles.groupBy("frame", "by").agg(F.map_from_entries(F.collect_list("t")).alias("tiles")), ["frame", "by"], "left")
    blank = F.array_repeat(F.lit(127 * 65793), 64)
    tile = lambda r, x: F.coalesce(F.try_element_at("tiles", F.floor(r / 8).cast("int") * 10 + x), blank)
    row = lambda r: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda x: F.slice(tile(r, x), r % 8 * 8 + 1, F.lit(8))))
    colours = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(_BAND - 1)), row))
    return held.select("frame", "by", F.lit(0).alias("bx"), F.lit(_BAND).alias("h"), F.lit(_SIDE).alias("w"), colours.alias("colours"), F.lit(_SIDE).alias("width"), F.lit(_SIDE).alias("height"), F.lit(_VIEW).alias("view"))


MODES = ("dom-only", "balanced", "paranoid")


def _sanitised(spark: SparkSession, sf_dir: str, mode: str) -> Sanitised:
    images = _pictures(spark, sf_dir)
    frames = images.where("by = 0").select("frame")
    n, r = F.col("n_nationkey"), F.col("r_regionkey")
    nation = table(spark, sf_dir, "nation").select((n % 5).cast("int").alias("k"), n.cast("int").alias("id"), F.when(n % 2 == 0, "dom-field").otherwise("dom-text").alias("source"), F.when(n % 2 == 0, "[MASK_CARD]").otherwise("[MASK_PII]").alias("token"), F.lit(2).alias("severity"), F.lit("x").alias("label"), geometry.box(n * 7 % 70, n * 5 % 60, n % 7 * 9, n % 9 + 6).alias("box"), F.lit(0.95).alias("confidence"))
    dom = frames.withColumn("k", F.col("frame") % 5).join(nation, "k").drop("k")
    kind = F.get(F.array(*map(F.lit, ("canvas", "img", "video"))), r % 3)
    region = table(spark, sf_dir, "region").select((r % 2).cast("int").alias("k"), r.cast("int").alias("seq"), kind.alias("kind"), geometry.box(r * 4, r * 3, F.lit(48), r + 10).alias("box"))
    surfaces = frames.withColumn("k", F.col("frame") % 2).join(region, "k").drop("k")
    return sanitise(images, dom, surfaces, ["frame"], Settings(mode=mode, threshold=2.0), band=_BAND, now=F.lit(None).cast("timestamp"))


def _sanitised_sql() -> str:
    """CTEs up to the regions of every mode (r), their masked pixels (done) and frames (f)."""
    half = lambda c: f"CAST(floor({c} * 1.25::DOUBLE + 0.5::DOUBLE) AS INTEGER) AS {c}"
    scaled = ", ".join(half(c) for c in "xywh")
    over = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"
    share = lambda t: f"least(1.0::DOUBLE, coalesce((SELECT sum({over}) FROM {t} b WHERE b.frame = a.frame), 0) / (a.w * a.h)::DOUBLE)"
    return f"""WITH RECURSIVE f AS (SELECT DISTINCT CAST(vec_id // 100 AS INTEGER) AS frame FROM embeddings WHERE vec_id IS NOT NULL),
e AS (SELECT *, CAST(vec_id // 100 AS INTEGER) AS frame, vec_id % 100 AS q FROM embeddings),
px AS (SELECT f.frame, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CASE WHEN e.embedding IS NULL THEN 127 ELSE CAST(least(255, greatest(0, floor((coalesce(CAST(e.embedding[y % 8 * 8 + x % 8 + 1] AS DOUBLE), 0.0::DOUBLE) * CASE WHEN y // 8 % 3 = 1 AND x // 8 < 4 + f.frame % 5 THEN 1.0::DOUBLE ELSE 0.125::DOUBLE END + 0.55::DOUBLE) / 1.1::DOUBLE * 255))) AS INTEGER) END * 65793 AS colour
  FROM f CROSS JOIN range(0, {_SIDE}) a(y) CROSS JOIN range(0, {_SIDE}) b(x) LEFT JOIN e ON e.frame = f.frame AND e.q = y // 8 * 10 + x // 8),
lu AS (SELECT *, y // 8 AS ty, x // 8 AS tx, (0.299::DOUBLE * (colour % 256) + 0.587::DOUBLE * (colour % 256) + 0.114::DOUBLE * (colour % 256)) / 255 AS lum FROM px),
di AS (SELECT *, coalesce(lead(lum) OVER (PARTITION BY frame, y ORDER BY x), lum) - lum AS dh, coalesce(lead(lum) OVER (PARTITION BY frame, x ORDER BY y), lum) - lum AS dv FROM lu),
si AS (SELECT *, CASE WHEN abs(dh) > 0.12 THEN sign(dh) END AS s FROM di),
be AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY frame, ty, tx, y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM si),
gr AS (SELECT frame, ty, tx, count(*) AS n, least(1.0::DOUBLE, min(lum)) AS mn, greatest(0.0::DOUBLE, max(lum)) AS mx, sum(abs(dh)) AS he, sum(abs(dv)) AS ve, count(*) FILTER (s IS NOT NULL AND before <> s) AS cr FROM be GROUP BY frame, ty, tx),
sc AS (SELECT frame, ty, tx, CASE WHEN mx - mn > 0.2 AND (he + ve) / n > 0.03 AND cr / n > 0.015 THEN (he + ve) / n * 6 + cr / n * 9 + (mx - mn) * 0.5::DOUBLE + least(he / greatest(ve, 1e-4::DOUBLE), 3) * 0.15::DOUBLE ELSE 0.0::DOUBLE END AS score FROM gr),
hot AS (SELECT * FROM sc WHERE score >= 2.0), gap AS (SELECT *, lag(tx) OVER (PARTITION BY frame, ty ORDER BY tx) AS b FROM hot),
cl AS (SELECT DISTINCT frame, ty, unnest(range(CASE WHEN tx - b - 1 <= 2 THEN b + 1 ELSE tx END, tx + 1)) AS tx FROM gap),
m AS (SELECT cl.*, coalesce(hot.score, 0.0::DOUBLE) AS score FROM cl LEFT JOIN hot USING (frame, ty, tx)),
rr AS (SELECT frame, ty, tx, ty * 10 + tx AS root FROM m UNION SELECT m.frame, m.ty, m.tx, rr.root FROM rr JOIN m ON m.frame = rr.frame AND abs(m.ty - rr.ty) <= 1 AND abs(m.tx - rr.tx) <= 1),
k AS (SELECT frame, ty, tx, min(root) AS root FROM rr GROUP BY ALL),
c AS (SELECT k.frame, root, min(k.tx) * 8 AS x, min(k.ty) * 8 AS y, (max(k.tx) - min(k.tx) + 1) * 8 AS w, (max(k.ty) - min(k.ty) + 1) * 8 AS h, count(*) AS tiles, round(avg(score), 3) AS score FROM k JOIN m USING (frame, ty, tx) GROUP BY k.frame, root),
v AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, root) AS id FROM c WHERE tiles >= 3 AND h >= 8 AND w / h::DOUBLE BETWEEN 1.2 AND 60 AND tiles * 64 / (w * h)::DOUBLE >= 0.35 AND w * h <= 0.35 * {_SIDE} * {_SIDE} QUALIFY id <= 120),
d0 AS (SELECT f.frame, n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'dom-field' ELSE 'dom-text' END AS source, CASE WHEN n_nationkey % 2 = 0 THEN '[MASK_CARD]' ELSE '[MASK_PII]' END AS token, n_nationkey * 7 % 70 AS x, n_nationkey * 5 % 60 AS y, n_nationkey % 7 * 9 AS w, n_nationkey % 9 + 6 AS h FROM f JOIN nation ON n_nationkey % 5 = f.frame % 5),
d AS (SELECT frame, id, source, token, {scaled} FROM d0),
s0 AS (SELECT f.frame, r_regionkey AS seq, ['canvas', 'img', 'video'][CAST(r_regionkey % 3 + 1 AS INTEGER)] AS kind, r_regionkey * 4 AS x, r_regionkey * 3 AS y, 48 AS w, r_regionkey + 10 AS h FROM f JOIN region ON r_regionkey % 2 = f.frame % 2),
s AS (SELECT * FROM (SELECT frame, seq, kind, {scaled} FROM s0) WHERE w >= 40 AND h >= 14),
vv AS (SELECT a.*, {share('s')} AS on_, {share('d')} AS masked, (SELECT min_by(kind, seq) FROM s b WHERE b.frame = a.frame AND {over} > 0) AS surface FROM v a),
every AS (
  SELECT mode, frame, 0 AS lens, id, source, token, CAST(NULL AS VARCHAR) AS surface, 0.95::DOUBLE AS confidence, x, y, w, h FROM d, (SELECT unnest({list(MODES)}) AS mode)
  UNION ALL SELECT mode, frame, 1, id, 'gpu-visual', '[MASK_PII]', surface, least(0.95::DOUBLE, 0.45::DOUBLE + score / 6), x, y, w, h FROM vv, (SELECT unnest({list(MODES[1:])}) AS mode) WHERE masked <= 0.55 AND (mode = 'paranoid' OR on_ >= 0.35)),
fit AS (SELECT mode, frame, lens, id, source, token, surface, confidence, greatest(0, least({_SIDE - 1}, x)) AS x, greatest(0, least({_SIDE - 1}, y)) AS y, w, h FROM every),
r AS (SELECT mode, frame, CAST(row_number() OVER (PARTITION BY mode, frame ORDER BY lens, id) - 1 AS INTEGER) AS index, source, token, surface, confidence, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(w AS INTEGER) AS w, CAST(h AS INTEGER) AS h
  FROM (SELECT * REPLACE (least(w, {_SIDE} - x) AS w, least(h, {_SIDE} - y) AS h) FROM fit) WHERE w > 2 AND h > 2),
done AS (SELECT mode, px.frame, y, x, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.mode = g.mode AND r.frame = px.frame AND px.x >= r.x AND px.x < r.x + r.w AND px.y >= r.y AND px.y < r.y + r.h) THEN 14676732 ELSE colour END AS colour FROM px, (SELECT unnest({list(MODES)}) AS mode) g)"""


@query(_sanitised_sql() + """, z AS (SELECT *, greatest(9, least(18, floor(h * 0.6::DOUBLE))) AS size, length(token) AS long, CASE token WHEN '[MASK_CARD]' THEN '[CARD]' ELSE '[PII]' END AS short FROM r),
y AS (SELECT *, floor((w - 8) / (length(short) * 0.6::DOUBLE)) AS most FROM z)
SELECT mode, frame, index, source, token, surface, round(confidence, 6) AS confidence, x, y, w, h, CAST((w - 2) * (h - 2) AS BIGINT) AS pixels, CAST(0 AS BIGINT) AS deviant, 1 AS colours, true AS uniform,
  CASE WHEN long * size * 0.6::DOUBLE <= w - 8 THEN token WHEN least(size, most) >= 7 THEN short END AS stamp, CAST(CASE WHEN long * size * 0.6::DOUBLE <= w - 8 THEN size WHEN least(size, most) >= 7 THEN least(size, most) END AS INTEGER) AS stamp_size FROM y""")
def sanitised_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every region of every frame in the three modes, with its proof and its stamp."""
    out = []
    for mode in MODES:
        done = _sanitised(spark, sf_dir, mode)
        stamps = done.stamps.select("frame", "index", F.col("label").alias("stamp"), F.col("size").alias("stamp_size"))
        both = done.regions.join(done.proofs.drop("token", "entropy"), ["frame", "index"]).join(stamps, ["frame", "index"], "left")
        out.append(both.select(F.lit(mode).alias("mode"), "frame", "index", "source", "token", "surface", F.round("confidence", 6).alias("confidence"), "box.x", "box.y", "box.w", "box.h", "pixels", "deviant", "colours", "uniform", "stamp", "stamp_size"))
    return out[0].union(out[1]).union(out[2])


_BAND_HASH = f"SELECT mode, frame, y // {_BAND} AS b, sha256(string_agg(CAST(colour AS VARCHAR), ',' ORDER BY y, x)) AS s FROM {{}} GROUP BY ALL"


@query(_sanitised_sql() + f""", h1 AS ({_BAND_HASH.format("(SELECT 'raw' AS mode, * FROM px)")}), h2 AS ({_BAND_HASH.format("done")}),
t1 AS (SELECT frame, sha256(string_agg(s, '' ORDER BY b)) AS raw_sha256 FROM h1 GROUP BY frame), t2 AS (SELECT mode, frame, sha256(string_agg(s, '' ORDER BY b)) AS sanitized_sha256 FROM h2 GROUP BY mode, frame),
n AS (SELECT mode, frame, count(*) AS n FROM r GROUP BY ALL)
SELECT mode, frame, coalesce(n, 0) AS mask_count, true AS all_uniform, 1.25::DOUBLE AS scale, raw_sha256, sanitized_sha256, CAST({_SIDE * _SIDE * 3} AS BIGINT) AS raw_bytes FROM t2 JOIN t1 USING (frame) LEFT JOIN n USING (mode, frame)""")
def sanitised_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attestation of every frame in the three modes."""
    out = []
    for mode in MODES:
        a = F.col("attestation")
        out.append(_sanitised(spark, sf_dir, mode).frames.select(F.lit(mode).alias("mode"), "frame", F.col("mask_count").cast("long").alias("mask_count"), "all_uniform", F.col("scale").cast("double").alias("scale"), a["raw_sha256"].alias("raw_sha256"), a["sanitized_sha256"].alias("sanitized_sha256"), a["raw_bytes"].alias("raw_bytes")))
    return out[0].union(out[1]).union(out[2])


# ---- points in nested frames ----


@query(f"""WITH RECURSIVE f AS ({_FRAMES}), p AS (SELECT o_orderkey AS point, CAST(o_custkey * 7 % 1000 AS INTEGER) AS x, CAST(o_custkey * 3 % 700 AS INTEGER) AS y FROM orders),
t AS (SELECT point, x, y, NULL::VARCHAR AS inside, 0 AS depth FROM p
  UNION ALL SELECT point, x - fx, y - fy, id, depth + 1 FROM (
    SELECT t.point, t.x, t.y, f.x AS fx, f.y AS fy, f.id, t.depth, row_number() OVER (PARTITION BY t.point ORDER BY f.id DESC) AS n
    FROM t JOIN f ON f.parent IS NOT DISTINCT FROM t.inside AND t.x >= f.x AND t.x < f.x + f.w AND t.y >= f.y AND t.y < f.y + f.h) WHERE n = 1)
SELECT point, depth, inside AS frame, x, y FROM t QUALIFY row_number() OVER (PARTITION BY point ORDER BY depth DESC) = 1""")
def point_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points followed through region, nation and customer frames to the innermost one that holds them, in its own coordinates."""
    c = F.col("o_custkey")
    points = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("point"), (c * 7 % 1000).cast("int").alias("x"), (c * 3 % 700).cast("int").alias("y"))
    return regions.descended(points, _frame_tree(spark, sf_dir), "point", levels=3).select("point", "depth", "frame", "x", "y")


# ---- texts with very many hits ----

_JOINED = "SELECT source, doc_id // 100 AS part, string_agg(text || ' ' || 'u' || doc_id || '@mail.example', ' ' ORDER BY doc_id) AS text FROM documents WHERE text IS NOT NULL GROUP BY ALL"
_MAIL = next(r for r in TEXT_RULES if r.id == "email")


@query(f"WITH j AS ({_JOINED}) SELECT source, part, CAST(length(text) AS INTEGER) AS n_chars, CAST(len({_found('email', 'text')}) AS INTEGER) AS mails, sha256(regexp_replace(text, '{_MAIL.pattern}', '{_MAIL.token}', 'g')) AS redacted_sha256 FROM j")
def joined_texts_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source, a hundred ids at a time, as one text with an address after each."""
    one = F.struct("doc_id", F.concat("text", F.lit(" u"), F.col("doc_id").cast("string"), F.lit("@mail.example")).alias("t"))
    j = table(spark, sf_dir, "documents").where("text IS NOT NULL").groupBy("source", F.expr("doc_id div 100").alias("part")).agg(F.array_sort(F.collect_list(one)).alias("ts"))
    j = j.select("source", "part", F.array_join(F.transform("ts", lambda x: x["t"]), " ").alias("text"))
    found = j.withColumn("h", scan.scan_text(F.col("text"), rules=(_MAIL,)))
    return found.select("source", "part", F.length("text").alias("n_chars"), F.size("h").alias("mails"), F.sha2(scan.redact(F.col("text"), F.col("h")), 256).alias("redacted_sha256"))


@query(_all_counts(_JOINED) + " SELECT source, part, rule_id, CAST(sum(n) AS BIGINT) AS hits FROM h WHERE n > 0 GROUP BY ALL")
def joined_texts_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of all rules in the same joined texts, by their offsets: each is where it says."""
    one = F.struct("doc_id", F.concat("text", F.lit(" u"), F.col("doc_id").cast("string"), F.lit("@mail.example")).alias("t"))
    j = table(spark, sf_dir, "documents").where("text IS NOT NULL").groupBy("source", F.expr("doc_id div 100").alias("part")).agg(F.array_sort(F.collect_list(one)).alias("ts"))
    j = j.select("source", "part", F.array_join(F.transform("ts", lambda x: x["t"]), " ").alias("text"))
    return scan.hits(j, "text", "source", "part").groupBy("source", "part", "rule_id").agg(F.count("*").alias("hits"))


# ---- what is shown ----


@query("""SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'idle' WHEN p_partkey % 4 = 0 THEN 'bad' ELSE 'ok' END AS state,
  CASE WHEN p_size % 7 = 0 THEN 'No verification data' WHEN p_partkey % 4 = 0 THEN 'Preview blocked' ELSE 'Safe preview verified' END AS title,
  CASE WHEN p_size % 7 = 0 THEN 'Run a new protection scan.' WHEN p_partkey % 4 = 0 THEN '2 region(s) failed verification; egress remains closed.' ELSE p_size || ' regions overwritten locally, ' || CASE WHEN p_partkey % 3 = 0 THEN 'DOM protection' ELSE 'Lens B: ' || p_brand END END AS text,
  '<' || p_partkey || ' bytes webp, sha256 ' || substr(sha256(p_name), 1, 16) || '...>' AS preview, round(p_retailprice::DOUBLE / greatest(1, p_size % 5), 2) AS ratio FROM part""")
def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame's verdict, an image's stand-in and its compression, a row for each part."""
    k, n = F.col("p_partkey"), F.col("p_size")
    shown = proof.headline(F.when(n % 7 != 0, n), F.when(k % 4 == 0, 2).otherwise(0), F.when(k % 3 != 0, F.col("p_brand")))
    made = table(spark, sf_dir, "part").select("p_partkey", shown.alias("h"), text.preview(k, F.sha2("p_name", 256)).alias("preview"), proof.compression(F.col("p_retailprice"), n % 5).alias("ratio"))
    return made.select("p_partkey", "h.state", "h.title", "h.text", "preview", "ratio")


_SAID = "SELECT doc_id, CASE WHEN len(violations) = 0 THEN 'Egress allowed' ELSE 'Egress blocked' END AS title, CASE WHEN len(violations) = 0 THEN scanned || ' metadata characters checked, no PII found' ELSE array_to_string(violations, ', ') END AS text FROM v"


@query(SQL["firewall"][: SQL["firewall"].rindex("SELECT doc_id, len(violations) = 0")] + _SAID)
def firewall_said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shown of the firewall's verdict on each document."""
    k = F.col("doc_id")
    image = F.when(k % 4 == 0, "data:image/png;base64,AA").otherwise("data:image/webp;base64,AA")
    v = policy.firewall(k % 11 != 0, F.when(k % 7 != 0, k % 5 != 0), k % 3 != 0, image, F.when(k % 6 == 0, "").otherwise("ab"), F.col("text"))
    said = table(spark, sf_dir, "documents").select("doc_id", v.alias("v")).select("doc_id", policy.verdict_text(F.col("v")).alias("s"))
    return said.select("doc_id", "s.title", "s.text")
