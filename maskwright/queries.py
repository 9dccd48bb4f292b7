"""Registered queries of the engine's own operators, and equivalent DuckDB SQL.

Inputs that the tables lack (boxes, fields, goals, envelopes) are derived from
their columns by arithmetic that both engines do alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import fields, geometry, scan, text
from .functions.checksums import verhoeff
from .functions.checksums import VERHOEFF_D, VERHOEFF_P
from .functions.rules import SCAN_CHARS, TEXT_RULES
from .operators import audit, pages, planner, policy, proof, regions, vision
from .plans.protect import protect_texts
from .sources.tables import envelope, envelopes, metadata, table
from .streaming import gather

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- SQL building blocks ----


def _luhn(d: str) -> str:
    at = f"CAST(substr({d}, CAST(length({d}) - i AS INTEGER), 1) AS INTEGER)"
    return f"(length({d}) > 0 AND list_sum(list_transform(range(0, length({d})), lambda i: CASE WHEN i % 2 = 0 THEN {at} WHEN {at} > 4 THEN 2 * {at} - 9 ELSE 2 * {at} END)) % 10 = 0)"


def _verhoeff(d: str) -> str:
    step = f"CAST(({VERHOEFF_P})[CAST((p[2] % 8) * 10 + p[1] + 1 AS INTEGER)] AS INTEGER)"
    digits = f"list_transform(range(0, length({d})), lambda i: [CAST(substr({d}, CAST(length({d}) - i AS INTEGER), 1) AS INTEGER), CAST(i AS INTEGER)])"
    return f"(length({d}) > 0 AND list_reduce(list_prepend(0, list_transform({digits}, lambda p: {step})), lambda a, c: CAST(({VERHOEFF_D})[CAST(a * 10 + c + 1 AS INTEGER)] AS INTEGER)) = 0)"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '', 'g')"


def _found(rule: str, t: str) -> str:
    """Valid matches of a rule."""
    r = next(r for r in TEXT_RULES if r.id == rule)
    every = f"regexp_extract_all({t}, '{r.pattern}')"
    if r.check == "card":
        return f"list_filter({every}, lambda m: length({_digits('m')}) BETWEEN 13 AND 19 AND {_luhn(_digits('m'))})"
    if r.check == "verhoeff":
        return f"list_filter({every}, lambda m: {_verhoeff(_digits('m'))})"
    return every


def _all_counts(source: str, t: str = "text") -> str:
    """rule_id, severity, n and keys."""
    parts = [f"SELECT *, '{r.id}' AS rule_id, '{r.token}' AS token, {r.severity} AS severity, len({_found(r.id, t)}) AS n FROM s" for r in TEXT_RULES]
    return f"WITH s AS (SELECT * FROM ({source}) WHERE length({t}) > 0), h AS ({' UNION ALL '.join(parts)})"


# ---- scanning ----

_TEXTS = "SELECT 'documents' AS source, text FROM documents UNION ALL SELECT 'conversations', text FROM conversations UNION ALL SELECT 'pages', html FROM pages"


@query(_all_counts(_TEXTS) + " SELECT source, rule_id, CAST(sum(n) AS BIGINT) AS hits FROM h WHERE n > 0 GROUP BY ALL")
def rule_hit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = [table(spark, sf_dir, t).select(F.lit(t).alias("source"), F.col(c).alias("text")) for t, c in (("documents", "text"), ("conversations", "text"), ("pages", "html"))]
    found = texts[0].union(texts[1]).union(texts[2]).select("source", F.inline(scan.rule_counts(F.col("text"))))
    return found.groupBy("source", "rule_id").agg(F.sum("n").alias("hits"))


_CARD = next(r for r in TEXT_RULES if r.id == "card").pattern


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{_CARD}')) AS candidates, len({_found('card', 'text')}) AS valid FROM documents WHERE len(regexp_extract_all(text, '{_CARD}')) > 0")
def card_luhn_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.rules import java

    d = table(spark, sf_dir, "documents")
    m = F.regexp_extract_all("text", F.lit(java(_CARD)), F.lit(0))
    d = d.select("doc_id", F.size(m).cast("long").alias("candidates"), F.size(F.filter(m, scan.CHECKS["card"])).cast("long").alias("valid"))
    return d.where("candidates > 0")


@query(f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {_verhoeff('CAST(l_orderkey * 1000003 + l_partkey AS VARCHAR)')}")
def verhoeff_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = (F.col("l_orderkey") * 1000003 + F.col("l_partkey")).cast("string")
    return table(spark, sf_dir, "lineitem").where(verhoeff(d)).select("l_orderkey", "l_linenumber")


def _offsets_sql(rule: str) -> str:
    r = next(r for r in TEXT_RULES if r.id == rule)
    valid = f"length({_digits('m')}) BETWEEN 13 AND 19 AND {_luhn(_digits('m'))}" if r.check else "true"
    return f"""SELECT doc_id, '{rule}' AS rule_id, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS index, CAST(length(m) AS INTEGER) AS length, m AS text
      FROM (SELECT doc_id, ms, p, unnest(ms) AS m, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{r.pattern}') AS ms, regexp_split_to_array(text, '{r.pattern}') AS p FROM documents)) WHERE {valid}"""


@query(_offsets_sql("card") + " UNION ALL " + _offsets_sql("email"))
def hit_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = tuple(r for r in TEXT_RULES if r.id in ("card", "email"))
    return scan.hits(table(spark, sf_dir, "documents"), "text", "doc_id", rules=rules).select("doc_id", "rule_id", "index", "length", "text")


_EMAIL = next(r for r in TEXT_RULES if r.id == "email")


@query(f"SELECT doc_id, sha256(regexp_replace(text, '{_EMAIL.pattern}', '{_EMAIL.token}', 'g')) AS masked_sha256 FROM documents")
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(scan.redact(t, scan.scan_text(t, rules=(_EMAIL,), limit=None)), 256).alias("masked_sha256"))


@query(_all_counts("SELECT doc_id, text FROM documents") + " SELECT CAST(count(DISTINCT CASE WHEN n > 0 THEN doc_id END) AS BIGINT) AS masked_docs, CAST(0 AS BIGINT) AS hits_left FROM h")
def rescan_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("h", scan.scan_text(F.col("text"))).where(F.size("h") > 0)
    d = scan.cleared(d, "text", "h")
    return d.agg(F.count_distinct("doc_id").alias("masked_docs"), F.coalesce(F.sum(F.size("left")), F.lit(0)).cast("long").alias("hits_left"))


@query(_all_counts("SELECT doc_id, text FROM documents") + " SELECT doc_id, CAST(max(severity) AS INTEGER) AS severity, CAST(sum(n) AS BIGINT) AS hits FROM h WHERE n > 0 GROUP BY doc_id")
def severity_max_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("h")
    d = table(spark, sf_dir, "documents").select("doc_id", scan.rule_counts(F.col("text")).alias("h")).where(F.size("h") > 0)
    return d.select("doc_id", F.array_max(F.transform(h, lambda x: x["severity"])).alias("severity"), F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("hits"))


@query(_all_counts("SELECT doc_id, text FROM documents") + ", d AS (SELECT doc_id, sum(n) > 0 AS hit FROM h GROUP BY doc_id) SELECT quality, hit, count(*) AS docs FROM d JOIN labels USING (doc_id) GROUP BY ALL")
def quality_by_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.length("text") > 0).select("doc_id", (F.size(scan.rule_counts(F.col("text"))) > 0).alias("hit"))
    return d.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "hit").agg(F.count("*").alias("docs"))


@query(_all_counts("SELECT doc_id, lang, source, text FROM documents") + " SELECT lang, source, CAST(sum(n) AS BIGINT) AS hits FROM h WHERE n > 0 GROUP BY ALL")
def hits_by_lang_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("lang", "source", F.inline(scan.rule_counts(F.col("text")))).groupBy("lang", "source").agg(F.sum("n").alias("hits"))


@query(f"SELECT CAST(count(*) FILTER (length(text) > {SCAN_CHARS}) AS BIGINT) AS over_limit, CAST(sum(len({_found('card', 'text')})) FILTER (length(text) <= {SCAN_CHARS}) AS BIGINT) AS within_limit_hits, CAST(sum(len({_found('card', 'text')})) AS BIGINT) AS all_hits FROM documents")
def long_text_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = tuple(r for r in TEXT_RULES if r.id == "card")
    n = lambda limit: F.sum(F.size(scan.scan_text(F.col("text"), rules=card, limit=limit)))
    return table(spark, sf_dir, "documents").agg(F.count_if(F.length("text") > SCAN_CHARS).alias("over_limit"), n(SCAN_CHARS).alias("within_limit_hits"), n(None).alias("all_hits"))


@query(_all_counts("SELECT doc_id, text FROM documents") + ", t AS (SELECT doc_id, token, sum(n) AS n FROM h WHERE n > 0 GROUP BY ALL) SELECT doc_id, string_agg(token || '×' || n, ', ' ORDER BY token) AS summary FROM t GROUP BY doc_id")
def token_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", scan.scan_text(F.col("text")).alias("h")).where(F.size("h") > 0)
    return d.select("doc_id", scan.token_counts(F.transform("h", lambda x: x["token"])).alias("summary"))


@query("SELECT conv_id, turn, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 120) AS label FROM conversations")
def label_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", scan.scrub(F.col("text")).alias("label"))


@query("SELECT doc_id, sha256(text) AS sha256, strlen(text) AS bytes, substr(sha256(text), 1, 32) AS short FROM documents")
def attestation_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))
    return d.withColumn("short", F.substring("sha256", 1, 32))


# ---- pages ----

_ANCHORS = r"""SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS label, unnest(range(1, 1 + len(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)))) AS n FROM pages"""


@query(f"SELECT page_id, 'f0:' || n AS ref, 'a' AS role, replace(replace(label, '&quot;', '\"'), '&amp;', '&') AS label, false AS sensitive FROM ({_ANCHORS})")
def page_anchors_action_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.action_map(pages.elements(table(spark, sf_dir, "pages"), "page_id", "html"), "page_id")
    return found.select("page_id", "ref", "role", "label", "sensitive")


@query()
def page_text_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.text_nodes(table(spark, sf_dir, "pages"), "page_id", "html").where("visible").select("page_id", "seq", "parent", "text")


@query("SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path, regexp_matches(url, '^(chrome|edge|about|chrome-extension):') AS internal FROM pages")
def url_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.url_path(F.col("url")).alias("path"), text.internal_page(F.col("url")).alias("internal"))


_NAMES = ["city", "one-time-code", "cc-number", "cvv", "aadhaarNumber", "ssn", "email", "mobile", "pan-no", "otp", "user"]
_TYPES = ["text", "password", "email", "tel", "search"]


def _pick(names: list[str], n: str) -> str:
    return f"({names})[CAST({n} % {len(names)} + 1 AS INTEGER)]"


@query(f"""WITH e AS (SELECT event_id, {_pick(_TYPES, 'event_id')} AS type, {_pick(_NAMES, 'event_id')} || CASE WHEN user_id % 3 = 0 THEN ' ' || event_type ELSE '' END AS h, user_id % 97 = 0 AS opted FROM events)
SELECT event_id, CASE WHEN type = 'password' THEN 'password'
  WHEN regexp_matches(h, '(?i)one-?time|\\botp\\b') THEN 'otp' WHEN regexp_matches(h, '(?i)cc-number|card-?number|cardnum') THEN 'cc_field'
  WHEN regexp_matches(h, '(?i)cc-csc|\\bcvv\\b|\\bcvc\\b|security-?code') THEN 'cvc_field' WHEN regexp_matches(h, '(?i)aadhaar|aadhar|uidai') THEN 'aadhaar_field'
  WHEN regexp_matches(h, '(?i)\\bssn\\b|national-?id|gov-?id|pan-?(no|number)') THEN 'ssn_field' WHEN type = 'email' OR regexp_matches(h, '(?i)\\bemail\\b') THEN 'email_field'
  WHEN type = 'tel' OR regexp_matches(h, '(?i)\\b(phone|mobile|tel)\\b') THEN 'tel_field' WHEN opted THEN 'opt_out' END AS rule_id FROM e""")
def field_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names: F.get(F.array(*map(F.lit, names)), F.col("event_id") % len(names))
    h = fields.hint(name=pick(_NAMES), class_name=F.when(F.col("user_id") % 3 == 0, F.col("event_type")))
    return table(spark, sf_dir, "events").select("event_id", fields.classify_field(pick(_TYPES), h, F.col("user_id") % 97 == 0)["rule_id"].alias("rule_id"))


# ---- geometry ----

_BOXES = "SELECT l_orderkey AS frame, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS INTEGER) AS id, CAST(l_partkey * 7 % 900 AS INTEGER) AS x, CAST(l_suppkey * 11 % 560 AS INTEGER) AS y, CAST(l_quantity * 6 AS INTEGER) + 20 AS w, CAST(l_quantity AS INTEGER) % 40 + 8 AS h FROM lineitem"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    li = table(spark, sf_dir, "lineitem")
    b = geometry.box(F.col("l_partkey") * 7 % 900, F.col("l_suppkey") * 11 % 560, (q * 6).cast("int") + 20, q.cast("int") % 40 + 8)
    order = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    return li.select(F.col("l_orderkey").alias("frame"), F.row_number().over(order).alias("id"), b.alias("box"))


def _flat(df: DataFrame, box: str, *more: str) -> DataFrame:
    return df.select("frame", "id", *more, f"{box}.x", f"{box}.y", f"{box}.w", f"{box}.h")


def _window():
    return geometry.box(F.lit(100), F.lit(80), F.lit(500), F.lit(300))


_CUT = "greatest(x, 100) AS x, greatest(y, 80) AS y, least(x + w, 600) - greatest(x, 100) AS w, least(y + h, 380) - greatest(y, 80) AS h"


@query(f"SELECT * FROM (SELECT frame, id, {_CUT} FROM ({_BOXES})) WHERE w > 1 AND h > 1")
def box_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_boxes(spark, sf_dir).withColumn("c", geometry.clip(F.col("box"), _window())).where("c IS NOT NULL"), "c")


@query(f"SELECT frame, id, {_CUT} FROM ({_BOXES})")
def box_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_boxes(spark, sf_dir).withColumn("c", geometry.intersection(F.col("box"), _window())), "c")


@query("SELECT frame, id, " + ", ".join(f"CAST(floor({c} * 1.25::DOUBLE + 0.5::DOUBLE) AS INTEGER) AS {c}" for c in "xywh") + f" FROM ({_BOXES})")
def box_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_boxes(spark, sf_dir).withColumn("c", geometry.scaled(F.col("box"), F.lit(1.25))), "c")


@query(f"SELECT frame, id, x, y, least(w, 640 - x) AS w, least(h, 400 - y) AS h FROM (SELECT frame, id, greatest(0, least(639, x)) AS x, greatest(0, least(399, y)) AS y, w, h FROM ({_BOXES}))")
def box_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_boxes(spark, sf_dir).withColumn("c", geometry.clamped(F.col("box"), F.lit(640), F.lit(400))), "c")


_OVERLAP = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"
_COVERED = f"WITH v AS ({_BOXES}), c AS (SELECT a.frame, a.id, least(1.0::DOUBLE, coalesce(sum(CASE WHEN b.id IS NOT NULL THEN {_OVERLAP} END), 0) / (a.w * a.h)::DOUBLE) AS covered FROM v a LEFT JOIN v b ON a.frame = b.frame AND b.id % 2 = 0 WHERE a.id % 2 = 1 GROUP BY a.frame, a.id, a.w, a.h)"


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir)
    return regions.coverage(b.where("id % 2 = 1"), b.where("id % 2 = 0"), ["frame"], "id")


@query(f"{_COVERED} SELECT frame, id, round(covered, 6) AS covered FROM c WHERE covered >= 0.35")
def coverage_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _covered(spark, sf_dir).where("covered >= 0.35").select("frame", "id", F.round("covered", 6).alias("covered"))


@query(f"{_COVERED} SELECT frame, id FROM c WHERE covered > 0.55")
def coverage_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _covered(spark, sf_dir).where("covered > 0.55").select("frame", "id")


@query(f"WITH v AS ({_BOXES}) SELECT a.frame, a.id, min_by('kind' || b.id % 3, b.id) AS surface FROM v a JOIN v b ON a.frame = b.frame AND b.id % 2 = 0 AND {_OVERLAP} > 0 WHERE a.id % 2 = 1 GROUP BY a.frame, a.id")
def first_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir)
    s = b.where("id % 2 = 0").select("frame", "box", F.concat(F.lit("kind"), (F.col("id") % 3).cast("string")).alias("kind"), F.col("id").alias("seq"))
    return regions.first_overlap(b.where("id % 2 = 1"), s, ["frame"], "id").where("surface IS NOT NULL").select("frame", "id", "surface")


@query(f"WITH v AS ({_BOXES}), p AS (SELECT o_orderkey AS frame, CAST(o_custkey * 13 % 900 AS INTEGER) AS px, CAST(o_custkey * 17 % 560 AS INTEGER) AS py FROM orders) SELECT p.frame, p.px, p.py, max(v.id) AS hit FROM p LEFT JOIN v ON p.frame = v.frame AND px >= x AND px < x + w AND py >= y AND py < y + h GROUP BY ALL")
def point_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame"), F.col("o_orderkey").alias("pid"), (F.col("o_custkey") * 13 % 900).cast("int").alias("px"), (F.col("o_custkey") * 17 % 560).cast("int").alias("py"))
    b = _boxes(spark, sf_dir).select("frame", F.col("id").alias("pid"), "box", F.col("id").alias("z"), F.col("id").alias("seq"))
    return regions.hit_test(p, b, ["frame"], "pid").select("frame", "px", "py", "hit")


def _near_sql(k: str, r: str) -> str:
    shared = f"greatest(0, least({k}.x + {k}.w, {r}.x + {r}.w) - greatest({k}.x, {r}.x)) * greatest(0, least({k}.y + {k}.h, {r}.y + {r}.h) - greatest({k}.y, {r}.y))"
    least = f"least({k}.w * {k}.h, {r}.w * {r}.h)"
    return f"({shared})::DOUBLE / CASE WHEN {least} = 0 THEN 1 ELSE {least} END > 0.7::DOUBLE"


# A fold by recursion: one more region of each frame a step.
_MERGED = "{'token': CASE WHEN r.severity > k.severity THEN r.token ELSE k.token END, 'severity': greatest(r.severity, k.severity), 'x': least(k.x, r.x), 'y': least(k.y, r.y), 'w': greatest(k.x + k.w, r.x + r.w) - least(k.x, r.x), 'h': greatest(k.y + k.h, r.y + r.h) - least(k.y, r.y)}"


@query(f"""WITH RECURSIVE b AS ({_BOXES}), v AS (SELECT frame, id, {{'token': '[T' || id % 4 || ']', 'severity': CAST(id % 3 + 1 AS INTEGER), 'x': CAST(x % 120 AS INTEGER), 'y': CAST(y % 60 AS INTEGER), 'w': w, 'h': h}} AS r FROM b),
f(frame, n, kept) AS (
  SELECT frame, 1, [r] FROM v WHERE id = 1
  UNION ALL SELECT f.frame, f.n + 1, CASE WHEN len(list_filter(f.kept, lambda k: {_near_sql('k', 'v.r')})) = 0 THEN list_append(f.kept, v.r)
    ELSE list_transform(f.kept, lambda k, i: CASE WHEN i = list_position(list_transform(f.kept, lambda q: {_near_sql('q', 'v.r')}), true) THEN {_MERGED.replace('r.', 'v.r.')} ELSE k END) END
  FROM f JOIN v ON v.frame = f.frame AND v.id = f.n + 1),
l AS (SELECT frame, max_by(kept, n) AS kept FROM f GROUP BY frame),
u AS (SELECT frame, unnest(kept) AS k, CAST(unnest(range(0, len(kept))) AS INTEGER) AS n FROM l)
SELECT frame, n, k.token AS token, k.severity AS severity, k.x AS x, k.y AS y, k.w AS w, k.h AS h FROM u""")
def dedupe_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _boxes(spark, sf_dir).select("frame", F.struct("id", F.struct(F.concat(F.lit("[T"), (F.col("id") % 4).cast("string"), F.lit("]")).alias("token"), (F.col("id") % 3 + 1).cast("int").alias("severity"), F.lit("l").alias("label"), geometry.box(F.col("box.x") % 120, F.col("box.y") % 60, F.col("box.w"), F.col("box.h")).alias("box")).alias("r")).alias("s"))
    kept = r.groupBy("frame").agg(F.array_sort(F.collect_list("s")).alias("s")).select("frame", regions.deduplicated(F.transform("s", lambda x: x["r"])).alias("k"))
    return kept.select("frame", F.posexplode("k").alias("n", "k")).select("frame", "n", "k.token", "k.severity", "k.box.x", "k.box.y", "k.box.w", "k.box.h")


_FRAMES = """SELECT 'r' || r_regionkey AS id, NULL AS parent, CAST(r_regionkey * 50 AS INTEGER) AS x, CAST(r_regionkey * 20 AS INTEGER) AS y, 900 AS w, 560 AS h FROM region
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, CAST(n_nationkey * 30 AS INTEGER), CAST(n_nationkey * 15 AS INTEGER), 300, 200 FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, CAST(c_custkey % 320 AS INTEGER), CAST(c_custkey % 210 AS INTEGER), 60, 40 FROM customer"""


@query(f"""WITH RECURSIVE f AS ({_FRAMES}), t AS (
  SELECT id, x AS ox, y AS oy, x AS cx, y AS cy, w AS cw, h AS ch, 0 AS depth FROM f WHERE parent IS NULL
  UNION ALL SELECT f.id, t.ox + f.x, t.oy + f.y, greatest(t.cx, t.ox + f.x), greatest(t.cy, t.oy + f.y), least(t.cx + t.cw, t.ox + f.x + f.w) - greatest(t.cx, t.ox + f.x), least(t.cy + t.ch, t.oy + f.y + f.h) - greatest(t.cy, t.oy + f.y), depth + 1
  FROM t JOIN f ON f.parent = t.id WHERE depth < 6 AND least(t.cx + t.cw, t.ox + f.x + f.w) > greatest(t.cx, t.ox + f.x) AND least(t.cy + t.ch, t.oy + f.y + f.h) > greatest(t.cy, t.oy + f.y))
SELECT * FROM t""")
def frame_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.frame_offsets(_frame_tree(spark, sf_dir)).select("id", "ox", "oy", F.col("clip.x").alias("cx"), F.col("clip.y").alias("cy"), F.col("clip.w").alias("cw"), F.col("clip.h").alias("ch"), "depth")


def _frame_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions hold nations, which hold customers."""

    def frames(name: str, key: str, id_: str, parent, x, y, w: int, h: int) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(id_), F.col(key).cast("string")).alias("id"), parent.alias("parent"), geometry.box(x, y, F.lit(w), F.lit(h)).alias("box"))

    r, n, c = F.col("r_regionkey"), F.col("n_nationkey"), F.col("c_custkey")
    f = frames("region", "r_regionkey", "r", F.lit(None).cast("string"), r * 50, r * 20, 900, 560)
    f = f.union(frames("nation", "n_nationkey", "n", F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), n * 30, n * 15, 300, 200))
    return f.union(frames("customer", "c_custkey", "c", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), c % 320, c % 210, 60, 40))


# ---- vision ----

_TILES = """WITH p AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, (CAST(v AS DOUBLE) + 0.55::DOUBLE) / 1.1::DOUBLE AS lum FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(0, 64)) AS i FROM embeddings)),
d AS (SELECT *, coalesce(lead(lum) OVER (PARTITION BY vec_id, y ORDER BY x), lum) - lum AS dh, coalesce(lead(lum) OVER (PARTITION BY vec_id, x ORDER BY y), lum) - lum AS dv FROM p),
s AS (SELECT *, CASE WHEN abs(dh) > 0.12 THEN sign(dh) END AS s FROM d),
b AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY vec_id, y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
g AS (SELECT vec_id, count(*) AS n, sum(lum) AS s1, sum(lum * lum) AS s2, least(1.0::DOUBLE, min(lum)) AS mn, greatest(0.0::DOUBLE, max(lum)) AS mx, sum(abs(dh)) AS he, sum(abs(dv)) AS ve, count(*) FILTER (s IS NOT NULL AND before <> s) AS cr FROM b GROUP BY vec_id),
t AS (SELECT vec_id, greatest(0.0::DOUBLE, s2 / n - (s1 / n) * (s1 / n)) AS variance, mx - mn AS contrast, (he + ve) / n AS edges, cr / n AS crossings, he / greatest(ve, 1e-4::DOUBLE) AS anisotropy FROM g),
f AS (SELECT *, CASE WHEN contrast > 0.2 AND edges > 0.03 AND crossings > 0.015 THEN edges * 6 + crossings * 9 + contrast * 0.5::DOUBLE + least(anisotropy, 3) * 0.15::DOUBLE ELSE 0.0::DOUBLE END AS score FROM t)"""


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vision.tile_features(vision.pixels_of(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), ["vec_id"])


@query(_TILES + " SELECT vec_id, round(variance, 6) AS variance, round(contrast, 6) AS contrast, round(edges, 6) AS edges, round(crossings, 6) AS crossings, round(score, 6) AS score FROM f")
def tile_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiles(spark, sf_dir).select("vec_id", *[F.round(c, 6).alias(c) for c in ("variance", "contrast", "edges", "crossings", "score")])


_QUADS = """WITH p AS (SELECT vec_id // 4 AS frame, i // 8 + vec_id % 4 // 2 * 8 AS y, i % 8 + vec_id % 2 * 8 AS x, (CAST(v AS DOUBLE) + 0.55::DOUBLE) / 1.1::DOUBLE AS lum FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(0, 64)) AS i FROM embeddings)),
d AS (SELECT *, y // 8 AS ty, x // 8 AS tx, coalesce(lead(lum) OVER (PARTITION BY frame, y ORDER BY x), lum) - lum AS dh, coalesce(lead(lum) OVER (PARTITION BY frame, x ORDER BY y), lum) - lum AS dv FROM p),
s AS (SELECT *, CASE WHEN abs(dh) > 0.12 THEN sign(dh) END AS s FROM d),
b AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY frame, ty, tx, y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
SELECT frame, CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx, round((sum(abs(dh)) + sum(abs(dv))) / count(*), 6) AS edges, round(count(*) FILTER (s IS NOT NULL AND before <> s) / count(*), 6) AS crossings FROM b GROUP BY frame, ty, tx"""


@query(_QUADS)
def tile_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of two by two tiles: differences cross the tiles' borders, crossings begin anew in each tile."""
    v = F.col("vec_id")
    p = vision.pixels_of(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    p = p.select(F.floor(v / 4).alias("frame"), (F.col("y") + F.floor(v % 4 / 2).cast("int") * 8).alias("y"), (F.col("x") + (v % 2).cast("int") * 8).alias("x"), "lum")
    return vision.tile_features(p, ["frame"]).select("frame", "ty", "tx", F.round("edges", 6).alias("edges"), F.round("crossings", 6).alias("crossings"))


_GRID = _TILES + ", m AS (SELECT vec_id // 500 AS frame, CAST(vec_id % 500 // 25 AS INTEGER) AS ty, CAST(vec_id % 25 AS INTEGER) AS tx, score FROM f WHERE score >= 3.9)"


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return _tiles(spark, sf_dir).where("score >= 3.9").select(F.floor(v / 500).alias("frame"), F.floor(v % 500 / 25).cast("int").alias("ty"), (v % 25).cast("int").alias("tx"), "score")


@query(_GRID + ", l AS (SELECT *, lag(tx) OVER (PARTITION BY frame, ty ORDER BY tx) AS b FROM m) SELECT DISTINCT frame, ty, CAST(unnest(range(CASE WHEN tx - b - 1 <= 2 THEN b + 1 ELSE tx END, tx + 1)) AS INTEGER) AS tx FROM l")
def closing_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vision.closed(_grid(spark, sf_dir), ["frame"])


_COMPONENTS = _GRID.replace("WITH p", "WITH RECURSIVE p", 1) + """, r AS (SELECT frame, ty, tx, ty * 25 + tx AS root FROM m UNION SELECT m.frame, m.ty, m.tx, r.root FROM r JOIN m ON m.frame = r.frame AND abs(m.ty - r.ty) <= 1 AND abs(m.tx - r.tx) <= 1),
k AS (SELECT frame, ty, tx, min(root) AS root FROM r GROUP BY ALL),
c AS (SELECT k.frame, root, min(k.tx) AS x0, max(k.tx) AS x1, min(k.ty) AS y0, max(k.ty) AS y1, count(*) AS tiles, avg(score) AS mean_score FROM k JOIN m USING (frame, ty, tx) GROUP BY k.frame, root),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY frame ORDER BY root) - 1 AS INTEGER) AS component FROM c)"""


@query(_COMPONENTS + " SELECT frame, component, x0, x1, y0, y1, CAST(tiles AS INTEGER) AS tiles, round(mean_score, 6) AS mean_score FROM n")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vision.components(_grid(spark, sf_dir), ["frame"]).withColumn("mean_score", F.round("mean_score", 6))


@query(_COMPONENTS + """, q AS (SELECT frame, component, (x1 - x0 + 1) * 8 AS w, (y1 - y0 + 1) * 8 AS h, tiles, round(mean_score, 3) AS score FROM n),
z AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, component) AS rank FROM q WHERE tiles >= 3 AND h >= 8 AND w / h::DOUBLE BETWEEN 1.2 AND 60 AND tiles * 64 / (w * h)::DOUBLE >= 0.35 AND w * h <= 0.35 * 25 * 8 * 20 * 8)
SELECT frame, component, w, h, CAST(tiles AS INTEGER) AS tiles, score, CAST(rank AS INTEGER) AS rank FROM z WHERE rank <= 120""")
def top_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vision.text_like(vision.components(_grid(spark, sf_dir), ["frame"]), width=25, height=20)
    return vision.best(found, ["frame"]).select("frame", "component", "w", "h", "tiles", "score", "rank")


@query(_TILES + " SELECT vec_id, round(least(1.0::DOUBLE, score / greatest(2.5::DOUBLE, 3.9::DOUBLE * 1.5::DOUBLE)), 6) AS shade, score >= 3.9 AS hot FROM f")
def heat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vision.heat(_tiles(spark, sf_dir), threshold=3.9).select("vec_id", F.round("shade", 6).alias("shade"), "hot")


# ---- fusion and proof ----


@query(f"""WITH v AS ({_BOXES}), s AS (SELECT * FROM v WHERE id % 3 = 0 AND w >= 40 AND h >= 14), d AS (SELECT * FROM v WHERE id % 3 = 1), c AS (SELECT * FROM v WHERE id % 3 = 2),
o AS (SELECT a.frame, a.id, least(1.0::DOUBLE, coalesce(sum(CASE WHEN b.id IS NOT NULL THEN {_OVERLAP} END), 0) / (a.w * a.h)::DOUBLE) AS on_, min_by('k' || b.id, b.id) FILTER ({_OVERLAP} > 0) AS surface FROM c a LEFT JOIN s b ON a.frame = b.frame GROUP BY a.frame, a.id, a.w, a.h),
m AS (SELECT a.frame, a.id, least(1.0::DOUBLE, coalesce(sum(CASE WHEN b.id IS NOT NULL THEN {_OVERLAP} END), 0) / (a.w * a.h)::DOUBLE) AS masked FROM c a LEFT JOIN d b ON a.frame = b.frame GROUP BY a.frame, a.id, a.w, a.h)
SELECT frame, id, 'dom-text' AS source, NULL AS surface FROM d UNION ALL
SELECT frame, id, 'gpu-visual', surface FROM o JOIN m USING (frame, id) WHERE on_ >= 0.35 AND masked <= 0.55""")
def fuse_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir)
    surfaces = b.where("id % 3 = 0").select("frame", "box", F.concat(F.lit("k"), F.col("id").cast("string")).alias("kind"), F.col("id").alias("seq"))
    dom = b.where("id % 3 = 1").select("frame", "id", F.lit("dom-text").alias("source"), F.lit("[MASK_PII]").alias("token"), F.lit(2).alias("severity"), F.lit("x").alias("label"), "box", F.lit(0.95).alias("confidence"))
    visual = b.where("id % 3 = 2").withColumn("score", F.lit(2.0))
    return regions.fuse(dom, visual, surfaces, ["frame"]).select("frame", "id", "source", "surface")


_PIXELS = "SELECT n_nationkey AS frame, y, x FROM nation, range(0, 40) t(y), range(0, 60) u(x)"


@query(f"""WITH p AS ({_PIXELS}), g AS (SELECT n_nationkey AS frame, n_nationkey % 30 AS x, n_nationkey % 20 AS y, 24 AS w, 12 AS h FROM nation),
q AS (SELECT p.frame, CASE WHEN p.frame % 5 = 0 AND p.y = g.y + 3 AND p.x = g.x + 4 THEN 0 ELSE 1 END AS good FROM p JOIN g ON p.frame = g.frame AND p.x BETWEEN g.x + 1 AND g.x + g.w - 2 AND p.y BETWEEN g.y + 1 AND g.y + g.h - 2)
SELECT frame, CAST(count(*) AS BIGINT) AS pixels, CAST(count(*) FILTER (good = 0) AS BIGINT) AS deviant, CAST(count(DISTINCT good) AS INTEGER) AS colours, min(good) = 1 AS uniform FROM q GROUP BY frame""")
def verify_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("frame")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("frame"))
    g = nation.select("frame", F.lit(0).alias("index"), F.lit("[MASK_PII]").alias("token"), geometry.box(k % 30, k % 20, F.lit(24), F.lit(12)).alias("box"))
    p = nation.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(39)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(59)))).withColumn("colour", F.lit(7))
    masked = proof.destroyed(p, g, ["frame"])
    spoiled = masked.withColumn("colour", F.when((k % 5 == 0) & (F.col("y") == k % 20 + 3) & (F.col("x") == k % 30 + 4), 1).otherwise(F.col("colour")))
    return proof.proofs(spoiled, g, ["frame"]).select("frame", "pixels", "deviant", "colours", "uniform")


# ---- policy ----

_SEVERE = [r for r in TEXT_RULES if r.severity >= 2]
_LEAKS = "list_concat(" * (len(_SEVERE) - 1) + ", ".join([f"list_transform({_found(_SEVERE[0].id, 'text')}, lambda m: 'PII_IN_METADATA:{_SEVERE[0].id}')"] + [f"list_transform({_found(r.id, 'text')}, lambda m: 'PII_IN_METADATA:{r.id}'))" for r in _SEVERE[1:]])


@query(f"""WITH e AS (SELECT doc_id, text, doc_id % 11 <> 0 AS attested, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 5 <> 0 END AS san, doc_id % 3 <> 0 AS uni, CASE WHEN doc_id % 4 = 0 THEN 'data:image/png;base64,AA' ELSE 'data:image/webp;base64,AA' END AS image, CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'ab' END AS sha FROM documents),
v AS (SELECT doc_id, length(text) AS scanned, list_concat(list_filter([CASE WHEN NOT (attested AND coalesce(san, false)) THEN 'MISSING_ATTESTATION' END, CASE WHEN attested AND NOT uni THEN 'REDACTION_NOT_VERIFIED' END, CASE WHEN NOT starts_with(image, 'data:image/webp;base64,') THEN 'IMAGE_NOT_ENCLAVE_ENCODED' END, CASE WHEN attested AND sha = '' THEN 'IMAGE_UNHASHED' END], lambda x: x IS NOT NULL), {_LEAKS}) AS violations FROM e)
SELECT doc_id, len(violations) = 0 AS allowed, coalesce(array_to_string(violations, ','), '') AS violations, CAST(scanned AS INTEGER) AS scanned FROM v""")
def firewall(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    image = F.when(k % 4 == 0, "data:image/png;base64,AA").otherwise("data:image/webp;base64,AA")
    v = policy.firewall(k % 11 != 0, F.when(k % 7 != 0, k % 5 != 0), k % 3 != 0, image, F.when(k % 6 == 0, "").otherwise("ab"), F.col("text"))
    d = table(spark, sf_dir, "documents").select("doc_id", v.alias("v"))
    return d.select("doc_id", "v.allowed", F.array_join("v.violations", ",").alias("violations"), F.col("v.scanned_chars").alias("scanned"))


@query("""WITH e AS (SELECT item_id, text, item_id % 3 <> 0 AS san, item_id % 4 <> 0 AS uni, CASE WHEN item_id % 5 = 0 THEN 'data:text/plain;base64,' ELSE 'data:image/webp;base64,' END AS head, CASE WHEN item_id % 2 = 0 THEN sha256(text) WHEN item_id % 7 = 0 THEN 'ff' ELSE '' END AS claimed FROM benchmark),
v AS (SELECT item_id, strlen(text) AS bytes, sha256(text) AS sha, list_filter([CASE WHEN NOT san THEN 'no client sanitisation attestation' END, CASE WHEN NOT uni THEN 'client did not verify redaction uniformity' END, CASE WHEN NOT starts_with(head, 'data:image/') THEN 'image is not an inline sanitised buffer' END, CASE WHEN strlen(text) > 200 THEN 'frame exceeds 200 bytes' END, CASE WHEN claimed <> '' AND claimed <> sha256(text) THEN 'attestation hash does not match the received bytes' END], lambda x: x IS NOT NULL) AS r FROM e)
SELECT item_id, CASE WHEN len(r) > 0 THEN 403 ELSE 200 END AS status, coalesce(array_to_string(r, ','), '') AS reasons, sha AS sha256, CAST(bytes AS INTEGER) AS bytes FROM v""")
def server_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t = F.col("item_id"), F.col("text")
    head = F.when(k % 5 == 0, "data:text/plain;base64,").otherwise("data:image/webp;base64,")
    claimed = F.when(k % 2 == 0, F.sha2(t, 256)).when(k % 7 == 0, "ff").otherwise("")
    v = policy.server_policy(k % 3 != 0, k % 4 != 0, F.concat(head, F.base64(t.cast("binary"))), claimed, most=200)
    d = table(spark, sf_dir, "benchmark").select("item_id", v.alias("v"))
    return d.select("item_id", "v.status", F.array_join("v.reasons", ",").alias("reasons"), "v.sha256", "v.bytes")


@query(f"SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'BLOCKED_CREDENTIAL_FIELD' WHEN len({_LEAKS}) > 0 THEN 'BLOCKED_PII_PAYLOAD' END AS code FROM documents")
def write_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    guard = policy.write_guard(F.when(k % 4 == 0, "press").otherwise("type"), F.when(k % 3 == 0, 3).otherwise(1), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", guard.alias("code"))


# ---- planning ----

_GOAL = "CASE p_partkey % 5 WHEN 0 THEN 'click ' || p_name || ' then type \"' || p_brand || '\" into the search field' WHEN 1 THEN 'search for ' || p_type || ', scroll down; open ' || p_name WHEN 2 THEN 'please open the ' || p_name || ' and then submit' WHEN 3 THEN 'scroll -> enter ' || p_brand || ' in ' || p_type ELSE 'Fill ' || p_name || ' , and' END"
_STOP = "['" + "','".join(text.STOP_WORDS) + "']"


def _words_sql(t: str) -> str:
    return f"list_filter(regexp_extract_all(lower({t}), '[a-z0-9]+'), lambda w: NOT list_contains({_STOP}, w))"


_PARTS = f"list_filter(list_transform(regexp_split_to_array(goal, '{text.SPLIT}'), lambda p: trim(p)), lambda p: p <> '')"


def _goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, b, t = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    by = F.col("p_partkey") % 5
    goal = F.when(by == 0, F.concat(F.lit("click "), n, F.lit(' then type "'), b, F.lit('" into the search field'))).when(by == 1, F.concat(F.lit("search for "), t, F.lit(", scroll down; open "), n)).when(by == 2, F.concat(F.lit("please open the "), n, F.lit(" and then submit"))).when(by == 3, F.concat(F.lit("scroll -> enter "), b, F.lit(" in "), t)).otherwise(F.concat(F.lit("Fill "), n, F.lit(" , and")))
    return table(spark, sf_dir, "part").select("p_partkey", goal.alias("goal"))


@query(f"SELECT p_partkey, unnest({_PARTS}) AS subgoal, unnest(range(0, len({_PARTS}))) AS n FROM (SELECT p_partkey, {_GOAL} AS goal FROM part)")
def subgoal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _goals(spark, sf_dir).select("p_partkey", F.posexplode(text.subgoals(F.col("goal"))).alias("n", "subgoal"))
    return g.withColumn("n", F.col("n").cast("long"))


_TYPED, _SEARCH = (p.replace("'", "''") for p in (text.TYPED, text.SEARCH))


@query(f"""WITH s AS (SELECT p_partkey, unnest({_PARTS}) AS subgoal, unnest(range(0, len({_PARTS}))) AS n FROM (SELECT p_partkey, {_GOAL} AS goal FROM part)),
l AS (SELECT *, lower(trim(subgoal)) AS low, {_words_sql('subgoal')}[1] AS verb FROM s)
SELECT p_partkey, n, CASE WHEN regexp_matches(low, '{_TYPED}') OR regexp_matches(low, '{_SEARCH}') THEN 'type' WHEN verb = 'scroll' THEN 'scroll' WHEN verb IN {text.TYPE_VERBS} THEN 'type' ELSE 'click' END AS op,
CASE WHEN regexp_matches(low, '{_TYPED}') THEN regexp_extract(low, '{_TYPED}', 2) WHEN regexp_matches(low, '{_SEARCH}') THEN 'search' WHEN verb = 'scroll' THEN '' WHEN verb IN {text.TYPE_VERBS} THEN low WHEN verb IN {text.CLICK_VERBS} THEN regexp_replace(low, '^\\w+\\s+', '') ELSE low END AS target,
CASE WHEN regexp_matches(low, '{_TYPED}') THEN regexp_extract(low, '{_TYPED}', 1) WHEN regexp_matches(low, '{_SEARCH}') THEN regexp_extract(low, '{_SEARCH}', 1) END AS value FROM l""")
def intent_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = subgoal_split(spark, sf_dir).withColumn("i", text.intent(F.col("subgoal")))
    return s.select("p_partkey", "n", "i.op", "i.target", "i.value")


@query(f"SELECT p_partkey, array_to_string({_words_sql('goal')}, ' ') AS words FROM (SELECT p_partkey, {_GOAL} AS goal FROM part)")
def goal_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _goals(spark, sf_dir).select("p_partkey", F.array_join(text.words(F.col("goal")), " ").alias("words"))


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.action_map(pages.elements(table(spark, sf_dir, "pages"), "page_id", "html"), "page_id")
    return found.select("page_id", "seq", "ref", "label", "role", "type", "sensitive")


def _page_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A goal for each page, out of its heading's first words."""
    head = F.regexp_extract("html", r"<h1>(\S+) ?(\S*)", 0)
    first = F.regexp_extract_all("html", F.lit(r'<a href="[^"]*">([^<]*)</a>'), F.lit(1))
    goal = F.concat(F.lit("open "), F.coalesce(F.get(first, F.lit(1)), F.lit("x")), F.lit(" then click "), F.regexp_replace(head, "<h1>", ""))
    return table(spark, sf_dir, "pages").select("page_id", F.lit(0).alias("goal_id"), goal.alias("goal"))


@query(f"""WITH a AS (SELECT page_id, n, {_words_sql("replace(replace(label, '&quot;', ' '), '&amp;', ' ')")} AS ws, trim(label) = '' AS blank FROM ({_ANCHORS})), t AS (SELECT page_id, {_words_sql("coalesce(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1)[2], 'x')")} AS ts FROM pages)
SELECT page_id, CAST(n AS INTEGER) AS seq, CASE WHEN len(ts) = 0 THEN 0.0::DOUBLE ELSE round(3.4::DOUBLE * len(list_filter(ts, lambda w: list_contains(ws, w))) / len(ts) + 0.45::DOUBLE - CASE WHEN blank THEN 0.5::DOUBLE ELSE 0 END, 6) END AS score FROM a JOIN t USING (page_id)""")
def element_score_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.regexp_extract_all("html", F.lit(r'<a href="[^"]*">([^<]*)</a>'), F.lit(1))
    g = table(spark, sf_dir, "pages").select("page_id", text.words(F.coalesce(F.get(first, F.lit(1)), F.lit("x"))).alias("targets"))
    e = _elements(spark, sf_dir).join(g, "page_id")
    own = planner.element_words(F.col("label"), F.lit(""), F.col("type"))
    similar = planner.exact_share(F.col("targets"), own)
    total = planner.score(F.lit("click"), F.col("targets"), F.col("label"), F.col("role"), F.col("type"), F.col("sensitive"), similar)
    return e.select("page_id", "seq", F.round(total, 6).alias("score"))


@query()
def rank_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _page_goals(spark, sf_dir).withColumn("subgoal", F.get(text.subgoals(F.col("goal")), F.lit(0))).drop("goal")
    best = planner.ranked(g, _elements(spark, sf_dir), ["page_id"]).where("rank = 1")
    return best.select("page_id", "subgoal", "ref", F.round("score", 6).alias("score"))


@query(SQL["element_score_exact"].replace("WITH a AS", "WITH e AS (WITH a AS", 1) + """)
SELECT page_id, 'f0:' || seq AS ref, score FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, seq) AS r FROM e) WHERE r = 1""")
def rank_top1_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best element of each page's first subgoal, by whole words only."""
    first = F.regexp_extract_all("html", F.lit(r'<a href="[^"]*">([^<]*)</a>'), F.lit(1))
    g = table(spark, sf_dir, "pages").select("page_id", F.lit(0).alias("goal_id"), F.concat(F.lit("click "), F.coalesce(F.get(first, F.lit(1)), F.lit("x"))).alias("subgoal"))
    best = planner.ranked(g, _elements(spark, sf_dir).withColumn("role", F.lit("a")), ["page_id"], exact=True).where("rank = 1")
    return best.select("page_id", "ref", F.round("score", 6).alias("score"))


@query()
def plan_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.plan_steps(_page_goals(spark, sf_dir), _elements(spark, sf_dir), ["page_id"], steps=4)


_RAW_ACTION = "event_id, CASE event_id % 6 WHEN 0 THEN 'CLICK' WHEN 1 THEN 'type' WHEN 2 THEN 'press' WHEN 3 THEN 'scroll' WHEN 4 THEN 'fly' END AS op, CASE WHEN user_id % 3 = 0 THEN 'f0:' || user_id % 9 END AS ref, CAST(user_id % 50 AS INTEGER) AS x, CASE WHEN event_id % 2 = 0 THEN event_type END AS txt, CAST(event_id % 4 * 100 AS INTEGER) AS dy, CASE WHEN event_id % 3 = 0 THEN 0.0::DOUBLE ELSE (event_id % 10) / 10.0::DOUBLE END AS conf"


@query(f"""WITH a AS (SELECT {_RAW_ACTION} FROM events), o AS (SELECT *, CASE WHEN lower(op) IN {text.OPERATIONS} THEN lower(op) ELSE 'noop' END AS o FROM a)
SELECT event_id, o AS op, ref, CASE WHEN ref IS NULL THEN x END AS px, CASE WHEN o = 'type' THEN coalesce(txt, '') END AS text, CASE WHEN o = 'press' THEN 'Enter' END AS key, CASE WHEN o = 'scroll' THEN CASE WHEN dy = 0 THEN 400 ELSE dy END END AS dy, CASE WHEN conf = 0 THEN 0.5::DOUBLE ELSE conf END AS confidence FROM o""")
def normalise_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    op = F.get(F.array(*map(F.lit, ("CLICK", "type", "press", "scroll", "fly"))), e % 6)
    ref = F.when(u % 3 == 0, F.concat(F.lit("f0:"), (u % 9).cast("string")))
    point = F.struct((u % 50).cast("int").alias("x"), F.lit(1).alias("y"))
    action = F.struct(op.alias("op"), ref.alias("ref"), point.alias("point"), F.when(e % 2 == 0, F.col("event_type")).alias("text"), F.lit("").alias("key"), (e % 4 * 100).cast("int").alias("dy"))
    raw = F.struct(action.alias("action"), F.lit("r").alias("rationale"), F.when(e % 3 == 0, 0.0).otherwise((e % 10) / 10.0).alias("confidence"), F.lit(None).cast("boolean").alias("done"))
    n = table(spark, sf_dir, "events").select("event_id", raw.alias("raw")).select("event_id", text.normalised(F.col("raw")).alias("n"))
    return n.select("event_id", "n.action.op", "n.action.ref", F.col("n.action.point.x").alias("px"), "n.action.text", "n.action.key", "n.action.dy", "n.confidence")


@query("SELECT event_id, props AS object FROM events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    answer = F.when(e % 3 == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(e % 3 == 1, F.concat(F.lit("Sure {not json}: "), F.col("props"), F.lit(" done {"))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", text.json_object(answer).alias("object"))


# ---- audit and streams ----

_ACCEPTED = "event_type <> 'error'"


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def audit_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_ring(table(spark, sf_dir, "events"), "ts", "event_id").select("event_id", "event_type")


@query(f"SELECT count(*) AS requests, count(*) FILTER (NOT {_ACCEPTED}) AS rejected, CAST(coalesce(sum(user_id % 7) FILTER ({_ACCEPTED}), 0) AS BIGINT) AS masks_seen, CAST(sum(length(props)) AS BIGINT) AS bytes_in FROM events")
def audit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.stats(table(spark, sf_dir, "events"), F.expr(_ACCEPTED), F.col("user_id") % 7, F.length("props"))


@query("WITH r AS (SELECT user_id, event_id, props, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) SELECT user_id, event_id, CASE WHEN n <= 3 THEN props END AS props FROM r WHERE n <= 24")
def trace_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.trace_ring(table(spark, sf_dir, "events").select("user_id", "event_id", "props"), ["user_id"], "event_id", "props")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 6")
def history_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.history_tail(table(spark, sf_dir, "events"), ["user_id"], "event_id").select("user_id", "event_id")


@query(f"SELECT user_id, event_id, CAST(sum(CASE WHEN {_ACCEPTED} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS subgoal FROM events")
def run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr(_ACCEPTED).alias("ok"))
    return audit.progress(e, ["user_id"], "event_id", "ok").select("user_id", "event_id", "subgoal")


@query("""WITH r AS (SELECT user_id // 3 AS scan_id, event_id AS seq, make_timestamp(epoch_us(ts) // 100000) AS ts, CAST(event_id % 3 = 0 AS INTEGER) AS children, user_id % 11 AS nodes FROM events),
l AS (SELECT *, epoch_ms(ts) - epoch_ms(min(ts) OVER (PARTITION BY scan_id)) > 400 AS late FROM r),
n AS (SELECT *, row_number() OVER w AS n, 1 + sum(children) OVER w AS expected FROM l WHERE NOT late WINDOW w AS (PARTITION BY scan_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, coalesce(max(CASE WHEN n >= expected THEN 1 ELSE 0 END) OVER (PARTITION BY scan_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM n)
SELECT scan_id, count(*) AS replies, CAST(max(expected) AS BIGINT) AS expected, CAST(sum(nodes) AS BIGINT) AS nodes, count(*) >= max(expected) AS complete FROM d WHERE done = 0 GROUP BY scan_id""")
def gather_deadline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gather.gathered_batch(_replies(spark, sf_dir))


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as replies of frames, with time running a hundred thousand times faster."""
    return table(spark, sf_dir, "events").select(F.expr("user_id div 3").alias("scan_id"), F.col("event_id").alias("seq"), F.timestamp_micros(F.expr("unix_micros(CAST(ts AS TIMESTAMP)) div 100000")).alias("ts"), (F.col("event_id") % 3 == 0).cast("int").alias("children"), (F.col("user_id") % 11).alias("nodes"))


@query(f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS requests, count(*) FILTER (NOT {_ACCEPTED}) AS rejected, CAST(sum(length(props)) AS BIGINT) AS bytes_in FROM events GROUP BY 1")
def rolling_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.expr(_ACCEPTED).alias("accepted"), F.length("props").alias("bytes"))
    out = gather.rolling_audit(e)
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


_LENSES = ("dom-field", "dom-text", "gpu-visual")


@query(f"""WITH r AS (SELECT frame, {list(_LENSES)}[CAST(id % 3 + 1 AS INTEGER)] AS source, id % 3 + 1 AS severity FROM ({_BOXES}))
SELECT frame, count(*) AS regions, count(*) FILTER (severity >= 3) AS severe, count(*) FILTER (source = 'dom-field') AS fields, count(*) FILTER (source = 'dom-text') AS texts, count(*) FILTER (source = 'gpu-visual') AS visual FROM r GROUP BY frame""")
def masks_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of three lenses gathered and counted per frame."""
    b = _boxes(spark, sf_dir)
    lens = lambda i: b.where(F.col("id") % 3 == i).select("frame", "id", F.lit(_LENSES[i]).alias("source"), F.lit(i + 1).alias("severity"))
    return regions.counts(regions.gathered(lens(0), lens(1).withColumn("index", F.lit(0)), lens(2)), ["frame"])


@query("SELECT event_id, 'f0:' || user_id % 40 AS ref, e.label, e.label IS NOT NULL AS owned FROM events LEFT JOIN (SELECT n_nationkey, n_name AS label FROM nation) e ON e.n_nationkey = user_id % 40")
def ref_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = lambda c: F.concat(F.lit("f0:"), c.cast("string"))
    actions = table(spark, sf_dir, "events").select("event_id", F.lit(0).alias("frame"), ref(F.col("user_id") % 40).alias("ref"))
    elements = table(spark, sf_dir, "nation").select(F.lit(0).alias("frame"), ref(F.col("n_nationkey")).alias("ref"), F.col("n_name").alias("label"))
    return regions.found_elements(actions, elements, ["frame"]).select("event_id", "ref", "label", "owned")


@query("SELECT o_orderkey, CAST(i AS INTEGER) AS n, 'T' || i AS token, CASE WHEN i < o_custkey % 4 THEN (o_orderkey + i) % 2 = 0 END AS uniform FROM orders, range(0, 5) r(i) WHERE i < o_orderkey % 5")
def region_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with their proofs by position; some frames have fewer proofs than regions."""
    upto = lambda n: F.filter(F.sequence(F.lit(0), F.lit(4)), lambda i: i < n)
    r = F.transform(upto(F.col("o_orderkey") % 5), lambda i: F.struct(F.concat(F.lit("T"), i.cast("string")).alias("token")))
    p = F.transform(upto(F.col("o_custkey") % 4), lambda i: F.struct(((F.col("o_orderkey") + i) % 2 == 0).alias("uniform")))
    found = table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(regions.with_proofs(r, p)).alias("n", "x"))
    return found.select("o_orderkey", "n", "x.region.token", "x.proof.uniform")


@query(f"""WITH s AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'blocked' WHEN 'signup' THEN 'done' ELSE 'step' END AS e FROM events),
o AS (SELECT *, coalesce(max(CASE WHEN e <> 'step' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM s)
SELECT user_id, count(*) AS steps, coalesce(max(CASE WHEN e <> 'step' THEN e END), CASE WHEN count(*) >= 8 THEN 'budget' ELSE 'running' END) AS status FROM o WHERE over = 0 GROUP BY user_id""")
def loop_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.when(F.col("event_type") == "error", "blocked").when(F.col("event_type") == "signup", "done").otherwise("step")
    return audit.loop_status(table(spark, sf_dir, "events").select("user_id", "event_id", e.alias("e")), ["user_id"], "event_id", "e", most=8)


# ---- planted texts: every rule has hits ----

_PLANTED = {
    "aadhaar": "2345 6789 0124", "pan": "ABCDE1234F", "card": "4111-1111-1111-1111", "ifsc": "HDFC0A1B2C3", "gstin": "22ABCDE1234F1Z5", "passport": "K1234567", "email": "a.b@mail.example.org", "phone_in": "+91 9876543210",
    "upi": "some.one@okaxis", "jwt": "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl", "apikey": "tok_ABCDEFGH12345678", "geo": "12.345 N, 77.123456 E", "dob": "31/12/1999", "none": "2345 6789 0123",
}
_PLANT = list(_PLANTED.values())


def _planted_sql(keys: str = "doc_id") -> str:
    return f"SELECT {keys}, text || ' ' || ({_PLANT})[CAST(doc_id % {len(_PLANT)} + 1 AS INTEGER)] || ' end' AS text FROM documents"


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat("text", F.lit(" "), F.get(F.array(*map(F.lit, _PLANT)), F.col("doc_id") % len(_PLANT)), F.lit(" end"))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("text"))


@query(_all_counts(_planted_sql()) + " SELECT rule_id, token, CAST(sum(n) AS BIGINT) AS hits, count(*) FILTER (n > 0) AS docs FROM h WHERE n > 0 GROUP BY ALL")
def planted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _planted(spark, sf_dir).select("doc_id", F.inline(scan.rule_counts(F.col("text"))))
    return found.groupBy("rule_id", "token").agg(F.sum("n").alias("hits"), F.count("*").alias("docs"))


@query(_all_counts(_planted_sql()) + """, c AS (SELECT doc_id, sum(n) AS n FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS INTEGER) AS hits, CAST(0 AS INTEGER) AS remaining, true AS sanitized, true AS uniform, sha256(d.text) AS raw_sha256, CAST(strlen(d.text) AS INTEGER) AS raw_bytes, coalesce(c.n, 0) > 0 AS changed FROM (""" + _planted_sql() + ") d LEFT JOIN c USING (doc_id)")
def protected_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = protect_texts(_planted(spark, sf_dir), "text", now=F.lit(None).cast("timestamp"))
    a = F.col("attestation")
    return d.select("doc_id", F.size("hits").alias("hits"), "remaining", a["sanitized"].alias("sanitized"), a["all_regions_uniform"].alias("uniform"), a["raw_sha256"].alias("raw_sha256"), a["raw_bytes"].alias("raw_bytes"), (F.col("masked") != F.col("text")).alias("changed"))


@query("SELECT doc_id, 'see ' || CASE doc_id % 3 WHEN 0 THEN '[MASK_EMAIL]' WHEN 1 THEN '[MASK_PAN] and [MASK_DOB]' ELSE 'nothing' END || ' end' AS label FROM documents")
def scrubbed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    raw = F.concat(F.lit("  see \n "), F.when(k == 0, "x.y@example.org").when(k == 1, "ABCDE1234F \t and 01-02-1990").otherwise("nothing"), F.lit("  end "))
    return table(spark, sf_dir, "documents").select("doc_id", scan.scrub(raw).alias("label"))


# ---- explanations and envelopes ----


@query("""WITH d AS (SELECT event_id, CAST(event_id % 4 + 1 AS INTEGER) AS number, 3 AS count, CASE WHEN user_id % 5 = 0 THEN 'scroll' ELSE 'click' END AS op, CASE WHEN user_id % 7 <> 0 THEN (event_id % 10) / 4.0::DOUBLE END AS score, user_id % 2 = 0 AS sensitive, CAST(user_id % 90 AS INTEGER) AS x FROM events)
SELECT event_id, CASE WHEN number > count THEN 'All 3 sub-goal(s) satisfied. ' WHEN op = 'scroll' THEN 'Sub-goal ' || number || '/3 is a scroll. '
  WHEN coalesce(score < 0.75, true) THEN 'Could not ground “open it” on this frame (best candidate “' || CASE WHEN score IS NULL THEN '—' ELSE 'It' END || '” scored ' || coalesce(printf('%.2f', score), '0.00') || ' if any). '
  ELSE 'Sub-goal ' || number || '/3: “open it”. Grounded to <a> “It” at ' || x || ',7 (score ' || printf('%.2f', score) || ').' || CASE WHEN sensitive THEN ' Target is a masked field — I can see its token and coordinates but not its contents, and the client will refuse any write to a severity-3 field.' ELSE '' END || ' ' END
  || 'frame carries 12 actionable elements; redactions: [A]×2, [B]×1.' AS rationale FROM d""")
def rationales(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    best = F.when(u % 7 != 0, F.struct(F.lit("a").alias("role"), F.lit("It").alias("label"), (u % 2 == 0).alias("sensitive"), geometry.box(u % 90, F.lit(7), F.lit(5), F.lit(5)).alias("box"), ((e % 10) / 4.0).alias("score")))
    said = planner.rationale((e % 4 + 1).cast("int"), F.lit(3), F.lit("open it"), F.when(u % 5 == 0, "scroll").otherwise("click"), best, F.lit(12), F.array(*map(F.lit, ("[B]", "[A]", "[A]"))))
    return table(spark, sf_dir, "events").select("event_id", said.alias("rationale"))


@query("SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) THEN 502 ELSE 200 END AS status, CASE event_id % 5 WHEN 0 THEN 'model back end failed: timeout' WHEN 1 THEN 'model back end failed: no decision' END AS error FROM events")
def planner_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    made = planner.outcome(F.when(k != 1, "noop"), F.when(k == 0, "timeout"), "model")
    return table(spark, sf_dir, "events").select("event_id", made.alias("o")).select("event_id", "o.status", "o.error")


def _envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    history = F.transform(F.filter(F.sequence(F.lit(1), F.lit(9)), lambda i: i <= e % 10), lambda i: F.struct(i.alias("step"), F.struct(F.lit("click").alias("op"), F.concat(F.lit("f0:"), i.cast("string")).alias("ref"), F.lit(None).cast("string").alias("text")).alias("action"), (i % 2 == 0).alias("ok"), F.lit(None).cast("string").alias("code")))
    box = geometry.box(F.lit(1), F.lit(2), F.lit(30), F.lit(40))
    found = F.array(F.struct(F.lit("[MASK_PII]").alias("token"), F.lit("secret value").alias("value"), F.lit("x").alias("label"), F.lit(2).alias("severity"), F.lit("dom-text").alias("source"), box.alias("box")))
    actions = F.array(F.struct(F.lit("f0:1").alias("ref"), F.lit("a").alias("role"), F.lit(None).cast("string").alias("type"), F.col("event_type").alias("label"), (e % 2 == 0).alias("sensitive"), box.alias("box")))
    made = envelope("frames/1", F.lit("do it"), (e % 9).cast("int"), F.lit(8), F.lit("data:image/webp;base64,AA"), F.struct(F.lit(640).alias("w"), F.lit(400).alias("h"), F.lit(1.5).alias("dpr")), F.when(e % 3 != 0, "Home"), found, actions, history, F.struct(F.lit(True).alias("sanitized")))
    return table(spark, sf_dir, "events").select("event_id", made.alias("envelope"))




def _history_sql(entry: str) -> str:
    return f"list_transform(range(greatest(1, event_id % 10 - 5), event_id % 10 + 1), lambda i: {entry})"


@query("SELECT event_id, '{\"protocol\":\"frames/1\",\"goal\":\"do it\",\"step\":' || event_id % 9 || ',\"maxSteps\":8,\"viewport\":{\"w\":640,\"h\":400,\"dpr\":1.5},\"pageTitle\":\"' || CASE WHEN event_id % 3 <> 0 THEN 'Home' ELSE '' END || '\",\"semanticTokens\":[{\"token\":\"[MASK_PII]\",\"label\":\"x\",\"severity\":2,\"source\":\"dom-text\",\"box\":{\"x\":1,\"y\":2,\"w\":30,\"h\":40}}],\"actionMap\":[{\"ref\":\"f0:1\",\"role\":\"a\",\"type\":null,\"label\":\"' || event_type || '\",\"sensitive\":' || (event_id % 2 = 0) || ',\"box\":{\"x\":1,\"y\":2,\"w\":30,\"h\":40}}],\"history\":[' || array_to_string(" + _history_sql("'{\"step\":' || i || ',\"action\":{\"op\":\"click\",\"ref\":\"f0:' || i || '\",\"text\":null},\"ok\":' || (i % 2 = 0) || ',\"code\":null}'") + ", ',') || '],\"attestation\":{\"sanitized\":true}}' AS metadata FROM events")
def envelope_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _envelopes(spark, sf_dir).select("event_id", metadata(F.col("envelope")).alias("metadata"))


@query("SELECT event_id, 'GOAL: do it' || chr(10) || 'STEP: ' || event_id % 9 || ' of 8' || chr(10) || 'PAGE: ' || CASE WHEN event_id % 3 <> 0 THEN 'Home' ELSE '' END || chr(10) || 'VIEWPORT: 640x400 css px, dpr 1.5' || chr(10) || chr(10) || 'REDACTED REGIONS (1) — values destroyed on-device:' || chr(10) || '  [MASK_PII]         sev2 1,2 30x40  (dom-text)' || chr(10) || chr(10) || 'ACTIONABLE ELEMENTS (1):' || chr(10) || '  f0:1       <a> \"' || event_type || '\" @1,2' || CASE WHEN event_id % 2 = 0 THEN ' SENSITIVE' ELSE '' END || CASE WHEN event_id % 10 > 0 THEN chr(10) || chr(10) || 'HISTORY:' || chr(10) || array_to_string(" + _history_sql("'  step ' || i || ': {\"op\":\"click\",\"ref\":\"f0:' || i || '\"} -> ok=' || CASE WHEN i % 2 = 0 THEN 'True' ELSE 'False' END || ' '") + ", chr(10)) ELSE '' END AS brief FROM events")
def layout_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _envelopes(spark, sf_dir).select("event_id", text.layout_brief(F.col("envelope")).alias("brief"))


# ---- records at the edge ----


@query(_all_counts("SELECT doc_id, text FROM documents") + " SELECT token, CASE token WHEN '[MASK_CARD]' THEN '[CARD]' WHEN '[MASK_EMAIL]' THEN '[EMAIL]' WHEN '[MASK_PHONE]' THEN '[PHONE]' WHEN '[MASK_AADHAAR]' THEN '[AADHAAR]' ELSE token END AS short, CAST(sum(n) AS BIGINT) AS hits FROM h WHERE n > 0 GROUP BY token")
def short_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan.hits(table(spark, sf_dir, "documents"), "text", "doc_id").groupBy("token").agg(F.count("*").alias("hits"))
    return found.select("token", scan.short_token(F.col("token")).alias("short"), "hits")


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_suppkey % 160 + 20 AS INTEGER) AS w, CAST(l_partkey % 40 + 6 AS INTEGER) AS h FROM lineitem),
s AS (SELECT *, greatest(9, least(18, floor(h * 0.6::DOUBLE))) AS size, floor((w - 8) / (5 * 0.6::DOUBLE)) AS most FROM b)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN 15 * size * 0.6::DOUBLE <= w - 8 THEN '[MASK_PASSWORD]' WHEN least(size, most) >= 7 THEN '[PWD]' END AS label, CAST(CASE WHEN 15 * size * 0.6::DOUBLE <= w - 8 THEN size WHEN least(size, most) >= 7 THEN least(size, most) END AS INTEGER) AS size FROM s""")
def fitted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = scan.fitted_label(F.lit("[MASK_PASSWORD]"), (F.col("l_suppkey") % 160 + 20).cast("int"), (F.col("l_partkey") % 40 + 6).cast("int"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", made.alias("m")).select("l_orderkey", "l_linenumber", "l_partkey", "m.label", "m.size")


@query("SELECT item_id, 'image/webp' AS media, CAST(length(base64(encode(text))) AS INTEGER) AS encoded, CAST(strlen(text) AS INTEGER) AS bytes FROM benchmark")
def data_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("data:image/webp;base64,"), F.regexp_replace(F.base64(F.col("text").cast("binary")), r"\s", ""))
    d = table(spark, sf_dir, "benchmark").select("item_id", url.alias("u"))
    return d.select("item_id", text.media_type(F.col("u")).alias("media"), F.length(text.payload(F.col("u"))).alias("encoded"), F.octet_length(F.try_to_binary(text.payload(F.col("u")), F.lit("base64"))).alias("bytes"))


@query("SELECT p_partkey, round((0.299::DOUBLE * (p_partkey % 256) + 0.587::DOUBLE * (p_size * 5 % 256) + 0.114::DOUBLE * (p_partkey * 7 % 256)) / 255, 6) AS lum, (p_partkey % 256) * 65536 + (p_size * 5 % 256) * 256 + p_partkey * 7 % 256 AS packed FROM part")
def luminance(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, g, b = F.col("p_partkey") % 256, F.col("p_size") * 5 % 256, F.col("p_partkey") * 7 % 256
    return table(spark, sf_dir, "part").select("p_partkey", F.round(vision.luminance(r, g, b), 6).alias("lum"), proof.packed(r, g, b).alias("packed"))


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def audit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_page(table(spark, sf_dir, "events"), "ts", "event_id", 25).select("event_id")


@query("SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN event_type END AS goal, CASE WHEN event_id % 10 <> 0 THEN CAST(user_id % 9 AS INTEGER) END AS step, CASE WHEN event_id % 10 <> 0 THEN event_id % 2 = 0 END AS sanitized, CASE WHEN event_id % 10 <> 0 THEN 1 ELSE 0 END AS tokens FROM events")
def envelope_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    body = F.format_string('{"goal":"%s","step":%d,"attestation":{"sanitized":%s},"semanticTokens":[{"token":"[MASK_PII]","severity":2}],"other":1}', F.col("event_type"), F.col("user_id") % 9, F.when(e % 2 == 0, "true").otherwise("false"))
    d = envelopes(table(spark, sf_dir, "events").select("event_id", F.when(e % 10 == 0, "{broken").otherwise(body).alias("j")), "j")
    return d.select("event_id", "envelope.goal", "envelope.step", "envelope.attestation.sanitized", F.greatest(F.size(F.coalesce("envelope.semanticTokens", F.array())), F.lit(0)).alias("tokens"))


@query("SELECT event_id, value::DOUBLE AS dom, round(CAST(user_id % 13 + user_id % 5 AS DOUBLE), 6) AS mask_and_verify, CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS DOUBLE) ELSE CAST(event_id AS DOUBLE) END AS end_to_end FROM events")
def timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, e = F.col("user_id").cast("double"), F.col("event_id").cast("double")
    m = F.struct(F.col("value").alias("dom_ms"), u.alias("visual_ms"), u.alias("group_ms"), (u % 13).alias("mask_ms"), (u % 5).alias("verify_ms"), u.alias("encode_ms"), F.when(F.col("event_id") % 3 == 0, u).alias("roundtrip_ms"), e.alias("total_ms"))
    return table(spark, sf_dir, "events").select("event_id", m.alias("m")).select("event_id", text.timing(F.col("m")).alias("t")).select("event_id", "t.dom", "t.mask_and_verify", "t.end_to_end")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'noop' ELSE ['click','type','scroll'][CAST(event_id % 3 + 1 AS INTEGER)] END AS op, CASE WHEN event_id % 4 = 0 THEN 'UNKNOWN_OP' WHEN event_id % 3 <> 2 AND user_id % 2 = 0 THEN CASE WHEN user_id % 3 = 0 THEN 'NO_ELEMENT_AT_POINT' ELSE 'NO_FRAME_HANDLED_ACTION' END END AS code FROM events")
def action_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    op = F.when(e % 4 == 0, "noop").otherwise(F.get(F.array(*map(F.lit, ("click", "type", "scroll"))), e % 3))
    made = policy.result(op, F.lit(None).cast("string"), u % 2 != 0, u % 3 == 0)
    return table(spark, sf_dir, "events").select("event_id", made.alias("r")).select("event_id", "r.op", "r.code")
