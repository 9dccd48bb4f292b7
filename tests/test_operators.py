"""Operators over small tables."""

import base64
import hashlib
import random

from pyspark.sql import functions as F

from maskwright.operators import pages, planner, policy, proof, regions, vision
from maskwright.plans import protect
from maskwright.plans.settings import Settings, layered


def boxes(spark, rows):
    df = spark.createDataFrame(rows, "frame int, id int, x int, y int, w int, h int")
    return df.select("frame", "id", F.struct("x", "y", "w", "h").alias("box"))


def test_coverage_over_cells(spark):
    rng = random.Random(1)
    rows = [(f, i, rng.randint(-50, 400), rng.randint(-50, 300), rng.randint(1, 300), rng.randint(1, 200)) for f in range(3) for i in range(12)]
    a, b = [r for r in rows if r[1] % 2], [r for r in rows if not r[1] % 2]
    got = {(r.frame, r.id): r.covered for r in regions.coverage(boxes(spark, a), boxes(spark, b), ["frame"], "id").collect()}
    for f, i, x, y, w, h in a:
        shared = sum(max(0, min(x + w, p + r) - max(x, p)) * max(0, min(y + h, q + s) - max(y, q)) for g, _, p, q, r, s in b if g == f)
        assert abs(got[f, i] - min(1, shared / (w * h))) < 1e-9


def test_hits_of_points_in_very_wide_boxes(spark):
    rng = random.Random(7)
    at = lambda: (rng.randint(-300, 300), rng.randint(-300, 300))
    points = [(f, i, *at()) for f in range(3) for i in range(25)] + [(3, 0, 5, 5), (4, 0, 1, 1), (5, 0, None, 1)]
    # The last ones reach over so many cells that there can't be a row for each.
    rows = [(f, i, *at(), rng.randint(0, 400), rng.randint(0, 300)) for f in range(3) for i in range(30)] + [(f, 99, -(1 << 29), -(1 << 29), 1 << 30, 1 << 30) for f in (3, 5)]
    b = boxes(spark, rows).withColumns({"z": F.col("id") % 7, "seq": F.col("id")})
    got = {(r.frame, r.id): r.hit for r in regions.hit_test(spark.createDataFrame(points, "frame int, id int, px int, py int"), b, ["frame"], "id").collect()}
    for f, i, px, py in points:
        held = [(k % 7, k) for g, k, x, y, w, h in rows if px is not None and f == g and x <= px < x + w and y <= py < y + h]
        assert got[f, i] == (max(held)[1] if held else None)
    assert len(got) == len(points)


def test_greedy_merging(spark):
    rng = random.Random(2)
    items = [(f"[T{rng.randint(0, 3)}]", rng.randint(1, 3), "l", (rng.randint(0, 40), rng.randint(0, 30), rng.randint(5, 40), rng.randint(5, 30))) for _ in range(14)]
    kept = []
    for t, s, lab, (x, y, w, h) in items:
        for k in kept:
            p, q, r, v = k[3]
            shared = max(0, min(x + w, p + r) - max(x, p)) * max(0, min(y + h, q + v) - max(y, q))
            if shared / (min(w * h, r * v) or 1) > 0.7:
                if s > k[1]:
                    k[0], k[1], k[2] = t, s, lab
                k[3] = (min(p, x), min(q, y), max(p + r, x + w) - min(p, x), max(q + v, y + h) - min(q, y))
                break
        else:
            kept.append([t, s, lab, (x, y, w, h)])
    df = spark.createDataFrame([(items,)], "r array<struct<token:string,severity:int,label:string,box:struct<x:int,y:int,w:int,h:int>>>")
    got = df.select(regions.deduplicated(F.col("r")).alias("k")).first()["k"]
    assert [(k["token"], k["severity"], k["label"], tuple(k["box"])) for k in got] == [tuple(k) for k in kept]


def test_components_partition_the_mask(spark):
    rng = random.Random(3)
    tiles = [(0, y, x, 1.0) for y in range(12) for x in range(15) if rng.random() < 0.4]
    on = spark.createDataFrame(tiles, "frame int, ty int, tx int, score double")
    got = vision.components(on, ["frame"]).collect()
    assert sum(r.tiles for r in got) == len(tiles)
    assert [r.component for r in sorted(got, key=lambda r: r.component)] == list(range(len(got)))


def test_closing_fills_short_gaps(spark):
    on = spark.createDataFrame([(0, 0, x, 1.0) for x in (0, 3, 7)], "frame int, ty int, tx int, score double")
    assert sorted(r.tx for r in vision.closed(on, ["frame"]).collect()) == [0, 1, 2, 3, 7]


def test_destroy_then_prove(spark):
    pixels = spark.range(20).withColumnRenamed("id", "y").crossJoin(spark.range(20).withColumnRenamed("id", "x")).select(F.lit(0).alias("frame"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.lit(9).alias("colour"))
    r = boxes(spark, [(0, 0, 2, 2, 10, 8)]).withColumns({"index": F.col("id"), "token": F.lit("[MASK_PII]")})
    before = proof.proofs(pixels, r, ["frame"]).first()
    after = proof.proofs(proof.destroyed(pixels, r, ["frame"]), r, ["frame"]).first()
    assert (before.uniform, before.deviant, before.pixels) == (False, 48, 48)
    assert (after.uniform, after.deviant, after.colours, after.entropy) == (True, 0, 1, 0.0)
    assert proof.verification(proof.proofs(pixels, r, ["frame"]), ["frame"]).first().failed == 1


def test_protected_texts_scan_clean(spark):
    df = spark.createDataFrame([("card 4111111111111111, ok",), ("none",), (None,)], "t string")
    got = protect.protect_texts(df, "t", now=F.lit("2024-01-01").cast("timestamp")).collect()
    assert got[0].masked == "card [MASK_CARD], ok" and got[0].remaining == 0 and got[0].attestation["all_regions_uniform"]
    assert got[0].attestation["raw_sha256"] == hashlib.sha256(b"card 4111111111111111, ok").hexdigest()
    assert got[1].attestation["mask_count"] == 0 and got[2].masked is None


def test_what_a_failed_match_hid_is_masked_too(spark):
    # The first scan reads 16 digits and the next number as one card, whose check fails.
    cases = [("pay 4655932058657044 12.345 N, 77.123456 E end", "pay 4655932058657044 [MASK_COORD] end", "pay [MASK_CARD] [MASK_COORD] end"), ("4875612363402641 31/12/1999", "4875612363402641 [MASK_DOB]", "[MASK_CARD] [MASK_DOB]")]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "i int, t string")
    got = protect.protect_texts(df, "t", now=F.current_timestamp()).orderBy("i").collect()
    for r, (_, once, whole) in zip(got, cases, strict=True):
        assert len(r.hits) == 1 and r.masked == whole != once and r.remaining == 0
        assert r.attestation.mask_count == 2 and r.attestation.all_regions_uniform


def test_firewall_names_every_violation(spark):
    v = lambda *a, **k: tuple(spark.range(1).select(policy.firewall(*[F.lit(x) for x in a], **k).alias("v")).first()["v"])
    webp = "data:image/webp;base64,AA"
    assert v(True, True, True, webp, "ab", "clean")[:2] == (True, [])
    assert v(False, None, None, "x", "", "pay 4111111111111111")[1] == ["MISSING_ATTESTATION", "IMAGE_NOT_ENCLAVE_ENCODED", "PII_IN_METADATA:card"]
    assert v(True, None, False, webp, "", "mail a@b.co")[1] == ["MISSING_ATTESTATION", "REDACTION_NOT_VERIFIED", "IMAGE_UNHASHED"]
    long = "x " * 10_001 + "4111111111111111"
    assert v(True, True, True, webp, "ab", long, limit=20_000)[0] and not v(True, True, True, webp, "ab", long)[0]


def test_server_policy(spark):
    raw = b"picture"
    url = "data:image/webp;base64," + base64.b64encode(raw).decode()
    p = lambda *a: spark.range(1).select(policy.server_policy(*[F.lit(x) for x in a]).alias("p")).first()["p"]
    good = p(True, True, url, hashlib.sha256(raw).hexdigest())
    assert (good["status"], good["reasons"], good["bytes"]) == (200, [], 7)
    assert p(True, True, url, "")["status"] == 200
    assert p(False, True, url, "")["reasons"] == ["no client sanitisation attestation"]
    assert p(True, False, url, "")["reasons"] == ["client did not verify redaction uniformity"]
    assert p(True, True, url, "ff")["reasons"] == ["attestation hash does not match the received bytes"]
    assert p(True, True, "no comma", "")["status"] == 422


def test_write_guard(spark):
    rows = [("type", 3, "x"), ("type", 1, "4111111111111111"), ("type", 1, "a@b.co"), ("press", 3, "x"), ("type", None, None)]
    df = spark.createDataFrame(rows, "op string, s int, t string")
    assert [r[0] for r in df.select(policy.write_guard(F.col("op"), F.col("s"), F.col("t"))).collect()] == ["BLOCKED_CREDENTIAL_FIELD", "BLOCKED_PII_PAYLOAD", None, None, None]


ELEMENTS = [(0, 1, "f0:1", "Dashboard", "a", None, False), (0, 2, "f0:2", "Payments", "a", None, False), (0, 3, "f0:3", "New transfer", "button", None, False), (0, 4, "f0:4", "Search facility", "input", "text", False), (0, 5, "f0:5", "[MASK_PASSWORD]", "input", "password", True)]


def steps(spark, goal, exact=False):
    e = spark.createDataFrame(ELEMENTS, "page int, seq int, ref string, label string, role string, type string, sensitive boolean")
    g = spark.createDataFrame([(0, 0, goal)], "page int, goal_id int, goal string")
    return planner.plan_steps(g, e, ["page"], exact=exact).orderBy("step").collect()


def test_planned_runs(spark):
    got = steps(spark, "open Payments then start a new transfer")
    assert [r.ref for r in got] == ["f0:2", "f0:3", None] and [r.done for r in got] == [False, False, True]
    typed = steps(spark, "type Bangalore in the search facility")[0]
    assert (typed.op, typed.ref, typed.text) == ("type", "f0:4", "bangalore")
    lost = steps(spark, "deorbit the satellite")
    assert len(lost) == 1 and lost[0].done and lost[0].op == "noop" and lost[0].confidence < 0.5
    assert [r.op for r in steps(spark, "scroll down, open Payments")] == ["scroll", "click", "noop"]
    assert [r.op for r in steps(spark, "")] == ["noop"]


def test_single_decisions(spark):
    e = spark.createDataFrame(ELEMENTS, "page int, seq int, ref string, label string, role string, type string, sensitive boolean")
    g = spark.createDataFrame([(0, 0, "open Payments then start a new transfer", 1), (0, 1, "open Payments", 1), (9, 2, "open x", 0)], "page int, goal_id int, goal string, done_count int")
    got = {r.goal_id: (r.op, r.ref, r.done) for r in planner.decided(g, e, ["page"]).collect()}
    assert got == {0: ("click", "f0:3", False), 1: ("noop", None, True), 2: ("noop", None, True)}


def test_pages(spark):
    html = '<p>short</p><script>not text at all</script><form><input type=password name=p><input name=q placeholder="Search  here"><button disabled>no</button><a href=x>Mail a@b.co</a></form><canvas></canvas><svg></svg>'
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "page int, html string")
    e = pages.elements(df, "page", "html")
    assert [(r.ref, r.role, r.label, r.sensitive) for r in pages.action_map(e, "page").orderBy("seq").collect()] == [("f0:1", "input", "[MASK_PASSWORD]", True), ("f0:2", "input", "Search here", False), ("f0:3", "a", "Mail [MASK_EMAIL]", False)]
    assert [r.kind for r in pages.surfaces(e, "page").collect()] == ["canvas"]
    assert [r.text for r in pages.text_nodes(df, "page", "html").collect()] == ["Mail a@b.co"]


def test_settings():
    assert layered({"tile": 16}, {"tile": None, "mode": "paranoid", "other": 1}) == Settings(tile=16, mode="paranoid")


def test_what_was_not_scanned_is_not_attested(spark):
    t = "x " * 12_000 + "4111111111111111"
    df = spark.createDataFrame([(1, t), (2, "4111111111111111"), (3, None)], "i int, t string")
    whole = {r.i: r for r in protect.protect_texts(df, "t", now=F.current_timestamp()).collect()}
    assert whole[1].masked.endswith("[MASK_CARD]") and whole[1].remaining == 0 and whole[1].attestation.sanitized and whole[1].attestation.all_regions_uniform
    some = {r.i: r for r in protect.protect_texts(df, "t", now=F.current_timestamp(), limit=20_000).collect()}
    assert some[1].masked is None and some[1].remaining is None and not some[1].attestation.sanitized and not some[1].attestation.all_regions_uniform
    assert some[2].masked == "[MASK_CARD]" and some[2].attestation.sanitized and not some[3].attestation.sanitized


def test_field_and_text_regions_of_visible_elements(spark):
    page = """<title>me@title.org is no text</title><body><input type=password name=p><input type=hidden><input type=email hidden>
    <div style="display: none"><input type=tel><p>mail a@b.co</p></div><p style="opacity:0">card 4111111111111111</p><textarea name=otp></textarea>
    <p>write to x@y.org now</p><div contenteditable data-sensitive>z</div><button disabled>no</button><a href=/>Go</a><script>var a = 'k@l.org'</script>"""
    df = spark.createDataFrame([(1, page)], "page int, html string")
    e = pages.elements(df, "page", "html")
    assert [(r.rule_id, r.tag, r.severity, r.source, r.confidence) for r in pages.field_regions(e, "page").orderBy("seq").collect()] == [("password", "input", 3, "dom-field", 1.0), ("otp", "textarea", 3, "dom-field", 1.0), ("opt_out", "div", 3, "dom-field", 1.0)]
    nodes = pages.text_nodes(df, "page", "html")
    assert [(r.rule_id, r.tag, r["index"], r.length) for r in pages.text_regions(nodes, "page").collect()] == [("email", "p", 9, 7)]
    assert [r.role for r in pages.action_map(e, "page").orderBy("seq").collect()] == ["input", "input", "textarea", "a"]
    many = spark.createDataFrame([(1, "<a>x</a>" * 300 + "<canvas></canvas>" * 90)], "page int, html string")
    found = pages.elements(many, "page", "html")
    assert pages.action_map(found, "page").count() == 300 and pages.action_map(found, "page", most=pages.ACTIONS).count() == 250
    assert pages.surfaces(found, "page").count() == 90 and pages.surfaces(found, "page", most=pages.SURFACES).count() == 80
