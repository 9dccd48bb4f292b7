"""Scalar functions: checksums, rules, scanning, fields, boxes, text."""

import dataclasses
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from maskwright.functions import fields, geometry, rules, scan, text
from maskwright.functions.checksums import luhn, verhoeff
from maskwright.functions.register import register


def values(spark, column, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_checksums(spark):
    assert values(spark, verhoeff, ["352741839170", "352741839171", "352741839107", "785623419086", "", None]) == [True, False, False, True, False, None]
    assert values(spark, luhn, ["4111111111111111", "4111111111111112", "5425233430109903", ""]) == [True, False, True, False]


def ids(spark, t, **options):
    df = spark.createDataFrame([(t,)], "t string")
    return [h["rule_id"] for h in df.select(scan.scan_text(F.col("t"), **options).alias("h")).first()["h"]]


def test_rules_fire(spark):
    joined = "352741839170 ABCDE1234F 4111 1111 1111 1111 HDFC0001234 22ABCDE1234F1Z5 K1234567 me@x.org +91 9876543210 me@okaxis " + "eyJ" + "a" * 9 + "." + "b" * 9 + "." + "c" * 9 + " sk" + "x" * 20 + " 12.345 N, 77.123 E 01/02/1990"
    found = set(ids(spark, joined))
    assert found == {"aadhaar", "pan", "card", "ifsc", "gstin", "passport", "email", "phone_in", "upi", "jwt", "apikey", "geo", "dob"}


def test_unsound_candidates_do_not_fire(spark):
    assert ids(spark, "reference 1234 5678 9012 is an order number") == []
    assert ids(spark, "4111111111111112") == []


def test_word_edges_are_ascii(spark):
    assert ids(spark, "ü9845512207") == ["phone_in"]


def test_long_texts_are_scanned_unless_limited(spark):
    t = "x " * 10_001 + "4111111111111111"
    assert ids(spark, t) == ["card"]
    assert ids(spark, t, limit=20_000) == []
    assert ids(spark, "") == [] and ids(spark, None) == []


def test_offsets_and_redaction(spark):
    t = "a@b.co and 4111111111111111, then a@b.co"
    row = spark.createDataFrame([(t,)], "t string").select(scan.scan_text(F.col("t")).alias("h"), scan.redact(F.col("t"), scan.scan_text(F.col("t"))).alias("r"), scan.scrub(F.col("t")).alias("s")).first()
    assert all(t[h["index"] : h["index"] + h["length"]] == h["text"] for h in row["h"])
    assert row["r"] == "[MASK_EMAIL] and [MASK_CARD], then [MASK_EMAIL]" == row["s"]
    assert ids(spark, row["r"]) == []


def test_scrub_collapses_and_cuts(spark):
    assert values(spark, scan.scrub, [" a\t  b ", None, "x" * 200]) == ["a b", "", "x" * 120]


def test_token_counts(spark):
    df = spark.createDataFrame([(["[B]", "[A]", "[B]"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(scan.token_counts(F.col("t"))).collect()] == ["[A]×1, [B]×2", "no redacted regions on this frame"]


def test_fields(spark):
    rows = [("password", None, False), ("text", "one-time-code", False), ("text", "cc-csc", False), ("text", "aadhaarNumber", False), ("text", "city", True), ("text", "city", False), ("email", None, False)]
    df = spark.createDataFrame(rows, "t string, n string, o boolean")
    got = df.select(fields.classify_field(F.col("t"), fields.hint(name=F.col("n"), class_name=F.lit("")), F.col("o"))["token"].alias("k")).collect()
    assert [r.k for r in got] == ["[MASK_PASSWORD]", "[MASK_OTP]", "[MASK_CVC]", "[MASK_AADHAAR]", "[MASK_PII]", None, "[MASK_EMAIL]"]


def test_boxes(spark):
    b = lambda x, y, w, h: geometry.box(*map(F.lit, (x, y, w, h)))
    row = spark.range(1).select(
        geometry.clip(b(-5, -5, 20, 20), b(-5, 0, 100, 100)).alias("c"), geometry.clip(b(0, 0, 1, 9), b(0, 0, 9, 9)).alias("n"),
        geometry.share_of_smaller(b(0, 0, 10, 10), b(5, 0, 10, 10)).alias("s"), geometry.scaled(b(1, 1, 3, 3), F.lit(1.5)).alias("z"),
        geometry.placed(F.lit(-0.5), F.lit(1.5), F.lit(2.0), F.lit(2.0), F.lit(0), F.lit(0), 1).alias("p"),
    ).first()
    assert tuple(row["c"]) == (0, 0, 20, 15) and row["n"] is None and row["s"] == 0.5
    assert tuple(row["z"]) == (2, 2, 5, 5) and tuple(row["p"]) == (-1, 1, 4, 4)


def test_goals(spark):
    assert values(spark, text.subgoals, ["click A and then click B, click C", "", None]) == [["click A", "click B", "click C"], [], []]
    got = values(spark, text.intent, ["type Bangalore in the search facility", "search for cats", "scroll down", "open Payments", "Payments"])
    assert [tuple(g) for g in got] == [("type", "search facility", "bangalore"), ("type", "search", "cats"), ("scroll", "", None), ("click", "payments", None), ("click", "payments", None)]


def test_json(spark):
    assert values(spark, text.json_object, ['```json\n{"a": {"b": 1}}\n```', 'well {no}: {"a": 1} and {"b": 2}', "none", None, "{}" + "x" * 50_000 + "{", "{" + "x" * 50_000 + "{}"]) == ['{"a": {"b": 1}}', '{"a": 1}', None, None, "{}", None]  # the last one's outer brace never closes


def test_json_of_any_depth(spark):
    deep = "{" + '"a":{' * 40 + '"b":1' + "}" * 41
    texts = ['Sure: {"a":{"b":{"c":{"d":1}}}} done', f"so {deep} and {{}}", "{x} then {\"y\":{\"z\":[{}]}} end {", "no } { \"a\":1 }", "}{", "", "a" * 50_000 + '{"k":2}', '```json\n{"q":{"r":{"s":{"t":5}}}}\n```']
    assert values(spark, text.json_object, texts) == ['{"a":{"b":{"c":{"d":1}}}}', deep, '{"y":{"z":[{}]}}', None, None, None, '{"k":2}', '{"q":{"r":{"s":{"t":5}}}}']


def test_word_edges_beside_words_are_one_lookaround(spark):
    assert rules.java(r"\b[2-9]\d{3}\b") == r"(?<!\w)[2-9]\d{3}(?!\w)" and rules.java(r"\b(?:sk|pk)[-_a]{2,}\b") == r"(?<!\w)(?:sk|pk)[-_a]{2,}" + rules._WORD_EDGE
    texts = ["ABCDE1234F", "xABCDE1234F", "ABCDE1234F_", "é ABCDE1234Fé", "-K1234567-", "K12345678", "+919876543210", "tok_ABCDEFGH12345678-", "12345678901 9876543210", "a@b.com.", "..a@b.com"]
    for r in rules.TEXT_RULES:
        want = [[m.group() for m in re.finditer(r.pattern, t, re.ASCII)] for t in texts]
        assert values(spark, lambda c, r=r: F.regexp_extract_all(c, F.lit(rules.java(r.pattern)), F.lit(0)), texts) == want, r.id


def test_counts_are_those_of_hits(spark):
    texts = ["a@b.co 4111111111111111 a@b.co", "", None, "x " * 12_000 + "ABCDE1234F", "4111111111111112"]
    got = values(spark, scan.rule_counts, texts)
    want = values(spark, scan.scan_text, texts)
    assert [{c["rule_id"]: c["n"] for c in g or []} for g in got] == [dict(Counter(h["rule_id"] for h in w)) for w in want]
    assert values(spark, scan.has_severe, texts) == [True, False, False, True, False]


def test_without_slash(spark):
    assert values(spark, text.without_slash, ["http://a.b/", "http://a.b//", "x", None]) == ["http://a.b", "http://a.b", "x", None]


def test_payload(spark):
    assert values(spark, text.payload, ["data:image/png;base64,AA", "AA"]) == ["AA", "AA"]
    assert values(spark, text.url_path, ["http://a/b?c#d", "http://a/b"]) == ["http://a/b", "http://a/b"]


def test_sql_names(spark):
    register(spark)
    assert spark.sql("SELECT luhn('4111111111111111') AS a, luhn('1') AS b").first() == (True, False)
    assert spark.table("text_rules").count() == 13


def test_sql_names_of_scans(spark):
    register(spark)
    got = spark.sql("SELECT verhoeff('352741839170') AS v, verhoeff('352741839171') AS w, rule_hits('a@b.co 4111 1111 1111 1111, or 4111 1111 1111 1112') AS h, rule_hits(NULL) AS n").first()
    assert got.v and not got.w and [(h.rule_id, h.token, h.severity, h.text) for h in got.h] == [("card", "[MASK_CARD]", 3, "4111 1111 1111 1111"), ("email", "[MASK_EMAIL]", 1, "a@b.co")] and got.n == []


def test_rules_are_tried_only_on_texts_that_may_match(spark):
    known = {r.id: r for r in rules.TEXT_RULES}
    said = "u17@mail.example, 12 34 5678 and the key to it"
    assert [i for i in ("upi", "card", "aadhaar") if re.search(known[i].hint, said)] == []
    rng = random.Random(5)
    parts = ["a.b@ybl", "@okaxis", "x@upi", "k@", "4111 1111-1111 1111", "2345 6789 0124", "12345678901234", "sk_", "ABCDEFGH12345678", "api", " ", "-", ".", "%", "u.v+w%@x.org", "@", "7"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(400)]
    plain = tuple(dataclasses.replace(r, hint=None) for r in rules.TEXT_RULES)
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scan.rule_counts(F.col("t")).alias("a"), scan.rule_counts(F.col("t"), rules=plain).alias("b"), F.size(scan.scan_text(F.col("t"), rules=(known["email"], known["upi"]))).alias("n")).collect()
    assert all(r.a == r.b for r in got) and {c.rule_id for r in got for c in r.a} >= {"upi", "card", "aadhaar", "email", "apikey"}
    mails = [re.compile(known[i].pattern, re.ASCII) for i in ("email", "upi")]
    assert all(r.n == sum(len(p.findall(r.t)) for p in mails) for r in got)
