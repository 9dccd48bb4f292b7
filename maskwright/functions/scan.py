"""Scanning and masking of text, as column expressions.

Everything about a text is computed in its own row from built-in functions, so
a scan is a projection: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import folded, let, replaced, running
from .checksums import digits, luhn, verhoeff
from .rules import SEVERE, SHORT_TOKENS, SPACE, TEXT_RULES, TextRule, java

HIT = "struct<rule_id:string,token:string,severity:int,label:string,index:int,length:int,text:string>"

#: Checks by name; add to it to plug in another.
CHECKS = {
    "verhoeff": lambda m: verhoeff(digits(m)),
    "card": lambda m: F.when(F.length(digits(m)).between(13, 19), luhn(digits(m))).otherwise(False),
}


#: The rules whose hits are severe.
SEVERE_RULES = tuple(r for r in TEXT_RULES if r.severity >= SEVERE)


def matches_at(text: Column, pattern: str, kind: str, made: Callable[[Column, Column], Column]) -> Column:
    """Array of ``made(start, match)`` (of the SQL type ``kind``) for the leftmost matches of a Java pattern, from left to right."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = lambda ms: F.slice(F.split(text, pattern, -1), F.lit(1), F.size(ms))
    steps = lambda ms: F.zip_with(gaps(ms), ms, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("m")))
    starts = lambda xs: F.zip_with(running(F.transform(xs, lambda x: x["gap"] + x["m"])), xs, lambda at, x: at + x["gap"])
    # Where nothing matches, the text isn't cut at its matches either: that reads it as often.
    found = let(matches, lambda ms: F.when(F.size(ms) > 0, F.zip_with(let(steps(ms), starts), ms, made)).otherwise(F.array().cast(f"array<{kind}>")))
    return F.when(text.isNotNull(), found).otherwise(F.lit(None).cast(f"array<{kind}>"))


def _rule_hits(text: Column, rule: TextRule) -> Column:
    def hit(at: Column, m: Column) -> Column:
        return F.struct(F.lit(rule.id).alias("rule_id"), F.lit(rule.token).alias("token"), F.lit(rule.severity).alias("severity"), F.lit(rule.label).alias("label"), at.alias("index"), F.length(m).alias("length"), m.alias("text"))

    found = matches_at(text, java(rule.pattern), HIT, hit)
    if rule.check:
        found = F.filter(found, lambda h: CHECKS[rule.check](h["text"]))
    none = F.array().cast(f"array<{HIT}>")
    return F.when(text.rlike(rule.hint) if rule.hint else F.lit(True), found).otherwise(none)


def scan_text(text: Column, *, rules: tuple[TextRule, ...] = TEXT_RULES, limit: int | None = None) -> Column:
    """Array of hits in rule order, then position; offsets in code points. A
    match that fails its check still uses up its span. Hits of different rules
    may overlap. Empty for null and empty texts, and for those longer than a
    ``limit``, if one is given: such a text was not looked at."""
    none = F.array().cast(f"array<{HIT}>")
    scanned = F.concat(*[_rule_hits(text, r) for r in rules])
    fits = F.length(text) > 0 if limit is None else F.length(text).between(1, limit)
    return F.when(fits, scanned).otherwise(none)


def hits(df: DataFrame, text: str, *keys: str, **options: object) -> DataFrame:
    """A row for each hit: the keys and the hit's fields."""
    return df.select(*keys, F.inline(scan_text(F.col(text), **options)))


def rule_counts(text: Column, *, rules: tuple[TextRule, ...] = TEXT_RULES) -> Column:
    """Array of (rule_id, token, severity, n) of the rules that hit a text, in
    rule order; where no offsets are wanted, each pattern runs once."""

    def count(rule: TextRule) -> Column:
        matches = F.regexp_extract_all(text, F.lit(java(rule.pattern)), F.lit(0))
        found = F.filter(matches, CHECKS[rule.check]) if rule.check else matches
        tried = text.rlike(rule.hint) if rule.hint else F.lit(True)
        n = F.coalesce(F.when(tried, F.size(found)), F.lit(0))
        return F.struct(F.lit(rule.id).alias("rule_id"), F.lit(rule.token).alias("token"), F.lit(rule.severity).alias("severity"), n.cast("long").alias("n"))

    return F.filter(F.array(*[count(r) for r in rules]), lambda c: c["n"] > 0)


def has_severe(text: Column) -> Column:
    """Whether a text has a severe hit; null and empty texts have none."""
    return F.size(rule_counts(F.coalesce(text, F.lit("")), rules=SEVERE_RULES)) > 0


def _replaced(text: Column, ordered: Column) -> Column:
    """Tokens put in for hits, which come from right to left; for short texts."""
    return F.aggregate(ordered, text, lambda out, h: F.concat(F.substring(out, F.lit(1), h["index"]), h["token"], F.substring(out, h["index"] + h["length"] + 1, F.length(out))))


def scrub(text: Column) -> Column:
    """White space collapsed, trimmed, first 120 characters, hits replaced by
    their tokens from right to left. Overlapping hits splice by their original
    offsets, as the reference semantics have it; ``redact`` does not."""
    clean = F.substring(F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " ")), 1, 120)
    return let(clean, lambda t: _replaced(t, _right_to_left(scan_text(t))))


def _right_to_left(found: Column) -> Column:
    # a stable order: equal indexes keep their order of rules
    keyed = F.transform(found, lambda h, i: F.struct((-h["index"]).alias("k"), i.alias("i"), h.alias("h")))
    return F.transform(F.array_sort(keyed), lambda x: x["h"])


def _disjoint(found: Column) -> Column:
    """Leftmost, then longest, hits without overlaps."""
    keyed = F.array_sort(F.transform(found, lambda h: F.struct(h["index"].alias("k"), (-h["length"]).alias("l"), h.alias("h"))))
    flag = lambda n: F.array(F.lit(n))
    step = lambda end, x: F.when(x["k"] >= end, F.struct((x["k"] - x["l"]).alias("s"), flag(1).alias("o"))).otherwise(F.struct(end.alias("s"), flag(0).alias("o")))
    chosen = lambda xs: F.filter(F.zip_with(xs, folded(xs, F.lit(0), step, "int"), lambda x, keep: F.when(keep == 1, x)), lambda x: x.isNotNull())
    # Mostly no hit meets the next one, and then all are kept.
    apart = lambda xs: ~F.exists(F.transform(xs, lambda x, i: F.coalesce(F.get(xs, i + 1)["k"] < x["k"] - x["l"], F.lit(False))), lambda b: b)
    return F.transform(let(keyed, lambda xs: F.when(apart(xs), xs).otherwise(chosen(xs))), lambda x: x["h"])


def redact(text: Column, found: Column) -> Column:
    """The text with its leftmost-longest hits replaced by their tokens; time grows with the text and its hits."""
    return replaced(text, _disjoint(found), lambda h: h["index"], lambda h: h["index"] + h["length"], lambda h: h["token"])


def cleared(df: DataFrame, text: str, found: str) -> DataFrame:
    """``df`` with masked (the text with its hits redacted until a scan finds none),
    left (hits of the last scan: none) and more (how many hits later scans found);
    null where ``found``, the first scan's hits, is.

    A match that fails its check uses up its span, so what it hid may be a hit
    once its neighbour is masked. Mostly one pass leaves nothing. A pass puts
    tokens, which hold no hit, for at least six code points of the text, so a
    sixth of its length bounds the passes, each a step to redact and one to scan."""
    none = F.array().cast(f"array<{HIT}>")
    state = lambda t, left, more, due: F.struct(t.alias("text"), left.alias("left"), more.alias("more"), F.lit(due).alias("due"))
    scanned = lambda s: state(s["text"], scan_text(s["text"]), s["more"], False)
    masked = lambda s: state(redact(s["text"], s["left"]), s["left"], s["more"] + F.size(s["left"]), True)
    step = lambda s, _: F.when(s["due"], scanned(s)).when(F.size(s["left"]) > 0, masked(s)).otherwise(s)
    steps = F.sequence(F.lit(1), 2 * F.floor(F.length(text) / 6).cast("int") + 2)
    once = df.withColumn("masked", F.when(F.col(found).isNotNull(), redact(F.col(text), F.col(found))))
    once = once.withColumn("left", F.when(F.size(found) > 0, scan_text(F.col("masked"))).when(F.col(found).isNotNull(), none))
    last = once.withColumn("_last", F.when(F.size("left") > 0, F.aggregate(steps, state(F.col("masked"), F.col("left"), F.lit(0), False), step)))
    more = F.when(F.col(found).isNotNull(), F.coalesce("_last.more", F.lit(0)))
    return last.withColumns({"masked": F.coalesce("_last.text", "masked"), "left": F.coalesce("_last.left", "left"), "more": more}).drop("_last")


def token_counts(tokens: Column) -> Column:
    """'token×count' of the tokens, sorted and comma-joined, or a fixed sentence without any."""
    listed = lambda ts: F.transform(F.array_sort(F.array_distinct(ts)), lambda t: F.concat(t, F.lit("×"), F.size(F.filter(ts, lambda x: x == t)).cast("string")))
    return let(tokens, lambda ts: F.when(F.size(ts) > 0, F.array_join(listed(ts), ", ")).otherwise("no redacted regions on this frame"))


def short_token(token: Column) -> Column:
    """The short name of a token; other texts stay as they are."""
    names = F.create_map(*[F.lit(x) for pair in SHORT_TOKENS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, token), token)


def fitted_label(token: Column, width: Column, height: Column, *, advance: float = 0.6) -> Column:
    """struct<label, size> that fits a box: the whole token if it fits at the
    box's size, else the short one at the largest size of 7 or more that fits;
    null if none does. ``advance`` is a character's width as a share of the size."""
    size = F.greatest(F.lit(9), F.least(F.lit(18), F.floor(height * 0.6)))
    short = short_token(token)
    most = F.floor((width - 8) / (F.length(short) * advance))
    fits = F.length(token) * size * advance <= width - 8
    return F.when(fits, F.struct(token.alias("label"), size.cast("int").alias("size"))).when(F.least(size, most) >= 7, F.struct(short.alias("label"), F.least(size, most).cast("int").alias("size")))
