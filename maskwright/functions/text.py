"""Text, number and JSON helpers of planning and policy, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import blocks, cut, let

# Words that carry no target, and the verbs of each kind of action.
STOP_WORDS = ("the", "a", "an", "and", "then", "to", "into", "in", "on", "of", "for", "please", "my", "with", "at", "it", "that", "this", "new", "go")
CLICK_VERBS = ("click", "open", "press", "tap", "select", "choose", "hit", "activate", "submit", "start", "goto")
TYPE_VERBS = ("type", "enter", "fill", "input", "write", "search")
SCROLL_VERBS = ("scroll",)
OPERATIONS = ("click", "type", "press", "scroll", "select", "noop")

# The patterns of goals and intents.
SPLIT = r"(?i)\s*(?:,|;|\bthen\b|\band then\b|\band\b|->|→)\s*"
TYPED = r"^(?:type|enter|fill|input|write)\s+(?:in\s+)?[\"']?(.+?)[\"']?\s+(?:in|into|to)\s+(?:the\s+)?(.+)$"
SEARCH = r"^search\s+(?:for\s+)?[\"']?(.+?)[\"']?$"


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits without stop words."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~F.array_contains(stop, w))


def subgoals(goal: Column) -> Column:
    """The parts of a goal, in order; quotes are not looked at."""
    return F.filter(F.transform(F.split(F.coalesce(goal, F.lit("")), SPLIT, -1), lambda p: F.btrim(p)), lambda p: p != "")


def intent(subgoal: Column) -> Column:
    """struct<op, target, value>; all on the lower-cased text."""
    low = F.lower(F.btrim(subgoal))
    first = F.get(words(low), F.lit(0))
    made = lambda op, target, value: F.struct(F.lit(op).alias("op"), target.alias("target"), value.cast("string").alias("value"))
    none, empty = F.lit(None), F.lit("")
    return (
        F.when(low.rlike(TYPED), made("type", F.regexp_extract(low, TYPED, 2), F.regexp_extract(low, TYPED, 1)))
        .when(low.rlike(SEARCH), made("type", F.lit("search"), F.regexp_extract(low, SEARCH, 1)))
        .when(first.isin(*SCROLL_VERBS), made("scroll", empty, none))
        .when(first.isin(*TYPE_VERBS), made("type", low, none))
        .when(first.isin(*CLICK_VERBS), made("click", F.regexp_replace(low, r"^\w+\s+", ""), none))
        .otherwise(made("click", low, none))
    )


def url_path(url: Column) -> Column:
    """Origin and path of an address."""
    return F.regexp_replace(url, "[?#].*$", "")


def internal_page(url: Column) -> Column:
    return url.rlike(r"^(chrome|edge|about|chrome-extension):")


def first_of(*texts: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])


def payload(data_url: Column) -> Column:
    """What follows the first comma; the whole text without one."""
    return F.when(F.instr(data_url, ",") > 0, F.substring(data_url, F.instr(data_url, ",") + 1, F.length(data_url))).otherwise(data_url)


def media_type(data_url: Column) -> Column:
    return F.regexp_extract(data_url, r"^data:([^;,]*)", 1)


def preview(image_bytes: Column, digest: Column) -> Column:
    """What stands for an image in a shown record."""
    return F.format_string("<%d bytes webp, sha256 %s...>", image_bytes, F.substring(digest, 1, 16))


def timing(metrics: Column) -> Column:
    """The shown timing figures of a metrics struct."""
    return F.struct(
        metrics["dom_ms"].alias("dom"), metrics["visual_ms"].alias("visual"), metrics["group_ms"].alias("grouping"),
        (metrics["mask_ms"] + metrics["verify_ms"]).alias("mask_and_verify"), metrics["encode_ms"].alias("encode"),
        F.coalesce(metrics["roundtrip_ms"], metrics["total_ms"]).alias("end_to_end"),
    )


def normalised(raw: Column) -> Column:
    """A decision struct in its canonical form: unknown operations become noop,
    a reference wins over a point, and each operation gets its defaults."""
    a = raw["action"]
    op = F.lower(first_of(a["op"], F.lit("noop")))
    op = F.when(op.isin(*OPERATIONS), op).otherwise("noop")
    ref = F.nullif(a["ref"], F.lit(""))
    point = F.when(ref.isNull() & a["point"].isNotNull(), F.struct(F.coalesce(a["point"]["x"], F.lit(0)).alias("x"), F.coalesce(a["point"]["y"], F.lit(0)).alias("y")))
    return F.struct(
        F.struct(
            op.alias("op"), ref.alias("ref"), point.alias("point"),
            F.when(op == "type", F.coalesce(a["text"], F.lit(""))).alias("text"),
            F.when(op == "press", first_of(a["key"], F.lit("Enter"))).alias("key"),
            F.when(op == "scroll", F.coalesce(F.nullif(a["dy"], F.lit(0)), F.lit(400))).alias("dy"),
        ).alias("action"),
        F.substring(F.coalesce(raw["rationale"], F.lit("")), 1, 600).alias("rationale"),
        F.coalesce(F.nullif(raw["confidence"], F.lit(0.0)), F.lit(0.5)).alias("confidence"),
        F.coalesce(raw["done"], F.lit(False)).alias("done"),
    )


def json_object(text: Column) -> Column:
    """The JSON object of a model's answer, as text: code fences are stripped; if
    the rest is no object, the first balanced braces of any depth that parse.
    Braces inside strings count like others. Null if there is none."""
    # The parser passes over what follows a value, but not inside another one.
    parses = lambda s: F.try_parse_json(F.concat(F.lit("["), s, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"k":'), s, F.lit("}"))).isNotNull()

    def first_inside(bare: Column, pieces: Column) -> Column:
        braces = F.regexp_extract_all(bare, F.lit(r"[{}]"), F.lit(0))
        steps = let(braces, lambda bs: F.zip_with(F.slice(F.split(bare, r"[{}]", -1), F.lit(1), F.size(bs)), bs, lambda g, b: F.struct(F.length(g).alias("gap"), b.alias("b"))))

        def step(a: Column, x: Column) -> Column:
            at = a["at"] + x["gap"] + 1  # the brace's place, from 1
            opens = x["b"] == "{"
            depth = a["depth"] + F.when(opens, 1).otherwise(-1)
            start = F.when(opens & (a["depth"] == 0), at).otherwise(a["start"])
            ends = ~opens & (depth == 0) & (a["start"] > 0) & a["found"].isNull()
            found = F.when(ends, let(cut(pieces, a["start"] - 1, at), lambda whole: F.when(parses(whole), whole)))
            return F.struct(at.alias("at"), depth.alias("depth"), F.when(ends, 0).otherwise(start).alias("start"), F.coalesce(a["found"], found).alias("found"))

        begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("start"), F.lit(None).cast("string").alias("found"))
        return F.aggregate(steps, begin, step, lambda a: a["found"])

    bare = F.btrim(F.regexp_replace(F.btrim(text), r"(?m)^```(?:json)?|```$", ""))
    return let(bare, lambda b: F.when(b.startswith("{") & parses(b), b).otherwise(let(blocks(b), lambda pieces: first_inside(b, pieces))))


def without_slash(url: Column) -> Column:
    """An address without the slashes that end it."""
    return F.rtrim(url, F.lit("/"))


def layout_brief(envelope: Column) -> Column:
    """A compact rendering of an envelope (see ``sources.tables.ENVELOPE``) for a
    model: at most 40 tokens and 80 actions, JSON labels of at most 64 characters."""
    # The lines' formats.
    at = lambda b: F.concat_ws(",", b["x"].cast("string"), b["y"].cast("string"))
    none = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    label = lambda c: F.to_json(F.array(F.coalesce(c, F.lit(""))))
    json_ = lambda c: F.substring(label(c), F.lit(2), F.length(label(c)) - 2)
    token = lambda t: F.format_string("  %-18s sev%s %s %sx%s  (%s)", t["token"], none(t["severity"]), at(t["box"]), none(t["box"]["w"]), none(t["box"]["h"]), none(t["source"]))
    action = lambda a: F.concat(F.format_string("  %-10s <%s> %s @%s", a["ref"], none(a["role"]), F.substring(json_(a["label"]), 1, 64), at(a["box"])), F.when(a["sensitive"], " SENSITIVE").otherwise(""))
    done = lambda h: F.format_string("  step %s: %s -> ok=%s %s", none(h["step"]), F.to_json(h["action"]), F.when(h["ok"], "True").otherwise("False"), F.coalesce(h["code"], F.lit("")))
    e, listed = envelope, lambda c, kind: F.coalesce(c, F.array().cast(kind))
    kinds = {"semanticTokens": "array<struct<token:string,label:string,severity:int,source:string,box:struct<x:int,y:int,w:int,h:int>>>", "actionMap": "array<struct<ref:string,role:string,type:string,label:string,sensitive:boolean,box:struct<x:int,y:int,w:int,h:int>>>", "history": "array<struct<step:int,action:struct<op:string,ref:string,text:string>,ok:boolean,code:string>>"}
    tokens, actions, history = (listed(e[n], k) for n, k in kinds.items())
    head = F.array(
        F.concat(F.lit("GOAL: "), none(e["goal"])), F.format_string("STEP: %s of %s", none(e["step"]), none(e["maxSteps"])), F.concat(F.lit("PAGE: "), none(e["pageTitle"])),
        F.format_string("VIEWPORT: %sx%s css px, dpr %s", none(e["viewport"]["w"]), none(e["viewport"]["h"]), none(e["viewport"]["dpr"])), F.lit(""),
        F.format_string("REDACTED REGIONS (%d) — values destroyed on-device:", F.size(tokens)),
    )
    past = F.when(F.size(history) > 0, F.concat(F.array(F.lit(""), F.lit("HISTORY:")), F.transform(history, done))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, F.transform(F.slice(tokens, 1, 40), token), F.array(F.lit(""), F.format_string("ACTIONABLE ELEMENTS (%d):", F.size(actions))), F.transform(F.slice(actions, 1, 80), action), past), "\n")
