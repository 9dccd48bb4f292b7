"""Elements, text nodes and action maps of HTML pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import classify_field, field_candidate, hint
from ..functions.scan import scan_text, scrub
from ..functions.text import first_of

# How much of a page a browser looks at (limits that callers may ask for; by default all of
# it counts), the shortest text, and which elements act or show images.
ELEMENTS, TEXTS, ACTIONS, SURFACES, SHORTEST = 4000, 6000, 250, 80, 6
INTERACTIVE_TAGS = ("a", "button", "input", "select", "textarea", "summary")
INTERACTIVE_ROLES = ("button", "link", "tab", "checkbox", "menuitem")
SURFACE_TAGS = ("canvas", "img", "video", "iframe", "embed", "object")
SILENT_PARENTS = ("script", "style", "noscript")
FIELD_TAGS = ("input", "textarea", "select")
_HEAD_TAGS = frozenset("base basefont link meta noscript script style template title".split())
_NONE, _HIDDEN, _CLEAR = re.compile(r"display\s*:\s*none", re.I), re.compile(r"visibility\s*:\s*hidden", re.I), re.compile(r"opacity\s*:\s*0(?:\.0*)?\s*(?:;|$)", re.I)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Walk(HTMLParser):
    """Elements and text nodes of one page in document order. Text nodes are
    those of the body: what a head holds is none. An element is visible unless
    it or one around it isn't displayed or is hidden, or it is itself clear."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[dict] = []
        self.texts: list[tuple[str, str, bool]] = []
        self.open: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in _HEAD_TAGS and self.open and self.open[-1]["tag"] == "head":
            self.open.pop()  # a head that nothing closes ends before what can't be in it
        attributes = {k: v or "" for k, v in attrs}
        style = attributes.get("style", "")
        gone = "hidden" in attributes or bool(_NONE.search(style) or _HIDDEN.search(style)) or (bool(self.open) and self.open[-1]["gone"])
        element = {"tag": tag, "attributes": attributes, "text": [], "depth": len(self.open), "gone": gone, "visible": not gone and not _CLEAR.search(style)}
        self.elements.append(element)
        if tag not in _VOID:
            self.open.append(element)

    def handle_endtag(self, tag: str) -> None:
        if any(e["tag"] == tag for e in self.open):
            while self.open.pop()["tag"] != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not any(e["tag"] in ("head", "title") for e in self.open):
            self.texts.append((self.open[-1]["tag"] if self.open else "", data, not self.open or self.open[-1]["visible"]))
        for e in self.open:
            if e["tag"] in INTERACTIVE_TAGS or e["attributes"].get("role") in INTERACTIVE_ROLES:
                e["text"].append(data)


def _walked(page: str | None) -> _Walk:
    walk = _Walk()
    walk.feed(page or "")
    walk.close()
    return walk


def elements(pages: DataFrame, key: str, html: str, *, most: int | None = None) -> DataFrame:
    """key, seq (from 1), tag, attributes, text (of interactive elements), depth, visible."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                rows = [(k, i + 1, e["tag"], list(e["attributes"].items()), "".join(e["text"]), e["depth"], e["visible"]) for k, h in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for i, e in enumerate(_walked(h).elements[:most])]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], part.schema.field(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.map_(pa.string(), pa.string())), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.int32()), pa.array(cols[6], pa.bool_())], names=[key, "seq", "tag", "attributes", "text", "depth", "visible"])

    return pages.select(key, html).mapInArrow(run, f"`{key}` {kind}, seq int, tag string, attributes map<string,string>, text string, depth int, visible boolean")


def text_nodes(pages: DataFrame, key: str, html: str, *, most: int | None = None) -> DataFrame:
    """key, seq, parent, text, visible of the body's text nodes of six characters or more, without scripts and styles."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                rows = [(k, i + 1, p, t, v) for k, h in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for i, (p, t, v) in enumerate([(p, t, v) for p, t, v in _walked(h).texts if len(t.strip()) >= SHORTEST and p not in SILENT_PARENTS][:most])]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], part.schema.field(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.bool_())], names=[key, "seq", "parent", "text", "visible"])

    return pages.select(key, html).mapInArrow(run, f"`{key}` {kind}, seq int, parent string, text string, visible boolean")


def interactive(tag: Column, attributes: Column) -> Column:
    return tag.isin(*INTERACTIVE_TAGS) | F.coalesce(attributes["role"].isin(*INTERACTIVE_ROLES), F.lit(False)) | attributes["onclick"].isNotNull() | F.coalesce(attributes["contenteditable"] == "true", F.lit(False))


def surfaces(found: DataFrame, key: str, *, most: int | None = None) -> DataFrame:
    """Image-bearing elements; inline SVG is none, as its tag is lower-case there."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy("seq"))
    out = found.where(F.col("tag").isin(*SURFACE_TAGS) & F.col("visible")).withColumn("n", rank)
    return (out if most is None else out.where(F.col("n") <= most)).select(key, F.col("n").alias("seq"), F.col("tag").alias("kind"))


def _field_rule(a: Column, opt_out: tuple[str, ...]) -> Column:
    h = hint(autocomplete=a["autocomplete"], name=a["name"], id=a["id"], aria_label=a["aria-label"], placeholder=a["placeholder"], data_testid=a["data-testid"], class_name=a["class"])
    return classify_field(a["type"], h, _opted(a, opt_out))


def _opted(a: Column, opt_out: tuple[str, ...]) -> Column:
    return F.coalesce(*[a[o] for o in opt_out]).isNotNull()


def field_regions(found: DataFrame, key: str, *, opt_out: tuple[str, ...] = ("data-sensitive",), box: str | None = None) -> DataFrame:
    """Sensitive fields of ``elements``: key, seq, source, rule_id, token,
    severity, label, tag, confidence, and box where ``found`` has one (a column
    of structs; what isn't on screen is left out by whoever makes it)."""
    a = F.col("attributes")
    editable = F.coalesce(a["contenteditable"], F.lit("false")).isin("", "true", "plaintext-only")
    rows = found.where(field_candidate(F.col("tag"), _opted(a, opt_out), editable) & F.col("visible")).withColumn("rule", _field_rule(a, opt_out)).where("rule IS NOT NULL")
    placed = [F.col(box).alias("box")] if box else []
    return rows.select(key, "seq", F.lit("dom-field").alias("source"), "rule.*", "tag", F.lit(1.0).alias("confidence"), *placed)


def text_regions(nodes: DataFrame, key: str) -> DataFrame:
    """Hits in visible text nodes: key, seq, source, rule_id, token, severity,
    label, tag, confidence, and the hit's index and length in its node, from
    which a layout engine gives the boxes."""
    hits = nodes.where("visible").select(key, "seq", F.col("parent").alias("tag"), F.inline(scan_text(F.col("text"))))
    return hits.select(key, "seq", F.lit("dom-text").alias("source"), "rule_id", "token", "severity", "label", "tag", F.lit(0.95).alias("confidence"), "index", "length")


def action_map(found: DataFrame, key: str, *, opt_out: tuple[str, ...] = ("data-sensitive",), most: int | None = None) -> DataFrame:
    """key, ref, role, type, label (scrubbed, or the token of a severity-3 field),
    sensitive of visible interactive elements; a browser stops at ``ACTIONS`` of them."""
    a = F.col("attributes")
    rows = found.where(interactive(F.col("tag"), a) & a["disabled"].isNull() & F.col("visible"))
    rule = _field_rule(a, opt_out)
    own = F.when(F.col("tag").isin("input", "select"), first_of(a["name"], a["id"])).otherwise(F.nullif("text", F.lit("")))
    raw = F.coalesce(first_of(a["aria-label"], a["placeholder"]), own, first_of(a["value"], a["title"]), F.lit(""))
    n = F.row_number().over(Window.partitionBy(key).orderBy("seq"))
    rows = rows.withColumns({"n": n, "rule": rule, "raw": raw})
    rows = rows if most is None else rows.where(F.col("n") <= most)
    label = F.when(F.col("rule.severity") >= 3, F.col("rule.token")).otherwise(scrub(F.col("raw")))
    return rows.select(key, F.col("n").alias("seq"), F.concat(F.lit("f0:"), F.col("n").cast("string")).alias("ref"), F.coalesce(a["role"], F.col("tag")).alias("role"), a["type"].alias("type"), label.alias("label"), F.col("rule").isNotNull().alias("sensitive"))
