"""Personal data by candidate gradient boosting, in DataFrame functions only.

High-recall generators propose overlapping spans as regular-expression
matches. Each candidate is described by a few small discrete features of its
format and context. Boosted trees are fitted on counts of feature vectors (a
table of bounded size), become one column expression, and score the
candidates; a threshold per kind, set out of fold, selects. Spans of the base
rules, which have checks of their own, always stay; the trees add spans of
other forms.

The trees learn from texts made up for it, in which what is personal is known:
addresses, numbers and cards in many forms, and look-alikes such as times and
places after an @, version, part and order numbers and byte strings.

Everything about a document is computed in its own row: no shuffle carries
text, and no group can be hot.
"""

from __future__ import annotations

import math
import random
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import blocks, cut, folded, let, replaced
from ..functions.checksums import digits, luhn
from ..functions.scan import matches_at

KINDS = ("email", "ip", "card", "phone")

# Base rules. Each equals its plain form ([local]+@host(.host)+, four dotted
# numbers, digits with single separators, + and digits): quantifiers are
# possessive where nothing can be given back, a local part or number is not
# tried again inside itself, and a card needs its 14 digits to match at all,
# which its length check asks anyway. So long texts take linear time and no
# stack.
_LOCAL = r"A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a rule of the kind to be tried.
HINT = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
# Further generators, looser than the base rules.
MORE = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}+ ?(?:\(at\)|\[at\]|@) ?[A-Za-z0-9-]{{1,63}}+(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{{1,63}}+){{1,8}}+",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ ./_-]{1,2}[0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
MORE_HINT = {"email": r"\((?i:at)\)|\[at\]|@ | @", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", "card": r"[0-9]{4}[ ./_-]{1,2}[0-9]{4}", "phone": r"[0-9]{3}\)? ?[ .-]?[0-9]{3}[ .-][0-9]{4}"}
#: Words shortly before a candidate that speak for it, and against it.
FOR = r"(?i)(?:e-?mail|\bmail|contact|write|reach|call|phone|tel\b|mobile|fax|card|visa|credit|pay|\bip\b|host|server|addr)[^\n]{0,24}$"
AGAINST = r"(?i)(?:order|invoice|\bpart|version|ticket|serial|model|isbn|build|batch|release|tracking|article|hash|bytes|fingerprint|meet|see you|lunch|\bat$)[^\n]{0,24}$"
#: Features and the number of values of each; their product bounds the fitted table.
FEATURES = {"kind": 4, "form": 4, "tail": 3, "left": 3, "right": 3, "cue": 3}
#: Made-up texts of each kind and label, and parts of them for thresholds.
MADE, FOLDS = 400, 5


SPAN = "struct<start:int,k:int,end:int,m:string>"


def _spans(text: Column, rule: str, kind: int) -> Column:
    """array<struct<start, k, end, m>> of a rule's leftmost matches, in code points, end exclusive."""
    return matches_at(text, rule, SPAN, lambda at, m: F.struct(at.alias("start"), F.lit(kind).alias("k"), (at + F.length(m)).alias("end"), m.alias("m")))


def _tried(text: Column, hint: str, rule: str, kind: int) -> Column:
    return F.when(text.rlike(hint), _spans(text, rule, kind)).otherwise(F.array().cast(f"array<{SPAN}>"))


def _sound(kind: str, m: Column) -> Column:
    """Whether a match passes its kind's check."""
    d = digits(m)
    if kind == "ip":
        small = F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.ltrim(p, F.lit("0")).try_cast("int")), F.lit(0)) <= 255))
        return small
    if kind == "card":
        return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(d).between(10, 15)
    return F.lit(True)


def _sound_more(k: Column, m: Column) -> Column:
    """The check of the looser forms: their patterns fix all but a card's last digit."""
    return F.when(k == KINDS.index("card"), luhn(digits(m))).otherwise(True)


def _described(parts: Column, size: Column, s: Column) -> Column:
    """The span of a text (given as blocks, and its length) with its features as small integers. form and tail are of its
    kind: how an address is written and ends, of what an IP address's groups
    are, and what stands between groups of digits."""
    m, kind = s["m"], s["k"]
    before = cut(parts, F.greatest(s["start"] - 40, F.lit(0)), s["start"])
    left, right = F.right(before, F.lit(1)), cut(parts, s["end"], F.least(s["end"] + 1, size))
    side = lambda c: F.when(c.rlike(r"^[\p{L}\p{N}]"), 2).when(c.rlike(r"^[^\s.,;:!?()]"), 1).otherwise(0)
    word_at, word_dot = m.rlike(r"[(\[]at[)\]]"), m.rlike(r"[(\[]dot[)\]]")
    seps = F.size(F.array_distinct(F.filter(F.split(m, "[A-Za-z0-9]+"), lambda c: c != "")))
    form = F.when(kind == 0, F.when(word_at & word_dot, 3).when(word_at, 2).when(m.rlike(r"\S@\S"), 1).otherwise(0))
    form = form.when(kind == 1, F.when(m.rlike("[0-9A-Fa-f]{3}"), 2).when(m.rlike("[A-Fa-f]"), 1).otherwise(0)).otherwise(F.least(seps, F.lit(3)))
    tail = F.when(kind == 0, F.when(m.rlike(r"\S\.[a-z]{2,6}$|[)\]] ?[a-z]{2,6}$"), 2).when(m.rlike("[A-Z][^.]*$"), 0).otherwise(1))
    tail = tail.when(kind == 1, F.when(m.rlike(r"(?:^|:)(?:[0-9A-Fa-f]{2}:){7}[0-9A-Fa-f]{2}$"), 0).otherwise(1)).otherwise(F.when(m.rlike(r"^\("), 2).when(m.rlike("[./_]"), 0).otherwise(1))
    cue = F.when(before.rlike(AGAINST), 0).when(before.rlike(FOR), 2).otherwise(1)
    return F.struct(
        s["start"].alias("start"), kind.alias("k"), s["end"].alias("end"), kind.alias("kind"), form.alias("form"), tail.alias("tail"),
        side(left).alias("left"), side(right).alias("right"), cue.alias("cue"),
    )


def candidates(docs: DataFrame, text: str, base: str, other: str) -> DataFrame:
    """``docs`` with the columns named ``base`` (validated base spans) and
    ``other`` (described candidates of other forms, apart from base)."""
    t, tag = F.coalesce(F.col(f"`{text}`"), F.lit("")), uuid.uuid4().hex
    names = [f"{k}_{tag}" for k in KINDS]
    forms = docs.withColumns({n: _tried(t, HINT[k], BASE[k], i) for i, (k, n) in enumerate(zip(KINDS, names, strict=True))} | {f"more_{n}": _tried(t, MORE_HINT[k], MORE[k], i) for i, (k, n) in enumerate(zip(KINDS, names, strict=True))})
    with_base = forms.withColumn(base, F.array_sort(F.concat(*[_kept(n, k) for k, n in zip(KINDS, names, strict=True)])))
    loose = F.array_sort(F.filter(F.concat(*[F.col(f"more_{n}") for n in names]), lambda s: _sound_more(s["k"], s["m"])))
    described = lambda found, parts: let(F.length(t), lambda size: F.transform(found, lambda s: _described(parts, size, s)))
    found = let(_apart(loose, F.col(base)), lambda x: F.when(F.size(x) > 0, let(blocks(t), lambda parts: described(x, parts))).otherwise(described(x, F.array().cast("array<string>"))))
    return with_base.withColumn(other, found).drop(*names, *[f"more_{n}" for n in names])


def _apart(spans: Column, base: Column) -> Column:
    """Spans, by start, that meet no base span (by start too). Both are laid out
    as one row of bounds; a base span before one may reach into it, the next one
    after it may begin in it. Where there are no base spans all stay."""
    every = F.array_sort(F.concat(F.transform(base, lambda b: _bound(b, 0)), F.transform(spans, lambda s, i: _bound(s, 1))))
    reach = lambda xs: folded(xs, F.lit(0), lambda top, x: F.struct(F.when(x["own"] == 0, F.greatest(top, x["end"])).otherwise(top).alias("s"), F.array(top).alias("o")), "int")
    far = F.lit(2_147_483_647)
    ahead = lambda xs: F.reverse(folded(F.reverse(xs), far, lambda low, x: F.struct(F.when(x["own"] == 0, x["start"]).otherwise(low).alias("s"), F.array(low).alias("o")), "int"))
    clear = lambda x, before, after: F.when((x["own"] == 1) & (before <= x["start"]) & (after >= x["end"]), x["span"])
    both = lambda xs: F.zip_with(F.zip_with(xs, reach(xs), lambda x, r: F.struct(x.alias("x"), r.alias("r"))), ahead(xs), lambda y, n: clear(y["x"], y["r"], n))
    return F.when(F.size(base) == 0, spans).otherwise(let(every, lambda xs: F.filter(both(xs), lambda s: s.isNotNull())))


def _bound(s: Column, own: int) -> Column:
    return F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), s.alias("span"))


def _kept(column: str, kind: str) -> Column:
    return F.filter(column, lambda s: _sound(kind, s["m"]))


def made_up(count: int = MADE, seed: int = 17) -> list[tuple[int, int, str]]:
    """kind, label and text: ``count`` texts of each kind and label, each with a
    candidate of a looser form that is personal (1) or only looks so (0)."""
    rng = random.Random(seed)
    word = lambda lo=2, hi=9: "".join(rng.choice("etaoinshrdlucmfwypvbgk") for _ in range(rng.randint(lo, hi)))
    digits_ = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    top = lambda: rng.choice(("com", "org", "net", "de", "co.uk", "io", "example"))
    at = lambda: rng.choice(("(at)", "[at]", " (at) ", " [at] "))
    dot = lambda: rng.choice((".", "(dot)", "[dot]", " (dot) ", " [dot] "))

    def email(y: int) -> str:
        if y:
            return word() + rng.choice(("", "." + word(), str(rng.randint(1, 99)))) + at() + word() + dot() + top()
        place, more = word(), rng.choice((word().capitalize(), word().capitalize(), word(), top()))
        return f"{word()} @ {place}{rng.choice(('. ', '. ', '.', ' . '))}{more}"

    def ip(y: int) -> str:
        return ":".join((f"{rng.randrange(1 << 16):x}" if rng.random() < 0.9 else "0") if y else rng.choice((f"{rng.randrange(256):02x}", f"{rng.randrange(256):02X}", f"{rng.randrange(60):02d}")) for _ in range(8))

    def card(y: int) -> str:
        while not _plain_luhn(d := rng.choice("3456" if y else "0123456789") + digits_(15)):
            pass
        sep = rng.choice((" ", "-", "  ", " - "[:2])) if y else rng.choice(("/", ".", "_", "-", " "))
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def phone(y: int) -> str:
        a, b, c = rng.choice("23456789") + digits_(2), digits_(3), digits_(4)
        return rng.choice((f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"{a}.{b}.{c}") if y else (f"{a}.{b}.{c}", f"{a}-{b}-{c}", f"{a} {b} {c}"))

    said = {
        (0, 1): ("email", "contact", "write to", "reach us:", "mail", ""), (0, 0): ("meet", "see you", "lunch", "sold", "", ""),
        (1, 1): ("server", "host", "ip", "address", ""), (1, 0): ("hash", "bytes", "fingerprint", "", ""),
        (2, 1): ("card", "visa", "pay with", "credit", ""), (2, 0): ("order", "tracking", "serial", "invoice", "batch"),
        (3, 1): ("call", "phone", "tel", "mobile", "fax:", ""), (3, 0): ("part", "version", "build", "model", "article", "isbn"),
    }
    made = []
    for kind, form in enumerate((email, ip, card, phone)):
        for y in (0, 1):
            for _ in range(count):
                before, after = " ".join(word() for _ in range(rng.randint(0, 5))), " ".join(word() for _ in range(rng.randint(0, 5)))
                cue = rng.choice(said[kind, y])
                close = rng.choice((" ", " ", ", ", ". ", "; ")) if rng.random() < 0.95 else rng.choice(("x", "7", "#"))
                made.append((kind, y, f"{before} {cue} {form(y)}{close}{after}".strip()))
    return made


def _plain_luhn(d: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


# ---- boosting, on a table of feature-vector counts ----

Leaf = float
Tree = tuple | Leaf  # (feature, cut, tree if feature <= cut, tree else) or a value


def fit(counts: list[tuple[dict[str, int], float, float]], *, rounds: int = 20, depth: int = 2, rate: float = 0.4, prior: float = 1.0) -> list[Tree]:
    """Boosted trees of the logistic loss. ``counts`` has feature vectors with
    the number of their sound and unsound candidates; leaves take a second-order
    step with ``prior`` pseudo-counts."""
    margins = [0.0] * len(counts)
    trees: list[Tree] = []
    for _ in range(rounds):
        grads = []
        for (_, pos, neg), m in zip(counts, margins, strict=True):
            p = 1 / (1 + math.exp(-m))
            grads.append((pos * (1 - p) - neg * p, (pos + neg) * p * (1 - p)))
        tree = _grow(counts, grads, list(range(len(counts))), depth, rate, prior)
        trees.append(tree)
        margins = [m + value(tree, x) for m, (x, _, _) in zip(margins, counts, strict=True)]
    return trees


def _grow(counts: list, grads: list, rows: list[int], depth: int, rate: float, prior: float) -> Tree:
    total = lambda rs: (sum(grads[r][0] for r in rs), sum(grads[r][1] for r in rs))
    g, h = total(rows)
    best = None
    if depth:
        for f, n in FEATURES.items():
            for cut in range(n - 1):
                low = [r for r in rows if counts[r][0][f] <= cut]
                if low and len(low) < len(rows):
                    gl, hl = total(low)
                    gain = gl * gl / (hl + prior) + (g - gl) ** 2 / (h - hl + prior) - g * g / (h + prior)
                    if gain > 1e-9 and (best is None or gain > best[0]):
                        best = (gain, f, cut, low)
    if best is None:
        return rate * g / (h + prior)
    _, f, cut, low = best
    inside = set(low)
    return (f, cut, _grow(counts, grads, low, depth - 1, rate, prior), _grow(counts, grads, [r for r in rows if r not in inside], depth - 1, rate, prior))


def value(tree: Tree, x: dict[str, int]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def _scored(trees: list[Tree], s: Column) -> Column:
    def part(tree: Tree) -> Column:
        return F.when(s[tree[0]] <= tree[1], part(tree[2])).otherwise(part(tree[3])) if isinstance(tree, tuple) else F.lit(float(tree))

    return reduce(lambda a, b: a + b, [part(t) for t in trees], F.lit(0.0))


def thresholds(counts: list[tuple[int, dict[str, int], float, float]], precision: float) -> dict[int, float]:
    """For each kind, the least margin at and above which candidates are personal
    in at least ``precision`` of the cases (infinite if none is). ``counts``
    begin with a fold; each fold's margins are of trees fitted on the others."""
    margins: list[tuple[int, float, float, float]] = []
    for fold in sorted({c[0] for c in counts}):
        trees = fit([c[1:] for c in counts if c[0] != fold])
        margins += [(x["kind"], sum(value(t, x) for t in trees), pos, neg) for f, x, pos, neg in counts if f == fold]
    out = {}
    for kind in range(len(KINDS)):
        out[kind], good, bad = math.inf, 0.0, 0.0
        ranked = sorted((m[1:] for m in margins if m[0] == kind), reverse=True)
        for i, (m, pos, neg) in enumerate(ranked):
            good, bad = good + pos, bad + neg
            if (i + 1 == len(ranked) or ranked[i + 1][0] < m) and good and good / (good + bad) >= precision and m > 0:
                out[kind] = m
    return out


def trained(spark: SparkSession, *, precision: float = 0.95, seed: int = 17) -> tuple[list[Tree], dict[int, float]]:
    """Trees and thresholds, from ``made_up`` texts."""
    texts = [(i % FOLDS, k, y, t) for i, (k, y, t) in enumerate(made_up(seed=seed))]
    names = list(FEATURES)
    made = candidates(spark.createDataFrame(texts, "fold int, k int, y int, text string"), "text", "base", "other")
    rows = made.select("fold", "y", F.col("k").alias("own"), F.inline("other")).where("own = kind").groupBy("fold", "y", *names).count().collect()
    merged: dict[tuple, list[float]] = {}
    for r in rows:
        merged.setdefault((r["fold"], *[r[n] for n in names]), [0.0, 0.0])[1 - r["y"]] += r["count"]
    counts = [(x[0], dict(zip(names, x[1:], strict=True)), pos, neg) for x, (pos, neg) in sorted(merged.items())]
    return fit([c[1:] for c in counts]), thresholds(counts, precision)


def private_spans(docs: DataFrame, *, text: str = "text", precision: float = 0.95) -> DataFrame:
    """``docs`` with added columns base and spans, arrays of (start, k, end) in
    code points, end exclusive, by start, kind and end; k indexes ``KINDS``.
    spans has all of base and what the boosted trees add.

    A null or empty text has no spans; texts of any length are searched whole.
    Overlapping base spans of different kinds all stay; added spans overlap no
    base span nor each other. Columns of ``docs`` named base or spans are
    replaced, all others keep their values. Repeated rows are treated alike; an
    empty table gives an empty result.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("base", "spans")])
    other = f"other_{uuid.uuid4().hex}"
    found = candidates(docs, text, "base", other)
    trees, bars = trained(docs.sparkSession, precision=precision)
    slim = lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end"))
    base = F.transform("base", slim)
    passes = lambda s: reduce(lambda rest, k: F.when(s["k"] == k, F.lit(False) if math.isinf(bars[k]) else _scored(trees, s) >= bars[k] - 1e-9).otherwise(rest), bars, F.lit(False))
    ranked = F.array_sort(F.transform(F.filter(other, passes), lambda s: F.struct((-_scored(trees, s)).alias("m"), s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end"))))
    none = F.array().cast("array<struct<start:int,k:int,end:int>>")
    clear = lambda kept, s: ~F.exists(kept, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    greedy = lambda group: F.aggregate(group, none, lambda kept, s: F.when(clear(kept, s), F.concat(kept, F.array(slim(s)))).otherwise(kept))
    added = F.flatten(F.transform(_groups(ranked), greedy))
    return found.withColumn("base", base).withColumn("spans", F.array_sort(F.concat(F.col("base"), added))).drop(other)


def _groups(ranked: Column) -> Column:
    """Spans in groups that don't meet each other, each in its given order. A
    group is a chain of spans, by start, of which each begins before all earlier ones end."""
    placed = F.array_sort(F.transform(ranked, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), i.alias("i"), s.alias("s"))))
    opens = lambda end, x: F.struct(F.greatest(end, x["end"]).alias("s"), F.array((x["start"] >= end).cast("int")).alias("o"))
    begins = lambda xs: F.filter(F.transform(folded(xs, F.lit(0), opens, "int"), lambda b, i: F.when(b == 1, i)), lambda i: i.isNotNull())
    group = lambda xs, a, b: F.transform(F.array_sort(F.transform(F.slice(xs, a + 1, b - a), lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s")))), lambda x: x["s"])
    cut_up = lambda xs: let(begins(xs), lambda at: F.transform(at, lambda a, i: group(xs, a, F.coalesce(F.get(at, i + 1), F.size(xs)))))
    return let(placed, cut_up)


def listed(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: str) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, of the first one's kind."""
    opens = lambda end, x: F.struct(F.greatest(end, x["end"]).alias("s"), F.array((x["start"] >= end).cast("int"), F.greatest(end, x["end"])).alias("o"))
    # Of each span whether it begins a run of overlapping ones, and where the run ends so far.
    marks = lambda xs: let(folded(xs, F.lit(0), opens, "int"), lambda o: F.transform(xs, lambda x, i: F.struct(x["start"].alias("start"), x["k"].alias("k"), F.get(o, 2 * i).alias("first"), F.get(o, 2 * i + 1).alias("end"), (F.coalesce(F.get(o, 2 * i + 2), F.lit(1)) == 1).alias("last"))))
    pick = lambda ms: let(F.filter(ms, lambda m: m["last"]), lambda lasts: F.transform(F.filter(ms, lambda m: m["first"] == 1), lambda m, i: F.struct(m["start"].alias("start"), m["k"].alias("k"), F.get(lasts, i)["end"].alias("end"))))
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    return replaced(text, let(let(F.col(spans), marks), pick), lambda s: s["start"], lambda s: s["end"], lambda s: F.get(kinds, s["k"]))
