"""Main text of HTML pages by a recurrent block labeller.

A page is cut into leaf blocks of text with their tag paths (tags, classes and
ids). Each block becomes a vector: hashed tag-path tokens, hashed words, and
some numbers on length and links. A bidirectional LSTM in numpy reads the
blocks of the whole page and labels every one as main text or not.

The labeller is trained here: on pages made up of many layouts with known
labels, and on a sample of the table's pages whose structure tells where the
text is: the element that holds most sentences. Labelling sees every block of
every page, each page in its own row; cutting takes time in proportion to the
page, however deep its elements lie.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

PATH, WORDS, NUMBERS, HIDDEN = 192, 32, 5, 16
WIDTH = PATH + WORDS + NUMBERS
#: Blocks whose vectors are held at once.
STEPS = 20_000

# Elements without content, elements whose content is not text,
# elements that begin a new block, and those that hold others.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template title textarea select iframe svg".split())
BLOCK = frozenset("address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
HOLDS = frozenset("article body center dd div fieldset form html main section table tbody td tr".split())
#: Opening one of these ends an open one of the same group.
ENDS = {"p": "p", "li": "li", "td": "td th", "th": "td th", "tr": "tr", "dt": "dt dd", "dd": "dt dd", "option": "option"}

_SHORT_COMMENT, _COMMENT_END = re.compile(r"<!---?>"), re.compile(r"--!?>")
# A slash that ends a value without quotes is the value's.
_SELF_CLOSED = re.compile(r"""(?:^|[\s"'])/\Z""")
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_STOP = re.compile(r"[\"'>]")
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PART = re.compile(r"[A-Za-z]+")
_HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none", re.I)


class Block:
    """A leaf block: its text, characters in links, vector of its tag path, and
    the number of the element that it lies in."""

    __slots__ = ("element", "links", "path", "text")

    def __init__(self, path: np.ndarray, text: str, links: int, element: int = 0) -> None:
        self.path, self.text, self.links, self.element = path, text, links, element


class _Page:
    """Finds the tags of a page one after another."""

    def __init__(self, page: str) -> None:
        self.page, self.last = page, {q: page.rfind(q) for q in "\"'"}
        self.open_ended: set[str] = set()

    def tag_end(self, at: int) -> int:
        """Place of the > that ends a tag, -1 without one. A quote that nothing closes is an ordinary character."""
        while True:
            m = _STOP.search(self.page, at)
            if not m:
                return -1
            if m[0] == ">":
                return m.start()
            at = (self.page.index(m[0], m.end()) if self.last[m[0]] > m.start() else m.start()) + 1

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """From ``at`` on: where the next tag or comment begins and ends, its
        name (empty if it isn't an element's), whether it closes, its attributes."""
        page = self.page
        while (begin := page.find("<", at)) >= 0:
            if page.startswith("<!--", begin):
                short = _SHORT_COMMENT.match(page, begin)
                if short:  # whole comments, though nothing else ends them
                    return begin, short.end(), "", False, ""
                end = _COMMENT_END.search(page, begin + 4)
                return begin, end.end() if end else len(page), "", False, ""
            closes = page.startswith("</", begin)
            m = _NAME.match(page, begin + 1 + closes)
            if m:
                end = self.tag_end(m.end())
                return begin, end + 1 if end >= 0 else len(page), m[0].lower() if end >= 0 else "", closes, page[m.end() : end] if end >= 0 else ""
            if closes or page[begin + 1 : begin + 2] in ("!", "?"):
                end = page.find(">", begin)
                return begin, end + 1 if end >= 0 else len(page), "", False, ""
            at = begin + 1
        return None

    def after(self, tag: str, at: int) -> int:
        """Where a raw element that begins before ``at`` ends. One that is never
        closed has no content, but for scripts and styles, which then last to
        the end, and titles, which last to the next tag."""
        if tag not in self.open_ended:
            depth = 1
            while depth:
                m = re.compile(rf"<(/?){tag}(?=[\s/>])", re.I).search(self.page, at)
                end = self.tag_end(m.end()) if m else -1
                if end < 0:
                    break
                if m[1]:
                    depth -= 1
                elif tag == "svg" and self.page[end - 1] != "/":
                    depth += 1
                at_end, at = end + 1, end + 1
            else:
                return at_end
            self.open_ended.add(tag)
        if tag in ("script", "style"):
            return len(self.page)
        if tag in ("title", "textarea"):
            return max(at, self.page.find("<", at)) if self.page.find("<", at) >= 0 else len(self.page)
        return at


def parsed(page: str | None) -> tuple[list[Block], list[tuple[str, int]]]:
    """Leaf blocks in page order (texts with character references decoded, white
    space runs turned to one space, trimmed; empty ones left out), and the
    elements, each with its tag and the number of the one around it. Element 0
    is the page itself."""
    page = page or ""
    find = _Page(page)
    out: list[Block] = []
    elements: list[tuple[str, int]] = [("", -1)]
    stack: list[tuple[str, int, tuple[str, ...], np.ndarray]] = [("", 0, (), np.zeros(PATH, np.float32))]
    open_tags: Counter[str] = Counter()
    open_tokens: Counter[str] = Counter()
    paths: dict[tuple[int, tuple[str, ...]], np.ndarray] = {}
    held: list[str] = []
    linked = at = 0

    def close() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append(Block(stack[-1][3], text, linked, stack[-1][1]))
            held.clear()
        linked = 0

    def pop() -> str:
        tag, _, tokens, _ = stack.pop()
        open_tags[tag] -= 1
        open_tokens.subtract(tokens)
        return tag

    while True:
        found = find.next(at)
        piece = page[at : found[0] if found else len(page)]
        if piece:
            held.append(piece)
            if open_tags["a"]:
                linked += len(piece)
        if not found:
            break
        _, at, tag, closes, attributes = found
        if not tag:
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in BLOCK:
            close()
        if closes:
            if open_tags[tag]:
                while pop() != tag:
                    pass
            continue
        if tag in RAW:
            if not (tag == "svg" and _SELF_CLOSED.search(attributes)):
                at = find.after(tag, at)
            continue
        if tag in VOID or _SELF_CLOSED.search(attributes):
            continue
        for t in ENDS.get(tag, "").split():
            if any(x[0] == t for x in stack[-4:]):
                while pop() != t:
                    pass
        tokens = _tokens(tag, attributes)
        new = tuple(t for t in tokens if not open_tokens[t])
        path = stack[-1][3]
        if new:
            key = (id(path), new)  # the arrays live in ``paths`` or on the stack
            if key not in paths:
                paths[key] = path + sum(_token(t) for t in new)
            path = paths[key]
        elements.append((tag, stack[-1][1]))
        stack.append((tag, len(elements) - 1, tokens, path))
        open_tags[tag] += 1
        open_tokens.update(tokens)
    close()
    return out, elements


def blocks(page: str | None) -> list[Block]:
    return parsed(page)[0]


def _tokens(tag: str, attributes: str) -> tuple[str, ...]:
    out = {"<" + tag: None}
    if attributes:
        for m in _NAMED.finditer(attributes):
            out |= {"." + p.lower(): None for p in _PART.findall(m[1] or m[2] or m[3] or "")}
        if _HIDDEN.search(attributes):
            out[".hidden"] = None
    return tuple(out)


def _slot(feature: str, size: int) -> tuple[int, float]:
    h = xxhash.xxh64_intdigest(feature)
    return h % size, 1.0 if h >> 63 else -1.0


_slots: dict[str, tuple[int, float]] = {}


def _kept(feature: str, size: int) -> tuple[int, float]:
    at = _slots.get(feature)
    if at is None:
        if len(_slots) > 200_000:
            _slots.clear()
        at = _slot(feature, size)
        if len(feature) <= 64:
            _slots[feature] = at
    return at


def _token(token: str) -> np.ndarray:
    out = np.zeros(PATH, np.float32)
    j, sign = _kept(token, PATH)
    out[j] = sign
    return out


def vectors(found: list[Block]) -> np.ndarray:
    x = np.zeros((len(found), WIDTH), np.float32)
    for i, b in enumerate(found):
        row = x[i]
        row[:PATH] = b.path
        kept = [_kept("w:" + w, WORDS) for w in b.text.lower().split()]
        at, signs = zip(*kept, strict=True)
        row[PATH : PATH + WORDS] = np.bincount(at, signs, WORDS) / len(kept)
        n = len(b.text)
        row[PATH + WORDS] = math.log1p(n) / 8
        row[PATH + WORDS + 1] = min(1.0, b.links / n)
        row[PATH + WORDS + 2] = b.text[-1] in ".!?…\"'»"
        row[PATH + WORDS + 3] = "©" in b.text
        row[PATH + WORDS + 4] = 1
    return x


def told(found: list[Block], elements: list[tuple[str, int]], *, share: float = 0.7) -> np.ndarray | None:
    """Labels of a page's blocks by structure and text: from the page down, the
    element within that holds ``share`` of the letters of sentences, as long as
    one does; its blocks are main text but for those that are mostly links. What
    lies in a further container inside is not told (nan). None if nothing below
    the body holds so much."""
    mass = np.zeros(len(elements))
    for b in found:
        if b.text[-1] in ".!?…" and b.links < 0.3 * len(b.text):
            mass[b.element] += len(b.text)
    for e in range(len(elements) - 1, 0, -1):  # elements come after what they lie in
        mass[elements[e][1]] += mass[e]
    at, inside, deeper = 0, np.zeros(len(elements), bool), np.zeros(len(elements), bool)
    for e in range(1, len(elements)):
        if elements[e][1] == at and elements[e][0] in HOLDS and mass[e] >= share * max(1.0, mass[0]):
            at = e
    if elements[at][0] in ("", "html", "body"):
        return None
    inside[at] = True
    for e in range(at + 1, len(elements)):
        inside[e] = inside[elements[e][1]]
        deeper[e] = inside[e] and (deeper[elements[e][1]] or elements[e][0] in HOLDS)
    return np.array([math.nan if deeper[b.element] else float(inside[b.element] and b.links < 0.5 * len(b.text)) for b in found])


# ---- the labeller ----


class Labeller:
    """One LSTM forward and one backward over a page's blocks, then a logistic output on both states."""

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p["W" + d] = rng.normal(0, 0.15, (WIDTH, 4 * HIDDEN))
            self.p["U" + d] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            self.p["c" + d] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        self.p["v"] = rng.normal(0, 0.3, 2 * HIDDEN)
        self.p["o"] = np.zeros(1)

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        return self._run(x, mask, d, keep, np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN)))[:2]

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, list, tuple]:
        """States of all steps for a batch (pages, steps, WIDTH) that begins with
        states h and c, a record for the gradients, and the last states; padded
        steps carry states on."""
        n, steps, _ = x.shape
        out, tape = np.zeros((n, steps, HIDDEN)), []
        base = x @ self.p["W" + d] + self.p["c" + d]
        u = self.p["U" + d]
        for t in range(steps) if d == "f" else reversed(range(steps)):
            z = base[:, t] + h @ u
            g = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
            a = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            new = f * c + i * a
            th = np.tanh(new)
            if keep:
                tape.append((t, h, c, i, f, o, a, th, m))
            c = np.where(m, new, c)
            h = np.where(m, o * th, h)
            out[:, t] = h
        return out, tape, (h, c)

    def predict(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        hidden = np.concatenate([self._pass(x, mask, d, False)[0] for d in "fb"], axis=2)
        return 1 / (1 + np.exp(-np.clip(hidden @ self.p["v"] + self.p["o"], -30, 30)))

    def predict_long(self, found: list[Block]) -> np.ndarray:
        """Of one page of any number of blocks, holding the vectors of some of them at a time."""
        z = np.full(len(found), self.p["o"][0])
        for k, d in enumerate("fb"):
            h, c = np.zeros((1, HIDDEN)), np.zeros((1, HIDDEN))
            starts = range(0, len(found), STEPS)
            for at in starts if d == "f" else reversed(starts):
                x = vectors(found[at : at + STEPS])[None]
                out, _, (h, c) = self._run(x, np.ones((1, x.shape[1]), bool), d, False, h, c)
                z[at : at + STEPS] += out[0] @ self.p["v"][k * HIDDEN : (k + 1) * HIDDEN]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over the blocks with a label, back through time."""
        runs = {d: self._pass(x, mask, d, True) for d in "fb"}
        hidden = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        p = 1 / (1 + np.exp(-np.clip(hidden @ self.p["v"] + self.p["o"], -30, 30)))
        known = mask & ~np.isnan(y)
        delta = np.where(known, p - np.nan_to_num(y), 0) / max(1, known.sum())
        g = {"v": np.einsum("nt,nth->h", delta, hidden), "o": np.array([delta.sum()])}
        down = delta[:, :, None] * self.p["v"]
        for k, d in enumerate("fb"):
            dh_out = down[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            u, gu, gw, gc = self.p["U" + d], 0, 0, 0
            dh, dc = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN))
            for t, h0, c0, i, f, o, a, th, m in reversed(runs[d][1]):
                dh = dh + dh_out[:, t]
                live_h, live_c = dh * m, dc * m
                dnew = live_h * o * (1 - th * th) + live_c
                dz = np.concatenate([dnew * a * i * (1 - i), dnew * c0 * f * (1 - f), live_h * th * o * (1 - o), dnew * i * (1 - a * a)], axis=1)
                gu = gu + h0.T @ dz
                gw = gw + x[:, t].T @ dz
                gc = gc + dz.sum(axis=0)
                dh = dz @ u.T + dh * ~m
                dc = dnew * f + dc * ~m
            g |= {"U" + d: gu, "W" + d: gw, "c" + d: gc}
        return g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], *, epochs: int = 14, rate: float = 0.02, batch: int = 32, seed: int = 5) -> Labeller:
        rng = random.Random(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        order = sorted(range(len(pages)), key=lambda i: len(pages[i][1]))
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        for _ in range(epochs):
            rng.shuffle(groups)
            for group in groups:
                x, mask = padded([pages[i][0] for i in group])
                y = np.zeros(mask.shape)
                for r, i in enumerate(group):
                    y[r, : len(pages[i][1])] = pages[i][1]
                step += 1
                for k, g in self.gradients(x, y, mask).items():
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.99 * m2[k] + 0.01 * g * g
                    self.p[k] = self.p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
        return self


def padded(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(x) for x in xs)
    x, mask = np.zeros((len(xs), steps, WIDTH)), np.zeros((len(xs), steps), bool)
    for i, one in enumerate(xs):
        x[i, : len(one)], mask[i, : len(one)] = one, True
    return x, mask


def made_up(count: int, seed: int = 9) -> list[tuple[str, list[int]]]:
    """Pages of many layouts with the label of each of their blocks."""
    rng = random.Random(seed)
    letters = "etaoinshrdlucmfwypvbgkqjxzäéñüß"
    word = lambda: "".join(rng.choice(letters[: rng.choice((12, 20, 31))]) for _ in range(rng.randint(2, 9)))
    text = lambda lo, hi: " ".join(word() for _ in range(rng.randint(lo, hi))).capitalize() + rng.choice((".", ".", "", "!"))
    pages = []
    for _ in range(count):
        parts: list[tuple[str, list[int]]] = []

        def other(body: str, blocks_: int, names: tuple[str, ...], tags: tuple[str, ...] = ("div", "section", "aside"), parts: list = parts) -> None:
            name, tag = rng.choice(names), rng.choice(tags)
            named = f' {rng.choice(("class", "id"))}="{rng.choice(("", "site-", "page-", "x "))}{name}{rng.choice(("", "-box", " wide", "-1"))}"' if name else ""
            parts.append((f"<{tag}{named}>{body}</{tag}>", [0] * blocks_))

        n = rng.randint(1, 7)
        links = "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(n))
        if rng.random() < 0.8:
            other(f"<ul>{links}</ul>", n, ("", "menu", "navbar"), ("nav",))
        if rng.random() < 0.5:
            other(f"<h1>{text(1, 4)}</h1><p>{text(2, 8)}</p>", 2, ("", "header", "banner"), ("header",))
        if rng.random() < 0.7:
            other(text(2, 20), 1, ("ad", "ads", "advert", "promo", "sponsored", "banner"), ("div", "aside"))
        if rng.random() < 0.4:
            other(f"<p>{text(3, 20)}</p><button>{word()}</button>", 2, ("cookie", "notice", "consent", "gdpr", "popup"))
        inner, labels = [], []
        if rng.random() < 0.9:
            inner.append(f"<h1>{text(1, 10)}</h1>")
            labels.append(1)
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.75:
                inner.append(rng.choice(("<p>{}</p>", "<p>{}</p>", "<p><b>{}<br>", "<p>{}", "<p>{} <i>x</i></p>")).format(text(1, 80)))
                labels.append(1)
            elif kind < 0.83:
                inner.append(f"<h2>{text(1, 6)}</h2>")
                labels.append(1)
            elif kind < 0.9:
                k = rng.randint(1, 4)
                inner.append("<ul>" + "".join(f"<li>{text(1, 12)}</li>" for _ in range(k)) + "</ul>")
                labels += [1] * k
            elif kind < 0.95:
                inner.append(f"<blockquote>{text(3, 30)}</blockquote>")
                labels.append(1)
            else:
                inner.append(f'<div class="{rng.choice(("ad", "promo", "related", "share", "newsletter"))}">{text(2, 15)}</div>')
                labels.append(0)
        opened, closed = rng.choice((("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="post-body">', "</div>"), ("<main><article>", "</article></main>")))
        parts.append((opened + "".join(inner) + closed, labels))
        if rng.random() < 0.4:
            k = rng.randint(1, 4)
            other("".join(f"<p>{text(2, 40)}</p>" for _ in range(k)), k, ("comments", "comment-list", "replies", "discussion"), ("div", "section"))
        if rng.random() < 0.4:
            k = rng.randint(1, 4)
            other("".join(f"<li>{text(1, 12)}</li>" for _ in range(k)), k, ("sidebar", "related", "widget", "recommended"), ("aside", "div"))
        if rng.random() < 0.3:
            other(f"<label>{word()}</label><input name=a><button>{word()}</button>", 2, ("", "login", "search", "signup", "newsletter"), ("form",))
        if rng.random() < 0.9:
            other(f"&copy; {word()}.example.com &middot; {text(2, 15)}", 1, ("", "footer", "legal", "copyright"), ("footer",))
        pages.append(("<!DOCTYPE html><html><head><title>x</title></head><body>" + "".join(p for p, _ in parts) + "</body></html>", [y for _, ys in parts for y in ys]))
    return pages


def train(pages: DataFrame, *, html_column: str = "html", most: int = 200, made: int = 300, chars: int = 100_000, longest: int = 500) -> Labeller:
    """Fit on ``made`` made-up pages and at most about ``most`` pages of the table
    that ``told`` labels, chosen by a hash of their HTML from those of up to
    ``chars`` characters; of these, pages of up to ``longest`` blocks."""
    examples = []
    for page, labels in made_up(made):
        found = blocks(page)
        if len(found) == len(labels):
            examples.append((vectors(found), np.array(labels, float)))
    some = pages.select(F.col(f"`{html_column}`").alias("h")).where(F.length("h") <= chars)
    share = max(1, some.count() // most)
    rank = F.xxhash64("h", F.lit(4))
    for r in some.where(F.pmod(rank, F.lit(share)) == 0).distinct().orderBy(rank, "h").limit(2 * most).collect():
        found, elements = parsed(r["h"])
        labels = told(found, elements) if 0 < len(found) <= longest else None
        if labels is not None:
            examples.append((vectors(found), labels))
    return Labeller().fit(examples)


def main_text(pages: DataFrame, labeller: Labeller, *, html_column: str = "html", batch: int = 64) -> DataFrame:
    """``pages`` with an added column main_text: the blocks labelled main text,
    in page order, joined by newlines; empty if there is none.

    A null or empty page has empty text. Pages are labelled whole, whatever
    their number of blocks; repeated rows are labelled alike. A column named
    main_text is replaced.
    """
    pages = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c != "main_text"])
    at = pages.columns.index(html_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512, at):
            found = [blocks(p) for p in b.column(at).to_pylist()]
            texts = [""] * len(found)
            order = sorted((i for i in range(len(found)) if found[i]), key=lambda i: len(found[i]))
            for k in range(0, len(order), batch):
                group = order[k : k + batch]
                while group:  # long pages in smaller groups, the longest ones alone
                    take = group[: max(1, STEPS // len(found[group[-1]]))]
                    group = group[len(take) :]
                    alone = len(take) == 1 and len(found[take[0]]) > STEPS
                    p = [labeller.predict_long(found[take[0]])] if alone else labeller.predict(*padded([vectors(found[i]) for i in take]))
                    for row, i in zip(p, take, strict=True):
                        texts[i] = "\n".join([x.text for x, y in zip(found[i], row, strict=False) if y >= 0.5])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "main_text"])

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField("main_text", T.StringType())]))
