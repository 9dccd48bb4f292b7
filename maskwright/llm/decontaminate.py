"""Benchmark decontamination by a generalised suffix automaton over words.

The test items' words form one automaton (an item set beyond a word bound is
cut into shards, each with an automaton of its own). Each document's words are
streamed through it; the automaton's state gives, at every word, the longest
run of words ending there that some item holds. Runs of ``window`` words or
more, and whole items shorter than that, are hits.

Rows are independent of each other: no shuffle, no skew, and a lost executor
costs the tasks it ran.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_others, keeps, slices, stored

#: Words of at least one letter or digit, or of characters beyond ASCII, lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TO_WORDS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_WORD = re.compile(WORD)
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_TO_WORDS).split() if text else []


class SuffixAutomaton:
    """Of all words sequences added. State 0 is the root; ``length`` is the
    longest sequence of a state, ``link`` its longest proper suffix's state."""

    def __init__(self, window: int) -> None:
        self.window, self.next, self.link, self.length = window, [{}], [-1], [0]
        self.own: list[list] = [[]]
        self._ended: list[tuple[object, list[bytes]]] = []
        self.vocabulary: dict[bytes, int] = {}
        self.short: dict[int, list[tuple[int, object]]] = {}
        self.least = window
        self._held: dict[int, frozenset] = {}

    def _state(self, length: int, link: int, moves: dict) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.own.append([])
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of state q that keeps only sequences as long as those through p."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def add(self, item: object, item_words: list[bytes]) -> None:
        if not item_words:
            return
        at = 0
        for w in item_words:
            at = self._extend(at, self.vocabulary.setdefault(w, len(self.vocabulary) + 1))
            self.own[at].append(item)
        if len(item_words) < self.window:
            self._ended.append((item, item_words))

    def close(self) -> SuffixAutomaton:
        """To be called after the last ``add``."""
        for item, ws in self._ended:
            at = 0
            for w in ws:
                at = self.next[at][self.vocabulary[w]]
            self.short.setdefault(at, []).append((len(ws), item))
            self.least = min(self.least, len(ws))
        self.children: list[list[int]] = [[] for _ in self.next]
        for v in range(1, len(self.next)):
            self.children[self.link[v]].append(v)
        self.any_short = [False] * len(self.next)
        if self.short:
            for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
                self.any_short[v] = v in self.short or self.any_short[self.link[v]]
        return self

    def holders(self, v: int) -> frozenset:
        """The items in which the sequences of state v occur."""
        if v not in self._held:
            found, todo = set(), [v]
            while todo:
                u = todo.pop()
                found.update(self.own[u])
                todo += self.children[u]
            self._held[v] = frozenset(found)
        return self._held[v]

    def matches(self, doc: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word ranges of the windows' occurrences (end exclusive), and the items they belong to."""
        ids = list(map(self.vocabulary.get, doc, repeat(0)))
        known = np.zeros(len(ids) + 2, dtype=np.int8)
        known[1:-1] = np.array(ids, dtype=np.int64) > 0
        edges = np.flatnonzero(np.diff(known)).reshape(-1, 2)
        hits: list[tuple[int, int]] = []
        items: set = set()
        for begin, end in edges[edges[:, 1] - edges[:, 0] >= self.least].tolist():  # no window has a word that no item has
            self._stream(ids, begin, end, hits, items)
        return hits, items

    def _stream(self, ids: list[int], begin: int, end: int, hits: list, items: set) -> None:
        nxt, link, length, n = self.next, self.link, self.length, self.window
        v = matched = 0
        for i in range(begin, end):
            c = ids[i]
            while v and c not in nxt[v]:
                v = link[v]
                matched = length[v]
            to = nxt[v].get(c)
            if to is None:
                continue
            v, matched = to, matched + 1
            if matched >= n:
                hits.append((i + 1 - n, i + 1))
                u = v
                while length[link[u]] >= n:
                    u = link[u]
                items |= self.holders(u)
            if self.any_short[v]:
                u, most = v, matched
                while u > 0:
                    for k, item in self.short.get(u, ()):
                        if k <= most:
                            hits.append((i + 1 - k, i + 1))
                            items.add(item)
                    u = link[u]
                    most = length[u]


def automaton(items: Iterable[tuple[object, str | None]], window: int) -> SuffixAutomaton:
    made = SuffixAutomaton(window)
    for item, text in items:
        made.add(item, words(text))
    return made.close()


def merged(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without the words of these word ranges and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    out, last = [], 0
    for a, b in ranges:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join(out) + text[last:]


_made: dict[str, SuffixAutomaton] = {}
keeps("decontaminate", _made.clear)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 13, coverage: float = 0.05, shard_words: int = 1_000_000, with_text: bool = True) -> DataFrame:
    """``docs`` with added columns: n_words, n_hit, items (sorted item ids that
    occur), contaminated (share of hit words at ``coverage`` or more) and, if
    ``with_text``, clean_text: the text without its hit spans.

    Items are collected by shards of about ``shard_words`` words, one at a
    time, so what a task or the driver holds is bounded however large the item
    set; each further shard adds a pass over the documents, not a join, and the
    table between two passes is stored.

    Nulls: a null text has no words and stays null; items with null or wordless
    text match nothing; a null item id hits but is not listed. Repeated items
    or rows change nothing but their own rows. Ids are compared as longs.
    Columns of ``docs`` keep their values; one named like an added column is
    replaced. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in {"n_words", "n_hit", "items", "contaminated", *["clean_text"] * with_text}]
    out = docs.select(*[F.col(f"`{c}`") for c in kept])
    items = benchmark.select(F.col(f"`{item}`").cast("long").alias("i"), F.col(f"`{item_text}`").alias("t")).where("t IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.size(F.split("t", "[^0-9A-Za-z\\u0080-\\x{10FFFF}]+"))), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-size // shard_words))
    held = tuple(f"{c}_{uuid.uuid4().hex}" for c in ("hits", "items"))  # found by earlier shards
    for k in range(shards):
        part = spark.sparkContext.broadcast([tuple(r) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(shards)) == k).collect()])
        out = _passed(out, part, text, window, held, k, k == shards - 1, with_text)
        if k < shards - 1:
            out = stored(out, "hits")
            part.destroy()
    # In whole numbers, as the share itself may be rounded.
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 1_000_000 >= F.col("n_words") * round(coverage * 1_000_000)))


def _passed(docs: DataFrame, items, text: str, window: int, between: tuple[str, str], shard: int, last: bool, with_text: bool) -> DataFrame:
    fields = [f for f in docs.schema.fields if f.name not in ("n_words", *between)]
    found = [T.StructField("n_hit", T.LongType())] if last else [T.StructField(between[0], T.ArrayType(T.IntegerType()))]
    clean = [T.StructField("clean_text", T.StringType())] if last and with_text else []
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), *found, T.StructField("items" if last else between[1], T.ArrayType(T.LongType())), *clean])
    at = [f.name for f in fields].index(text)
    names = [f.name for f in fields]
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others("decontaminate")
        if key not in _made:
            _made.clear()
            _made[key] = automaton(items.value, window)
        machine = _made[key]
        for b in slices(batches, 2000, at):
            before, before_items = (b.column(c).to_pylist() if shard else repeat([]) for c in between)
            n_words, n_hit, flat, held, clean = [], [], [], [], []
            for t, old, old_items in zip(b.column(at).to_pylist(), before, before_items, strict=False):
                ws = words(t)
                ranges, found = machine.matches(ws)
                ranges = merged([*zip(old[::2], old[1::2], strict=True), *ranges])
                n_words.append(len(ws))
                n_hit.append(sum(y - x for x, y in ranges))
                flat.append([x for r in ranges for x in r])
                held.append(sorted({x for x in found if x is not None} | set(old_items)))
                if last and with_text:
                    clean.append(without(t, ranges) if ranges else t)
            long_lists = pa.array(held, pa.list_(pa.int64()))
            new = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), long_lists, *([pa.array(clean, pa.string())] * with_text)] if last else [pa.array(n_words, pa.int64()), pa.array(flat, pa.list_(pa.int32())), long_lists]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], *new], names=schema.names)

    return docs.mapInArrow(run, schema)
