"""Folds over arrays and cuts of texts that take time in proportion to their size.

A fold copies all that it has put together at every step, and ``substring``
counts code points from a text's start; both make a text with very many hits
take the square of its size. Here folds put out numbers, within chunks, and
texts are cut into blocks first, any of which is found at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items that a fold appends to one array; then the array is put away.
CHUNK = 256
#: Numbers of a chunk of running sums.
SMALL = 64
#: Code points of a block of text.
BLOCK = 1024


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once."""
    return F.transform(F.array(value), use)[0]


def running(numbers: Column) -> Column:
    """Of each of an array's numbers the sum of those before it. Sums of chunks come
    first, so that within a chunk only its own numbers are put together."""
    none = F.array().cast("array<int>")
    span = lambda v, c: F.slice(v, c * SMALL + 1, F.lit(SMALL))
    sums = lambda v, cs: F.transform(cs, lambda c: F.aggregate(span(v, c), F.lit(0), lambda a, x: a + x))
    step = lambda at, x: F.struct((at + x).alias("s"), F.array(at).alias("o"))

    def every(v: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / SMALL).cast("int"))
        begins = folded(sums(v, chunks), F.lit(0), step, "int")
        within = lambda at, c: F.aggregate(span(v, c), F.struct(at.alias("at"), none.alias("o")), lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["o"], F.array(a["at"])).alias("o")), lambda a: a["o"])
        return F.flatten(F.transform(begins, within))

    return let(numbers, lambda v: F.when(F.size(v) > 0, every(v)).when(v.isNotNull(), none))


def folded(items: Column, zero: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """Array of what a fold puts out. ``step(state, item)`` gives struct<s, o>: the
    next state and an array of values of the SQL type ``kind``, which should be
    numbers. Null items give null."""
    none, nones = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")
    start = lambda state, out: F.struct(F.struct(state.alias("s"), none.alias("o")).alias("last"), out.alias("out"))

    # What a step gives is put to the rest by the next one, so that it is computed once and nothing long is copied.
    def few(part: Column, state: Column) -> Column:
        one = lambda a, x: F.struct(step(a["last"]["s"], x).alias("last"), F.concat(a["out"], a["last"]["o"]).alias("out"))
        return F.aggregate(part, start(state, none), one, lambda a: F.struct(a["last"]["s"].alias("s"), F.concat(a["out"], a["last"]["o"]).alias("o")))

    def every(v: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int"))
        more = lambda a, c: F.struct(few(F.slice(v, c * CHUNK + 1, F.lit(CHUNK)), a["last"]["s"]).alias("last"), F.concat(a["out"], F.array(a["last"]["o"])).alias("out"))
        return F.aggregate(chunks, start(zero, nones), more, lambda a: F.flatten(F.concat(a["out"], F.array(a["last"]["o"]))))

    return let(items, lambda v: F.when(F.size(v) > 0, every(v)).when(v.isNotNull(), none))


def blocks(text: Column) -> Column:
    """A text cut into blocks of ``BLOCK`` code points, the last one shorter."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(blocks_: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to before ``end`` (within the text) of a text given as blocks."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")
    head = lambda n: F.substring(F.get(blocks_, first), start - first * BLOCK + 1, n)
    between = F.array_join(F.slice(blocks_, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    over = F.concat(head(F.lit(BLOCK)), between, F.substring(F.get(blocks_, last), F.lit(1), end - last * BLOCK))
    return F.when(end <= start, "").when(first == last, head(end - start)).otherwise(over)


def replaced(text: Column, spans: Column, start: Callable[[Column], Column], end: Callable[[Column], Column], by: Callable[[Column], Column]) -> Column:
    """A text with disjoint spans, from left to right, replaced; with none it stays as it is."""

    def done(bs: Column, found: Column) -> Column:
        before = lambda i: F.when(i > 0, end(F.get(found, i - 1))).otherwise(0)
        parts = F.transform(found, lambda s, i: F.concat(cut(bs, before(i), start(s)), by(s)))
        return F.concat(F.array_join(parts, ""), cut(bs, end(F.element_at(found, -1)), F.length(text)))

    return let(spans, lambda found: F.when(F.size(found) > 0, let(blocks(text), lambda bs: done(bs, found))).otherwise(text))
