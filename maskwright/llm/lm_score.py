"""Stupid-backoff language-model scores of documents against all other documents.

S(w | context) is count(context w) / count(context) if that n-gram occurs in
another document, else ``backoff`` times S(w | shorter context); the shortest
context is empty and its count is the number of words; a word seen nowhere else
counts as seen once. Counts are those of the whole table less the document's
own, so that a document never vouches for itself.

Relational form: documents are dealt to blocks, and each block explodes its
n-grams to the distinct ones and their counts. The count table is dealt by
ranges of the n-gram's hash: a row holds a block's n-grams of one range, as
packed steps from hash to hash (45 bits each, not 64 and a row). Each range
sums its n-grams and sends every block, in the order in which they came, the
counts in other blocks; each block then sums its documents' positions. Rows
grow with the text; a hot n-gram is a number from each block, so no key is hot.

An n-gram is known by a 64-bit hash. A position's score is rounded to
millionths before summing, so sums do not depend on their order.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Bytes of text in a block, about: a third of a gigabyte of its task's memory at order 3; and parcels of texts that make one.
BLOCK_BYTES, PARCELS = 6 << 20, 32


def _words(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's number of words (runs without ASCII white space, A-Z lower-cased), and all words' 64-bit hashes; a distinct word is hashed once."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    doc = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(lists).fill_null(0)))
    coded = pc.list_flatten(lists).dictionary_encode()
    if not len(coded):
        return np.zeros(len(texts), np.int64), np.zeros(0, np.uint64)
    distinct = coded.chunk(0).dictionary  # that of all chunks
    sizes = np.asarray(pc.binary_length(distinct))
    raw = b"".join(memoryview(x) for x in distinct.buffers()[2:] if x is not None)
    at = [0, *np.cumsum(sizes, dtype=np.int64).tolist()]
    hashes = np.array([xxhash.xxh64_intdigest(raw[i:j]) for i, j in pairwise(at)], np.uint64)
    code = np.concatenate([np.asarray(c.indices) for c in coded.chunks])
    full = (sizes > 0)[code]  # white space at an end of a text leaves an empty word there
    return np.bincount(doc[full], minlength=len(texts)), hashes[code[full]]


def _sorted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit numbers in ascending order, equal ones as they come, and their places.

    The high bits are sorted with the place in the low ones, as values are
    sorted much faster than places; numbers that only their low bits tell
    apart, few if they are hashes, are then sorted among themselves.
    """
    low = np.uint64((1 << len(h).bit_length()) - 1)
    both = h & ~low
    both |= np.arange(len(h), dtype=np.uint64)
    both.sort()
    tied = (both[1:] ^ both[:-1]) <= low
    both &= low
    at = both.view(np.int64)
    got = h[at]
    mixed = tied & (got[1:] != got[:-1])
    if mixed.any():
        run = np.concatenate((np.zeros(1, np.int64), np.cumsum(~tied)))
        again = np.zeros(run[-1] + 1, bool)
        again[run[1:][mixed]] = True
        again = again[run]
        at[again] = at[again][np.lexsort((at[again], got[again]))]
        got[again] = h[at[again]]
    return got, at


def _firsts(h: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.concatenate((np.ones(min(1, len(h)), bool), h[1:] != h[:-1]))


def _lengths(first: np.ndarray) -> np.ndarray:
    """The lengths of runs that begin at ``first``."""
    return np.diff(np.flatnonzero(first), append=len(first))


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (multiply and shift)."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _packed(x: np.ndarray, raw: bool) -> bytes:
    """Numbers from 0 as planes of their bytes, compressed; if ``raw``, the highest plane only, for the others are noise."""
    x = x.astype("<u8")
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    plain = width - 1 if raw else 0
    return bytes([width]) + planes[:plain].tobytes() + pa.compress(planes[plain:].tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, raw: bool) -> np.ndarray:
    """The n numbers of ``_packed``."""
    width = data[0]
    at = (width - 1 if raw else 0) * n
    planes = data[1 : 1 + at] + pa.decompress(data[1 + at :], decompressed_size=width * n - at, codec="zstd", asbytes=True)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return out.view("<u8").reshape(-1)


def _parcels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows k, t in parcels: compressed Arrow streams of a share of a block each."""
    for part in slices(batches, 100_000, 1, BLOCK_BYTES // PARCELS):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
            out.write_batch(part)
        yield pa.RecordBatch.from_pydict({"parcel": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _opened(table: pa.Table) -> pa.Table:
    """The rows k, t of a block's parcels."""
    return pa.concat_tables([pa.ipc.open_stream(p.as_buffer()).read_all() for p in table.column("parcel")]).combine_chunks()


class _Block:
    """The n-grams of a block's documents: hashes of those of order 1, then of order 2 and on; the empty one is known by 0."""

    def __init__(self, texts: pa.ChunkedArray, order: int) -> None:
        self.sizes, word = _words(texts)
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), self.sizes)
        place = np.arange(len(word)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.valid, grams, h = [place >= n for n in range(order)], [], _mix(word)
        for n in range(order):
            if n and len(h):  # the n-gram that ends at a position: the shorter one before it, and the word
                h = np.concatenate((np.zeros(1, np.uint64), _mix(h[:-1] * np.uint64(0xD1342543DE82EF95) + word[1:] + np.uint64(n))))
            grams.append(h[self.valid[n]])
        self.grams = np.concatenate([np.zeros(0, np.uint64), *grams])

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct hashes in ascending order, and their counts."""
        h, empty = np.sort(self.grams), np.zeros(min(1, len(self.doc)), np.uint64)
        first = _firsts(h)
        return np.concatenate((empty, h[first])), np.concatenate((empty.astype(np.int64) + len(self.doc), _lengths(first)))

    def scores(self, elsewhere: np.ndarray, backoff: float) -> np.ndarray:
        """Per document, in millionths; ``elsewhere`` has the counts in other blocks of the hashes of ``table``."""
        if not len(self.doc):
            return np.zeros(len(self.sizes), np.int64)
        h, at = _sorted(self.grams)
        first = _firsts(h)
        here, own = _lengths(first), _lengths(first | _firsts(np.concatenate([self.doc[v] for v in self.valid])[at]))  # equal n-grams go by document
        left = np.repeat(elsewhere[1:] + here, here)
        left -= np.repeat(own, own)
        counts = h.view(np.int64)  # in other documents, at each position
        counts[at] = left
        others = [elsewhere[0] + len(self.doc) - self.sizes[self.doc]]
        for v, c in zip(self.valid, np.split(counts, np.cumsum([int(v.sum()) for v in self.valid])[:-1]), strict=True):
            full = np.zeros(len(v), np.int64)
            full[v] = c
            others.append(full)
        score, open_, factor = np.zeros(len(self.doc)), np.ones(len(self.doc), bool), np.ones(len(self.doc))
        for n in reversed(range(1, len(others))):
            c = others[n]
            if n > 1:
                valid, context = self.valid[n - 1], np.concatenate((np.zeros(1, np.int64), others[n - 1][:-1]))
                hit = open_ & valid & (c > 0)
                score[hit] = np.log(factor[hit] * (c[hit] / context[hit]))
                open_ &= ~hit
                factor[open_ & valid] *= backoff
            else:
                score[open_] = np.log(factor[open_] * (np.maximum(c[open_], 1) / np.maximum(others[0][open_], 1)))
        return np.bincount(self.doc, weights=np.rint(score * 1e6), minlength=len(self.sizes)).astype(np.int64)


def lm_scores(docs: DataFrame, *, key: str = "doc_id", text: str = "text", order: int = 3, backoff: float = 0.4) -> DataFrame:
    """key, n_words, total_micro (sum of the positions' log scores in
    millionths) and score_micro (its share a word, towards zero; null without
    words), one row per row of ``docs``.

    Null and wordless texts have no words and total 0. Repeated rows are
    documents of their own and see each other's counts. A null key is kept.
    A text of any length lies in one block and is scored whole. Rows of a
    partition must come in one order each time that they are read, as those of
    a table do. Extra columns are not read; an empty table gives an empty
    result.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length(f"`{text}`")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // BLOCK_BYTES))
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).mapInArrow(_parcels, "parcel binary")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("parcel"), F.lit(blocks)).cast("int")).repartition("block")
    starts = np.array([-(-(p << 64) // blocks) for p in range(blocks)], np.uint64)  # of the ranges of hashes, as many as blocks

    def exploded(table: pa.Table) -> pa.Table:
        keys, counts = _Block(_opened(table).column("t"), order).table()
        cuts = [*np.searchsorted(keys, starts).tolist(), len(keys)]
        parts = [p for p in range(blocks) if cuts[p] < cuts[p + 1]]
        steps = [np.diff(keys[cuts[p] : cuts[p + 1]], prepend=starts[p]) for p in parts]
        own = [counts[cuts[p] : cuts[p + 1]] for p in parts]
        made = {"part": pa.array(parts, pa.int32()), "block": pa.array([table.column("block")[0].as_py()] * len(parts), pa.int32()), "c": pa.array([len(x) for x in own], pa.int32())}
        return pa.table(made | {"h": pa.array([_packed(x, True) for x in steps], pa.binary()), "n": pa.array([_packed(x, False) for x in own], pa.binary())})

    def summed(table: pa.Table) -> pa.Table:
        sizes = table.column("c").to_pylist()
        keys = np.concatenate([np.cumsum(_unpacked(x, c, True), dtype=np.uint64) for x, c in zip(table.column("h").to_pylist(), sizes, strict=True)])  # from the range's start
        own = np.concatenate([_unpacked(x, c, False) for x, c in zip(table.column("n").to_pylist(), sizes, strict=True)]).astype(np.int64)
        keys, at = _sorted(keys * np.uint64(blocks))  # a range is 2**64 / blocks wide, so this stays below 2**64
        first, own = _firsts(keys), own[at]
        others = np.empty(len(at), np.int64)
        others[at] = np.repeat(np.add.reduceat(own, np.flatnonzero(first)), _lengths(first)) - own
        others = [_packed(x, False) for x in np.split(others, np.cumsum(sizes)[:-1])]
        return pa.table({"block": table.column("block"), "part": table.column("part"), "c": table.column("c"), "n": pa.array(others, pa.binary())})

    def scored(texts: pa.Table, known: pa.Table) -> pa.Table:
        texts = _opened(texts)
        schema = pa.schema([(key, texts.schema.field("k").type), ("n_words", pa.int64()), ("total_micro", pa.int64())])
        found = _Block(texts.column("t"), order)
        known = known.sort_by("part")
        others = [_unpacked(x, c, False) for x, c in zip(known.column("n").to_pylist(), known.column("c").to_pylist(), strict=True)]
        elsewhere = np.concatenate([np.zeros(0, np.int64), *others]).astype(np.int64)
        return pa.table([texts.column("k"), pa.array(found.sizes), pa.array(found.scores(elsewhere, backoff))], schema=schema)

    grams = rows.groupBy("block").applyInArrow(exploded, "part int, block int, c int, h binary, n binary")
    elsewhere = grams.groupBy("part").applyInArrow(summed, "block int, part int, c int, n binary")
    out = rows.groupBy("block").cogroup(elsewhere.groupBy("block")).applyInArrow(scored, f"`{key}` {kind}, n_words long, total_micro long")
    return out.withColumn("score_micro", F.expr("CASE WHEN n_words > 0 THEN -(-total_micro DIV n_words) END"))
