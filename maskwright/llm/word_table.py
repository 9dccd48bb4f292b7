"""Byte-level BPE through a table of distinct words.

Spark splits texts into words and counts the distinct ones, each of which the
``tokenizers`` library encodes once. The words' ids are then joined back by
position: the commonest words, as many as fit a stated number of bytes, by a
broadcast table that tasks look whole columns of words up in. What is beyond
that bound comes back in one of two ways. By default a task makes a word table
of its own for each batch of texts, so a rare word is encoded once in each
batch that holds it; ``join_rare`` joins the rare words' ids by a shuffle of their
own occurrences instead, which are few for each word, so no key of it is hot.
Decoding joins ids to their pieces in the same way; a vocabulary is bounded.

A word begins at a space that no white space follows: the pre-tokeniser cuts
there always, so words are encoded as they are within their text. Only that
pre-tokeniser (byte-level with its usual pattern, no normaliser) is taken;
others raise a ValueError.

Null texts count as empty, empty ones have no ids, texts may be of any length;
repeated rows are encoded each for itself. The columns named ``keys`` stay,
others are dropped; names that begin with an underscore are this module's.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard as zs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, stored
from .tokens import Encoder

#: Bytes of common words and their ids that are sent to each task's process.
SENT_BYTES = 24 << 20
#: Ids that a vocabulary may have; larger ones raise.
MOST_IDS = 1_000_000
#: Bytes of text that a task looks up at once.
BATCH_BYTES = 4 << 20

#: After a space these may count as white space: there no word begins.
_DOUBTFUL = r"\x09-\x0D\x1C-\x20\x7F-\xA0\u1680\u180E\u2000-\u200F\u2028-\u202F\u205F-\u206F\u3000\uFEFF"
#: Where texts are split; the space goes.
SPLIT = rf" (?=[^{_DOUBTFUL}])"


class Vocabulary:
    """What is asked of a tokeniser file, once it is known to be a fitting one."""

    def __init__(self, path: str) -> None:
        self.tokenizer = tokenizer(path)
        # The parts' states are their JSON.
        state = lambda part: json.loads(part.__getstate__()) if part is not None else {}
        pre, added = state(self.tokenizer.pre_tokenizer), self.tokenizer.get_added_tokens_decoder().values()
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and self.tokenizer.normalizer is None
        if not plain or any(t.lstrip or t.rstrip or t.single_word or " " in t.content for t in added):
            raise ValueError("not a plain byte-level tokeniser")
        size = self.tokenizer.get_vocab_size()
        if size > MOST_IDS:
            raise ValueError(f"more than {MOST_IDS} ids")
        self.kind = "<u2" if size <= 1 << 16 else "<u4"

    def pieces(self) -> list[bytes]:
        """Pieces by id, the last one empty: that of ids that have none."""
        # The usual naming of bytes by printable characters.
        named = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(named)]
        byte_of = {chr(b): b for b in named} | {chr(256 + i): b for i, b in enumerate(rest)}
        plain = lambda s: bytes(byte_of[c] for c in s) if all(c in byte_of for c in s) else s.encode()
        found = {i: plain(s) for s, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        return [found.get(i, b"") for i in range(max(found) + 2)]


def tokenizer(path: str):  # noqa: ANN201  loaded only where words are encoded, and on the driver
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def words_of(text: Column) -> Column:
    """The words of a text, in order and without the space before all but the first; of an empty one the empty word."""
    return F.split(F.coalesce(text, F.lit("")), SPLIT, -1)


class _Words:
    """The distinct ``words`` of a batch of texts, ``which`` of them each word is, and where each text's words end."""

    def __init__(self, lists: pa.ListArray) -> None:
        self.ends = np.asarray(lists.offsets, dtype="i8") - lists.offsets[0].as_py()
        flat, firsts = lists.flatten(), self.ends[:-1]
        coded = flat.dictionary_encode()
        # A text's first word has no space before it, so it is a word of its own.
        self.which = np.array(coded.indices, dtype="i4")
        self.which[firsts] = len(coded.dictionary) + np.arange(len(firsts), dtype="i4")
        spaced = pc.binary_join_element_wise(pa.array([" "], pa.string()).take(pa.array(np.zeros(len(coded.dictionary), "i4"))), coded.dictionary, "")
        self.words = pa.concat_arrays([spaced, flat.take(pa.array(firsts))])


def _batches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 50_000, words, BATCH_BYTES):
        if batch.num_rows:
            yield batch


def word_table(df: DataFrame, path: str, *, text: str = "text") -> DataFrame:
    """A stored row for each distinct word: word, n (its occurrences), ids (little-endian bytes)."""

    kind = Vocabulary(path).kind

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches, 0):
            found = _Words(batch.column(0))
            n = np.bincount(found.which, minlength=len(found.words))
            yield pa.RecordBatch.from_arrays([found.words.filter(pa.array(n > 0)), pa.array(n[n > 0])], ["word", "n"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _encode(path, kind)
        for batch in slices(batches, 20_000, text=0):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids_of(batch.column(0).to_pylist()), pa.binary())], ["word", "n", "ids"])

    counts = df.select(words_of(F.col(text))).mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return stored(counts.mapInArrow(encode, "word string, n long, ids binary"), "words")


def _often(words: DataFrame, most: int) -> int:
    """The least power of two such that the words of as many occurrences fit ``most`` bytes."""
    size = F.octet_length("word") + F.octet_length("ids") + 16
    fits = words.agg(*[F.coalesce(F.sum(F.when(F.col("n") >= 1 << k, size)), F.lit(0)).alias(str(k)) for k in range(63)]).first()
    return next((1 << k for k in range(63) if fits[str(k)] <= most), 1 << 62)


class _Table:
    """Common words and their ids, as it is sent to the tasks."""

    def __init__(self, often: pa.Table, kind: str) -> None:
        whole = often.combine_chunks()
        column = lambda c: whole.column(c).chunk(0) if whole.num_rows else pa.array([], whole.schema.field(c).type)
        self.words, ids, size = column("word"), column("ids"), np.dtype(kind).itemsize
        # The last one is of what isn't there.
        self.lengths = np.append(np.asarray(pc.binary_length(ids), dtype="i4") // size, np.int32(0))
        self.starts = np.append(np.zeros(1, "i4"), np.cumsum(self.lengths[:-1], dtype="i4"))
        self.flat = np.frombuffer(b"".join(ids.to_pylist()), dtype=kind)

    def find(self, words: pa.StringArray) -> np.ndarray:
        """Places of words; the last place for those that aren't there."""
        return np.array(pc.index_in(words, value_set=self.words).fill_null(len(self.words)), dtype="i4")


def _gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Slices of ``flat`` one after another."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]


class _Joined:
    """A batch's words joined to the common ones, and to those of the batch if
    there is a way to encode them: ``ids`` of all texts, ``places`` where each
    text's begin, and of the words left their number in the batch, text, position in it and place in its ids."""

    def __init__(self, found: _Words, table: _Table, encode: Callable[[list[str]], list[bytes]] | None = None) -> None:
        code, (lengths, starts, flat) = table.find(found.words), (table.lengths, table.starts, table.flat)
        if encode is not None and (lacking := np.flatnonzero(code == len(table.words))).size:
            ids = encode(found.words.take(pa.array(lacking)).to_pylist())
            sizes = np.array([len(x) for x in ids], "i4") // flat.itemsize
            lengths, starts = np.append(lengths, sizes), np.append(starts, len(flat) + np.cumsum(sizes, dtype="i4") - sizes)
            flat = np.append(flat, np.frombuffer(b"".join(ids), dtype=flat.dtype))
            code[lacking] = len(table.words) + 1 + np.arange(len(lacking))
        each = lengths[code][found.which].astype("i8")
        self.ids = _gathered(flat, starts[code][found.which].astype("i8"), each)
        at = np.concatenate([np.zeros(1, "i8"), np.cumsum(each)])
        self.places = at[found.ends]
        self.number = np.flatnonzero((code == len(table.words))[found.which])
        self.text = np.searchsorted(found.ends, self.number, side="right") - 1
        self.position = (self.number - found.ends[self.text]).astype("i4")
        self.place = (at[self.number] - self.places[self.text]).astype("i4")


def _kept(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def _encode(path: str, kind: str) -> Callable[[list[str]], list[bytes]]:
    """The library's ids of words, as bytes."""
    if kind == "<u2":
        return Encoder(path)._pieces  # many words in a call
    library = tokenizer(path)
    return lambda words: [np.array(e.ids, dtype=kind).tobytes() for e in library.encode_batch_fast(words, add_special_tokens=False)]


def encoded(df: DataFrame, path: str, *, keys: Sequence[str], text: str = "text", sent_bytes: int = SENT_BYTES, join_rare: bool = False, and_back: bool = False) -> DataFrame:
    """``keys`` and ``ids`` (array<int>) of each row's text. ``sent_bytes`` bounds
    the table of words that is broadcast and ``join_rare`` says how all others
    come back; results don't depend on either. With ``and_back`` the same task
    decodes the ids: ``keys``, n_tokens and what ``decoded`` gives, without the ids."""
    keys, kind = list(keys), Vocabulary(path).kind
    words = word_table(df, path, text=text)
    least = _often(words, sent_bytes)
    table = df.sparkSession.sparkContext.broadcast(_Table(words.where(F.col("n") >= least).select("word", "ids").toArrow(), kind))
    fields, at = _kept(df, keys), len(keys)
    done = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])
    if and_back:
        done = T.StructType([*fields, T.StructField("n_tokens", T.LongType(), False), *_DECODED])
        read = _reader(df, path, [*keys, "n_tokens"])
    else:
        read = None

    def out(columns: list[pa.Array], ids: pa.ListArray) -> pa.RecordBatch:
        if read is None:
            return pa.RecordBatch.from_arrays([*columns, ids], [*keys, "ids"])
        n = pc.list_value_length(ids).cast(pa.int64())
        return pa.Table.from_batches(read(iter([pa.RecordBatch.from_arrays([*columns, n, ids], [*keys, "n_tokens", "ids"])]))).combine_chunks().to_batches()[0]

    lists = lambda ids, places: pa.ListArray.from_arrays(pa.array(places.astype("i4")), pa.array(ids.astype("i4")))

    if least == 1 or not join_rare:
        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids_of = _encode(path, kind) if least > 1 else None
            for batch in _batches(batches, at):
                made = _Joined(_Words(batch.column(at)), table.value, ids_of)
                yield out(batch.columns[:at], lists(made.ids, made.places))

        return df.select(*keys, words_of(F.col(text)).alias("_words")).mapInArrow(whole, done)

    # What tells texts apart in the shuffle of rare words: a hash and the length.
    full = F.coalesce(F.col(text), F.lit(""))
    marked = df.select(*keys, F.xxhash64(full).alias("_h"), F.length(full).alias("_len"), words_of(F.col(text)).alias("_words"))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zs.ZstdCompressor(level=1).compress
        for batch in _batches(batches, at + 2):
            made = _Joined(_Words(batch.column(at + 2)), table.value)
            ids = [squeeze(made.ids[a:b].tobytes()) for a, b in pairwise(made.places.tolist())]
            cuts = np.searchsorted(made.text, np.arange(batch.num_rows + 1)).tolist()
            steps = lambda x: np.diff(x, prepend=np.int32(0))  # noqa: E731  small numbers are squeezed better
            gaps = [squeeze(np.concatenate([steps(made.position[a:b]), steps(made.place[a:b])]).tobytes()) if a < b else None for a, b in pairwise(cuts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: at + 2], pa.array(ids, pa.binary()), pa.array(gaps, pa.binary())], [*keys, "_h", "_len", "_known", "_holes"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches, 2):
            found = _Words(batch.column(2))
            made = _Joined(found, table.value)
            rows = pa.array(made.text)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(made.position), found.words.take(pa.array(found.which[made.number]))], ["_h", "_len", "_at", "word"])

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zs.ZstdDecompressor().decompress
        for batch in slices(batches, 2000):
            if not batch.num_rows:
                continue
            made = []
            for raw, gaps, more in zip(*(batch.column(at + i).to_pylist() for i in range(3)), strict=True):
                ids = np.frombuffer(open_(raw), dtype=kind) if raw else np.zeros(0, kind)
                if gaps is not None:
                    ids = _patched(ids, np.frombuffer(open_(gaps), dtype="i4").reshape(2, -1).cumsum(axis=1), {x["_at"]: x["ids"] for x in more}, kind)
                made.append(ids)
            yield out(batch.columns[:at], lists(np.concatenate(made), np.cumsum([0, *map(len, made)])))

    # Words that aren't common occur fewer than ``least`` times, so neither they nor the texts that hold them are hot.
    seldom = marked.select("_h", "_len", "_words").mapInArrow(rare, "_h long, _len int, _at int, word string")
    patches = seldom.join(words.where(F.col("n") < least).select("word", "ids"), "word").groupBy("_h", "_len").agg(F.collect_set(F.struct("_at", "ids")).alias("_rare"))
    schema = T.StructType([*fields, T.StructField("_h", T.LongType()), T.StructField("_len", T.IntegerType()), T.StructField("_known", T.BinaryType()), T.StructField("_holes", T.BinaryType())])
    both = marked.mapInArrow(known, schema).join(patches, ["_h", "_len"], "left").select(*keys, "_known", "_holes", "_rare")
    return both.mapInArrow(filled, done)


def _patched(ids: np.ndarray, holes: np.ndarray, rare: dict[int, bytes], kind: str) -> np.ndarray:
    """Ids with the rare words' put in where they belong."""
    out, last = [], 0
    for position, place in holes.T.tolist():
        out += [ids[last:place], np.frombuffer(rare[position], dtype=kind)]
        last = place
    return np.concatenate([*out, ids[last:]])


def decoded(df: DataFrame, path: str, *, keys: Sequence[str], ids: str = "ids") -> DataFrame:
    """``keys``, ``ids_sha256`` (lowercase hex, of the decimal ids joined by
    commas) and ``decoded``, the text of each row's ``ids``: ids are joined to
    their pieces, the pieces' bytes put together and read as UTF-8, with a
    replacement character for what isn't. Ids without a piece, and null ones, are
    passed over by the text, as the library does; null ones count as -1 in the
    digest. Null and empty arrays give an empty text."""
    return df.select(*keys, ids).mapInArrow(_reader(df, path, list(keys)), T.StructType([*_kept(df, keys), *_DECODED]))


_DECODED = [T.StructField(c, T.StringType(), False) for c in ("ids_sha256", "decoded")]


def _reader(df: DataFrame, path: str, keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What turns batches of keys and ids into batches of keys, ids_sha256 and decoded."""
    table = df.sparkSession.sparkContext.broadcast(Vocabulary(path).pieces())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(table.value, pa.binary())
        names = pa.array([b"%d," % i for i in range(len(pieces) - 1)], pa.binary())
        for batch in slices(batches, 2000, len(keys), BATCH_BYTES):
            column = pc.coalesce(batch.column(len(keys)), pa.scalar([], batch.schema.field(len(keys)).type))
            each = np.asarray(column.flatten().fill_null(-1), dtype="i8")
            known = (each >= 0) & (each < len(names))
            ends = np.asarray(column.offsets, dtype="i8") - column.offsets[0].as_py()
            texts = [x.decode("utf-8", "replace") for x in _cut(pieces.take(pa.array(np.where(known, each, len(names)))), ends)]
            listed = names.take(pa.array(each)) if known.all() else pa.array([b"%d," % i for i in each.tolist()], pa.binary())
            digests = [hashlib.sha256(x[:-1]).hexdigest() for x in _cut(listed, ends)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(digests, pa.string()), pa.array(texts, pa.string())], [*keys, "ids_sha256", "decoded"])

    return read


def _cut(values: pa.BinaryArray, ends: np.ndarray) -> list[bytes]:
    """The bytes of values from each place to the next, put together."""
    raw = memoryview(b"".join(values.to_pylist())) if values.offset or values.buffers()[2] is None else memoryview(values.buffers()[2])
    at = np.concatenate([np.zeros(1, "i8"), np.cumsum(np.asarray(pc.binary_length(values), dtype="i8"))])[ends].tolist()
    return [bytes(raw[a:b]) for a, b in pairwise(at)]
