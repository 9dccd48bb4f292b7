"""Token ids in Arrow files of equal-length sequences.

Each file is an Arrow IPC file (a stream with a footer, so that any record
batch can be reached and memory-mapped without copying). A row is a sequence:

- ids: fixed-size list of ``length`` unsigned 16-bit token ids;
- mask: fixed-size list of ``length`` booleans, false on padding;
- doc_ids, doc_ends: the documents that end in the sequence, in order, and the
  place after their last id.

Documents follow one another in ascending id order, within a file and over the
files by their number; a file's last sequence is padded. ``Sequences`` gives
random access to a file's sequences and masks.
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored
from .tokens import encoder

#: Sequences in a record batch; only a file's last one may have fewer.
BATCH = 128
#: Bytes of text a file, about.
FILE_BYTES = 64 << 20


def schema(length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint16(), length)), ("mask", pa.list_(pa.bool_(), length)), ("doc_ids", pa.list_(pa.int64())), ("doc_ends", pa.list_(pa.int32()))])


class _Writer:
    """One file, written as documents come; holds at most a batch of sequences."""

    def __init__(self, path: str, length: int) -> None:
        self.length, self.path = length, path
        store, place = fs.FileSystem.from_uri(path)
        store.create_dir(place.rsplit("/", 1)[0], recursive=True)
        self.out = store.open_output_stream(place)
        self.file = ipc.new_file(self.out, schema(length))
        self.held: list[bytes] = []
        self.n = self.total = self.docs = 0
        self.ends: list[tuple[int | None, int]] = []

    def add(self, doc: int | None, ids: bytes) -> None:
        self.held.append(ids)
        self.n += len(ids) // 2
        self.docs += 1
        self.ends.append((doc, self.n))
        if self.n >= BATCH * self.length:
            self._flush(False)

    def _flush(self, all_: bool) -> None:
        """Write what is held in batches of exactly ``BATCH`` sequences; if ``all_``, the rest too."""
        flat, full = np.frombuffer(b"".join(self.held), "<u2"), BATCH * self.length
        at = ended = 0
        while len(flat) - at >= full or (all_ and at < len(flat)):
            now = flat[at : at + full]
            last = bisect_right(self.ends, at + len(now), ended, key=lambda e: e[1])
            self._batch(now, [(d, e - at) for d, e in self.ends[ended:last]])
            at, ended = at + len(now), last
        self.total += at
        self.ends = [(d, e - at) for d, e in self.ends[ended:]]
        self.held, self.n = [flat[at:].tobytes()], len(flat) - at

    def _batch(self, now: np.ndarray, ended: list[tuple[int | None, int]]) -> None:
        sequences = -(-len(now) // self.length)
        size = sequences * self.length
        mask = np.ones(size, bool)
        if len(now) < size:
            mask[len(now) :] = False
            now = np.concatenate([now, np.zeros(size - len(now), "<u2")])
        at = np.array([(e - 1) // self.length for _, e in ended], np.int64)
        offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(at, minlength=sequences)))).astype(np.int32))
        arrays = [
            pa.FixedSizeListArray.from_arrays(pa.array(now, pa.uint16()), self.length),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length),
            pa.ListArray.from_arrays(offsets, pa.array([d for d, _ in ended], pa.int64())),
            pa.ListArray.from_arrays(offsets, pa.array([e - k * self.length for (_, e), k in zip(ended, at.tolist(), strict=True)], pa.int32())),
        ]
        self.file.write_batch(pa.RecordBatch.from_arrays(arrays, schema=schema(self.length)))

    def close(self) -> None:
        self._flush(True)
        self.file.close()
        self.out.close()


def write(docs: DataFrame, folder: str, tokenizer: str, *, key: str = "doc_id", text: str = "text", end_id: int = 0, length: int = 2048) -> DataFrame:
    """Encode every text, append ``end_id``, write the files under ``folder``, and
    return their table: file, path, n_tokens, n_docs.

    Files of tasks that were lost or repeated may stay in the folder; only those
    in the table count. A null text counts as empty; rows with a null key come
    first; repeated keys follow one another by a hash of their text. Extra columns are not read.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("t")).withColumn("h", F.xxhash64("t"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first()["n"]
    files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    # Rows of equal key and text are alike, so a number that tells them apart lets them fill several files.
    rows = rows.withColumn("s", F.monotonically_increasing_id() % 65_536)
    rows = rows.repartitionByRange(files, "k", "h", "s").sortWithinPartitions("k", "h", "t").select("k", "t")
    tail = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, writer = TaskContext.get().partitionId(), None
        for b in slices(batches, 512, 1):
            for k, ids in zip(b.column(0).to_pylist(), encoder(tokenizer).encode(b.column(1).to_pylist()), strict=True):
                writer = writer or _Writer(f"{folder}/{number:07d}-{uuid.uuid4().hex}.arrow", length)
                writer.add(k, ids + tail)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"file": [number], "path": [writer.path], "n_tokens": [writer.total], "n_docs": [writer.docs]})

    return stored(rows.mapInArrow(run, "file long, path string, n_tokens long, n_docs long"), "files")


def read(files: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Per document of the files: key, start (ids of all documents before it),
    n_tokens and ids_crc32 (of its ids as little-endian unsigned 32-bit integers)."""
    starts = F.sum("n_tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    placed = files.select("path", F.coalesce(starts, F.lit(0)).alias("start"))
    spread = placed.repartition(max(1, files.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield from _documents(path, start, key)

    return spread.mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids_crc32 long")


def _documents(path: str, start: int, key: str) -> Iterator[pa.RecordBatch]:
    crc = size = 0
    with Sequences(path) as file:
        for i in range(file.batches):
            b = file.batch(i)
            length = b.schema.field("ids").type.list_size
            ids = b.column("ids").flatten().to_numpy()
            rows = np.repeat(np.arange(b.num_rows), np.diff(b.column("doc_ends").offsets.to_numpy()))
            ends = (b.column("doc_ends").flatten().to_numpy() + rows * length).tolist()
            valid = int(b.column("mask").flatten().to_numpy(zero_copy_only=False).sum())
            wide = ids.astype("<u4")
            out, at = [], 0
            for e in ends:
                crc, size = zlib.crc32(wide[at:e], crc), size + e - at
                out.append((start, size, crc))
                start, crc, size, at = start + size, 0, 0, e
            crc, size = zlib.crc32(wide[at:valid], crc), size + valid - at
            columns = [pa.array([x[j] for x in out], pa.int64()) for j in range(3)]
            yield pa.RecordBatch.from_arrays([b.column("doc_ids").flatten(), *columns], names=[key, "start", "n_tokens", "ids_crc32"])


class Sequences:
    """Random access to a file. Local files are memory-mapped: nothing is copied."""

    def __init__(self, path: str) -> None:
        store, place = fs.FileSystem.from_uri(path)
        self._source = pa.memory_map(place) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(place)
        self._file = ipc.open_file(self._source)
        self.batches = self._file.num_record_batches

    def batch(self, i: int) -> pa.RecordBatch:
        return self._file.get_batch(i)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence i; the ids are a view of the file."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        b = self.batch(i // BATCH)
        row = i % BATCH
        ids, mask = b.column("ids")[row].values, b.column("mask")[row].values
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def __len__(self) -> int:
        return (self.batches - 1) * BATCH + self.batch(self.batches - 1).num_rows if self.batches else 0

    def __enter__(self) -> Sequences:
        return self

    def __exit__(self, *_: object) -> None:
        self._source.close()
