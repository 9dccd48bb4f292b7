"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text
of labelled documents. A document's windows, every two words that follow each
other, are compressed with the ordinary dictionary, once with and once without
the toxic one beside it; a window's margin is the number of bytes that the
toxic one saves. A word's margin is the lesser one of the two windows that
hold it, as chance matches rarely show in both; windows that share no run of
bytes with the toxic dictionary save nothing. Counts of words above some
margins are calibrated to a probability by logistic regression on labelled
documents, each with dictionaries that it had no part in.

Toxic training text: of toxic documents, the words (with what is written to
them) that such documents hold far more often than others do; most text of a
toxic document is ordinary. Ordinary training text: windows of the others.

Dictionaries and calibration see at most about ``most`` labelled documents,
chosen by a hash of their id; scoring sees every window of every whole
document, each document in its own row.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, stored

#: Margins at and above which words are counted.
CUTS = (3, 4, 5, 6, 7, 8)
#: Sizes of the dictionaries in bytes.
TOXIC_BYTES, ORDINARY_BYTES = 4096, 8192
#: Bytes of a segment of the ordinary one.
SEGMENT = 20
#: Parts of the sample; each is calibrated with the dictionaries of the others.
FOLDS = 4
#: Telling words, distinct toxic training texts and how often each may count, and ordinary windows, at most.
TELLING, TOXIC_TEXTS, COPIES, ORDINARY_TEXTS = 600, 5000, 200, 50_000
#: Bytes in a row in common with the toxic dictionary without which a window counts as saving nothing; shorter matches save hardly more than they cost.
RUN = 6
#: Words, and bytes of one, whose sharing is kept per Python process.
KEPT, KEPT_BYTES = 400_000, 64
# Both dictionaries end with these and every window begins and ends with them:
# the compressor finds no matches in a window's last bytes, nor in windows too short to shrink.
_HEAD, _TAIL = bytes(range(2, 8)) + bytes(range(14, 20)), bytes(range(20, 32)) + b"\x7f\x01\x7f"


def _words(text: str | None) -> list[bytes]:
    return text.lower().encode().split() if text else []


def trained(size: int, texts: list[bytes], segment: int = 0) -> bytes:
    """Content of a dictionary trained on these texts, of segments of so many
    bytes (0: the library tries several); empty if the texts are too few."""
    texts = sorted(texts)
    random.Random(8).shuffle(texts)  # a segment chosen from copies in a row would hold one text again and again
    try:
        return zs.train_dictionary(size, texts, k=segment, d=6, **({} if segment else {"steps": 24})).as_bytes()
    except zs.ZstdError:
        return b""


def compressor(content: bytes) -> zs.ZstdCompressor:
    data = zs.ZstdCompressionDict(content + _TAIL + _HEAD, dict_type=zs.DICT_TYPE_RAWCONTENT)
    # Bare frames, as only lengths count.
    how = zs.ZstdCompressionParameters(window_log=16, chain_log=12, hash_log=12, search_log=5, min_match=4, target_length=32, strategy=zs.STRATEGY_LAZY, write_checksum=False, write_content_size=False, write_dict_id=False, format=zs.FORMAT_ZSTD1_MAGICLESS)
    data.precompute_compress(compression_params=how)
    return zs.ZstdCompressor(dict_data=data, compression_params=how)


class Model:
    """Dictionary contents and calibration; compressors are made where it is used."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        self.toxic, self.ordinary = toxic, ordinary
        self.centre = self.scale = self.weights = None
        self.bias = 0.0
        self._ready = False

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_kept", "_ends", "_starts", "_runs", "_with", "_without")} | {"_ready": False}

    def _prepare(self) -> None:
        # In place of the toxic dictionary, bytes that no text has: the ordinary one stays as near to a window.
        none = bytes(0xF8 + (i * i + i // 7) % 8 for i in range(len(self.toxic)))
        self._with, self._without = compressor(self.ordinary + self.toxic), compressor(self.ordinary + none)
        self._runs = {self.toxic[i : i + RUN] for i in range(len(self.toxic) - RUN + 1)}
        across = [r.split(b" ") for r in self._runs if b" " in r[1:-1]]
        self._ends, self._starts = {r[0] for r in across if len(r) == 2}, {r[1] for r in across if len(r) == 2}
        self._kept, self._ready = {}, True

    def saved(self, body: bytes) -> int:
        """Bytes that the toxic dictionary saves on a window."""
        window = _HEAD + body + _TAIL
        return len(self._without.compress(window)) - len(self._with.compress(window))

    def _shares(self, body: bytes) -> bool:
        return not self._runs.isdisjoint([body[i : i + RUN] for i in range(len(body) - RUN + 1)])

    def _sharing(self, word: bytes) -> int:
        """1 if the word between spaces shares a run; else 2 if a run may begin at its end, plus 4 if one may end at its start."""
        if self._shares(b" " + word + b" "):
            return 1
        some = range(1, RUN - 1)
        return 2 * any(word[-n:] in self._ends for n in some) + 4 * any(word[:n] in self._starts for n in some)

    def margins(self, text: str | None) -> np.ndarray:
        """Of every word, 0 where a window shares no run of bytes with the toxic dictionary."""
        if not self._ready:
            self._prepare()
        words = _words(text)
        if not words or not self.toxic:
            return np.zeros(len(words), np.int64)
        kept = self._kept
        near = list(map(kept.get, words))
        if None in near:
            if len(kept) > KEPT:
                kept.clear()
            for i, w in enumerate(words):
                if near[i] is None:
                    near[i] = self._sharing(w)
                    if len(w) <= KEPT_BYTES:
                        kept[w] = near[i]
        go = {0, len(words)}
        for i, has in enumerate(near):
            if has == 1:
                go.add(i)
                go.add(i + 1)
            elif has & 4 and i and near[i - 1] & 2 and self._shares(words[i - 1][2 - RUN :] + b" " + words[i][: RUN - 2]):
                go.add(i)
        padded = [b"", *words, b""]
        saved = np.zeros(len(words) + 1, np.int64)
        for j in go:
            saved[j] = self.saved(b" " + padded[j] + b" " + padded[j + 1] + b" ")
        return np.minimum(saved[:-1], saved[1:])

    def features(self, text: str | None) -> np.ndarray:
        m = self.margins(text)
        counts = [int((m >= c).sum()) for c in CUTS]
        n = max(1, len(m))
        return np.array([*[math.log1p(c) for c in counts], *[math.log1p(100 * c / n) for c in counts]])

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return self.bias
        z = float(((self.features(text) - self.centre) / self.scale) @ self.weights + self.bias)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 30, penalty: float = 0.01) -> None:
        """Logistic regression by Newton's method; the penalty keeps it finite."""
        if not len(y) or y.min() == y.max():
            self.bias = float(y.mean()) if len(y) else 0.0
            return
        self.centre, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        a = np.hstack([(x - self.centre) / self.scale, np.ones((len(x), 1))])
        w, ridge = np.zeros(a.shape[1]), np.full(a.shape[1], penalty)
        ridge[-1] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            g = a.T @ (p - y) / len(y) + ridge * w
            h = (a * (p * (1 - p))[:, None]).T @ a / len(y) + np.diag(ridge)
            w -= np.linalg.solve(h, g)
        self.weights, self.bias = w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = 8000, where: Column | None = None) -> Model:
    """Fit on at most about ``most`` labelled rows (of those that ``where``, over
    k and y, leaves). Rows with a null key, text or label are left out."""
    rated = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).where("k IS NOT NULL AND y IS NOT NULL")
    rated = rated if where is None else rated.where(where)
    parts = max(1, math.ceil(rated.count() / most))
    h = F.xxhash64("k", F.lit(8))
    rated = rated.where(F.pmod(h, F.lit(parts)) == 0).withColumn("fold", F.pmod(F.shiftright(h, 20), F.lit(FOLDS)))
    rated = F.broadcast(rated) if rated.count() <= 4 * most else rated  # many rows only where keys repeat
    sample = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).where("t IS NOT NULL").join(rated, "k")
    sample = stored(sample.select("y", "k", "t", "fold"), "sample")
    model = _dictionaries(sample)
    # Documents meet what they brought into a dictionary too often, so each is calibrated with others'.
    folds = [_dictionaries(sample.where(F.col("fold") != f)) for f in range(FOLDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 500, 1):
            made = [folds[f].features(t).tolist() for t, f in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.list_(pa.float64())), b.column(2)], names=["y", "x", "k"])

    rest = sample.select("y", "t", F.col("k").cast("string").alias("k"), F.col("fold").cast("int").alias("fold")).mapInArrow(run, "y int, x array<double>, k string").toPandas()  # about ``most`` rows
    rest = rest.sort_values(["k", "y"], kind="stable")
    model.calibrate(np.array(rest["x"].tolist()).reshape(len(rest), 2 * len(CUTS)), rest["y"].to_numpy().astype(float))
    return model


def _dictionaries(sample: DataFrame) -> Model:
    texts = sample.select("y", "k", F.split(F.lower("t"), r"[ \t\n\x0B\f\r]+").alias("ws"))
    cores = F.array_distinct(F.flatten(F.transform("ws", lambda w: F.regexp_extract_all(w, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))))
    counts = texts.select("y", F.explode(cores).alias("w")).groupBy("w").agg(F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") != 1).alias("b"))
    sizes = sample.agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") != 1).alias("n")).first()
    odds = F.log(((F.col("a") + 0.5) / (sizes["p"] + 1)) / ((F.col("b") + 0.5) / (sizes["n"] + 1)))
    telling = counts.withColumn("o", odds).where((F.col("a") >= 4) & (F.col("o") > math.log(8))).orderBy(F.desc(F.col("a") * F.col("o")), "w").limit(TELLING).collect()
    words = sorted(r["w"] for r in telling)
    holds = F.arrays_overlap(F.regexp_extract_all("w", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array(*map(F.lit, words)).cast("array<string>"))
    toxic = texts.where("y = 1").select(F.explode("ws").alias("w")).where(holds).groupBy("w").agg(F.count("*").alias("n"))
    found = toxic.orderBy(F.desc("n"), "w").limit(TOXIC_TEXTS).collect() if words else []
    pairs = texts.where("y <> 1 AND size(ws) > 1").select("k", F.posexplode(F.zip_with(F.slice("ws", 1, F.size("ws") - 1), F.slice("ws", 2, F.size("ws")), lambda a, b: F.concat_ws(" ", a, b))).alias("i", "w"))
    pairs = pairs.where("i % 2 = 0")
    share = max(1, pairs.count() // ORDINARY_TEXTS)
    ordinary = sorted(r["w"] for r in pairs.where(F.pmod(F.xxhash64("k", "i"), F.lit(share)) == 0).select("w").limit(2 * ORDINARY_TEXTS).collect())
    wide = lambda w: f" {w} ".encode()
    return Model(trained(TOXIC_BYTES, [wide(r["w"]) for r in found for _ in range(min(r["n"], COPIES))]), trained(ORDINARY_BYTES, [wide(w) for w in ordinary], SEGMENT))


def scored(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs`` with an added column toxicity, 0 to 1.

    A null or empty text is scored by the calibration alone. Every row is
    scored by itself; a column of that name is replaced. A model without two
    labels to learn from gives the share of toxic labels that it saw.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "toxicity"])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2000, at):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([model.score(t) for t in b.column(at).to_pylist()], pa.float64())], names=[*b.schema.names, "toxicity"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("toxicity", T.DoubleType())]))
