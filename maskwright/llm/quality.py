"""Quality by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered
thresholds separate them: P(grade > g) = sigmoid(s - threshold_g), where s is
the mean weight of a text's words plus the weights of features of the whole
text. A word's features are itself, its shape and its last characters.

The fit sees at most ``most`` labelled documents, chosen by a hash of their id;
scoring sees every document and whole texts, each in its own row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_others, slices

#: Hashed features; distinct words of up to so many characters whose weights are kept per Python process.
BUCKETS, KEPT, KEPT_CHARS = 1 << 14, 300_000, 64


def _bucket(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature) % BUCKETS


def word_features(word: str) -> tuple[int, int, int]:
    core = word.strip(".,;:")
    shape = "".join("A" if c.isupper() else "a" if c.islower() else "9" if c.isdigit() else c for c in core)
    shape = re.sub(r"(.)\1+", r"\1", shape)
    return _bucket("w:" + core.lower()), _bucket("s:" + shape), _bucket("e:" + core[-2:].lower())


def text_features(words: list[str], distinct: int) -> list[int]:
    n = len(words)
    return [_bucket(f"n:{int(math.log2(n + 1))}"), _bucket(f"d:{int(10 * distinct / max(1, n))}")]


class Model:
    """weights, ordered thresholds and the grades they lie between."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, grades: list[int]) -> None:
        self.weights, self.thresholds, self.grades = weights, thresholds, grades
        self._kept: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_kept": {}}

    def score(self, text: str | None) -> float:
        words = text.split() if text else []
        kept = self._kept
        got = list(map(kept.get, words))
        if None in got:
            if len(kept) > KEPT:
                kept.clear()
            for i, x in enumerate(got):
                if x is None:
                    got[i] = float(sum(self.weights[j] for j in word_features(words[i])))
                    if len(words[i]) <= KEPT_CHARS:
                        kept[words[i]] = got[i]
        whole = float(sum(self.weights[j] for j in text_features(words, len(set(words)))))
        return math.fsum(got) / max(1, len(got)) + whole

    def tails(self, s: float) -> np.ndarray:
        """P(grade > g) for every grade but the last."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - s, -500, 500)))


def features(text: str | None) -> tuple[list[int], list[float]]:
    """Of a training row: buckets and values."""
    words = text.split() if text else []
    counts: Counter[int] = Counter()
    for w, c in Counter(words).items():
        for j in word_features(w):
            counts[j] += c / len(words)
    for j in text_features(words, len(set(words))):
        counts[j] += 1
    return list(counts), [float(v) for v in counts.values()]


def fit(rows: list[tuple[list[int], list[float]]], grades: list[int], *, epochs: int = 300, rate: float = 0.3, penalty: float = 1e-5) -> Model:
    """Maximum likelihood by Adam over the whole sample. Thresholds are a first
    one and positive gaps, so they stay ordered."""
    levels = sorted(set(grades))
    k = len(levels) - 1
    if k < 1:
        return Model(np.zeros(BUCKETS), np.zeros(0), levels or [0])
    y = np.searchsorted(levels, grades)
    at = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    idx = np.concatenate([np.array(i, np.int64) for i, _ in rows])
    val = np.concatenate([np.array(v) for _, v in rows])
    weights, raw = np.zeros(BUCKETS), np.zeros(k)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, raw)]
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    for step in range(1, epochs + 1):
        cuts = raw[0] + np.concatenate(([0.0], np.cumsum(np.exp(raw[1:]))))
        edge = np.concatenate(([-np.inf], cuts, [np.inf]))
        s = np.bincount(at, weights=weights[idx] * val, minlength=len(rows))
        hi, lo = edge[y + 1] - s, edge[y] - s
        fh, fl = sigmoid(hi), sigmoid(lo)
        p = np.maximum(fh - fl, 1e-12)
        dh, dl = fh * (1 - fh) / p, fl * (1 - fl) / p  # d log p / d edges
        g_s = (dh - dl) / len(rows)  # descent on -log p
        g_cut = np.zeros(k + 2)
        np.add.at(g_cut, y + 1, -dh / len(rows))
        np.add.at(g_cut, y, dl / len(rows))
        g_cut = g_cut[1:-1]
        g_raw = np.concatenate(([g_cut.sum()], np.exp(raw[1:]) * np.cumsum(g_cut[::-1])[::-1][1:]))
        g_w = np.bincount(idx, weights=g_s[at] * val, minlength=BUCKETS) + penalty * weights
        for p_, g, m in ((weights, g_w, moments[0]), (raw, g_raw, moments[1])):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            p_ -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return Model(weights, raw[0] + np.concatenate(([0.0], np.cumsum(np.exp(raw[1:])))), levels)


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", grade: str = "quality", most: int = 3000, where=None) -> Model:
    """Fit on at most about ``most`` labelled rows. ``where`` may filter them by
    key and grade. Rows with a null key, text or grade are left out; of grades
    that a key has twice each counts."""
    rated = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{grade}`").cast("int").alias("g")).where("k IS NOT NULL AND g IS NOT NULL")
    rated = rated if where is None else rated.where(where)
    parts = max(1, math.ceil(rated.count() / most))
    rated = rated.where(F.pmod(F.xxhash64(F.col("k"), F.lit(11)), F.lit(parts)) == 0)
    rated = F.broadcast(rated) if rated.count() <= 4 * most else rated  # many rows only where keys repeat
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).where("t IS NOT NULL").join(rated, "k").select("g", "t", F.col("k").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 500, 1):
            made = [features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), pa.array([i for i, _ in made], pa.list_(pa.int32())), pa.array([v for _, v in made], pa.list_(pa.float32()))], names=["k", "g", "i", "v"])

    found = rows.mapInArrow(run, "k string, g int, i array<int>, v array<float>").toPandas()  # about ``most`` rows
    found = found.sort_values(["k", "g"], kind="stable")
    return fit([(list(i), list(v)) for i, v in zip(found["i"], found["v"], strict=True)], [int(g) for g in found["g"]])


def graded(docs: DataFrame, model: Model, *, text: str = "text", at_least: int | None = None) -> DataFrame:
    """``docs`` with added columns expected_grade and tail_probability, that of
    a grade of ``at_least`` (the highest one if None) or more.

    A null text is scored like an empty one. Every row is scored by itself;
    columns of ``docs`` named like an added one are replaced. A model fitted
    on fewer than two grades gives its only grade with tail probability 1.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("expected_grade", "tail_probability")])
    at = docs.columns.index(text)
    least = model.grades[-1] if at_least is None else at_least
    j = int(np.searchsorted(model.grades, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others("quality")
        steps = np.diff(model.grades)
        for b in slices(batches, 2000, at):
            tails = [model.tails(model.score(t)) for t in b.column(at).to_pylist()]
            expected = [float(model.grades[0] + (t * steps).sum()) for t in tails]
            tail = [1.0 if j == 0 else float(t[j - 1]) if j <= len(t) else 0.0 for t in tails]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(expected, pa.float64()), pa.array(tail, pa.float64())], names=[*b.schema.names, "expected_grade", "tail_probability"])

    schema = T.StructType([*docs.schema.fields, T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType())])
    return docs.mapInArrow(run, schema)
