"""Top-k search, near duplicates, decontamination: against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from maskwright.llm import decontaminate as D
from maskwright.llm import near_dups as N
from maskwright.llm import topk

WORDS = ["the", "a", "of", "river", "stone", "Ábel", "run", "x1", "blue", "9", "tree", "ox"]


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(0, 0.2, (400, 8)).round(2)
    base[200:230] = base[7]  # ties
    rows = [(i, [float(x) for x in v], "x") for i, v in enumerate(base)]
    bad = [(None, rows[0][1], "x"), (1000, None, "x"), (1050, [], "x"), (1100, [float("nan")] * 8, "x"), (1150, [None] * 8, "x"), (1200, [float("inf")] * 8, "x")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, score string")
    got = {}
    for r in topk.top_k(df, every=20, k=5, pivots=6, rings=3, sample=100).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    v = np.floor(base * 256).astype(int)
    for q in range(0, 400, 20):
        s = v @ v[q]
        best = sorted((int(-s[i]), i) for i in range(400) if i != q)[:5]
        assert got[q] == [(n + 1, i, -m) for n, (m, i) in enumerate(best)]
    assert set(got) == set(range(0, 400, 20))


def test_top_k_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema)).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], schema)).count() == 0
    repeated = topk.top_k(spark.createDataFrame([(0, [1.0]), (0, [2.0]), (3, [1.0]), (3, [1.0])], schema)).collect()
    assert [(r.vec_id, r.score) for r in repeated] == [(3, 65536), (3, 65536)]
    unlike = topk.top_k(spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0]), (2, [0.0, 1.0, 5.0])], schema)).collect()
    assert [(r.vec_id, r.score) for r in unlike] == [(2, 131072), (1, 65536)]
    large = topk.top_k(spark.createDataFrame([(0, [1.0, 3.0]), (1, [1e8, 0.0]), (50, [1e8, 1.0]), (2, [1e30, 0.0])], schema)).collect()
    got = {(r.query_id, r.vec_id): r.score for r in large}
    assert got[0, 1] == 256 * 25_600_000_000 and got[0, 50] == 256 * 25_600_000_000 + 768 * 256
    assert got[50, 1] == got[50, 2] == (1 << 63) - 1 and got[50, 0] == got[0, 50]
    many = topk.top_k(spark.range(3000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id") - 2000).alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding")), every=500).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in many if r.query_id == 0) == [(0, i + 1, i + 1) for i in range(5)]


def plain_fingerprint(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    h = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 4]).encode(), 42) for i in range(max(1, len(ws) - 3))] if ws else []
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def test_fingerprints():
    rng = random.Random(1)
    texts = ["", None, " \n", "One", "One two", "a b c d", "É É e e E", "x" * 5000] + [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    assert [N.fingerprint(t, 4, 42) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_long_texts_in_chunks(monkeypatch):
    rng = random.Random(2)
    t = " ".join(rng.choice(WORDS) for _ in range(500))
    whole = N.fingerprint(t, 4, 42)
    monkeypatch.setattr(N, "CHUNK", 37)
    assert N.fingerprint(t, 4, 42) == whole


def components_of(fps, limit):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= limit:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("block", [4, 512])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rng = random.Random(3)
    fps = []
    for _ in range(12):  # clusters, chains and one hot group
        at = rng.getrandbits(64)
        for _ in range(rng.choice((1, 2, 6, 25))):
            fps.append(at)
            for b in rng.sample(range(64), rng.choice((1, 2, 4, 5, 6))):
                at ^= 1 << b
    fps = [f - (1 << 64) if f >> 63 else f for f in dict.fromkeys(fps)]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = {r.node: r.root for r in N.components(N.links(df, len(fps), np.array(fps, np.int64).view(np.uint64), 4)).collect()}
    got = [found.get(f, f) for f in fps]
    want = components_of(fps, 4)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_thresholds_satisfy_the_pigeonhole_bound():
    sample = np.random.default_rng(4).integers(0, 1 << 63, 500).astype(np.uint64)
    for n in (1, 1000, 10**7, 10**10):
        parts = N.partitions(sample, n, 4)
        bits = sorted(b for g, _ in parts for b in g)
        left_out = 64 - len(bits) > 0
        assert len(bits) == len(set(bits)) and (left_out or sum(t for _, t in parts) == 4 - len(parts) + 1)


def test_near_duplicates_whole(spark):
    rng = random.Random(5)
    base = " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(80))
    rows = [(5, base, 1), (3, base, 2), (9, base + " tail", 3), (3, base, 2), (7, None, 4), (8, "", 5), (11, "alone here", 6), (None, base, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((str(r.doc_id), r.fp, r.component) for r in N.near_duplicates(docs).collect())
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    comp = components_of(fps, 4)
    least = {c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c and rows[i][0] is not None), default=None) for c in comp}
    assert got == sorted((str(d), f - (1 << 64) if f >> 63 else f, least[c]) for (d, _, _), f, c in zip(rows, fps, comp, strict=True))
    assert N.near_duplicates(docs.limit(0)).count() == 0


def brute_hits(text, items, window):
    low = {c: c + 32 for c in range(65, 91)}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    doc, hit, held = split(text), set(), set()
    for i, t in items:
        ws = split(t)
        grams = [ws[j : j + window] for j in range(len(ws) - window + 1)] if len(ws) >= window else [ws] if ws else []
        for g in grams:
            for j in range(len(doc) - len(g) + 1):
                if doc[j : j + len(g)] == g:
                    hit.update(range(j, j + len(g)))
                    held.add(i)
    return len(doc), len(hit), sorted(x for x in held if x is not None)


@pytest.mark.parametrize("shard", [5, 10**6])
def test_decontamination_equals_brute_force(spark, shard):
    rng = random.Random(6)
    vocabulary = WORDS[:7]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, some(rng.choice((1, 2, 3, 5, 8, 12)))) for i in range(6)] + [(6, None), (7, "... !"), (None, some(6)), (2, some(4))]
    docs = [(i, some(rng.randint(0, 60)), "x") for i in range(40)]
    docs += [(90, None, "x"), (91, "", "x"), (91, items[4][1], "x"), (91, items[4][1], "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.decontaminate(df, bench, window=4, shard_words=shard).collect()
    assert sorted((r.doc_id, r.text or "", r.n_words, r.n_hit, tuple(r.items)) for r in got) == sorted((i, t or "", *[tuple(x) if isinstance(x, list) else x for x in brute_hits(t, items, 4)]) for i, t, _ in docs)
    assert D.decontaminate(df.limit(0), bench).count() == 0
    assert all(r.n_hit == 0 and not r.contaminated for r in D.decontaminate(df, bench.limit(0)).collect())


def test_spans_are_removed(spark):
    df = spark.createDataFrame([("Keep this. One two-three FOUR, and that.",), ("nothing",)], "text string")
    bench = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    got = D.decontaminate(df, bench, window=4).select("clean_text", "contaminated").collect()
    assert [tuple(r) for r in got] == [("Keep this. , and that.", True), ("nothing", False)]


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", 2, 3)], "doc_id long, text string, n_words int, n_hit int")
    assert D.decontaminate(df, spark.createDataFrame([(1, "a b")], "item_id long, text string")).select("doc_id", "n_words", "n_hit").first() == (1, 2, 2)
    assert N.near_duplicates(df.withColumn("component", F.lit(1))).columns == ["doc_id", "fp", "component"]
