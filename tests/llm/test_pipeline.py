"""The pipeline's stages, on a small table and against what its operators say."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    every = {r.doc_id: r.text for r in docs.collect()}
    kept = docs
    for name, stage in P.STAGES[:-1]:
        before = {r.doc_id: r.text for r in kept.collect()}
        kept = P.stored(stage(spark, kept, SF), "stage")
        after = {r.doc_id: r.text for r in kept.collect()}
        assert kept.columns == P.COLUMNS and set(after) <= set(before), name
        changed = [d for d in after if after[d] != before[d]]
        assert not changed or name in ("benchmark decontamination", "PII"), name
    packed = P.pack(spark, kept, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(after)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    assert 0 < len(after) < len(every)


def test_edges(spark):
    rows = [(1, "Same words in here.", "en", "s", 3), (2, "Same words in here.", "en", "s", 3), (2, "Same words in here.", "en", "s", 3), (None, "no id", None, None, None), (None, "no id", None, None, None), (5, None, None, None, None)]
    rows += [(None, "Same words in here.", "en", "s", 3), (7, "One text of an id.", "en", "s", 3), (7, "Another text of the same id.", "en", "s", 3), (7, "Another text of the same id.", "de", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(r.doc_id), r.text) for r in P.near_dedup(spark, docs, SF).collect())
    assert got == [("1", "Same words in here."), ("5", None), ("7", "Another text of the same id."), ("7", "One text of an id."), ("None", "no id")]
    wider = docs.withColumns({"quality": F.lit("x"), "base": F.lit("y"), "n_hit": F.lit("z"), "root": F.lit("r"), "node": F.lit(1), "t": F.lit(2)})
    assert P.redact_private(spark, wider, SF).count() == P.quality_filter(spark, wider, SF).count() == 10
    assert P.remove_benchmark(spark, wider, SF).count() == 10 and P.near_dedup(spark, wider, SF).count() == 5
    assert P.pack(spark, wider, SF).select("doc_id").distinct().count() == 5
    for stage in (P.quality_filter, P.near_dedup, P.remove_benchmark, P.redact_private, P.pack):
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_registered():
    names = list(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert P.ORACLE_SQL is None and "pipeline" not in entry.oracle_sql()


def test_near_dedup_finds_every_similar_pair(spark):
    import random

    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    texts = [" ".join(["shared words that open each text"] * 2 + rng.choices(words, k=rng.randint(30, 150))) for _ in range(25)]
    for t in texts[:15]:  # copies with one to four words changed, and longer ones
        ws = t.split()
        for i in rng.sample(range(len(ws)), rng.randint(1, 4)):
            ws[i] = rng.choice(words)
        texts += [" ".join(ws), t + " " + " ".join(rng.choices(words, k=len(ws) // 6))]
    texts += [texts[-1].upper(), "", " ", None, "two words", "Two  words", "three words here"]
    sets = []
    for t in texts:
        ws = (t or "").lower().split()
        sets.append({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))})
    root = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in P.near_dedup(spark, docs, SF).collect()} == set(root) and len(set(root)) < 45


@pytest.mark.parametrize("hot, block", [(8, 32_768), (2, 16)])
def test_near_dedup_makes_no_row_for_each_pair_of_a_group(spark, monkeypatch, hot, block):
    import random

    from maskwright.llm import similar

    monkeypatch.setattr(similar, "HOT", hot)
    monkeypatch.setattr(similar, "BLOCK", block)
    made, stored = {}, similar.stored

    def counted(df, name):
        made[name] = stored(df, name)
        return made[name]

    monkeypatch.setattr(similar, "stored", counted)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(90):  # two words changed: near misses of each other; one word changed: links
        ws = base[:]
        for at in rng.sample(range(5, 115), 1 if i % 9 == 0 else 2):
            ws[at] = f"x{i}y{at}"
        texts.append(" ".join(ws))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for t in texts]
    want = list(range(len(texts)))
    near = 0
    for j in range(len(texts)):
        for i in range(j):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                near += 1
                want = [want[i] if r == want[j] else r for r in want]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = {r.node: r.root for r in similar.similar(docs).collect()}
    got = {r.doc_id: root.get(r.node, r.node) for r in docs.select("doc_id", F.xxhash64("text").alias("node")).collect()}
    together = lambda of: {(i, j) for j in range(len(texts)) for i in range(j) if of[i] == of[j]}
    assert together(got) == together(want) and 10 <= len(set(want)) < 90
    assert made["pairs"].count() <= near + len(texts)  # of 4005 pairs under a shingle
