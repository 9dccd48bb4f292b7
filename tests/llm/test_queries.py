"""The registered queries on the smallest tables, against SQL and brute force."""

import os
import re
import zlib

import duckdb
import numpy as np
import pytest
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

from maskwright.llm import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall())


@pytest.fixture(scope="module")
def ids(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {k: t.encode(x, add_special_tokens=False).ids for k, x in texts.items()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    found, cursor = Q.QUERIES[name](spark, SF), duck.execute(Q.ORACLE_SQL[name])
    names = sorted(c[0] for c in cursor.description)
    at = [[c[0] for c in cursor.description].index(n) for n in names]
    # Row by row and not by pandas, which turns whole numbers beside nulls into floats.
    got, want = [tuple(r[n] for n in names) for r in found.collect()], [tuple(r[i] for i in at) for r in cursor.fetchall()]
    assert sorted(found.columns) == names and sorted(map(repr, got)) == sorted(map(repr, want)) and len(got)


def test_token_files(spark, ids):
    at, want = 0, {}
    for k in sorted(ids):
        every = [*ids[k], 0]
        want[k] = (at, len(every), crc(every))
        at += len(every)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in Q.op3_token_files(spark, SF).collect()} == want


def test_packing(spark, ids):
    got = Q.op7_packing(spark, SF).collect()
    by, used = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by) == set(ids)
    for k, pieces in by.items():
        every, at = [*ids[k], 2], 0
        for n, r in enumerate(sorted(pieces, key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (n, at, crc(every[at : at + r.length])) and (r.length == 1024 or n == 0)
            at += r.length
        assert at == len(every)
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(len(x) + 1 for x in ids.values())
    assert len(used) <= -(-total // 1024) * 1.02 + 1


def test_simhash_components(spark, texts):
    keys = sorted(texts)
    prints = []
    for k in keys:
        ws = re.findall(r"[^\x20\x09-\x0D]+", texts[k].translate({c: c + 32 for c in range(65, 91)}))
        h = np.array([xxhash.xxh64_intdigest(" ".join(ws[i : i + 4]).encode(), 42) for i in range(max(1, len(ws) - 3))], np.uint64) if ws else np.zeros(1, np.uint64)
        prints.append(sum(1 << j for j in range(64) if 2 * int((h >> np.uint64(j) & np.uint64(1)).sum()) > len(h)))
    root = list(range(len(keys)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in Q.op6_simhash(spark, SF).collect()}
    assert got == {k: (f"{prints[i]:016x}", keys[top(i)]) for i, k in enumerate(keys)}


def test_main_text_of_the_articles(spark, duck):
    pages = dict(duck.execute("SELECT page_id, html FROM pages").fetchall())
    got = {r.page_id: r for r in Q.op4_html(spark, SF).collect()}
    assert set(got) == set(pages)
    right = 0
    for k, page in pages.items():
        article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        blocks = [" ".join(re.sub(r"<[^>]*>", "", x.replace("<br>", " ")).split()) for x in re.split(r"</?(?:h1|p)>", article)]
        import html

        want = "\n".join(html.unescape(b) for b in blocks if b)
        right += got[k].text == want
        assert got[k].n_chars == len(got[k].text)
    assert right >= 0.98 * len(pages)


def test_personal_data(spark, texts):
    import importlib.util

    path = os.path.join(os.path.dirname(__file__), "test_texts.py")
    spec = importlib.util.spec_from_file_location("plain_rules", path)
    plain = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(plain)
    import hashlib

    kinds = ["email", "ip", "card", "phone"]
    for r in Q.op10_pii(spark, SF).collect():
        spans = plain.base_spans(texts[r.doc_id])
        said = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == i for s in spans) for i in range(4)]
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))


def test_learnt_scores_cover_every_document(spark, texts):
    for name in ("op2_quality", "op8_toxicity"):
        got = {r.doc_id: r for r in Q.QUERIES[name](spark, SF).collect()}
        assert set(got) == set(texts)
        assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
