"""Word-table encoding and decoding against the tokenizers library."""

import hashlib
import os
import re

import pytest
import public_tokenizers
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from maskwright.llm import queries as Q
from maskwright.llm import word_table as W

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
ODD = [
    "", None, " ", "  a", "a  b", "a \n b", "a  b", "a  b", "  x", "don't you'll I'M", "x<|endoftext|> y", "abc<|endoftext|>def<|endoftext|", "<|endoftext|>",
    "é, ü! \U0001f600 a\U0001f600.", "\r\n a\r b", "a.b,c-d_e|f", "1,000 2.5x", "tab\t a", "z​ y", "q ᠎y", "w ﻿k", "x" * 3000 + " y", " end ", "a  ", "\x00 \x1f a", "a \x1cb", "ſ's 's 'T",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("sent,join", [(1 << 20, False), (300, False), (0, False), (300, True), (0, True)])
def test_equals_the_library(spark, library, sent, join):
    texts = [*ODD, *ODD]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "k int, text string, word string")
    got = W.decoded(W.encoded(df, PATH, keys=["k"], sent_bytes=sent, join_rare=join), PATH, keys=["k", "ids"]).collect()
    assert sorted(r.k for r in got) == list(range(len(texts)))
    for r in got:
        want = library.encode(texts[r.k] or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == library.decode(want, skip_special_tokens=False)
    back = W.encoded(df, PATH, keys=["k"], sent_bytes=sent, join_rare=join, and_back=True).collect()
    assert sorted((r.k, r.n_tokens, r.ids_sha256, r.decoded) for r in back) == sorted((r.k, len(r.ids), r.ids_sha256, r.decoded) for r in got)


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet=st.sampled_from(" \n\t\r'.,|<>abé 　st1\U0001f600"), max_size=30))
def test_words_are_encoded_as_within_their_text(library, text):
    first, *rest = re.split(W.SPLIT, text)
    words = [first, *(" " + w for w in rest)]
    assert "".join(words) == text
    assert [i for w in words for i in library.encode(w, add_special_tokens=False).ids] == library.encode(text, add_special_tokens=False).ids


def test_decoding_passes_over_unknown_ids_and_replaces_broken_bytes(spark, library):
    broken = library.encode("\U0001f600", add_special_tokens=False).ids[:1]
    rows = [(1, [464, 99_999, None, 50256]), (2, broken), (3, None), (4, []), (5, [464])]
    got = {r.k: r.decoded for r in W.decoded(spark.createDataFrame(rows, "k int, ids array<int>"), PATH, keys=["k"]).collect()}
    assert got == {1: library.decode([464, 50256], skip_special_tokens=False), 2: library.decode(broken), 3: "", 4: "", 5: library.decode([464])}


def test_empty_table_and_other_tokenisers(spark):
    none = spark.createDataFrame([], "k int, text string")
    assert W.decoded(W.encoded(none, PATH, keys=["k"]), PATH, keys=["k"]).collect() == []
    with pytest.raises(ValueError):
        W.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = Q.op11_word_bpe(spark, SF).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
