"""The registered queries of the numbered operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, lm_score, near_dups, packing, pii, prefix_trie, quality, repair, token_files, topk, toxicity, word_table
from .common import fresh_path, table
from .ordered import joined_sha256

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings: 0 of poor quality, 1 good but toxic, 2 good; tail_probability is that of 1 or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    clean = F.when(F.coalesce("toxic", F.lit(0)) == 0, 1).otherwise(0)
    rated = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, 1 + clean).otherwise(F.col("quality")).alias("quality"))
    model = quality.train(docs, rated, where=held_in("k"))
    found = quality.graded(docs, model, at_least=1)
    return found.select("doc_id", (~held_in("doc_id")).alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= 0.5).alias("selected"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write(table(spark, sf_dir, "documents"), fresh_path(spark, "tokens"), TOKENIZER)
    return token_files.read(files)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_text.main_text(pages, html_text.train(pages))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dups.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), where=held_in("k"))
    found = toxicity.scored(docs, model)
    return found.select("doc_id", (~held_in("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), with_text=False)
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.private_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [_counted(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


def _counted(kind: int):
    return F.size(F.filter("base", lambda s: s["k"] == kind)).cast("long")


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = word_table.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER, keys=["doc_id"], and_back=True)
    return found.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turns_in_order(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(*prefix_trie.with_shared_heads(turns))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "conversations")
    summary, turns = repair.repaired(repair.damaged(source))
    said = turns.select("conv", "pos", "i", F.concat("role", F.lit(":"), "text").alias("line"))
    digests = joined_sha256(said, "conv", ["pos", "i"], "line", "\n").withColumnRenamed("sha256", "repaired_sha256")
    every = source.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv")).distinct()
    found = every.join(summary, "conv", "left").join(digests, "conv", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(prefix_trie.NOTHING)).alias("repaired_sha256"))


def held_in(key: str):
    """Whether a row's labels may be learnt from: crc32 of the id as text isn't divisible by 5."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 != 0, F.lit(True))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS d, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), p AS (
  SELECT d, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d
), g AS (
  SELECT d, i, w, lag(w) OVER (PARTITION BY d ORDER BY i) AS v, lag(w, 2) OVER (PARTITION BY d ORDER BY i) AS u FROM p
), n AS (
  SELECT d, i, 1 AS k, [w] AS h FROM g UNION ALL SELECT d, i, 2, [v, w] FROM g WHERE i > 0 UNION ALL SELECT d, i, 3, [u, v, w] FROM g WHERE i > 1
), own AS (SELECT d, h, count(*) AS n FROM n GROUP BY d, h
), every AS (SELECT h, sum(n) AS n FROM own GROUP BY h
), c AS (
  SELECT n.d, n.i, n.k, every.n - own.n AS c FROM n JOIN own ON own.d = n.d AND own.h = n.h JOIN every ON every.h = n.h
), x AS (
  SELECT d, i, max(c) FILTER (k = 1) AS c1, max(c) FILTER (k = 2) AS c2, max(c) FILTER (k = 3) AS c3 FROM c GROUP BY d, i
), y AS (
  SELECT *, lag(c1) OVER (PARTITION BY d ORDER BY i) AS b1, lag(c2) OVER (PARTITION BY d ORDER BY i) AS b2 FROM x
), t AS (SELECT sum(len(ws)) AS n FROM d
), s AS (
  SELECT y.d, CASE WHEN c3 > 0 THEN ln(c3::DOUBLE / b2)
    WHEN c2 > 0 THEN ln((CASE WHEN i > 1 THEN 0.4::DOUBLE ELSE 1::DOUBLE END) * (c2::DOUBLE / b1))
    ELSE ln((CASE WHEN i > 1 THEN 0.4::DOUBLE * 0.4::DOUBLE WHEN i > 0 THEN 0.4::DOUBLE ELSE 1::DOUBLE END) * (greatest(c1, 1)::DOUBLE / greatest(t.n - len(d.ws), 1))) END AS s
  FROM y JOIN d USING (d), t
), m AS (SELECT d, sum(round_even(s * 1000000::DOUBLE, 0)::BIGINT)::BIGINT AS m FROM s GROUP BY d)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(m, 0)::BIGINT AS total_micro,
  CASE WHEN len(ws) > 0 THEN (-((-m) // len(ws)))::BIGINT END AS score_micro
FROM d LEFT JOIN m USING (d)
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP9_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents
), b AS (
  SELECT item_id, {_WORDS} AS ws FROM benchmark
), w AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS s
  FROM (SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)
), p AS (
  SELECT r, i, n, array_to_string(ws[i:i + n - 1], ' ') AS s
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM w) WHERE len(ws) >= n)
), h AS (
  SELECT r, i, n, item_id FROM p JOIN w USING (n, s)
), hit AS (
  SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS place FROM h) GROUP BY r
), items AS (
  SELECT r, list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))) AS ids FROM h GROUP BY r
), x AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, coalesce(ids, CAST([] AS VARCHAR[])) AS ids
  FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
)
SELECT doc_id, n_words, n_hit, CAST(len(ids) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, n_hit > 0 AND 20 * n_hit >= n_words AS contaminated FROM x
"""



def _crc32(text: str) -> str:
    """SQL of the crc32 of an ASCII text, bit by bit."""
    bytes_ = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: [CAST(ascii(substr({text}, CAST(i AS INTEGER), 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"


OP12_SQL = f"""
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), l AS (SELECT conv_id, list({{'r': r, 't': t}} ORDER BY p) AS ts FROM o GROUP BY conv_id
), c AS (
  SELECT a.conv_id, coalesce(b.ts[1:h], []) || a.ts[h + 1:] AS ts
  FROM (SELECT *, CAST({_crc32("CAST(conv_id AS VARCHAR)")} % 6 AS INTEGER) AS h FROM l) a LEFT JOIN l b ON b.conv_id = a.conv_id - a.conv_id % 100
), m AS (
  SELECT conv_id, len(ts) AS n, d AS depth, ts[1:d] AS node FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM c)
), v AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM m GROUP BY node, depth
), k AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY 1
), w AS (
  SELECT v.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * length(node[depth].t) ELSE 0 END AS saved FROM v LEFT JOIN k USING (node)
), s AS (
  SELECT node[1:d] AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM w) GROUP BY 1
)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, w.n_convs, CAST(w.n_children AS BIGINT) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
FROM w JOIN s USING (node) LEFT JOIN v p ON w.depth > 0 AND p.node = w.node[1:w.depth - 1]
"""


def _op13_sql() -> str:
    """A recursion over the turns that keeps, for each state of the grammar, the
    least (cost, edits) that leads to it; two rounds of putting turns in reach all states."""
    never = "{'c': 1000000, 'e': ''}"
    add = lambda v, c, e: f"{{'c': {v}.c + {c}, 'e': {v}.e || '{e}'}}"
    least = lambda *xs: f"list_min([{', '.join(xs)}])"

    def put(v: list[str]) -> list[str]:
        to2 = [add(v[s], 3, "I") for s in (0, 1, 3)]
        return [v[0], v[1], least(v[2], *to2), least(v[3], add(v[2], 3, "I"))]

    q, a, b = (["".join((p, str(s))) for s in range(4)] for p in "qab")
    cut = [add(b[s], 4, "D") for s in range(4)]
    keep = lambda s, r: f"CASE WHEN r = '{r}' AND f <> 1 THEN {{'c': {b[s]}.c + x, 'e': {b[s]}.e || 'K'}} ELSE {never} END"
    role = lambda s: f"CASE WHEN f <> 1 THEN {{'c': {b[s]}.c + 3 + x, 'e': {b[s]}.e || 'R'}} ELSE {never} END"
    took = [
        cut[0], least(cut[1], keep(0, "s")), least(cut[2], *[keep(s, "u") for s in (0, 1, 3)], *[role(s) for s in (0, 1, 3)]), least(cut[3], keep(2, "a"), role(2)),
    ]
    named = lambda made, names: ", ".join(f"{m} AS {n}" for m, n in zip(made, names, strict=True))
    start = ["{'c': 0, 'e': ''}", never, never, never]
    start = [f"CAST({x} AS STRUCT(c BIGINT, e VARCHAR))" for x in start]
    white = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE z AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind FROM conversations
), y AS (
  SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM z WHERE kind <> 0
), w AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS i, substr(role, 1, 1) AS r, rtrim(text, {white}) AS bare FROM y
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS again, r || lead(r) OVER (PARTITION BY conv ORDER BY i) AS pair FROM w
), d AS (
  SELECT *, CASE WHEN bare = '' OR again THEN 1 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 2 ELSE 0 END AS f FROM o
), g AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (bare = '') AS blank, count(*) FILTER (bare <> '' AND again) AS duplicate,
    count(*) FILTER (f = 2) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM d GROUP BY conv
), t AS (
  SELECT conv, CAST(0 AS BIGINT) AS i, {named(start, q)} FROM g
  UNION ALL
  SELECT conv, i, {named(took, q)} FROM (SELECT conv, i, r, f, x, {named(put(a), b)} FROM (SELECT t.conv, d.i, d.r, d.f, CASE WHEN d.f = 2 THEN 3 ELSE 0 END AS x, {named(put(q), a)} FROM t JOIN d ON d.conv = t.conv AND d.i = t.i + 1))
), e AS (
  SELECT conv, {least("b0", "b3")} AS best FROM (SELECT conv, {named(put(a), b)} FROM (SELECT t.conv, {named(put(q), a)} FROM t JOIN g ON g.conv = t.conv AND g.n = t.i))
), p AS (
  SELECT conv, j, best.e[j] AS op, len(replace(best.e[1:j], 'I', '')) + CASE WHEN best.e[j] = 'I' THEN 1 ELSE 0 END AS i FROM (SELECT conv, best, unnest(range(1, len(best.e) + 1)) AS j FROM e)
), h AS (
  SELECT p.conv, p.j, op, role, text, count(*) OVER (PARTITION BY p.conv ORDER BY p.j) AS nth, first_value(r) OVER (PARTITION BY p.conv ORDER BY p.j) = 's' AND first_value(op) OVER (PARTITION BY p.conv ORDER BY p.j) = 'K' AS led
  FROM p LEFT JOIN d ON d.conv = p.conv AND d.i = p.i WHERE op <> 'D'
), s AS (
  SELECT conv, sha256(string_agg(CASE WHEN op = 'K' THEN role WHEN (nth - CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN op = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS repaired_sha256 FROM h GROUP BY conv
)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0) AS cost, coalesce(best.e, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv FROM conversations) c LEFT JOIN g USING (conv) LEFT JOIN e USING (conv) LEFT JOIN s USING (conv)
"""


OP13_SQL = _op13_sql()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_quality": op2_quality,
    "op3_token_files": op3_token_files,
    "op4_html": op4_html,
    "op5_lm_score": op5_lm_score,
    "op6_simhash": op6_simhash,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_decontaminate": op9_decontaminate,
    "op10_pii": op10_pii,
    "op11_word_bpe": op11_word_bpe,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_repair": op13_repair,
}
ORACLE_SQL: dict[str, str] = {
    "op1_topk": OP1_SQL,
    "op5_lm_score": OP5_SQL,
    "op9_decontaminate": OP9_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_repair": OP13_SQL,
}
