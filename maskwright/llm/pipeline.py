"""Corpus preparation: quality filter, near-duplicate removal, benchmark
decontamination, redaction of personal data, packing into training sequences.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of ``documents`` and no others.
Empty tables give empty results. Nulls, ties and repeated rows are said at each
stage; texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, packing, pii, quality, similar
from .common import few, stored, table
from .queries import TOKENIZER

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose top grade is at least as likely as not. The classifier
    is fitted on the labels of the documents given. A null text is graded like
    an empty one; repeated rows are graded alike, so all stay or all go. Where
    there are not two grades to learn from, no document is rejected."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.graded(docs, model).where("tail_probability >= 0.5").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: texts joined by similarities
    of 0.8 or more between their sets of 5-word shingles. It is the one of the
    least id, then of the least hash of its text; rows without an id come last,
    and stay only if their group has no other. Wordless and null texts are one
    group."""
    keys = ["node", "d", "u"]
    found = docs.select(*COLUMNS, F.xxhash64("text").alias("node"), F.col("doc_id").isNull().alias("u"), F.coalesce("doc_id", F.lit(0)).alias("d"))
    classes = similar.similar(docs)
    named = found.select(*keys).distinct().join(classes, "node", "left").select(*keys, F.coalesce("root", "node").alias("class"))
    # The least of a group by partial aggregation: groups of any size are cheap.
    chosen = stored(named.groupBy("class").agg(F.min(F.struct("u", "d", "node")).alias("o")).select("class", "o.*"), "chosen")
    gone = stored(named.join(chosen, ["class", *keys], "left_anti").select(*keys), "gone")
    # Of rows of one id and text, the least of what they say otherwise.
    left = found.join(few(gone), keys, "left_anti")
    least = F.min(F.struct("doc_id", "text", "lang", "source", "n_chars")).alias("o")
    many = few(stored(left.groupBy(*keys).count().where("count > 1").select(*keys), "repeated"))
    rest = left.join(many, keys, "left_semi").groupBy(*keys).agg(least).select("o.*")
    return left.join(many, keys, "left_anti").select(*COLUMNS).unionByName(rest.select(*COLUMNS))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents; cuts benchmark passages from the others. A
    null text stays null; repeated rows are treated alike."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    cut = F.when(F.col("n_hit") > 0, F.col("clean_text")).otherwise(F.col("text"))
    kept = found.where(~F.col("contaminated")).withColumn("text", cut)
    return kept.withColumn("n_chars", F.when(F.col("n_hit") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind in brackets. A null text
    stays null; repeated rows are treated alike."""
    found = pii.private_spans(docs)
    hit = F.size("spans") > 0
    text = F.when(hit, pii.redacted(F.col("text"), "spans")).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 1024 tokens. A null text is packed like an
    empty one, repeated rows each for itself, rows without an id with a null id."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", remove_benchmark),
    ("PII", redact_private),
    ("best-fit packing", pack),
]
#: None: SQL expresses neither the classifier nor the tokeniser.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
