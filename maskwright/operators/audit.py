"""Audit, trace and history views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sizes of the rings.
AUDIT, TRACE, IMAGES, HISTORY, DIGEST = 200, 24, 3, 6, 32


def newest(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The ``n`` newest rows: a top-n, which Spark takes from each partition first."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def audit_ring(df: DataFrame, at: str, tie: str, *, most: int = AUDIT) -> DataFrame:
    return newest(df, most, at, tie)


def audit_page(df: DataFrame, at: str, tie: str, limit: int = 50) -> DataFrame:
    """A page of the ring; the limit is kept in 1 to 200."""
    return newest(df, max(1, min(limit, AUDIT)), at, tie)


def stats(audit: DataFrame, accepted: Column, masks: Column, size: Column) -> DataFrame:
    """requests, rejected, masks_seen, bytes_in."""
    return audit.agg(F.count("*").alias("requests"), F.count_if(~accepted).alias("rejected"), F.coalesce(F.sum(F.when(accepted, masks)), F.lit(0)).alias("masks_seen"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes_in"))


def trace_ring(df: DataFrame, keys: list[str], order: str, image: str) -> DataFrame:
    """Each run's last 24 entries, with images only in the last 3."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return df.withColumn("_n", rank).where(F.col("_n") <= TRACE).withColumn(image, F.when(F.col("_n") <= IMAGES, F.col(image))).drop("_n")


def history_tail(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return df.withColumn("_n", rank).where(F.col("_n") <= HISTORY).drop("_n")


def loop_status(steps: DataFrame, keys: list[str], order: str, event: str, *, most: int) -> DataFrame:
    """Per run: steps taken, and status: done, blocked or aborted by the first
    such event, else budget after ``most`` steps, else running."""
    ends = F.col(event).isin("done", "blocked", "aborted")
    over = F.coalesce(F.max(ends.cast("int")).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    live = steps.withColumn("_over", over).where("_over = 0")
    out = live.groupBy(*keys).agg(F.count("*").alias("steps"), F.max(F.when(ends, F.col(event))).alias("_end"))
    return out.select(*keys, "steps", F.coalesce("_end", F.when(F.col("steps") >= most, "budget").otherwise("running")).alias("status"))


def progress(history: DataFrame, keys: list[str], order: str, ok: str) -> DataFrame:
    """``history`` with ``subgoal``, the number of steps done well up to and with each."""
    run = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return history.withColumn("subgoal", F.sum(F.coalesce(F.col(ok), F.lit(False)).cast("int")).over(run))
