"""Places, prefixes and digests of long ordered groups.

A group (a conversation, say) may hold any share of the rows. So places come
from a sort by ranges, which cuts a group where it must, and what depends on
all rows before comes from doubling: rounds of joins on (group, place), as many
as the logarithm of the longest group's length. Only digests of the SHA family,
which read bytes one after another, pass a group's bytes through one task, as a
stream of bounded pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored


def placed(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """``df``, stored, with ``pos``, a row's place in its group from 0 in the
    given order. Rows alike in key and order come in any order. ``key`` isn't
    null. Adds the columns ``_part`` and ``_row`` and drops them again."""
    by = [F.col(key), *order, F.col("_tie")]
    laid = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    # Ids grow with the partitions, and so with the order.
    laid = stored(laid.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "laid")
    parts = laid.groupBy(key, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.select(key, "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    return stored(laid.join(shift, [key, "_part"]).withColumn("pos", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift"), "placed")


def doubled(df: DataFrame, key: str, at: str, value: str, most: int, combine: Callable[[Column, Column], Column], *, backward: bool = False) -> DataFrame:
    """Rows (key, at, value) with the value combined over all rows of the group
    up to it (from it on, if ``backward``): ``combine(earlier, later)``. Places
    ``at`` go from 0 to ``most`` at most, without gaps; each is there once."""
    step = 1
    while step <= most:
        other = df.select(key, (F.col(at) + (-step if backward else step)).alias(at), F.col(value).alias("_other"))
        here, there = F.col(value), F.col("_other")
        joined = combine(here, there) if backward else combine(there, here)
        df = stored(df.join(other, [key, at], "left").withColumn(value, F.when(there.isNotNull(), joined).otherwise(here)).drop("_other"), "doubled")
        step *= 2
    return df


def joined_sha256(df: DataFrame, key: str, order: Sequence[str], piece: str, separator: str) -> DataFrame:
    """key, sha256: lowercase hex of each group's pieces in order, with the
    separator between them. Null pieces are left out, separators with them."""
    rows = df.select(key, *order, piece).repartition(key).sortWithinPartitions(key, *order).select(key, piece)
    between = separator.encode()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, last, state, begun = None, None, None, False
        made = lambda k, h: pa.RecordBatch.from_arrays([pa.array(k, kind), pa.array(h, pa.string())], [key, "sha256"])
        for batch in batches:
            kind, keys, digests = batch.schema.field(0).type, [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or k != last:
                    if state is not None:
                        keys.append(last)
                        digests.append(state.hexdigest())
                    last, state, begun = k, hashlib.sha256(), False
                if text is not None:
                    if begun:
                        state.update(between)
                    state.update(text.encode())
                    begun = True
            if keys:
                yield made(keys, digests)
        if state is not None:
            yield made([last], [state.hexdigest()])

    return rows.mapInArrow(read, T.StructType([df.schema[key], T.StructField("sha256", T.StringType())]))
