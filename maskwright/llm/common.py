"""Shared plumbing: durable intermediate tables and batched Arrow helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder every machine can reach, named by ``spark.checkpoint.dir``.

    Only where a session on one machine (a local master) names none is a
    temporary folder made and kept in the session's configuration; on a
    cluster that raises a ValueError.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage durably: a lost executor costs the tasks it ran, never
    the steps before the table.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by ``stored`` that nothing reads any more."""
    folder = shared_folder(spark)
    for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if top.split(":", 1)[-1].lstrip("/").startswith(folder.split(":", 1)[-1].lstrip("/")):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a few small columns up to which a table is broadcast to filter another one; more are joined by a shuffle.
FEW = 500_000


def few(df: DataFrame) -> DataFrame:
    """A stored table of small rows, marked for broadcast if it has at most ``FEW``."""
    return F.broadcast(df) if df.count() <= FEW else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What modules keep per Python process, and how it is dropped.
_keeps: dict[str, Callable[[], None]] = {}


def keeps(module: str, drop: Callable[[], None]) -> None:
    _keeps[module] = drop


def drop_others(module: str) -> None:
    """Drop what other modules keep in this process: workers are used again, and
    the words of one stage are no use to the next one."""
    for name, drop in _keeps.items():
        if name != module:
            drop()


def slices(batches: Iterator[pa.RecordBatch], rows: int, text: int | None = None, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches to at most ``rows`` rows and, by the string column numbered
    ``text``, about ``limit`` bytes, to bound what Python holds at once."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, rows)
            if text is not None:
                while part.num_rows > 1 and part.column(text).nbytes > limit:
                    part = batch.slice(at, part.num_rows // 2)
            yield part
            at += part.num_rows
