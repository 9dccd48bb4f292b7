"""Registered queries that run streams to their end, and the SQL of their batch forms."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .queries import SQL, _replies, query
from .sources.tables import table
from .streaming import gather, machines

#: Parts that a table arrives in.
PARTS = 3


def _in_parts(df: DataFrame, by: str) -> list[DataFrame]:
    """A table cut by the range of a number or time, as it would come in."""
    low, high = df.agg(F.min(by), F.max(by)).first()
    if low is None:
        return [df]
    at = lambda i: low + (high - low) * i / PARTS if isinstance(low, dt.datetime) else low + (high - low) * i // PARTS
    cuts = [at(i) for i in range(1, PARTS)]
    edge = lambda i, v: F.col(by) <= F.lit(cuts[i]) if v else F.col(by) > F.lit(cuts[i])
    return [df.where(edge(0, True)), *[df.where(edge(i - 1, False) & edge(i, True)) for i in range(1, PARTS - 1)], df.where(edge(PARTS - 2, False))]


def _far(df: DataFrame, **values: object) -> DataFrame:
    """One row far in the future, which moves the watermark past all deadlines."""
    row = {f.name: None for f in df.schema} | values
    return df.sparkSession.createDataFrame([tuple(row[f.name] for f in df.schema)], df.schema)


_END = dt.datetime(2100, 1, 1)


@query(SQL["gather_deadline"])
def gather_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies gathered by the state machine with event-time timers, in three parts and an end."""
    replies = _replies(spark, sf_dir).select(F.col("scan_id").cast("long").alias("scan_id"), "seq", "ts", "children", F.col("nodes").cast("long").alias("nodes"))
    last = replies.agg(F.max("scan_id")).first()[0]
    end = 0 if last is None else last + 1  # no scan's number
    parts = [*_in_parts(replies, "ts"), _far(replies, scan_id=end, seq=0, ts=_END, children=0, nodes=0)]
    return machines.drained(spark, {"replies": parts}, machines.gathered_stream, "gather").where(F.col("scan_id") != end)


_EVENTS = "CASE event_type WHEN 'error' THEN 'blocked' WHEN 'signup' THEN 'done' ELSE 'step' END"


@query(f"""WITH s AS (SELECT user_id AS run_id, {_EVENTS} AS e, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE user_id IS NOT NULL),
l AS (SELECT run_id, least(8, coalesce(min(n) FILTER (e <> 'step'), 8), max(n)) AS steps FROM s GROUP BY run_id)
SELECT l.run_id, CAST(steps AS BIGINT) AS steps, max(CASE WHEN n = steps THEN CASE WHEN e <> 'step' THEN e WHEN steps >= 8 THEN 'budget' ELSE 'running' END END) AS status,
  string_agg(n || ':' || CASE WHEN ok THEN 't' ELSE 'f' END, ',' ORDER BY n) FILTER (n > steps - 6) AS history
FROM l JOIN s ON s.run_id = l.run_id AND n <= steps GROUP BY l.run_id, steps""")
def run_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs driven by the state machine with list state, events in three parts."""
    steps = table(spark, sf_dir, "events").where("user_id IS NOT NULL").select(F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.expr(_EVENTS).alias("event"), (F.col("event_type") != "error").alias("ok"))
    # Events come in the order of their ids, whatever their times, so the watermark waits for any.
    out = machines.drained(spark, {"steps": _in_parts(steps, "seq")}, lambda steps: machines.run_stream(steps, late="3650 days"), "runs")
    last = out.groupBy("run_id").agg(F.max(F.struct("steps", "status", "history")).alias("x"))
    return last.select("run_id", "x.steps", "x.status", "x.history")


@query("""WITH s AS (SELECT user_id AS scan_id, event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'view' AND user_id IS NOT NULL),
c AS (SELECT user_id AS scan_id, event_id, epoch_us(ts) AS t FROM events WHERE event_type IN ('click', 'purchase'))
SELECT s.scan_id, s.event_id AS scan, c.event_id AS capture FROM s LEFT JOIN c ON c.scan_id = s.scan_id AND abs(c.t - s.t) <= 7200000000""")
def scan_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans with the captures of the same scan within two hours, by an outer join of two streams."""
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL").select(F.col("user_id").alias("scan_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    scans = e.where("event_type = 'view'").select("scan_id", F.col("event_id").alias("scan"), "ts")
    captures = e.where("event_type IN ('click', 'purchase')").select("scan_id", F.col("event_id").alias("capture"), "ts")
    sources = {"scans": [*_in_parts(scans, "ts"), _far(scans, scan_id=-1, scan=-1, ts=_END)], "captures": [*_in_parts(captures, "ts"), _far(captures, scan_id=-2, capture=-1, ts=_END)]}
    make = lambda scans, captures: gather.captured_scans(scans, captures, within="2 hours").select("scan_id", "scan", "capture")
    return machines.drained(spark, sources, make, "captures").where("scan_id >= 0")
