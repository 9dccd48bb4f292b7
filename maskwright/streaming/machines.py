"""State machines over streams: gathering a scan's replies, driving an agent's runs.

State is kept by key in the state store, whatever the stream's length: counters
of a scan until it is forgotten, and of a run its status and last entries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.audit import HISTORY
from ..sources.shared import fresh_path
from .gather import DEADLINE_MS, KEPT_MS, ORDER

#: The state store that these machines need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Fixed value: steps of a run.
STEPS = 8
#: How long nothing may be heard of a run until it is forgotten.
RUN_KEPT_MS = 90 * 24 * 3600 * 1000
ENDS = ("done", "blocked", "aborted")


def _sorted(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(list(by), kind="stable")


class Gather(StatefulProcessor):
    """Replies of a scan (ts, seq, children, nodes) until as many have come as
    are expected, one more for each child that a reply announces, or the deadline
    after the first has passed in the watermark's time. A timer closes an open
    scan and puts out what there is; a second one forgets a closed scan, whose
    late replies are dropped until then."""

    def __init__(self, deadline_ms: int = DEADLINE_MS, kept_ms: int = KEPT_MS) -> None:
        self.deadline_ms, self.kept_ms = deadline_ms, kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "n long, expected long, nodes long, first long, closed boolean")

    def _out(self, key: tuple, n: int, expected: int, nodes: int, complete: bool) -> pd.DataFrame:
        return pd.DataFrame({"scan_id": [key[0]], "replies": [n], "expected": [expected], "nodes": [nodes], "complete": [complete]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, expected, nodes, first, closed = self.counts.get() if self.counts.exists() else (0, 1, 0, -1, False)
        known = first >= 0
        for ts, children, more in _sorted(rows, *ORDER)[["ts", "children", "nodes"]].itertuples(index=False):
            at = ts.value // 1_000_000
            first = at if first < 0 else first
            if closed or at - first > self.deadline_ms:
                continue
            n, expected, nodes = n + 1, expected + int(children), nodes + int(more)
            closed = n >= expected
            if closed:
                yield self._out(key, n, expected, nodes, True)
        self.counts.update((n, expected, nodes, first, closed))
        if not known:  # whether it is closed by then or not, this timer sets the last one
            self.handle.registerTimer(max(first + self.deadline_ms, timerValues.getCurrentWatermarkInMs()) + 1)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, expected, nodes, first, closed = self.counts.get()
        forgets = first + self.deadline_ms + self.kept_ms
        if closed and timerValues.getCurrentWatermarkInMs() >= forgets:
            self.counts.clear()
            return
        if not closed:
            yield self._out(key, n, expected, nodes, False)
            self.counts.update((n, expected, nodes, first, True))
        self.handle.registerTimer(max(forgets, timerValues.getCurrentWatermarkInMs() + 1))

    def close(self) -> None:
        pass


class Runs(StatefulProcessor):
    """Steps of a run (ts, seq, event, ok): it ends with the first event that is
    one of ``ENDS`` or when its budget is spent, and what comes later is passed
    over. After each batch that touches a live run its status is put out with the
    last entries of its history, as 'step:ok' joined by commas. A timer forgets a
    run of which nothing was heard for ``kept_ms`` in the watermark's time."""

    def __init__(self, most: int = STEPS, entries: int = HISTORY, kept_ms: int = RUN_KEPT_MS) -> None:
        self.most, self.entries, self.kept_ms = most, entries, kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", "steps long, status string, heard long")
        self.history = handle.getListState("history", "step long, ok boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        steps, status, heard = self.status.get() if self.status.exists() else (0, "running", -1)
        known, held = heard >= 0, list(self.history.get()) if self.history.exists() else []
        new = _sorted(rows, "seq")
        heard = max(heard, int(new["ts"].max().value // 1_000_000))
        live = status == "running"
        for event, ok in zip(new["event"], new["ok"], strict=True) if live else ():
            steps += 1
            held.append((steps, bool(ok)))
            status = event if event in ENDS else "budget" if steps >= self.most else "running"
            if status != "running":
                break
        self.status.update((steps, status, heard))
        if not known:
            self.handle.registerTimer(max(heard + self.kept_ms, timerValues.getCurrentWatermarkInMs() + 1))
        if live:
            held = held[-self.entries :]
            self.history.put([tuple(h) for h in held])
            yield pd.DataFrame({"run_id": [key[0]], "steps": [steps], "status": [status], "history": [",".join(f"{s}:{'t' if ok else 'f'}" for s, ok in held)]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        heard, now = self.status.get()[2], timerValues.getCurrentWatermarkInMs()
        if heard + self.kept_ms > now:
            self.handle.registerTimer(heard + self.kept_ms)
        else:
            self.status.clear()
            self.history.clear()
        return iter(())

    def close(self) -> None:
        pass


def gathered_stream(replies: DataFrame, *, deadline_ms: int = DEADLINE_MS, kept_ms: int = KEPT_MS) -> DataFrame:
    """scan_id, replies, expected, nodes, complete of each scan, once; see ``Gather``."""
    kind = replies.schema["scan_id"].dataType.simpleString()
    timed = replies.withWatermark("ts", f"{deadline_ms} milliseconds")
    return timed.groupBy("scan_id").transformWithStateInPandas(Gather(deadline_ms, kept_ms), f"scan_id {kind}, replies long, expected long, nodes long, complete boolean", "Append", "EventTime")


def run_stream(steps: DataFrame, *, most: int = STEPS, late: str = "1 hour") -> DataFrame:
    """run_id, steps, status, history of the live runs (run_id, ts, seq, event, ok)
    that each batch touches; the row of most steps is a run's last; see ``Runs``."""
    kind = steps.schema["run_id"].dataType.simpleString()
    timed = steps.withWatermark("ts", late)
    return timed.groupBy("run_id").transformWithStateInPandas(Runs(most), f"run_id {kind}, steps long, status string, history string", "Append", "EventTime")


def drained(spark: SparkSession, sources: dict[str, list[DataFrame]], make: Callable[..., DataFrame], name: str) -> DataFrame:
    """What a streaming query puts out when it has read all there is.

    ``sources`` are tables in parts that arrive one after another: each is
    appended to its source's folder, and the query ``make(**streams)`` then takes
    what is new and stops, going on from its checkpoint the next time. Files,
    checkpoint and results are in the shared folder, so every batch is there once
    whatever is lost. The query runs in a session of its own with the state store
    that it needs."""
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    folder = fresh_path(spark, name)
    schemas = {n: parts[0].schema for n, parts in sources.items()}
    found = None
    for i in range(max(len(parts) for parts in sources.values())):
        for n, parts in sources.items():
            if i < len(parts):
                parts[i].write.mode("append").parquet(f"{folder}/{n}")
        found = make(**{n: own.readStream.schema(schemas[n]).parquet(f"{folder}/{n}") for n in sources})
        run = found.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/marks").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/out")
