"""Scatter and gather of frame scans, and rolling audit counters."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Fixed value: how long replies of a scan are waited for.
DEADLINE_MS = 400
#: How long after that a closed scan is remembered, so that its late replies are dropped.
KEPT_MS = 60_000
#: The order of a scan's replies, with which equal ones alone are tied.
ORDER = ("ts", "seq", "children", "nodes")
#: Entries of a run's trace, and how many of the last keep their image.
TRACE, IMAGES = 24, 3


def gathered_batch(replies: DataFrame, *, deadline_ms: int = DEADLINE_MS) -> DataFrame:
    """The batch form. ``replies``: scan_id, seq, ts (timestamp), children (frames
    that a reply announces), nodes. A scan is complete once it has as many
    replies as expected: 1 plus all announced children so far. Later replies,
    and those past the deadline after the first, are dropped. Replies of equal ts
    and seq go by children, then nodes, in every form. Returns scan_id, replies,
    expected, nodes, complete."""
    order = Window.partitionBy("scan_id").orderBy(*ORDER)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    late = F.unix_millis("ts") - F.unix_millis(F.min("ts").over(Window.partitionBy("scan_id"))) > deadline_ms
    r = replies.withColumn("late", late).where("NOT late").withColumns({"n": F.row_number().over(order), "expected": 1 + F.sum("children").over(so_far)})
    r = r.withColumn("done_before", F.coalesce(F.max((F.col("n") >= F.col("expected")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    kept = r.where("done_before = 0").groupBy("scan_id").agg(F.count("*").alias("replies"), F.max("expected").alias("expected"), F.sum("nodes").alias("nodes"))
    return kept.withColumn("complete", F.col("replies") >= F.col("expected"))


def gathered_stream(replies: DataFrame, *, deadline_ms: int = DEADLINE_MS, kept_ms: int = KEPT_MS) -> DataFrame:
    """The streaming form: state per scan holds the counters; a scan is put out
    when complete, or partial when the watermark passes its deadline. Replies
    that come later than that find a closed scan and are dropped; a closed scan
    is forgotten ``kept_ms`` after its deadline, in the watermark's time."""
    timed = replies.withWatermark("ts", f"{deadline_ms} milliseconds")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, expected, nodes, first, closed = state.get if state.exists else (0, 1, 0, None, False)
        if state.hasTimedOut:
            if closed:
                state.remove()
                return
            yield pd.DataFrame({"scan_id": [key[0]], "replies": [n], "expected": [expected], "nodes": [nodes], "complete": [False]})
            state.update((n, expected, nodes, first, True))
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + kept_ms)
            return
        rows = pd.concat(list(frames)).sort_values(list(ORDER))
        for ts, children, more in zip(rows["ts"], rows["children"], rows["nodes"], strict=True):
            at = ts.value // 1_000_000
            first = at if first is None else first
            if closed or at - first > deadline_ms:
                continue
            n, expected, nodes = n + 1, expected + int(children), nodes + int(more)
            closed = n >= expected
            if closed:
                yield pd.DataFrame({"scan_id": [key[0]], "replies": [n], "expected": [expected], "nodes": [nodes], "complete": [True]})
        state.update((n, expected, nodes, first, closed))
        state.setTimeoutTimestamp(max(first + deadline_ms, state.getCurrentWatermarkMs()) + (kept_ms if closed else 1))

    kind = replies.schema["scan_id"].dataType.simpleString()
    return timed.groupBy("scan_id").applyInPandasWithState(step, f"scan_id {kind}, replies long, expected long, nodes long, complete boolean", "n long, expected long, nodes long, first long, closed boolean", "append", GroupStateTimeout.EventTimeTimeout)


def traced_stream(entries: DataFrame) -> DataFrame:
    """The streaming form of ``audit.trace_ring``: entries (run_id, seq, note,
    image) in; after each micro-batch, for each run that it touched, the run's
    last entries (run_id, seq, note, image), images only in the newest ones.
    A run's state is the entries it puts out, no more."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        new = pd.concat(list(frames))
        held += [[int(s), None if pd.isna(n) else n, None if pd.isna(i) else i] for s, n, i in zip(new["seq"], new["note"], new["image"], strict=True)]
        held = sorted(held, key=lambda e: e[0])[-TRACE:]
        held = [[s, n, i if k >= len(held) - IMAGES else None] for k, (s, n, i) in enumerate(held)]
        state.update((json.dumps(held),))
        yield pd.DataFrame({"run_id": [key[0]] * len(held), "seq": [e[0] for e in held], "note": [e[1] for e in held], "image": [e[2] for e in held]})

    kind = entries.schema["run_id"].dataType.simpleString()
    return entries.groupBy("run_id").applyInPandasWithState(step, f"run_id {kind}, seq long, note string, image string", "held string", "update", GroupStateTimeout.NoTimeout)


def rolling_audit(events: DataFrame, *, every: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """Counters for each window of time: requests, rejected, bytes_in; of a batch,
    or of a stream with rows up to ``late`` late. ``events``: ts, accepted, bytes."""
    timed = events.withWatermark("ts", late) if events.isStreaming and late else events
    out = timed.groupBy(F.window("ts", every).alias("w")).agg(F.count("*").alias("requests"), F.count_if(~F.col("accepted")).alias("rejected"), F.sum("bytes").alias("bytes_in"))
    return out.select(F.col("w.start").alias("start"), "requests", "rejected", "bytes_in")


def captured_scans(scans: DataFrame, captures: DataFrame, *, within: str = "2 seconds") -> DataFrame:
    """Every scan with each capture of the same scan taken ``within`` of it, or
    with none: columns of both, the capture's time as captured_at. Of streams,
    rows later than ``within`` are dropped, a scan without a capture comes out
    when the watermarks say that none can come, and both sides' state is kept only
    as long as a partner may come."""
    a, b = scans.alias("a"), captures.withColumnsRenamed({"scan_id": "capture_id", "ts": "captured_at"}).alias("b")
    if scans.isStreaming:
        a, b = scans.withWatermark("ts", within).alias("a"), b.withWatermark("captured_at", within)
    near = F.expr(f"scan_id = capture_id AND captured_at BETWEEN ts - interval {within} AND ts + interval {within}")
    return a.join(b, near, "left")


def forwarded(verdicts: DataFrame, send) -> object:
    """A writer that hands each micro-batch's allowed envelopes to ``send(df, batch_id)``; refused ones never reach it."""
    return verdicts.writeStream.foreachBatch(lambda df, i: send(df.where("verdict.allowed"), i))
