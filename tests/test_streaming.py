"""Streams give what the batch forms give."""

import datetime as dt
import time

from maskwright import queries, stream_queries  # noqa: F401  registers itself
from maskwright.streaming import gather


def at(ms):
    return dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)


SCHEMA = "scan_id long, seq long, ts timestamp, children int, nodes long"
ROWS = [(1, 1, at(0), 1, 5), (1, 2, at(100), 0, 7), (1, 3, at(150), 0, 9), (2, 4, at(0), 1, 1), (2, 5, at(900), 0, 1), (3, 6, at(50), 0, 4)]


def test_batch_gather(spark):
    got = {r.scan_id: (r.replies, r.expected, r.nodes, r.complete) for r in gather.gathered_batch(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert got == {1: (2, 2, 12, True), 2: (1, 2, 1, False), 3: (1, 1, 4, True)}


def test_stream_gather(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.parquet(source)
    stream = gather.gathered_stream(spark.readStream.schema(SCHEMA).parquet(source))
    q = stream.writeStream.format("memory").queryName("gathered").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    # a later row moves the watermark past the open scan's deadline
    spark.createDataFrame([(9, 9, at(60_000), 0, 0)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    until = time.time() + 60
    while time.time() < until and spark.sql("SELECT * FROM gathered WHERE scan_id = 2").count() == 0:
        q.processAllAvailable()
        time.sleep(0.5)
    q.stop()
    got = {r.scan_id: (r.replies, r.expected, r.nodes, r.complete) for r in spark.table("gathered").collect() if r.scan_id != 9}
    assert got == {1: (2, 2, 12, True), 2: (1, 2, 1, False), 3: (1, 1, 4, True)}


def test_replies_of_any_number_and_tied_ones(spark, tmp_path):
    big = 3 * (1 << 53)
    users = [u for base in (-7, 30, big - 6) for u in range(base, base + 12)]
    # Users of a scan reply at one time by one number, with different nodes.
    rows = [(i // 7 * 7, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i // 7), u, "view", 1.0, "{}") for i, u in enumerate(users * 3)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    want, scans = {}, {}
    for e, ts, u, *_ in rows:
        cut = lambda a, b: (abs(a) // b) * (1 if a >= 0 else -1)
        us = int(ts.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
        scans.setdefault(cut(u, 3), []).append((us // 100000, e, int(e % 3 == 0), u - 11 * cut(u, 11)))
    for scan, replies in scans.items():
        n, expected, nodes, first = 0, 1, 0, min(replies)[0] // 1000
        for at_, _, children, more in sorted(replies):
            if n < expected and at_ // 1000 - first <= 400:
                n, expected, nodes = n + 1, expected + children, nodes + more
        want[scan] = (n, expected, nodes, n >= expected)
    for name in ("gather_deadline", "gather_stream"):
        got = queries.QUERIES[name](spark, str(tmp_path)).collect()
        assert {r.scan_id: (r.replies, r.expected, r.nodes, r.complete) for r in got} == want and len(got) == len(want), name


def _run(spark, tmp_path, make, schema, batches, mode, name):
    """Feeds the batches one after another and returns all rows put out."""
    source = tmp_path / f"{name}-in"
    source.mkdir()
    q = make(spark.readStream.schema(schema).parquet(str(source))).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-c")).start()
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        for _ in range(3):  # a further batch without data follows where the watermark moved
            q.processAllAvailable()
            time.sleep(0.3)
    q.stop()
    return spark.table(name).collect()


def test_late_replies_do_not_open_a_closed_scan(spark, tmp_path):
    batches = [[(1, 1, at(0), 1, 5), (7, 1, at(0), 0, 1)], [(9, 9, at(1000), 0, 0)], [(1, 2, at(1500), 0, 7), (7, 2, at(1500), 0, 1)], [(9, 10, at(3000), 0, 0)], [(9, 11, at(200_000), 0, 0)], [(8, 1, at(200_001), 0, 3)]]
    got = [(r.scan_id, r.replies, r.nodes, r.complete) for r in _run(spark, tmp_path, gather.gathered_stream, SCHEMA, batches, "append", "late")]
    assert sorted(x for x in got if x[0] != 9) == [(1, 1, 5, False), (7, 1, 1, True), (8, 1, 3, True)]


def test_traced_stream_keeps_the_last_entries(spark, tmp_path):
    schema = "run_id long, seq long, note string, image string"
    batches = [[(1, i, f"n{i}", f"i{i}") for i in range(20)] + [(2, 0, None, None)], [(1, i, f"n{i}", f"i{i}") for i in range(20, 30)]]
    got = _run(spark, tmp_path, gather.traced_stream, schema, batches, "update", "traced")
    last = [r for r in got if r.run_id == 1][-gather.TRACE :]
    assert [(r.seq, r.note, r.image) for r in last] == [(i, f"n{i}", f"i{i}" if i >= 27 else None) for i in range(6, 30)]
    assert [(r.seq, r.note, r.image) for r in got if r.run_id == 2] == [(0, None, None)]


def test_rolling_audit_stream(spark, tmp_path):
    schema = "ts timestamp, accepted boolean, bytes long"
    rows = [(at(0), True, 5), (at(1000), False, 7), (at(3_700_000), True, 9)]
    source = str(tmp_path / "in")
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(source)
    q = gather.rolling_audit(spark.readStream.schema(schema).parquet(source)).writeStream.format("memory").queryName("rolled").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("rolled").collect()) == sorted(gather.rolling_audit(df).collect())


def test_machine_gathers_forgets_and_drops_late_replies(spark, tmp_path):
    from maskwright.streaming import machines

    make = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1)
    batches = [[(1, 1, at(0), 1, 5), (7, 1, at(0), 0, 1)], [(9, 9, at(1000), 0, 0)], [(1, 2, at(1500), 0, 7), (7, 2, at(1500), 0, 1)], [(9, 10, at(200_000), 0, 0)], [(7, 1, at(200_001), 0, 3)], [(9, 11, at(900_000), 0, 0)]]
    out = machines.drained(spark, {"replies": [make(b) for b in batches]}, machines.gathered_stream, "late").collect()
    got = sorted((r.scan_id, r.replies, r.nodes, r.complete) for r in out if r.scan_id != 9)
    # Scan 7 is done with its first reply, is forgotten in time, and then begins anew.
    assert got == [(1, 1, 5, False), (7, 1, 1, True), (7, 1, 3, True)]


def test_run_machine_stops_at_ends_and_at_its_budget(spark):
    from maskwright.streaming import machines

    rows = [(1, at(i), i, "step", i % 2 == 0) for i in range(12)] + [(2, at(1), 1, "step", True), (2, at(2), 2, "blocked", False), (2, at(3), 3, "step", True), (3, at(5), 1, "step", None)]
    df = spark.createDataFrame(rows, "run_id long, ts timestamp, seq long, event string, ok boolean")
    out = machines.drained(spark, {"steps": [df.where("seq < 2"), df.where("seq >= 2")]}, machines.run_stream, "runs").collect()
    last = {r.run_id: (r.steps, r.status, r.history) for r in sorted(out, key=lambda r: r.steps)}
    assert last == {1: (8, "budget", "3:t,4:f,5:t,6:f,7:t,8:f"), 2: (2, "blocked", "1:t,2:f"), 3: (1, "running", "1:f")}


def test_scans_without_captures_come_out_and_late_ones_do_not(spark):
    from maskwright.streaming import machines

    a = [[(1, at(0)), (2, at(0))], [(9, at(60_000))], [(3, at(100))], [(9, at(600_000))]]
    b = [[(1, at(900), "x"), (2, at(9000), "y")], [(9, at(60_000), "z")], [(1, at(500), "late")], [(9, at(600_000), "z")]]
    sources = {"scans": [spark.createDataFrame(x, "scan_id long, ts timestamp").coalesce(1) for x in a], "captures": [spark.createDataFrame(x, "scan_id long, ts timestamp, image string").coalesce(1) for x in b]}
    out = machines.drained(spark, sources, lambda scans, captures: gather.captured_scans(scans, captures).select("scan_id", "image"), "captures").collect()
    assert sorted((r.scan_id, r.image) for r in out if r.scan_id != 9) == [(1, "x"), (2, None)]
