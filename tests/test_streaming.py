"""Windows and gaps as streams over files, against their batch forms."""

from __future__ import annotations

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewake.streaming import gaps, windows

T0 = datetime(2026, 9, 12, 18)
EVENTS = "mmsi long, event_time timestamp, name string, speed double, ship_type int, navigation_status int"


def at(minute):
    return T0 + timedelta(minutes=minute)


def rows(df):
    return sorted((r["mmsi"], r["window_minutes"], r["window_start"], r["position_count"], r["avg_speed"], r["name"], r["last_navigation_status"]) for r in df.collect())


def test_alignment_and_half_open_edges(spark):
    e = spark.createDataFrame([(1, at(10), "A", 1.0, 1, 1)], EVENTS)
    r = windows.window_features(e).collect()
    assert {m: sum(x["window_minutes"] == m for x in r) for m in windows.SIZES} == {5: 1, 15: 3, 30: 6, 60: 12}
    assert all(x["window_start"] <= at(10) < x["window_end"] for x in r)


def test_settings():
    assert windows.check_windows((5, 10), 5) == (5, 10)
    for sizes, slide in (((5, 5), 5), ((7,), 5), ((), 5), ((0,), 5), ((5,), 0)):
        with pytest.raises(ValueError):
            windows.check_windows(sizes, slide)


def test_aggregates_of_reversed_events(spark):
    e = [(1, at(k), None if k == 59 else f"Vessel {k % 3}", None if k % 4 == 0 else float(k), 70, None if k == 59 else k) for k in range(60)][::-1]
    r = next(x for x in windows.window_features(spark.createDataFrame(e, EVENTS)).collect() if x["window_minutes"] == 60 and x["window_start"] == T0)
    assert (r["position_count"], r["min_speed"], r["max_speed"], r["name"], r["last_navigation_status"]) == (60, 1.0, 59.0, "Vessel 1", None)
    assert abs(r["avg_speed"] - sum(k for k in range(60) if k % 4) / 45) < 1e-9


def test_stream_equals_batch_and_recovers(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    first = spark.createDataFrame([(m, at(k), f"V{m}", float(k), 70, k % 3) for m in (1, 2) for k in range(0, 40)], EVENTS)
    first.coalesce(1).write.mode("append").parquet(source)

    def run():
        s = spark.readStream.schema(EVENTS).parquet(source)
        windows.start_query(windows.window_features(s, watermark="30 seconds"), out, checkpoint, available_now=True).awaitTermination(120)

    run()
    spark.createDataFrame([(1, at(300), "V1", 1.0, 70, 0)], EVENTS).coalesce(1).write.mode("append").parquet(source)
    run()
    spark.createDataFrame([(1, at(400), "V1", 1.0, 70, 0)], EVENTS).coalesce(1).write.mode("append").parquet(source)
    run()
    closed = spark.read.parquet(out).where(F.col("window_end") <= F.lit(at(120)))
    assert rows(closed) == rows(windows.window_features(first))


def test_late_events_count_in_windows_still_open(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def step(*minutes):
        spark.createDataFrame([(1, at(m), "V", 1.0, 70, 0) for m in minutes], EVENTS).coalesce(1).write.mode("append").parquet(source)
        s = spark.readStream.schema(EVENTS).parquet(source)
        windows.start_query(windows.window_features(s, sizes=(5, 60), watermark="30 seconds"), out, checkpoint, available_now=True).awaitTermination(120)

    step(1, 12)
    step(2)
    step(200)
    step(201)
    r = {(x["window_minutes"], x["window_start"]): x["position_count"] for x in spark.read.parquet(out).collect()}
    assert r[(5, T0)] == 1 and r[(60, T0)] == 3


def test_gaps_over_history(spark):
    p = spark.createDataFrame([(1, at(m), n, 60.0, 5.0, 70, s) for m, n, s in ((0, "A", 0), (5, None, 1), (20, None, 5), (25, "B", 5))], "mmsi long, msgtime timestamp, name string, latitude double, longitude double, ship_type int, navigational_status int")
    r = sorted((x["event_type"], x["gap_detected_at"], x["gap_ended_at"], x["gap_duration_seconds"]) for x in gaps.gap_events_batch(p).collect() if x["gap_ended_at"])
    assert r == [("AIS_GAP_ENDED", at(15), at(20), 900.0)]
    detected = [x["gap_detected_at"] for x in gaps.gap_events_batch(p, as_of=F.lit(at(30))).where("event_type = 'AIS_GAP_DETECTED'").collect()]
    assert detected == [at(15)]


GAP_EVENTS = "mmsi long, name string, msgtime string, latitude double, longitude double, ship_type int, navigation_status int"


def test_gap_detector(spark, tmp_path):
    """Silence is reported once, and the return once, with the name kept from before."""
    source = str(tmp_path / "in")

    def send(*events):
        spark.createDataFrame(list(events), GAP_EVENTS).coalesce(1).write.mode("append").parquet(source)

    send((1, "A", "t1", 60.0, 5.0, 70, 0), (2, "B", "t1", 60.0, 5.0, 70, 0))
    s = spark.readStream.schema(GAP_EVENTS).parquet(source)
    q = gaps.gap_events(s, timeout=3).writeStream.format("memory").queryName("gap_test").outputMode("update").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="1 second").start()

    def wait(n):
        end = time.time() + 60
        while time.time() < end:
            found = spark.sql("SELECT * FROM gap_test").collect()
            if len(found) >= n:
                return found
            time.sleep(0.5)
        raise AssertionError(f"{len(found)} of {n} events; {q.exception()}")

    try:
        assert {(r["event_type"], r["mmsi"], r["name"]) for r in wait(2)} == {("AIS_GAP_DETECTED", 1, "A"), ("AIS_GAP_DETECTED", 2, "B")}
        send((1, None, "t2", 61.0, 5.0, 71, 5))
        ended = next(r for r in wait(3) if r["event_type"] == "AIS_GAP_ENDED")
        assert (ended["mmsi"], ended["name"], ended["previous_event_msgtime"], ended["resumed_event_msgtime"]) == (1, "A", "t1", "t2")
        assert (ended["ship_type"], ended["previous_navigation_status"], ended["resumed_navigation_status"]) == (71, 0, 5)
        assert ended["gap_duration_seconds"] >= 3 and ended["gap_ended_at"] > ended["gap_detected_at"]
        again = [r for r in wait(4) if r["mmsi"] == 1 and r["event_type"] == "AIS_GAP_DETECTED"]
        assert len(again) == 2
    finally:
        q.stop()


def test_silences_are_reported_after_a_stop_between_two_batches(spark, tmp_path):
    """The first batch is committed and the query ends with timers pending; started again, it has no new message to read and reports all the same."""
    source, found = str(tmp_path / "in"), {}
    spark.createDataFrame([(1, "A", "t1", 60.0, 5.0, 70, 0), (2, "B", "t1", 60.0, 5.0, 70, 0)], GAP_EVENTS).coalesce(1).write.parquet(source)

    def start(**trigger):
        def keep(df, n):
            found[n] = sorted((r["event_type"], r["mmsi"], r["name"]) for r in df.collect())

        events = gaps.gap_events(spark.readStream.schema(GAP_EVENTS).parquet(source), timeout=3)
        return events.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(**trigger).start()

    assert start(once=True).awaitTermination(120)
    assert found == {0: []}
    q = start(processingTime="1 second")
    try:
        end = time.time() + 60
        while time.time() < end and not any(found.values()):
            time.sleep(0.5)
        time.sleep(3)
    finally:
        q.stop()
    assert sorted(r for rows in found.values() for r in rows) == [("AIS_GAP_DETECTED", 1, "A"), ("AIS_GAP_DETECTED", 2, "B")]


def test_detector_takes_a_hundred_thousand_rows_of_a_vessel_at_once(spark, tmp_path):
    """The batch's last known name and last values are kept; reading the rows takes no Python step for each."""
    import pandas as pd

    columns = [c.split()[0] for c in GAP_EVENTS.split(", ")][1:]
    n = 100_000
    frames = [pd.DataFrame({"name": ["A" if k == 7 else None for k in range(part * n // 10, (part + 1) * n // 10)], "msgtime": [f"t{k}" for k in range(part * n // 10, (part + 1) * n // 10)], "latitude": 60.0, "longitude": 5.0, "ship_type": 70, "navigation_status": 1})[columns] for part in range(10)]

    class Value:
        kept = (0, True, "OLD", "t", 1.0, 2.0, None, 5, None, 1000)

        def exists(self):
            return True

        def get(self):
            return self.kept

        def update(self, row):
            self.kept = row

    class Timers:
        def getCurrentProcessingTimeInMs(self):
            return 5000

        def registerTimer(self, at):
            self.at = at

    detector = gaps.GapDetector(10)
    detector.state, detector.handle = Value(), Timers()
    began = time.perf_counter()
    (out,) = detector.handleInputRows((1,), iter(frames), Timers())
    assert time.perf_counter() - began < 1
    (ended,) = out.to_dict("records")
    assert (ended["event_type"], ended["name"], ended["resumed_event_msgtime"], ended["gap_duration_seconds"]) == ("AIS_GAP_ENDED", "OLD", "t0", 5.0)
    assert detector.state.kept == (5000, False, "A", f"t{n - 1}", 60.0, 5.0, 70, 1, 15000, None) and detector.handle.at == 15000


STATE = "mmsi long, msgtime timestamp, seq long, name string"


def test_upsert_sink_takes_each_batch_once(spark, tmp_path):
    from tidewake.streaming.upsert import UpsertSink

    def batch(*rows):
        return spark.createDataFrame(list(rows), STATE)

    def state():
        return sorted(map(tuple, sink.read().collect()))

    sink = UpsertSink(spark, str(tmp_path / "state"), "mmsi", ("msgtime", "seq"), STATE, buckets=4)
    assert state() == []
    sink(batch(*((m, at(0), 0, "first") for m in range(20))), 0)
    sink(batch((1, at(5), 1, "new"), (1, at(3), 9, "old"), (2, at(-5), 7, "late"), (3, at(0), 0, "z"), (99, None, None, None)), 1)
    expected = sorted([(1, at(5), 1, "new"), (3, at(0), 0, "z"), (99, None, None, None)] + [(m, at(0), 0, "first") for m in range(20) if m not in (1, 3)])
    assert state() == expected
    sink(batch((1, at(50), 1, "repeated with other rows")), 1)
    sink(batch((4, at(50), 1, "older batch")), 0)
    assert state() == expected and sink.commits() == [0, 1]

    # a crash while batch 2 is committed: its folders are there, its commit is not closed
    sink(batch((5, at(9), 2, "five")), 2)
    (tmp_path / "state/commits/000000000002/_SUCCESS").unlink()
    assert state() == expected
    sink(batch((5, at(9), 2, "five")), 2)
    after = sorted([r for r in expected if r[0] != 5] + [(5, at(9), 2, "five")])
    assert state() == after
    sink(batch(), 3)
    assert state() == after and sink.commits() == [2, 3]
    untouched = {r["bucket"]: r["folder"] for r in spark.read.parquet(f"{tmp_path}/state/commits/000000000003").collect()}
    assert len({f.split("/data/")[1].split("/")[0] for f in untouched.values()}) > 1


def test_settings_of_a_stream_stay_with_it(spark):
    before = {k: spark.conf.get(k, None) for s in (windows.RECOVERABLE, windows.IDLE_SOURCES) for k in s}
    own = windows.stream_session(spark, windows.RECOVERABLE, windows.IDLE_SOURCES)
    assert own.conf.get("spark.sql.streaming.multipleWatermarkPolicy") == "max" and own.sparkContext is spark.sparkContext
    assert {k: spark.conf.get(k, None) for k in before} == before


def test_panes_are_what_goes_into_longer_windows(spark):
    """Events are aggregated once, by pane; no plan node multiplies them."""
    import contextlib
    import io

    e = spark.createDataFrame([(m, at(k / 7), f"V{k}" if k % 3 else None, float(k % 50), 70, k % 4) for m in (1, 2) for k in range(2000)], EVENTS)
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        windows.window_features(e).explain()
    lines = text.getvalue().split("\n")
    generate = [k for k, line in enumerate(lines) if "Generate explode" in line]
    assert len(generate) == 1 and "- Expand" not in text.getvalue() and "Aggregate(key" in "".join(lines[generate[0] + 1 : generate[0] + 4])
    slow = {}
    for r in e.collect():
        for size in windows.SIZES:
            first = int((r["event_time"] - T0).total_seconds() // 300)
            for w in range(first - size // 5 + 1, first + 1):
                slow.setdefault((r["mmsi"], size, T0 + timedelta(minutes=5 * w)), []).append(r)
    got = {(r["mmsi"], r["window_minutes"], r["window_start"]): r for r in windows.window_features(e).collect()}
    assert set(got) == set(slow)
    for key, rs in slow.items():
        r, newest = got[key], max(rs, key=lambda x: x["event_time"])
        names = [x for x in rs if x["name"]]
        assert (r["position_count"], r["min_speed"], r["max_speed"], r["last_navigation_status"]) == (len(rs), min(x["speed"] for x in rs), max(x["speed"] for x in rs), newest["navigation_status"])
        assert r["name"] == max(names, key=lambda x: x["event_time"])["name"] and abs(r["avg_speed"] - sum(x["speed"] for x in rs) / len(rs)) < 1e-9


def test_small_state_stores_reserve_no_disk(spark):
    own = windows.stream_session(spark, windows.RECOVERABLE)
    assert own.conf.get("spark.sql.streaming.stateStore.rocksdb.allowFAllocate") == "false"
