"""Hand-written cases of the vessel operators."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewake import checks, reports, schemas
from tidewake.functions import expressions as E
from tidewake.operators import daily, joins, network, versioned, visits
from tidewake.plans import daily_job, enrichment, marts
from tidewake.sources import derived, files, positions, reference

T0 = datetime(2026, 9, 12)
PORT = [("A", "Harbour A", "NO", 60.0, 5.0, 1500.0)]
PORTS = "port_id string, name string, country string, latitude double, longitude double, radius_m double"
POINTS = "mmsi long, msgtime timestamp, latitude double, longitude double, speed_over_ground double"


def at(minute):
    return T0 + timedelta(minutes=minute)


def track(*steps, mmsi=257000001):
    """(minute, inside?, speed) as positions."""
    return [(mmsi, at(m), 60.0 if inside else 60.5, 5.0, speed) for m, inside, speed in steps]


def detect(spark, rows, ports=PORT, **kw):
    found = visits.detect_visits(spark.createDataFrame(rows, POINTS), spark.createDataFrame(ports, PORTS), **kw)
    return [r.asDict() for r in found.orderBy("mmsi", "arrival_at").collect()]


def slow(*minutes):
    return [(m, True, 0.5) for m in minutes]


# ---------------------------------------------------------------- visits


def test_two_visits_with_a_certain_arrival(spark):
    rows = track((0, False, 5.0), *slow(1, 11, 21), (22, False, 5.0), *slow(30, 40, 50), (51, False, 5.0))
    a, b = detect(spark, rows)
    assert (a["arrival_censored"], a["departure_at"], a["end_reason"], a["observation_count"]) == (0, at(22), "observed_exit", 3)
    assert (b["arrival_at"], b["observed_stay_seconds"]) == (at(30), 1200.0)
    assert a["visit_id"] == hashlib.sha256(b'[257000001,"A","2026-09-12 00:01:00+00:00"]').hexdigest()


def test_short_fast_and_broken_stays_are_none(spark):
    assert detect(spark, track((0, True, 12.0), (10, True, 12.0), (20, True, 12.0))) == []
    assert detect(spark, track(*slow(0, 5))) == []
    assert detect(spark, track(*slow(0, 60))) == []


def test_gap_splits_a_stay(spark):
    a, b = detect(spark, track(*slow(0, 10, 20, 60 + 0, 70, 80)))
    assert (a["end_reason"], a["departure_at"], b["arrival_censored"], b["end_reason"]) == ("data_gap", None, 1, "window_end")


def test_order_and_repetition_do_not_matter(spark):
    rows = track(*slow(0, 10, 20))
    assert detect(spark, rows) == detect(spark, rows[::-1] + rows) and detect(spark, rows)[0]["observation_count"] == 3


def test_conflict_and_unknown_speed_break_a_stay(spark):
    conflict = [*track(*slow(0, 10, 20)), (257000001, at(10), 60.001, 5.0, 0.5)]
    assert detect(spark, conflict) == []
    s = visits.visit_stats(spark.createDataFrame(conflict, POINTS), spark.createDataFrame(PORT, PORTS)).first()
    assert (s["conflicting_timestamps"], s["source_rows"], s["unique_timestamps"], s["visits"], s["short_candidates"], s["invalid_rows"]) == (1, 4, 3, 0, 2, 0)
    assert detect(spark, track((0, True, 0.5), (10, True, None), (20, True, 0.5))) == []


def test_equal_circles_give_the_smaller_id(spark):
    twins = [("B", "b", "NO", 60.0, 5.0, 1500.0), ("A", "a", "NO", 60.0, 5.0, 1500.0)]
    assert [v["port_id"] for v in detect(spark, track(*slow(0, 10, 20)), twins)] == ["A"]


def test_invalid_rows_and_thresholds(spark):
    bad = [*track(*slow(0, 10, 20)), (257000001, at(30), 91.0, 5.0, 0.1), (0, at(30), 60.0, 5.0, 0.1)]
    s = visits.visit_stats(spark.createDataFrame(bad, POINTS), spark.createDataFrame(PORT, PORTS)).first()
    assert s["invalid_rows"] == 2
    with pytest.raises(ValueError):
        detect(spark, bad, min_stay=0)
    with pytest.raises(ValueError):
        detect(spark, bad, max_speed=float("nan"))


def plain_visits(rows, ports, min_stay, max_gap, max_speed):
    """Visits by a loop over each vessel's observations, and the number of short stays."""

    def metres(a, b):
        x, y, u, v = map(math.radians, (*a, *b))
        h = math.sin((u - x) / 2) ** 2 + math.cos(x) * math.cos(u) * math.sin((v - y) / 2) ** 2
        return 6371008.8 * 2 * math.asin(math.sqrt(min(1.0, h)))

    out, short, by = [], 0, {}
    for mmsi, t, lat, lon, speed in rows:
        by.setdefault(mmsi, []).append((t, lat, lon, speed))
    for mmsi, seen in by.items():
        around = []
        for t, lat, lon, speed in sorted(seen):
            near = sorted((d, p[0]) for p in ports if (d := metres((lat, lon), p[3:5])) <= p[5])
            around.append((t, near[0][1] if near and speed <= max_speed else None, {i for _, i in near}))
        start = 0
        for k in range(1, len(around) + 1):
            if k < len(around) and around[k][1] == around[k - 1][1] and (around[k][0] - around[k - 1][0]).total_seconds() <= max_gap:
                continue
            (first, port, _), last, n, stay = around[start], around[k - 1][0], k - start, (around[k - 1][0] - around[start][0]).total_seconds()
            before, after = around[start - 1] if start else None, around[k] if k < len(around) else None
            start = k
            if port is None:
                continue
            if n < 2 or stay < min_stay:
                short += 1
                continue
            reason = "window_end" if after is None else "data_gap" if (after[0] - last).total_seconds() > max_gap else "movement_or_unknown" if port in after[2] else "observed_exit"
            censored = before is None or (first - before[0]).total_seconds() > max_gap or port in before[2]
            out.append((mmsi, port, first, last, after[0] if reason == "observed_exit" else None, int(censored), reason, n, stay))
    return sorted(out, key=str), short


@pytest.mark.parametrize("max_gap", [900, 3600, 100_000])
def test_visits_over_midnights_are_those_of_a_loop(spark, max_gap):
    rng, ports = random.Random(max_gap), [(f"P{k}", "p", "NO", 60.0 + 0.01 * (k % 4), 5.0, 1500.0 + 400 * (k % 3)) for k in range(12)]
    rows = []
    for mmsi in range(257000001, 257000041):
        t, lat, step = datetime(2026, 1, 1, 20), 60.0, rng.choice([300, 800, 20_000, 90_000])
        for _ in range(150 if step < 1000 else 25):
            t += timedelta(seconds=rng.choice([step // 2, step, step, step + rng.randrange(max(1, step)), 70_000 if rng.random() < 0.1 else step]))
            lat = rng.choice([60.0, 60.005, 60.01, 60.02, 60.05]) if rng.random() < 0.15 else lat
            rows.append((mmsi, t, lat, 5.0, 9.0 if rng.random() < 0.08 else 0.5))
    expected, short = plain_visits(rows, ports, 1200, max_gap, 3.0)
    assert len(expected) > 20 and any(e[2].date() != e[3].date() for e in expected)
    df, at_ports = spark.createDataFrame(rows, POINTS).repartition(5), spark.createDataFrame(ports, PORTS)
    found = visits.detect_visits(df, at_ports, 1200, max_gap, 3.0).collect()
    assert sorted((tuple(r[c] for c in visits.VISIT_COLUMNS[1:]) for r in found), key=str) == expected
    s = visits.visit_stats(df, at_ports, 1200, max_gap, 3.0).first()
    assert (s["visits"], s["short_candidates"], s["source_rows"], s["invalid_rows"]) == (len(expected), short, len(rows), 0)


def test_newest_rows_count_with_a_version(spark):
    old, new = track(*slow(0, 10, 20)), track((0, True, 0.5), (10, True, 9.0), (20, True, 0.5))
    df = spark.createDataFrame([(*r, v) for v, rows in ((1, old), (2, new)) for r in rows], f"{POINTS}, v int")
    ports = spark.createDataFrame(PORT, PORTS)
    assert visits.detect_visits(df.where("v = 1"), ports, version=["v"]).count() == 1
    assert visits.detect_visits(df, ports, version=["v"]).isEmpty()
    s = visits.visit_stats(df, ports, version=["v"]).first()
    assert (s["source_rows"], s["unique_timestamps"], s["conflicting_timestamps"], s["short_candidates"], s["invalid_rows"]) == (3, 3, 0, 2, 0)


def shuffled_bytes(spark, df) -> int:
    """Bytes that computing ``df`` shuffles, those of tables written on the way not counted."""
    df.collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plan, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        metric = node.metrics().get("shuffleBytesWritten")
        plan += metric.get().value() if metric.isDefined() else 0
        children = [node.executedPlan()] if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else [node.plan()] if "QueryStage" in node.getClass().getSimpleName() else [node.children().apply(k) for k in range(node.children().size())]
        todo += children
    return plan


def test_work_of_visits_does_not_grow_with_ports_of_one_circle(spark):
    rows = [r for m in range(20) for r in track(*slow(*range(0, 600, 5)), mmsi=257000001 + m)]
    df = spark.createDataFrame(rows, POINTS)

    def of(n):
        many = spark.createDataFrame([(f"P{k:05d}", "p", "NO", 60.0, 5.0, 1500.0) for k in range(n)], PORTS)
        e = visits.assign_ports(visits.collapse_positions(df), many)
        assert {(r["nearest"], r["n_inside"]) for r in e.select("nearest", "n_inside").distinct().collect()} == {("P00000", n)}
        return shuffled_bytes(spark, e)

    assert of(2000) < 1.5 * of(1)


def test_few_islands_are_moved_by_vessel(spark):
    """Of sparse vessels only what is near midnight or a visit is written."""
    rows = [(257000001 + m, at(1440 * d + 700 + 5 * k), 60.0, 5.0, 0.5) for m in range(30) for d in range(4) for k in range(3)]
    rows += track(*slow(*range(1400, 1480, 10)), mmsi=257009999)
    e = visits.assign_ports(visits.collapse_positions(spark.createDataFrame(rows, POINTS)), spark.createDataFrame(PORT, PORTS))
    chosen = F.col("eligible").isNotNull() & (F.col("seen") >= 5)
    found = visits.chosen_islands(e, chosen)
    assert [(r["mmsi"], r["seen"], r["later"]) for r in found.collect()] == [(257009999, 8, False)]
    full = visits.island_table(e).where(chosen)
    assert [(r["mmsi"], r["seen"]) for r in full.collect()] == [(257009999, 8)]
    assert shuffled_bytes(spark, found) < shuffled_bytes(spark, full) / 2


def test_radius_join_wraps_longitude_and_nears_poles(spark):
    ports = [("W", "w", "", 0.0, 179.999, 1500.0), ("P", "p", "", 89.99, 0.0, 5000.0)]
    points = spark.createDataFrame([(1, 0.0, -179.999), (2, 0.0, 179.5), (3, 89.99, 180.0), (4, 60.0, 0.0)], "id long, latitude double, longitude double")
    found = joins.ports_within_radius(points, spark.createDataFrame(ports, PORTS))
    assert {(r["id"], r["port_id"]) for r in found.collect()} == {(1, "W"), (3, "P")}
    every = points.crossJoin(spark.createDataFrame(ports, PORTS).select("port_id", F.col("latitude").alias("a"), F.col("longitude").alias("b"), "radius_m"))
    exact = every.where(E.haversine_m(F.col("latitude"), F.col("longitude"), F.col("a"), F.col("b")) <= F.col("radius_m"))
    assert exact.count() == 2


# ---------------------------------------------------------------- network


def routes(spark, *stops):
    """(mmsi, minute, visit id, port)."""
    v = spark.createDataFrame([(m, at(t), i, p) for m, t, i, p in stops], "mmsi long, arrival_at timestamp, visit_id string, port_id string")
    return {(r["from_port_id"], r["to_port_id"]): (r["movement_count"], r["vessel_count"], r["first_seen"], r["last_seen"]) for r in network.port_connections(v).collect()}


def test_routes(spark):
    assert routes(spark, (1, 0, "a", "A"), (1, 10, "b", "B")) == {("A", "B"): (1, 1, at(0), at(10))}
    assert routes(spark, (1, 0, "a", "A"), (1, 5, "b", "A")) == {}
    assert routes(spark, (1, 0, "a", "A"), (1, 5, "b", "A"), (1, 9, "c", "B")) == {("A", "B"): (1, 1, at(5), at(9))}
    assert set(routes(spark, (1, 0, "a", "A"), (1, 5, "b", "B"), (1, 9, "c", "A"))) == {("A", "B"), ("B", "A")}
    assert routes(spark, (1, 0, "a", "A"), (2, 1, "x", "A"), (1, 5, "b", "B"), (2, 9, "y", "B"))[("A", "B")] == (2, 2, at(0), at(9))
    assert set(routes(spark, (1, 0, "b", "B"), (1, 0, "a", "A"))) == {("A", "B")}


def cliques(spark):
    pairs = [(a, b) for g in ("abcd", "wxyz") for a in g for b in g if a < b] + [("d", "w")]
    return spark.createDataFrame([(a, b, 5) for a, b in pairs], "from_port_id string, to_port_id string, movement_count long")


def test_louvain_finds_planted_cliques(spark):
    e = network.project(cliques(spark), undirected=True)
    m = network.louvain(e)
    assert {r["node"]: r["community"] for r in m.collect()} == {**dict.fromkeys("abcd", "a"), **dict.fromkeys("wxyz", "w")}
    single = m.withColumn("community", F.col("node"))
    whole = m.withColumn("community", F.lit("a"))
    q = network.modularity(e, m).first()[0]
    assert q > network.modularity(e, single).first()[0] and q > network.modularity(e, whole).first()[0]
    s = network.community_stats(e, m).first()
    assert (s["communities"], s["smallest"], s["largest"]) == (2, 4, 4) and abs(s["modularity"] - q) < 1e-12


def test_pagerank_against_plain_iteration(spark):
    edges = [("a", "b", 3), ("b", "c", 1), ("b", "a", 1), ("c", "d", 2)]
    r = {x["node"]: x["page_rank"] for x in network.pagerank(network.project(spark.createDataFrame(edges, "from_port_id string, to_port_id string, movement_count long")), max_iter=7).collect()}
    out = {"a": 3, "b": 2, "c": 2}
    x = dict.fromkeys("abcd", 0.15)
    for _ in range(7):
        x = {n: 0.15 + 0.85 * sum(x[s] * w / out[s] for s, d, w in edges if d == n) for n in "abcd"}
    assert all(abs(r[n] - x[n]) < 1e-12 for n in "abcd")


def test_empty_network_flows_through(spark):
    none = cliques(spark).limit(0)
    ranks, members = network.pagerank(network.project(none)), network.louvain(network.project(none, undirected=True))
    rows = network.metric_rows(ranks, members, "r", F.lit(T0), F.lit(T0))
    assert rows.count() == members.count() == 0


def test_community_labels(spark):
    names = [("1", " ÅLESUND "), ("2", "MÅLØY"), ("3", "FLORØ"), ("4", "X"), ("5", "  ")]
    m = spark.createDataFrame([("r", p, 0 if p != "5" else 1, s) for (p, _), s in zip(names, (2.0, 1.0, 0.5, 0.2, 1.0), strict=True)], "run_id string, port_id string, community_id long, page_rank double")
    found = {r["community_id"]: (r["community_name"], r["community_label"], r["port_count"]) for r in network.community_labels(m, spark.createDataFrame(names, "port_id string, name string")).collect()}
    assert found == {0: ("ÅLESUND", "ÅLESUND / MÅLØY / FLORØ", 4), 1: ("5", "5", 1)}


def test_edges_are_validated(spark):
    e = cliques(spark)
    known = spark.createDataFrame([(c,) for c in "abcdwxyz"], "port_id string")
    assert network.validate_edges(e, known, 13).count() == 13
    for edges, ports, n in ((e, known.where("port_id <> 'a'"), None), (e, known, 12), (e.withColumn("movement_count", F.lit(0)), known, None)):
        with pytest.raises(ValueError):
            network.validate_edges(edges, ports, n)


# ---------------------------------------------------------------- versions


def test_publish_sequence(spark):
    schema = "run_id string, port_id string, page_rank double, exported_at timestamp, is_deleted int"
    history, clock = spark.createDataFrame([], schema), T0
    keys = ["run_id", "port_id"]
    for members, now in (("AB", clock), ("AB", clock), ("A", clock - timedelta(hours=1)), ("", clock), ("BC", clock), ("ABC", clock)):
        new = spark.createDataFrame([("r", m, 1.0) for m in members], "run_id string, port_id string, page_rank double")
        rows = versioned.publish_snapshot(history, new, "r", keys, "exported_at", now)
        history = spark.createDataFrame([tuple(r[c] for c in history.columns) for r in history.unionByName(rows).collect()], schema)
        assert {r["port_id"] for r in versioned.active(history, keys, ["exported_at"]).collect()} == set(members)
    twice = spark.createDataFrame([("r", "A", 1.0), ("r", "A", 2.0)], "run_id string, port_id string, page_rank double")
    with pytest.raises(PySparkException):
        versioned.publish_snapshot(history, twice, "r", keys, "exported_at", clock).collect()
    with pytest.raises(PySparkException):
        versioned.publish_snapshot(history, twice.limit(1), "other", keys, "exported_at", clock).collect()


def run_rows(spark):
    return spark.createDataFrame([("r", T0, at(60), "h", "{}", 10, 1, at(99)), ("r", T0, at(60), "h", "{}", 10, 2, at(100))], schemas.RUNS)


def test_run_registry(spark):
    runs = run_rows(spark)
    versioned.check_run_window(runs, "r", T0, at(60))
    with pytest.raises(ValueError):
        versioned.check_run_window(runs, "r", T0, at(61))
    v = spark.createDataFrame([("r", i, 1, "A", None, T0, T0, None, 0, "window_end", 2, 1.0, T0, 0) for i in "ab"], schemas.VISITS)
    assert versioned.completed_visits(v, runs, "r").count() == 2
    with pytest.raises(ValueError):
        versioned.completed_visits(v.limit(1), runs, "r")
    with pytest.raises(ValueError):
        versioned.completed_visits(v, runs, "unknown")
    assert {str(r["activity_date"]) for r in versioned.backfill_activity_dates(v, runs).collect()} == {"2026-09-12"}
    with pytest.raises(PySparkException):
        versioned.backfill_activity_dates(v.withColumn("run_id", F.lit("x")), runs).collect()
    row = {"run_id": "s", "window_start": T0, "window_end": at(1), "dataset_hash": "h", "parameters": "{}", "source_rows": 1, "visit_count": 1, "completed_at": at(500)}
    assert versioned.latest_run(versioned.complete_run(runs, row)).first()["run_id"] == "s"


def test_snapshot_dates_are_corrected_within_a_month(spark):
    import datetime as dt

    def metrics(start, day):
        return spark.createDataFrame([("r", start, start, day, "A", 1.0, 0, T0, None, None, 0)], schemas.METRICS)

    fixed = versioned.backfill_snapshot_dates(metrics(T0, dt.date(2026, 9, 1))).first()
    assert str(fixed["snapshot_date"]) == "2026-09-12" and fixed["exported_at"] > T0
    assert versioned.backfill_snapshot_dates(metrics(T0, dt.date(2026, 9, 12))).count() == 0
    with pytest.raises(PySparkException):
        versioned.backfill_snapshot_dates(metrics(T0, dt.date(2026, 8, 31))).collect()


# ---------------------------------------------------------------- parsing and loads


def values(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_gap_events_are_parsed_leniently(spark):
    d = values(spark, '{"mmsi":257000001,"name":"A","shipType":70}', '{"mmsi":"257000002"}', '{"mmsi":true}', '{"mmsi":1.5}', '{"mmsi":0}', '{"mmsi":1000000000}', '{"mmsi":"12a"}', "[1]", "{bad", '"x"', None, '{"name":"x"}')
    assert {(r["mmsi"], r["name"], r["ship_type"]) for r in positions.parse_gap_events(d).collect()} == {(257000001, "A", 70), (257000002, None, None)}


def test_feature_events_need_a_zone(spark):
    def event(time, speed="1.5"):
        return f'{{"mmsi":1,"msgtime":{time},"speedOverGround":{speed}}}'

    d = values(spark, event('"2026-09-12T00:00:00.1239Z"'), event('"2026-09-12T02:00:00+02:00"', '"fast"'), event('"2026-09-12T00:00:00"'), event("5"), event('"x"'))
    r = positions.parse_feature_events(d).orderBy("event_time").collect()
    assert [(x["event_time"], x["speed"]) for x in r] == [(T0, None), (T0 + timedelta(milliseconds=123), 1.5)]


def test_positions_keep_nanoseconds(spark):
    d = values(spark, '{"mmsi":1,"msgtime":"2026-09-12T00:00:00.123456789Z","latitude":60.1,"longitude":5,"speedOverGround":3.2,"trueHeading":90}', "{bad", '{"mmsi":2}')
    r = positions.positions_from_json(d).collect()
    assert len(r) == 1 and r[0]["msgtime_ns"] % 1_000_000_000 == 123456789 and r[0]["true_heading"] == 90 and r[0]["msgtime"].microsecond == 123456


def test_historic_records(spark):
    d = spark.createDataFrame([(1, "2026-09-12T00:00:00Z", 60.0, 5.0), (2, None, 60.0, 5.0), (3, "2026-09-12T00:00:00Z", None, 5.0)], "mmsi long, dateTimeUtc string, latitude double, longitude double")
    for c in (*positions.SNAKE, "name"):
        d = d.withColumn(c, F.lit(None).cast("string"))
    assert [r["mmsi"] for r in positions.normalize_historic(d).collect()] == [1]


def test_window_ceiling(spark):
    d = spark.createDataFrame(track(*slow(0, 10, 20)), POINTS)
    assert positions.positions_window(d, at(0), at(20), 2).count() == 2
    with pytest.raises(ValueError):
        positions.positions_window(d, at(0), at(21), 2)


def test_strict_events(spark):
    good = '{"mmsi":"257000001","window_minutes":"5","window_start":"2026-09-12T00:00:00Z","window_end":"2026-09-12T00:05:00Z","position_count":"3","avg_speed":"0.1234567890123456","name":null}'
    r = derived.ingest_features(values(spark, good)).first()
    assert (r["avg_speed"], r["name"], r["max_speed"], str(r["activity_date"])) == (0.1234567890123456, None, None, "2026-09-12")
    bad = [good.replace('"name"', '"unknown"'), good.replace("257000001", "0"), good.replace('"5"', '"x"'), good.replace("00:05:00Z", "00:00:00Z"), good.replace("00:05:00Z", "00:05:00"), "[]", "{"]
    for text in bad:
        with pytest.raises(PySparkException):
            derived.ingest_features(values(spark, text)).collect()
    gap = '{"event_type":"AIS_GAP_ENDED","mmsi":257000001,"gap_detected_at":"2026-09-12T23:59:00Z","gap_ended_at":"2026-09-13T00:01:00.5Z","gap_duration_seconds":"720.5"}'
    g = derived.ingest_gap_events(values(spark, gap)).first()
    assert (str(g["activity_date"]), g["gap_duration_seconds"], g["ship_type"]) == ("2026-09-13", 720.5, None)
    for text in (gap.replace("AIS_GAP_ENDED", "OTHER"), gap.replace("23:59:00Z", "late")):
        with pytest.raises(PySparkException):
            derived.ingest_gap_events(values(spark, text)).collect()


def historical(spark, *rows):
    from decimal import Decimal

    full = [(T0, 257000001, 5.0, 60.0, 0, Decimal(str(c)), h, Decimal(str(s)), t, 0, "x", "A", 1, b"\x01\x02") for c, h, s, t in rows]
    return spark.createDataFrame(full, schemas.HISTORICAL_RAW)


def test_curated_sentinels(spark, tmp_path):
    d = historical(spark, (360, 511, "102.30", -128), (448, 512, "102.31", -127), (471, 0, "0.00", 0), (511, 1, "1.00", 1), (-1, 2, "2.00", 2), ("359.99", 359, "102.29", 127))
    r = files.curate_positions(d).collect()
    assert [x["course_over_ground"] is None for x in r] == [True] * 5 + [False]
    assert [x["true_heading"] for x in r][:2] == [None, 512] and [x["rate_of_turn"] for x in r][:2] == [None, -127]
    assert [x["speed_over_ground"] is None for x in r] == [True] + [False] * 5 and r[0]["geometry"] == b"\x01\x02"
    assert checks.curated_load(files.curated_summary(d, files.curate_positions(d))).count() == 0
    assert {x["measure"] for x in checks.curated_load(files.curated_summary(d, files.curate_positions(d).limit(5))).collect()} == {"curated_rows"}
    files.load_curated(d, str(tmp_path / "curated"))
    assert spark.read.parquet(str(tmp_path / "curated")).where("day = '2026-09-12'").count() == 6
    with pytest.raises(ValueError):
        files.load_curated(d.withColumn("data_source", F.lit(None).cast("string")), str(tmp_path / "none"))


def test_parquet_inspection_and_replacement(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(10).coalesce(1).write.parquet(f"{source}/a")
    spark.range(5).coalesce(1).write.parquet(f"{source}/b")
    assert files.check_files(files.inspect_parquet(spark, source)) == 15
    out = str(tmp_path / "out")
    files.replace_table(spark.range(15), out, 15)
    files.replace_table(spark.range(7), out)
    assert files.read_table(spark, out).count() == 7
    with pytest.raises(ValueError):
        files.replace_table(spark.range(3), out, 4)
    assert files.read_table(spark, out).count() == 7
    spark.range(5).withColumn("other", F.lit(1)).coalesce(1).write.parquet(f"{source}/c")
    with pytest.raises(ValueError):
        files.check_files(files.inspect_parquet(spark, source))


def test_seed_faults(spark, tmp_path):
    def seed(text):
        p = tmp_path / f"{abs(hash(text))}.csv"
        p.write_text(text)
        return files.read_seed(spark, str(p), "code", ("name",))

    assert {(r["code"], r["name"]) for r in seed("code,name\n 1 , One \n02,\n").collect()} == {(1, "One"), (2, None)}
    for bad in ("code,label\n1,a\n", "code,name\nx,a\n", "code,name\n1,a\n 1,b\n", "code,name\n1,a,b\n", ""):
        with pytest.raises(ValueError):
            seed(bad)


def test_ports_and_countries(spark):
    ports = spark.createDataFrame(PORT, PORTS)
    assert reference.validate_ports(ports).count() == 1 and len(reference.dataset_hash(ports)) == 64
    for bad in (ports.limit(0), ports.union(ports), ports.withColumn("name", F.lit(" ")), ports.withColumn("latitude", F.lit(91.0)), ports.withColumn("radius_m", F.lit(0.5)), ports.withColumn("longitude", F.lit(float("nan")))):
        with pytest.raises(ValueError):
            reference.validate_ports(bad)
    raw = [('{"alpha_2":"NO","alpha_3":"NOR","ccn3":"578"}', '{"common":"Norway"}', "Europe", '[{"name":"Oslo","attributes":{"primary":true}}]'), ('{"alpha_2":"x"}', None, None, None), (None, None, None, None)]
    r = reference.stg_countries(spark.createDataFrame(raw, "codes string, names string, region string, capitals string")).collect()
    assert [(x["country_code"], x["iso3"], x["numeric_code"], x["country_name"], x["capital_city"]) for x in r] == [("NO", "NOR", "578", "Norway", "Oslo")]


def test_topics_must_differ(spark):
    with pytest.raises(ValueError):
        positions.write_topic(spark.range(1), {"topic": "a", "sourceTopic": "a"}, "x")


# ---------------------------------------------------------------- marts and job


def test_speed_limit_and_classes(spark):
    d = spark.createDataFrame([(102.2,), (102.1,), (None,)], "s double")
    assert [r[0] for r in d.select(E.valid_speed(F.col("s"))).collect()] == [None, 102.1, None]
    numbers = {"25700000": "invalid_length", "001234567": "coast_station", "012345678": "group_call", "111234567": "sar_aircraft", "991234567": "aid_to_navigation", "970123456": "ais_sart", "972123456": "mob_device", "974123456": "epirb_ais", "812345678": "handheld_vhf", "257000001": "ship", "981234567": "parent_ship_craft", "123456789": "nonstandard"}
    found = spark.createDataFrame([(n,) for n in numbers], "n string").withColumn("c", E.mmsi_format_class(F.col("n"))).collect()
    assert {r["n"]: r["c"] for r in found} == numbers


def test_rounding_is_half_away_from_zero(spark):
    r = spark.createDataFrame([(12.25,), (-12.25,), (0.0,), (None,)], "x double").select(E.round_(F.col("x"), 1)).collect()
    assert [x[0] for x in r] == [12.3, -12.3, 0.0, None]


def enrichment_tables(spark):
    import datetime as dt

    names = daily.ANOMALY_COLUMNS
    base = dict.fromkeys(names, 1.0) | {"mmsi": 1, "activity_date": dt.date(2026, 9, 1), "vessel_name": "V", "ship_type_name": "T", "ship_category": "C", "dominant_navigational_status_name": "Moored", "anomaly_reason": "speed", "ais_points": 5, "baseline_days": 3} | dict.fromkeys(("speed_anomaly", "stationary_anomaly", "status_speed_mismatch", "navigation_status_inconsistent"), True)
    rows = [tuple((base | {"mmsi": m, "anomaly_rank": k})[n] for n in names) for m, k in ((1, 1), (2, 100), (3, 101))]
    types = {"mmsi": "long", "activity_date": "date", "ais_points": "long", "baseline_days": "long", "anomaly_rank": "int"} | dict.fromkeys(("vessel_name", "ship_type_name", "ship_category", "dominant_navigational_status_name", "anomaly_reason"), "string") | dict.fromkeys(("speed_anomaly", "stationary_anomaly", "status_speed_mismatch", "navigation_status_inconsistent"), "boolean")
    return spark.createDataFrame(rows, ", ".join(f"{n} {types.get(n, 'double')}" for n in names))


def test_enrichment_cycle(spark):
    anomalies = enrichment_tables(spark)
    c = marts.enrichment_candidates(anomalies)
    assert {r["mmsi"] for r in c.collect()} == {1, 2}

    def fn(row):
        if row["mmsi"] == 2:
            return {"activity_class": "flying"}
        return {"activity_class": "transit", "navigation_status_quality": "consistent", "summary": "s", "notable_behavior": "n", "response_id": "r1", "input_tokens": 1, "output_tokens": 2}

    done, failed = enrichment.apply_enrichment(c, fn, "m", "v1")
    assert [r["mmsi"] for r in failed.collect()] == [2] and "flying" in failed.first()["error"]
    history = done.cache()
    assert [r["mmsi"] for r in marts.pending_enrichment(c, history, None, "m", "v1", 1).collect()] == [2]
    assert marts.pending_enrichment(c, history, None, "other", "v1").count() == 2
    features = c.select("mmsi", "activity_date").union(anomalies.where("mmsi = 3").select("mmsi", "activity_date"))
    enriched = marts.vessel_daily_enriched(features, c, history, "m", "v1")
    assert {r["mmsi"]: (r["has_ai_enrichment"], r["ai_summary"]) for r in enriched.collect()} == {1: (1, "s"), 2: (0, None), 3: (0, None)}
    assert checks.valid_current_enrichment(enriched, c, "m", "v1").count() == 0
    assert [r["mmsi"] for r in checks.valid_current_enrichment(enriched, c, "m", "v2").collect()] == [1]
    changed = marts.enrichment_candidates(anomalies.withColumn("anomaly_score", F.lit(9.0)))
    assert marts.vessel_daily_enriched(features, changed, history, "m", "v1").where("has_ai_enrichment = 1").count() == 0
    assert reports.enriched_anomalies(anomalies, enriched, "v1").first()["vessels"] == 1


def test_activity_window():
    now = datetime(2026, 9, 13, 2, tzinfo=UTC)
    assert daily_job.activity_window(None, now)[0] == datetime(2026, 9, 12, tzinfo=UTC)
    assert daily_job.activity_window({"activity_date": "2026-09-01"}, now)[1] == datetime(2026, 9, 2, tzinfo=UTC)
    for bad in ({"start": "x"}, {"activity_date": "1/9/2026"}, {"activity_date": "2026-02-30"}):
        with pytest.raises(ValueError):
            daily_job.activity_window(bad, now)


def answer(row):
    return {"activity_class": "transit", "navigation_status_quality": "consistent", "summary": f"rank {row['anomaly_rank']}", "notable_behavior": "n", "response_id": str(row["mmsi"])}


def test_daily_job(spark, small, tmp_path):
    from tidewake.bindings import SLOW_KN, VISIT_GAP, VISIT_SPEED, Tables

    t = Tables(spark, small)
    for name in ("positions_raw", "ports", "ship_types", "status_names", "countries_raw"):
        getattr(t, name).write.parquet(str(tmp_path / name))
    options = {"stationary": SLOW_KN, "hours": 12, "points": 5, "max_gap": VISIT_GAP, "max_speed": VISIT_SPEED, "model": "m", "enrich": answer}
    paths = daily_job.Paths(*(str(tmp_path / n) for n in ("positions_raw", "ports", "ship_types", "status_names", "out")), countries=str(tmp_path / "countries_raw"), options=options)
    assert daily_job.run_range(spark, "2024-01-09", "2024-01-10", paths) == ["2024-01-09", "2024-01-10"]
    out = f"{tmp_path}/out"
    f = spark.read.parquet(f"{out}/vessel_daily_features")
    assert {str(r["activity_date"]) for r in f.collect()} == {"2024-01-09", "2024-01-10"}
    published = spark.read.parquet(f"{out}/port_visits").where("run_id = '2024-01-10T00:00:00Z'")
    assert published.count() > 1 and published.where("is_deleted = 1").count() == 0
    runs = spark.read.parquet(f"{out}/port_visit_runs")
    assert {r["run_id"]: r["visit_count"] for r in runs.collect()}["2024-01-10T00:00:00Z"] == published.count()
    with pytest.raises(ValueError):
        daily_job.run_range(spark, "2024-01-10", "2024-01-09", paths)

    # what a run publishes again depends on its own folder alone
    mine = paths.of_run(spark, "port_visits", schemas.VISITS, "2024-01-10T00:00:00Z")
    assert mine.count() == published.count() and mine.where("run_id <> '2024-01-10T00:00:00Z'").isEmpty()
    assert all("/of_run=2024-01-10T000000Z/" in f for f in mine.inputFiles())
    assert spark.read.parquet(f"{out}/port_visits").select("run_id").distinct().count() == 2
    assert paths.of_run(spark, "port_visits", schemas.VISITS, "2030-01-01T00:00:00Z").isEmpty()

    # a rerun without the positions of one visit leaves a tombstone and the others alive
    gone = published.orderBy("visit_id").first()
    rest = t.positions_raw.where(~((F.col("mmsi") == gone["mmsi"]) & F.col("msgtime").between(gone["arrival_at"], gone["last_observed_at"])))
    rest.write.parquet(str(tmp_path / "fewer"))
    again = daily_job.Paths(str(tmp_path / "fewer"), *(str(tmp_path / n) for n in ("ports", "ship_types", "status_names", "out")), countries=paths.countries, options=options)
    assert not any(daily_job.run_day(spark, "2024-01-10", again).values())
    history = spark.read.parquet(f"{out}/port_visits").where("run_id = '2024-01-10T00:00:00Z'")
    assert gone["visit_id"] in {r["visit_id"] for r in history.where("is_deleted = 1").collect()}
    alive = versioned.active(history, ["run_id", "visit_id"], ["updated_at"])
    assert gone["visit_id"] not in {r["visit_id"] for r in alive.collect()} and alive.count() > 0
    assert spark.read.parquet(f"{out}/port_visit_runs").where("run_id = '2024-01-10T00:00:00Z'").count() == 2

    # a day without positions publishes nothing and passes its checks
    assert not any(daily_job.run_day(spark, "2023-05-01", paths).values())


def test_daily_job_enriches_each_input_once(spark, tmp_path):
    stamps = [(257000000 + m, T0 + timedelta(days=d, minutes=10 * k), 60.0, 5.0, 10.0 + (20 if d == 9 else 0), 0, 70, f"V{m}", T0) for m in (1, 2) for d in range(10) for k in range(144)]
    columns = "mmsi long, msgtime timestamp, latitude double, longitude double, speed_over_ground double, navigational_status int, ship_type int, name string, ingested_at timestamp"
    p = spark.createDataFrame(stamps, columns).withColumns({"course_over_ground": F.lit(1.0), "true_heading": F.lit(1), "stream": F.lit("s")})
    p.write.parquet(str(tmp_path / "positions"))
    spark.createDataFrame(PORT, PORTS).write.parquet(str(tmp_path / "ports"))
    spark.createDataFrame([(70, "Cargo ship", "Cargo")], "ship_type int, ship_type_name string, ship_category string").write.parquet(str(tmp_path / "types"))
    spark.createDataFrame([(0, "Under way")], "navigational_status int, navigational_status_name string").write.parquet(str(tmp_path / "status"))
    calls = spark.sparkContext.accumulator(0)

    def fn(row):
        calls.add(1)
        return answer(row)

    paths = daily_job.Paths(*(str(tmp_path / n) for n in ("positions", "ports", "types", "status", "out")), options={"model": "m", "enrich": fn})
    for _ in range(2):
        daily_job.run_day(spark, "2026-09-21", paths)
        e = spark.read.parquet(f"{tmp_path}/out/vessel_daily_enriched/day=2026-09-21").collect()
        assert {(r["mmsi"], r["ai_summary"], r["has_ai_enrichment"]) for r in e} == {(257000001, "rank 1", 1), (257000002, "rank 2", 1)}
    assert calls.value == 2


def test_windows_open_only_their_folders(spark, tmp_path):
    import contextlib
    import io

    rows = [(m, T0 + timedelta(hours=7 * k), 60.0, 5.0, 1.0) for m in (1, 2) for k in range(300)]
    p = spark.createDataFrame(rows, POINTS)
    for unit in ("month", "day"):
        files.write_partitioned(p, f"{tmp_path}/{unit}", "msgtime", unit)
        d = spark.read.parquet(f"{tmp_path}/{unit}")
        for start, end in ((at(0), at(1440)), (at(100), at(100_000)), (datetime(2026, 10, 1), datetime(2026, 11, 1)), (at(-5000), at(1))):
            w = positions.positions_window(d, start, end)
            assert sorted(map(tuple, w.select(*p.columns).collect())) == sorted(r for r in rows if start <= r[1] < end)
        plan = io.StringIO()
        with contextlib.redirect_stdout(plan):
            positions.positions_window(d, datetime(2026, 10, 1), datetime(2026, 11, 1)).explain()
        assert f"PartitionFilters: [isnotnull({unit}#" in plan.getvalue() or f"PartitionFilters: [(cast({unit}" in plan.getvalue() or f"PartitionFilters: [({unit}" in plan.getvalue()
        read = positions.positions_window(d, datetime(2026, 10, 1), datetime(2026, 11, 1)).select(F.input_file_name().alias("f"), unit)
        assert {str(r[unit])[:7] for r in read.collect()} == {"2026-10"}
    assert positions.positions_window(p.withColumn("month", F.lit("x")), at(0), at(1440)).count() == sum(at(0) <= r[1] < at(1440) for r in rows)


def test_vessel_dimension_covers_more_than_ninety_days(spark, tmp_path):
    """Every day's run equals the whole history up to it, whatever the order of runs, and reads no day twice."""
    start = datetime(2026, 1, 1, tzinfo=UTC)
    rows = [(257000001 + k % 3, start + timedelta(hours=20 * k, minutes=k % 7), 60.0 + k % 5, 5.0, float(k % 40), k % 9, 70 + k % 3, None if k % 4 else f"NAME {k // 60}", start + timedelta(days=300, hours=k)) for k in range(150)]
    rows += [(257000001, r[1], 1.0, 1.0, 200.0, 1, 80, "LATER", start + timedelta(days=400)) for r in rows[::30]]
    p = spark.createDataFrame(rows, "mmsi long, msgtime timestamp, latitude double, longitude double, speed_over_ground double, navigational_status int, ship_type int, name string, ingested_at timestamp")
    p = p.withColumns({"course_over_ground": F.col("latitude"), "true_heading": F.lit(1), "stream": F.lit("s")})
    files.write_partitioned(p, f"{tmp_path}/positions", "msgtime", "day")
    paths = daily_job.Paths(f"{tmp_path}/positions", "", "", "", f"{tmp_path}/out")
    for day in ("2026-05-05", "2026-03-01", "2026-05-06", "2026-05-06"):
        at_, end = daily_job.activity_window({"activity_date": day}, start)
        got = daily.fold_vessel_days(daily_job._vessel_days(spark, paths, at_, end))
        expected = daily.stg_vessels(p.where(F.col("msgtime") < F.lit(end)))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect())) and got.count() == 3
    assert (expected.agg(F.max(F.datediff("last_seen", "first_seen"))).first()[0]) > 90
    done = spark.read.parquet(f"{tmp_path}/out/vessel_days_done")
    assert {r["count"] for r in done.groupBy("activity_date").count().where("activity_date NOT IN ('2026-03-01', '2026-05-06')").collect()} == {1}
    late = daily_job.Paths(f"{tmp_path}/positions", "", "", "", f"{tmp_path}/late", options={"analysis_start": "2026-04-01"})
    at_, end = daily_job.activity_window({"activity_date": "2026-05-05"}, start)
    got = daily.fold_vessel_days(daily_job._vessel_days(spark, late, at_, end))
    expected = daily.stg_vessels(p.where((F.col("msgtime") < F.lit(end)) & (F.col("msgtime") >= "2026-04-01")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
