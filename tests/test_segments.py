"""Scans by vessel and day against plain loops, with one vessel that has most rows."""

from __future__ import annotations

import contextlib
import io
import random
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewake.operators import network, visits
from tidewake.streaming import gaps

T0 = datetime(2026, 1, 1, 23, 0)
HOT = 257000001
EVENTS = "mmsi long, msgtime timestamp, eligible string, inside array<string>"


def rows(seed=4, n=4000):
    """Observations of a hot vessel (nine in ten rows) and others over many midnights, some days empty."""
    rng, out = random.Random(seed), []
    for mmsi, count in ((HOT, n * 9 // 10), (257000002, n // 20), (257000003, n // 20)):
        t, port = T0, "A"
        for _ in range(count):
            t += timedelta(seconds=rng.choice([60, 300, 600, 899, 900, 901, 7200, 200_000] if rng.random() < 0.1 else [60, 300, 600]))
            port = rng.choice(["A", "B", None]) if rng.random() < 0.05 else port
            out.append((mmsi, t, port, [port] if port else []))
    return out


def plain_islands(events):
    out, last = [], {}
    for mmsi, t, port, inside in sorted(events, key=lambda r: r[:2]):
        before = last.get(mmsi)
        number = 1 if before is None else before[2] + ((t - before[0]).total_seconds() > 900 or port != before[1])
        last[mmsi] = (t, port, number)
        out.append((mmsi, t, number))
    return out


def plan_of(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()


def only_days_go_by_vessel(df) -> None:
    """What is dealt by vessel alone has been aggregated to vessel-days before."""
    lines = plan_of(df).split("\n")
    alone = [k for k, line in enumerate(lines) if re.search(r"hashpartitioning\(mmsi#\d+L?, \d+\)", line)]
    for k in alone:
        below = next(line for line in lines[k + 1 :] if not re.search(r"[-:] \*?(\(\d+\) )?(Project|Filter)", line))
        assert re.search(r"Aggregate\(keys?=\[mmsi#\d+L?, segment#\d+\]", below), below


def test_islands_of_a_hot_vessel_are_those_of_a_loop(spark):
    events = rows()
    df = spark.createDataFrame(events, EVENTS).repartition(6)
    found = visits.visit_islands(df)
    assert sorted((r["mmsi"], r["msgtime"], r["island"]) for r in found.collect()) == plain_islands(events)
    only_days_go_by_vessel(found)
    assert "hashpartitioning(mmsi" in plan_of(found)


def test_island_table_joins_pieces_over_midnight(spark):
    events = rows(seed=9)
    df = spark.createDataFrame(events, EVENTS).repartition(6)
    table = visits.island_table(df, 900, {"at_port": F.count("eligible")})
    only_days_go_by_vessel(table)
    found = {(r["mmsi"], r["island"]): r for r in table.collect()}
    numbered = plain_islands(events)
    by = {}
    for mmsi, t, k in numbered:
        by.setdefault((mmsi, k), []).append(t)
    assert set(found) == set(by)
    assert any(ts[0].date() != ts[-1].date() for ts in by.values())
    for key, ts in by.items():
        r = found[key]
        assert (r["seen"], r["head"]["here"]["msgtime"], r["tail"]["here"]["msgtime"]) == (len(ts), ts[0], ts[-1])
        before, after = by.get((key[0], key[1] - 1)), by.get((key[0], key[1] + 1))
        assert (r["head"]["before"] or {"msgtime": None})["msgtime"] == (before[-1] if before else None)
        assert (r["tail"]["after"] or {"msgtime": None})["msgtime"] == (after[0] if after else None)
        assert r["at_port"] in (0, len(ts))


def test_moves_of_a_hot_vessel(spark):
    rng = random.Random(3)
    stays = [(HOT if k % 10 else 257000002, rng.choice("ABC"), T0 + timedelta(hours=7 * (k // 3)), f"v{k:04d}") for k in range(400)]
    v = spark.createDataFrame(stays, "mmsi long, port_id string, arrival_at timestamp, visit_id string").repartition(5)
    expected, last = [], {}
    for mmsi, port, t, _ in sorted(stays, key=lambda s: (s[0], s[2], s[3])):
        if mmsi in last:
            expected.append((mmsi, last[mmsi][0], port, last[mmsi][1], t))
        last[mmsi] = (port, t)
    moves = network.consecutive_visits(v)
    only_days_go_by_vessel(moves)
    assert sorted(map(tuple, moves.collect())) == sorted(expected)


def test_silences_of_a_hot_vessel(spark):
    events = rows(seed=5)
    p = spark.createDataFrame([(m, t, f"n{k}" if k % 3 else None, k % 90, k % 9) for k, (m, t, _, _) in enumerate(events)], "mmsi long, msgtime timestamp, name string, ship_type int, navigational_status int")
    p = p.withColumns({"latitude": F.lit(60.0), "longitude": F.lit(5.0)}).repartition(6)
    by = {}
    for m, t, _, _ in sorted(events, key=lambda r: r[:2]):
        by.setdefault(m, []).append(t)
    pairs = [(m, a, b) for m, ts in by.items() for a, b in zip(ts, [*ts[1:], None], strict=True) if b is None or (b - a).total_seconds() > 600]
    found = gaps.gap_events_batch(p)
    only_days_go_by_vessel(found)
    ended = sorted((r["mmsi"], r["last_event_msgtime"], r["resumed_event_msgtime"]) for r in found.where("event_type = 'AIS_GAP_ENDED'").collect())
    assert ended == sorted(x for x in pairs if x[2])
    assert sorted((r["mmsi"], r["last_event_msgtime"]) for r in found.where("event_type = 'AIS_GAP_DETECTED'").collect()) == sorted(x[:2] for x in pairs)
