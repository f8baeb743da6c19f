"""The registered queries and their DuckDB SQL.

A query returns plain columns: times as microseconds, dates as text, flags as
0 or 1, so that both engines' results can be compared as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewake import bindings as B
from tidewake import schemas
from tidewake.bindings import Tables, with_tables
from tidewake.functions.expressions import mmsi_format_class, run_id
from tidewake.operators import daily, joins, network, versioned, visits
from tidewake.plans import marts
from tidewake.shared import shared_folder, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Times as microseconds, dates as text, flags as 0 or 1, decimals as doubles."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = F.unix_micros(c)
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, tables: bool = True):
    """Register a function of :class:`Tables`, with its SQL if there is one."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plain(f(Tables(spark, sf_dir)))
        if sql:
            ORACLES[name] = with_tables(sql) if tables else sql
        return f

    return add


def us(*columns: str) -> str:
    return ", ".join(f"epoch_us({c}) AS {c}" for c in columns)


def bits(*columns: str) -> str:
    return ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in columns)


DAY = "CAST(activity_date AS VARCHAR) AS activity_date"

# ---------------------------------------------------------------- derived tables, each defined once


def positions(t: Tables) -> DataFrame:
    return daily.newest_positions(t.positions_raw)


def vessel_table(t: Tables) -> DataFrame:
    return marts.vessels(daily.stg_vessels(t.positions_raw), t.ship_types, t.status_names)


def features(t: Tables) -> DataFrame:
    return marts.vessel_daily_features(t.positions_raw, vessel_table(t), t.status_names, stationary=B.SLOW_KN)


def anomalies(t: Tables) -> DataFrame:
    return daily.daily_anomalies(features(t), B.HOURS, B.POINTS, stationary_floor=B.STATIONARY_FLOOR)


def visit_table(t: Tables) -> DataFrame:
    return visits.detect_visits(t.positions_raw, t.ports, B.VISIT_STAY, B.VISIT_GAP, B.VISIT_SPEED, daily.POSITION_VERSION)


def points(t: Tables) -> DataFrame:
    return daily.with_previous_status(positions(t).withColumn("activity_date", F.to_date("msgtime")))


# ---------------------------------------------------------------- positions and versions


@query("latest_by_key", "SELECT mmsi, epoch_us(msgtime) AS msgtime, seq, speed_over_ground, epoch_us(ingested_at) AS ingested_at FROM positions")
def latest_by_key(t: Tables) -> DataFrame:
    return positions(t).select("mmsi", "msgtime", "seq", "speed_over_ground", "ingested_at")


@query("duplicate_keys", "SELECT mmsi, epoch_us(msgtime) AS msgtime, count(*) AS copies FROM positions_raw GROUP BY ALL HAVING count(*) > 1 ORDER BY copies DESC, mmsi, msgtime LIMIT 20")
def duplicate_keys(t: Tables) -> DataFrame:
    return versioned.duplicate_keys(t.positions_raw, ["mmsi", "msgtime"])


@query("row_versions", "SELECT CAST(sum(n) AS BIGINT) AS physical_rows, count(*) AS logical_rows FROM (SELECT count(*) AS n FROM positions_raw GROUP BY mmsi, msgtime)")
def row_versions(t: Tables) -> DataFrame:
    return versioned.row_versions(t.positions_raw, ["mmsi", "msgtime"])


@query("latest_order_of_customer", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1", False)
def latest_order_of_customer(t: Tables) -> DataFrame:
    return versioned.latest_by_key(t.read("orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("latest_vessel_rows", "SELECT mmsi, epoch_us(msgtime) AS msgtime, latitude, longitude, name, ship_type FROM positions_raw QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY msgtime DESC, ingested_at DESC) = 1")
def latest_vessel_rows(t: Tables) -> DataFrame:
    return versioned.latest_vessel_rows(t.positions_raw).drop("ingested_at")


@query("missing_keys", "SELECT 'without order' AS side, c_custkey AS custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) UNION ALL SELECT DISTINCT 'indebted', o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)", False)
def missing_keys(t: Tables) -> DataFrame:
    c, o = t.read("customer").select(F.col("c_custkey").alias("custkey")), t.read("orders").select(F.col("o_custkey").alias("custkey"))
    big = t.read("orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("custkey"))
    rich = t.read("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("custkey"))
    left = versioned.missing_keys(c, big, "custkey").select(F.lit("without order").alias("side"), "custkey")
    return left.unionByName(versioned.missing_keys(o, rich, "custkey").select(F.lit("indebted").alias("side"), "custkey"))


@query("uppercase_stream", "SELECT mmsi, epoch_us(msgtime) AS msgtime, latitude, longitude, name, upper(stream) AS stream FROM positions_raw WHERE mmsi IS NOT NULL")
def uppercase_stream(t: Tables) -> DataFrame:
    from tidewake.sources.positions import uppercase_stream as run

    return run(t.positions_raw)


@query("positions_window", "SELECT mmsi, epoch_us(msgtime) AS msgtime, speed_over_ground FROM positions_raw WHERE msgtime >= TIMESTAMP '2024-01-05' AND msgtime < TIMESTAMP '2024-01-06'")
def positions_window(t: Tables) -> DataFrame:
    from tidewake.sources.positions import positions_window as run

    return run(t.positions_raw, "2024-01-05", "2024-01-06").select("mmsi", "msgtime", "speed_over_ground")


@query("mmsi_format_class", """
    SELECT n AS number, CASE WHEN length(n) <> 9 THEN 'invalid_length' WHEN n LIKE '00%' THEN 'coast_station' WHEN n LIKE '0%' THEN 'group_call' WHEN n LIKE '111%' THEN 'sar_aircraft'
      WHEN n LIKE '99%' THEN 'aid_to_navigation' WHEN n LIKE '98%' THEN 'parent_ship_craft' WHEN n LIKE '970%' THEN 'ais_sart' WHEN n LIKE '972%' THEN 'mob_device' WHEN n LIKE '974%' THEN 'epirb_ais'
      WHEN n LIKE '8%' THEN 'handheld_vhf' WHEN substr(n, 1, 1) IN ('2', '3', '4', '5', '6', '7') THEN 'ship' ELSE 'nonstandard' END AS class
    FROM (SELECT CAST((o_orderkey * 7919 + o_custkey * 104729) % 1100000000 AS VARCHAR) AS n FROM orders)""", False)  # fmt: skip
def mmsi_classes(t: Tables) -> DataFrame:
    n = ((F.col("o_orderkey") * 7919 + F.col("o_custkey") * 104729) % 1100000000).cast("string")
    return t.read("orders").select(n.alias("number")).withColumn("class", mmsi_format_class(F.col("number")))


@query("run_id", "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS run_id FROM events", False)
def run_ids(t: Tables) -> DataFrame:
    return t.read("events").select("event_id", run_id(F.col("ts").cast("timestamp")).alias("run_id"))


@query("busiest_vessels", f"SELECT mmsi, count(*) AS positions, {B.sql_round('avg(speed_over_ground)', 2)} AS avg_speed, {us('min(msgtime)').replace('AS min(msgtime)', 'AS first_seen')}, epoch_us(max(msgtime)) AS last_seen FROM positions_raw GROUP BY mmsi ORDER BY positions DESC, mmsi LIMIT 10")
def busiest_vessels(t: Tables) -> DataFrame:
    return daily.busiest_vessels(t.positions_raw)


@query("valid_positions", "SELECT mmsi, epoch_us(msgtime) AS msgtime, CASE WHEN speed_over_ground >= 0 AND speed_over_ground < 102.3e0 THEN speed_over_ground END AS speed FROM positions")
def valid_positions(t: Tables) -> DataFrame:
    return visits.valid_positions(positions(t)).select("mmsi", "msgtime", F.col("speed_over_ground").alias("speed"))


# ---------------------------------------------------------------- marts


@query("stg_vessels", f"SELECT mmsi, vessel_name, ship_type, {us('first_seen', 'last_seen')}, name_count, ais_message_count, {B.sql_round('avg_speed_kn', 6)} AS avg_speed_kn, max_speed_kn, last_speed_kn, last_latitude, last_longitude, last_course, last_heading, last_navigational_status FROM stg_vessels")
def stg_vessels(t: Tables) -> DataFrame:
    from tidewake.functions.expressions import round_

    return daily.stg_vessels(t.positions_raw).withColumn("avg_speed_kn", round_(F.col("avg_speed_kn"), 6))


@query("fold_vessel_days", f"SELECT mmsi, vessel_name, ship_type, {us('first_seen', 'last_seen')}, name_count, ais_message_count, {B.sql_round('avg_speed_kn', 6)} AS avg_speed_kn, max_speed_kn, last_speed_kn, last_latitude, last_longitude, last_course, last_heading, last_navigational_status FROM stg_vessels")
def fold_vessel_days(t: Tables) -> DataFrame:
    """The vessel dimension from partials by vessel and day, which a job keeps instead of reading all positions again."""
    from tidewake.functions.expressions import round_

    return daily.fold_vessel_days(daily.vessel_days(t.positions_raw)).withColumn("avg_speed_kn", round_(F.col("avg_speed_kn"), 6))


@query("vessels", f"SELECT mmsi, vessel_name, ship_type_name, ship_category, last_navigational_status_name, mmsi_format_class, {bits('is_valid_mmsi', 'has_identity_conflict', 'has_unknown_ship_type', 'is_test_record', 'is_dashboard_eligible', 'is_ai_enrichment_eligible')} FROM vessels")
def vessels(t: Tables) -> DataFrame:
    return vessel_table(t).select("mmsi", "vessel_name", "ship_type_name", "ship_category", "last_navigational_status_name", "mmsi_format_class", "is_valid_mmsi", "has_identity_conflict", "has_unknown_ship_type", "is_test_record", "is_dashboard_eligible", "is_ai_enrichment_eligible")


@query("vessel_daily_features", f"SELECT * REPLACE ({DAY}, {us('first_seen', 'last_seen')}) FROM features")
def vessel_daily_features(t: Tables) -> DataFrame:
    return features(t)


@query("with_previous_status", "SELECT mmsi, epoch_us(msgtime) AS msgtime, coalesce(navigational_status, -1) AS navigational_status, coalesce(before, -1) AS previous_navigational_status FROM points")
def with_previous_status(t: Tables) -> DataFrame:
    return points(t).select("mmsi", "msgtime", "navigational_status", "previous_navigational_status").fillna(-1)


@query("dominant_status", f"SELECT mmsi, {DAY}, dominant_navigational_status, dominant_status_pct FROM dominant")
def dominant_status(t: Tables) -> DataFrame:
    return daily.dominant_status(points(t))


@query("daily_aggregates", f"SELECT * REPLACE ({DAY}, {us('first_seen', 'last_seen')}) FROM daily")
def daily_aggregates(t: Tables) -> DataFrame:
    return daily.daily_aggregates(points(t), stationary=B.SLOW_KN)


@query("well_observed", f"SELECT mmsi, {DAY}, ais_points, observation_hours FROM observed")
def well_observed(t: Tables) -> DataFrame:
    return daily.well_observed(features(t), B.HOURS, B.POINTS).select("mmsi", "activity_date", "ais_points", "observation_hours")


_BASE = ", ".join(f"{B.sql_round(c, 6)} AS {c}" for c in ("baseline_avg_speed_kn", "baseline_sd_speed_kn", "baseline_stationary_pct", "baseline_sd_stationary_pct"))
_BASE_SQL = f"SELECT mmsi, {DAY}, coalesce(baseline_days, 0) AS baseline_days, coalesce(baseline_speed_days, 0) AS baseline_speed_days, coalesce(baseline_stationary_days, 0) AS baseline_stationary_days, {_BASE} FROM baseline"


def _baseline(df: DataFrame) -> DataFrame:
    from tidewake.functions.expressions import round_

    rounded = ("baseline_avg_speed_kn", "baseline_sd_speed_kn", "baseline_stationary_pct", "baseline_sd_stationary_pct")
    return df.select("mmsi", "activity_date", "baseline_days", "baseline_speed_days", "baseline_stationary_days", *(round_(F.col(c), 6).alias(c) for c in rounded))


@query("rolling_baseline", _BASE_SQL)
def rolling_baseline(t: Tables) -> DataFrame:
    return _baseline(joins.rolling_baseline(daily.well_observed(features(t), B.HOURS, B.POINTS)))


@query("rolling_baseline_by_days", _BASE_SQL)
def rolling_baseline_by_days(t: Tables) -> DataFrame:
    return _baseline(joins.rolling_baseline_by_days(daily.well_observed(features(t), B.HOURS, B.POINTS)))


_ANOMALY_SELECT = ", ".join(DAY if c == "activity_date" else f"CAST({c} AS INTEGER) AS {c}" if c in ("speed_anomaly", "stationary_anomaly", "status_speed_mismatch", "navigation_status_inconsistent") else c for c in daily.ANOMALY_COLUMNS)


@query("vessel_daily_anomalies", f"SELECT {_ANOMALY_SELECT} FROM anomalies")
def vessel_daily_anomalies(t: Tables) -> DataFrame:
    return anomalies(t)


# ---------------------------------------------------------------- visits and network


@query("ports_within_radius", "SELECT mmsi, epoch_us(msgtime) AS msgtime, nearest, len(ports_inside) AS n_inside FROM near")
def ports_within_radius(t: Tables) -> DataFrame:
    seen = visits.collapse_positions(visits.valid_positions(positions(t)))
    return visits.assign_ports(seen, t.ports, B.VISIT_SPEED).where("nearest IS NOT NULL").select("mmsi", "msgtime", "nearest", "n_inside")


@query("collapse_positions", "SELECT mmsi, epoch_us(msgtime) AS msgtime, latitude, longitude, speed FROM observations")
def collapse_positions(t: Tables) -> DataFrame:
    return visits.collapse_positions(visits.valid_positions(positions(t))).select("mmsi", "msgtime", "latitude", "longitude", F.col("speed_over_ground").alias("speed"))


@query("visit_islands", "SELECT mmsi, epoch_us(msgtime) AS msgtime, eligible, CAST(island AS BIGINT) AS island FROM islands")
def visit_islands(t: Tables) -> DataFrame:
    seen = visits.collapse_positions(visits.valid_positions(positions(t)))
    return visits.visit_islands(visits.assign_ports(seen, t.ports, B.VISIT_SPEED), B.VISIT_GAP).select("mmsi", "msgtime", "eligible", "island")


@query("detect_visits", f"SELECT visit_id, mmsi, port_id, {us('arrival_at', 'last_observed_at')}, coalesce(epoch_us(departure_at), -1) AS departure_at, arrival_censored, end_reason, observation_count, observed_stay_seconds FROM visits")
def detect_visits(t: Tables) -> DataFrame:
    return plain(visit_table(t)).fillna(-1, ["departure_at"])


@query("visit_summaries", "SELECT mmsi, port_id, count(*) AS visit_count FROM visits GROUP BY ALL")
def visit_summaries(t: Tables) -> DataFrame:
    return visits.visit_summaries(visit_table(t))


@query("visit_stats", f"""
    SELECT (SELECT count(*) FROM positions) AS source_rows, 0 AS invalid_rows, (SELECT count(*) FROM observations) AS unique_timestamps,
      (SELECT count(*) FROM observations WHERE latitude IS NULL) AS conflicting_timestamps, (SELECT count(*) FROM assigned WHERE nearest IS NOT NULL) AS positions_inside_ports,
      (SELECT count(*) FROM visits) AS visits, (SELECT count(*) FROM (SELECT 1 FROM islands WHERE eligible IS NOT NULL GROUP BY mmsi, island HAVING count(*) < 2 OR epoch_us(max(msgtime)) - epoch_us(min(msgtime)) < {B.VISIT_STAY * 1_000_000})) AS short_candidates""")  # fmt: skip
def visit_stats(t: Tables) -> DataFrame:
    return visits.visit_stats(t.positions_raw, t.ports, B.VISIT_STAY, B.VISIT_GAP, B.VISIT_SPEED, daily.POSITION_VERSION)


@query("port_connections", f"SELECT from_port_id, to_port_id, movement_count, vessel_count, {us('first_seen', 'last_seen')} FROM routes")
def port_connections(t: Tables) -> DataFrame:
    return network.port_connections(visit_table(t))


@query("consecutive_visits", "SELECT mmsi, from_port_id, to_port_id, epoch_us(from_arrival_at) AS from_arrival_at, epoch_us(arrival_at) AS arrival_at FROM moves")
def consecutive_visits(t: Tables) -> DataFrame:
    return network.consecutive_visits(visit_table(t)).where("from_port_id <> to_port_id")


@query("connection_stats", "SELECT (SELECT count(*) FROM visits) AS visits, count(*) AS movements, count(DISTINCT (from_port_id, to_port_id)) AS relationships, count(DISTINCT mmsi) AS vessels FROM moves")
def connection_stats(t: Tables) -> DataFrame:
    return network.connection_stats(visit_table(t))


@query("endpoints", "SELECT from_port_id AS port_id FROM network UNION SELECT to_port_id FROM network")
def endpoints(t: Tables) -> DataFrame:
    return joins.endpoints(t.network)


@query("project_directed", "SELECT from_port_id AS src, to_port_id AS dst, CAST(movement_count AS DOUBLE) AS weight FROM network")
def project_directed(t: Tables) -> DataFrame:
    return network.project(t.network)


@query("project_undirected", "SELECT src, dst, CAST(sum(w) AS DOUBLE) AS weight FROM (SELECT from_port_id AS src, to_port_id AS dst, movement_count AS w FROM network UNION ALL SELECT to_port_id, from_port_id, movement_count FROM network) GROUP BY ALL")
def project_undirected(t: Tables) -> DataFrame:
    return network.project(t.network, undirected=True)


@query("pagerank", f"SELECT node, {B.sql_round('page_rank', 9)} AS page_rank FROM ranks")
def pagerank(t: Tables) -> DataFrame:
    from tidewake.functions.expressions import round_

    return network.pagerank(network.project(t.network), B.DAMPING, B.ROUNDS).withColumn("page_rank", round_(F.col("page_rank"), 9))


@query("modularity", f"""
    SELECT {B.sql_round('sum(inner_w / w - pow(deg / w, 2))', 9)} AS modularity FROM (
      SELECT c, sum(m) AS deg, sum(CASE WHEN c = d THEN m ELSE 0 END) AS inner_w FROM (
        SELECT right(a, 1) AS c, right(b, 1) AS d, m FROM (SELECT from_port_id AS a, to_port_id AS b, CAST(movement_count AS DOUBLE) AS m FROM network UNION ALL SELECT to_port_id, from_port_id, CAST(movement_count AS DOUBLE) FROM network)) GROUP BY c),
      (SELECT 2 * sum(movement_count) AS w FROM network)""")  # fmt: skip
def modularity(t: Tables) -> DataFrame:
    """Of the partition by last letter, which SQL can compute as well."""
    from tidewake.functions.expressions import round_

    e = network.project(t.network, undirected=True)
    m = joins.endpoints(t.network).select(F.col("port_id").alias("node"), F.substring("port_id", -1, 1).alias("community"))
    return network.modularity(e, m).withColumn("modularity", round_(F.col("modularity"), 9))


@query("louvain")
def louvain(t: Tables) -> DataFrame:
    return network.louvain(network.project(t.network, undirected=True))


# ---------------------------------------------------------------- windows and gaps


def window_table(t: Tables) -> DataFrame:
    return _window_table(t, positions(t))


def folded_window_table(t: Tables) -> DataFrame:
    """Windows of positions that lie close together: the latest one holds many vessels, some without speeds."""
    return _window_table(t, t.folded(positions(t)), (30,))


def _window_table(t: Tables, p: DataFrame, sizes: tuple[int, ...] = B.SIZES) -> DataFrame:
    from tidewake.streaming import windows as W

    e = p.select("mmsi", F.col("msgtime").alias("event_time"), "seq", "name", F.col("speed_over_ground").alias("speed"), "ship_type", F.col("navigational_status").alias("navigation_status"))
    return W.labelled(W.window_features(e, sizes, B.SLIDE, order=("event_time", "seq")), t.ship_types, t.status_names)


def gap_table(t: Tables) -> DataFrame:
    from tidewake.streaming import gaps as G

    return G.labelled(G.gap_events_batch(positions(t), B.GAP_TIMEOUT), t.ship_types, t.status_names)


AS_OF_SQL = "TIMESTAMP '2024-01-20 12:00:00'"


def as_of():
    return F.lit("2024-01-20 12:00:00").cast("timestamp")


R = B.sql_round
_SPEEDS = ", ".join(f"{R(c, 2)} AS {c}" for c in ("avg_speed", "min_speed", "max_speed"))


@query("window_features", f"SELECT mmsi, window_minutes, {us('window_start', 'window_end')}, position_count, {R('avg_speed', 6)} AS avg_speed, min_speed, max_speed, name, ship_type, coalesce(last_navigation_status, -1) AS last_navigation_status, ship_type_name, ship_category, last_navigation_status_name FROM window_labels")
def window_features(t: Tables) -> DataFrame:
    from tidewake.functions.expressions import round_

    return window_table(t).drop("activity_date").withColumn("avg_speed", round_(F.col("avg_speed"), 6)).fillna(-1, ["last_navigation_status"])


@query("tumbling_windows", f"SELECT mmsi, epoch_us(window_start) AS window_start, position_count FROM window_features WHERE window_minutes = {B.SLIDE}")
def tumbling_windows(t: Tables) -> DataFrame:
    from tidewake.streaming import windows as W

    e = positions(t).select("mmsi", F.col("msgtime").alias("event_time"), "name", F.col("speed_over_ground").alias("speed"), "ship_type", F.col("navigational_status").alias("navigation_status"))
    return W.window_features(e, (B.SLIDE,), B.SLIDE).select("mmsi", "window_start", "position_count")


@query("gap_events_batch", f"SELECT event_type, mmsi, name, {us('last_event_msgtime', 'gap_detected_at')}, coalesce(epoch_us(gap_ended_at), -1) AS gap_ended_at, gap_duration_seconds, ship_category, navigation_status_name FROM gap_labels")
def gap_events_batch(t: Tables) -> DataFrame:
    return plain(gap_table(t).select("event_type", "mmsi", "name", "last_event_msgtime", "gap_detected_at", "gap_ended_at", "gap_duration_seconds", "ship_category", "navigation_status_name")).fillna(-1, ["gap_ended_at"])


@query("upsert_vessel_state", "SELECT mmsi, epoch_us(msgtime) AS msgtime, seq, name FROM positions QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY msgtime DESC, seq DESC) = 1")
def upsert_vessel_state(t: Tables) -> DataFrame:
    from tidewake.streaming.gaps import upsert_vessel_state as run

    p = positions(t).select("mmsi", "msgtime", "seq", "name")
    half = F.lit("2024-01-15").cast("timestamp")
    old = run(p.limit(0), p.where(F.col("msgtime") < half))
    return run(old, p.where(F.col("msgtime") >= half))


def run_stream(t: Tables, stream: DataFrame, name: str) -> DataFrame:
    """What a stream writes until it has read everything there is, from the shared folder."""
    from tidewake.streaming.windows import start_query

    folder = shared_folder(t.spark, name)
    start_query(stream, f"{folder}/out", f"{folder}/checkpoint", available_now=True).awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("stream_window_features", f"""
    SELECT mmsi, {B.SLIDE * 3} AS window_minutes, epoch_us(make_timestamp(w * {B.SLIDE * 60_000_000})) AS window_start, count(*) AS position_count, {B.sql_round('avg(value)', 6)} AS avg_speed, max(value) AS max_speed
    FROM (SELECT {B.MMSI_SQL} AS mmsi, value, unnest(range(epoch_us(ts) // {B.SLIDE * 60_000_000} - 2, epoch_us(ts) // {B.SLIDE * 60_000_000} + 1)) AS w FROM events)
    WHERE w * {B.SLIDE * 60_000_000} + {B.SLIDE * 3 * 60_000_000} <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - 30000000 FROM events) GROUP BY mmsi, w""", False)  # fmt: skip
def stream_window_features(t: Tables) -> DataFrame:
    """Windows that the watermark has closed when the stream has read all events."""
    from tidewake.functions.expressions import round_
    from tidewake.streaming import windows as W

    p = B.positions_of(t.stream("events"))
    e = p.select("mmsi", F.col("msgtime").alias("event_time"), "name", F.col("speed_over_ground").alias("speed"), "ship_type", F.col("navigational_status").alias("navigation_status"))
    out = run_stream(t, W.window_features(e, (3 * B.SLIDE,), B.SLIDE, watermark="30 seconds"), "stream-windows")
    return out.select("mmsi", "window_minutes", "window_start", "position_count", round_(F.col("avg_speed"), 6).alias("avg_speed"), "max_speed")


@query("stream_uppercase", f"SELECT {B.MMSI_SQL} AS mmsi, epoch_us(ts) AS msgtime, upper(event_type) AS stream FROM events", False)
def stream_uppercase(t: Tables) -> DataFrame:
    from tidewake.sources.positions import uppercase_stream as run

    return run_stream(t, run(B.positions_of(t.stream("events"))), "stream-uppercase").select("mmsi", "msgtime", "stream")


def _report(name: str, sql: str, f: Callable[[Tables], DataFrame]) -> None:
    query(f"report_{name}", sql)(f)


def _reports() -> None:
    from tidewake import reports as P

    w, g = window_table, gap_table
    for suffix, w, labels in (("", window_table, "window_labels"), ("_of_many", folded_window_table, "folded_labels")):
        source, latest = f"(SELECT * FROM {labels} WHERE window_minutes = 30) f", f"window_end = (SELECT max(window_end) FROM {labels} WHERE window_minutes = 30)"
        _report(f"active_vessels_latest{suffix}", f"SELECT count(DISTINCT mmsi) AS active_vessels FROM {source} WHERE {latest}", lambda t, w=w: P.active_vessels_latest(w(t), 30))
        _report(f"average_speed_latest{suffix}", f"SELECT {R('avg(avg_speed)', 2)} AS avg_speed FROM {source} WHERE {latest}", lambda t, w=w: P.average_speed_latest(w(t), 30))
        _report(f"fastest_latest{suffix}", f"SELECT mmsi, name, ship_category, last_navigation_status_name, {R('avg_speed', 2)} AS avg_speed, {R('max_speed', 2)} AS max_speed FROM {source} WHERE {latest} AND max_speed IS NOT NULL ORDER BY f.max_speed DESC, mmsi LIMIT 10", lambda t, w=w: P.fastest_latest(w(t), 30))
        _report(f"categories_latest{suffix}", f"SELECT coalesce(ship_category, 'Unknown') AS ship_category, count(DISTINCT mmsi) AS vessels FROM {source} WHERE {latest} GROUP BY 1", lambda t, w=w: P.categories_latest(w(t), 30))
        _report(f"statuses_latest{suffix}", f"SELECT coalesce(last_navigation_status_name, 'Unknown') AS navigation_status, count(DISTINCT mmsi) AS vessels FROM {source} WHERE {latest} GROUP BY 1", lambda t, w=w: P.statuses_latest(w(t), 30))
        _report(f"features_latest{suffix}", f"SELECT name, mmsi, ship_category, last_navigation_status_name AS navigation_status, position_count, {_SPEEDS}, {us('window_start', 'window_end')} FROM {source} WHERE {latest} ORDER BY f.max_speed DESC NULLS LAST, mmsi LIMIT 100", lambda t, w=w: P.features_latest(w(t), 30))
    w = window_table
    _report("windows_by_size", "SELECT window_minutes, count(*) AS windows FROM window_labels GROUP BY 1", lambda t: P.windows_by_size(w(t)))
    _report("newest_features", f"SELECT mmsi, window_minutes, {us('window_start', 'window_end')}, position_count FROM window_labels f ORDER BY f.window_end DESC, mmsi, window_minutes LIMIT 20", lambda t: P.newest_features(w(t)).select("mmsi", "window_minutes", "window_start", "window_end", "position_count"))
    ended = f"FROM gap_labels WHERE event_type = 'AIS_GAP_ENDED' AND gap_ended_at >= {AS_OF_SQL} - INTERVAL"
    _report("gaps_detected", f"SELECT count(*) AS gaps_detected FROM gap_labels WHERE event_type = 'AIS_GAP_DETECTED' AND gap_detected_at >= {AS_OF_SQL} - INTERVAL 1 HOUR", lambda t: P.gaps_detected(g(t), as_of()))
    _report("gaps_recovered", f"SELECT count(*) AS gaps_recovered {ended} 1 HOUR", lambda t: P.gaps_recovered(g(t), as_of()))
    _report("most_recovered", f"SELECT mmsi, arg_max(name, gap_ended_at) AS name, arg_max(ship_category, gap_ended_at) AS ship_category, count(*) AS recovered_gaps, {R('(avg(gap_duration_seconds) / 60)', 1)} AS avg_gap_minutes, {R('(max(gap_duration_seconds) / 60)', 1)} AS max_gap_minutes {ended} 24 HOUR GROUP BY mmsi ORDER BY recovered_gaps DESC, max_gap_minutes DESC, mmsi LIMIT 10", lambda t: P.most_recovered(g(t), as_of()))
    _report("average_gap", f"SELECT {R('(avg(gap_duration_seconds) / 60)', 1)} AS avg_gap_minutes {ended} 24 HOUR", lambda t: P.average_gap(g(t), as_of()))
    _report("gap_durations", f"SELECT CASE WHEN gap_duration_seconds < 900 THEN '10–15 min' WHEN gap_duration_seconds < 1800 THEN '15–30 min' WHEN gap_duration_seconds < 3600 THEN '30–60 min' ELSE '60+ min' END AS gap_duration, count(*) AS gaps {ended} 24 HOUR GROUP BY 1", lambda t: P.gap_durations(g(t), as_of()))
    _report("latest_gap_events", f"SELECT CASE event_type WHEN 'AIS_GAP_DETECTED' THEN 'Detected' ELSE 'Recovered' END AS event_type, name, mmsi, ship_category, navigation_status_name, epoch_us(gap_detected_at) AS gap_detected_at, coalesce(epoch_us(gap_ended_at), -1) AS gap_ended_at, {R('(gap_duration_seconds / 60)', 1)} AS gap_minutes, epoch_us(coalesce(gap_ended_at, gap_detected_at)) AS event_time FROM gap_labels h WHERE coalesce(gap_ended_at, gap_detected_at) >= {AS_OF_SQL} - INTERVAL 24 HOUR ORDER BY coalesce(h.gap_ended_at, h.gap_detected_at) DESC, mmsi, h.event_type LIMIT 100", lambda t: plain(P.latest_gap_events(g(t), as_of())).fillna(-1, ["gap_ended_at"]))
    _report("long_recovered", "SELECT mmsi, epoch_us(gap_ended_at) AS gap_ended_at, gap_duration_seconds FROM gap_labels WHERE event_type = 'AIS_GAP_ENDED' AND gap_duration_seconds >= 1800 ORDER BY gap_duration_seconds DESC, mmsi, gap_detected_at LIMIT 20", lambda t: P.long_recovered(g(t)).select("mmsi", "gap_ended_at", "gap_duration_seconds"))
    _report("gaps_by_type", "SELECT event_type, count(*) AS events FROM gap_labels GROUP BY 1", lambda t: P.gaps_by_type(g(t)))
    _report("matched_gap", "SELECT event_type, mmsi, epoch_us(gap_detected_at) AS gap_detected_at FROM gap_labels WHERE (mmsi, gap_detected_at) = (SELECT (mmsi, gap_detected_at) FROM gap_labels WHERE event_type = 'AIS_GAP_ENDED' ORDER BY gap_detected_at DESC, mmsi LIMIT 1)", lambda t: P.matched_gap(g(t)).select("event_type", "mmsi", "gap_detected_at"))
    v, a = vessel_table, anomalies
    _report("total_vessels", "SELECT count(*) AS vessels FROM vessels WHERE is_dashboard_eligible", lambda t: P.total_vessels(v(t)))
    _report("active_vessels", f"SELECT count(*) AS vessels FROM vessels WHERE is_dashboard_eligible AND last_seen >= {AS_OF_SQL} - INTERVAL 24 HOUR", lambda t: P.active_vessels(v(t), as_of()))
    _report("vessels_by_category", "SELECT ship_category, count(*) AS vessels FROM vessels WHERE is_dashboard_eligible GROUP BY 1", lambda t: P.vessels_by_category(v(t)))
    _report("vessels_by_status", "SELECT last_navigational_status_name, count(*) AS vessels FROM vessels WHERE is_dashboard_eligible GROUP BY 1", lambda t: P.vessels_by_status(v(t)))
    _report("last_positions", "SELECT DISTINCT mmsi, vessel_name, ship_category, last_latitude, last_longitude, epoch_us(date_trunc('minute', last_seen)) AS last_seen FROM vessels WHERE is_dashboard_eligible", lambda t: P.last_positions(v(t)))
    _report("vessel_details", "SELECT DISTINCT mmsi, vessel_name, ship_type_name, ship_category, ais_message_count, last_speed_kn, last_navigational_status_name FROM vessels WHERE is_dashboard_eligible AND CAST(last_seen AS DATE) = DATE '2024-01-30'", lambda t: P.vessel_details(v(t), "2024-01-30"))
    _report("anomaly_days", "SELECT count(*) AS vessel_days FROM anomalies", lambda t: P.anomaly_days(a(t)))
    _report("speed_and_stationary", "SELECT count(*) AS vessel_days FROM anomalies WHERE anomaly_reason = 'speed_and_stationary'", lambda t: P.speed_and_stationary(a(t)))
    _report("average_score", f"SELECT {R('avg(anomaly_score)', 3)} AS avg_score FROM anomalies", lambda t: P.average_score(a(t)))
    _report("anomalies_by_type", "SELECT CASE anomaly_reason WHEN 'speed_and_stationary' THEN 'Speed + Stationary' WHEN 'speed' THEN 'Speed' ELSE 'Stationary' END AS anomaly_type, count(*) AS vessel_days FROM anomalies GROUP BY 1", lambda t: P.anomalies_by_type(a(t)))
    _report("top_anomalies", f"SELECT {DAY}, mmsi, vessel_name, anomaly_reason, anomaly_score FROM anomalies b ORDER BY anomaly_score DESC, b.activity_date, mmsi LIMIT 10", lambda t: P.top_anomalies(a(t)))


_reports()


# ---------------------------------------------------------------- versioned snapshots


def visit_history(t: Tables) -> DataFrame:
    """Two publications of one run: all visits, then those of a changed set, at an earlier clock."""
    empty = t.spark.createDataFrame([], schemas.VISITS)
    first = visit_table(t).withColumns({"run_id": F.lit(B.RUN), "activity_date": F.lit("2024-01-01").cast("date")})
    first = written(first, "visits")
    keys = ["run_id", "visit_id"]
    one = written(versioned.publish_snapshot(empty, first, B.RUN, keys, "updated_at", F.lit("2024-02-02").cast("timestamp")), "visit-history")
    two = versioned.publish_snapshot(one, first.where("observation_count % 3 <> 0"), B.RUN, keys, "updated_at", F.lit("2024-02-01").cast("timestamp"))
    return written(one.unionByName(two.select(*one.columns)), "visit-history")


def runs(t: Tables) -> DataFrame:
    """Registry rows: one for each order status, as runs of which the newest is the published one."""
    o = t.read("orders").groupBy("o_orderstatus").agg(F.count("*").alias("source_rows"))
    run = F.when(F.col("o_orderstatus") == "F", B.RUN).otherwise(F.concat(F.lit("2023-"), F.col("o_orderstatus")))
    done = F.when(F.col("o_orderstatus") == "F", "2024-02-03").otherwise("2023-02-03").cast("timestamp")
    start = F.when(F.col("o_orderstatus") == "F", B.WINDOW[0]).otherwise("2023-01-01 00:00:00").cast("timestamp")
    return o.select(run.alias("run_id"), start.alias("window_start"), F.lit("h").alias("dataset_hash"), "source_rows", done.alias("completed_at"))


_LIVE = f"SELECT run_id, CAST(activity_date AS VARCHAR) AS activity_date, visit_id, mmsi, port_id, epoch_us(arrival_at) AS arrival_at, observation_count, epoch_us(updated_at) AS updated_at"
_LIVE_COLUMNS = ["run_id", "activity_date", "visit_id", "mmsi", "port_id", "arrival_at", "observation_count", "updated_at"]


@query("publish_snapshot", f"{_LIVE}, is_deleted FROM visit_history")
def publish_snapshot(t: Tables) -> DataFrame:
    return visit_history(t).select(*_LIVE_COLUMNS, "is_deleted")


@query("active_versions", f"{_LIVE} FROM live_visits")
def active_versions(t: Tables) -> DataFrame:
    return versioned.active(visit_history(t), ["run_id", "visit_id"], ["updated_at"]).select(*_LIVE_COLUMNS)


@query("current_port_visits", f"{_LIVE} FROM live_visits")
def current_port_visits(t: Tables) -> DataFrame:
    return versioned.current_port_visits(visit_history(t), runs(t)).select(*_LIVE_COLUMNS)


@query("backfill_activity_dates", f"SELECT run_id, visit_id, '2024-01-01' AS activity_date, epoch_us(updated_at) + 1 AS updated_at FROM live_visits")
def backfill_activity_dates(t: Tables) -> DataFrame:
    undated = visit_history(t).withColumn("activity_date", F.lit(None).cast("date"))
    return versioned.backfill_activity_dates(undated, runs(t)).select("run_id", "visit_id", "activity_date", "updated_at")


@query("membership_diff", "SELECT 'old' AS side, visit_id FROM visits WHERE observation_count % 3 = 0 UNION ALL SELECT 'new', visit_id FROM visits WHERE observation_count % 3 = 1")
def membership_diff(t: Tables) -> DataFrame:
    v = written(visit_table(t), "visits")
    return versioned.membership_diff(v.where("observation_count % 3 <> 1"), v.where("observation_count % 3 <> 0"), ["visit_id"])


@query("report_visits_of_run", f"SELECT visit_id, mmsi, port_id, epoch_us(arrival_at) AS arrival_at FROM live_visits")
def report_visits_of_run(t: Tables) -> DataFrame:
    from tidewake import reports as P

    return P.visits_of_run(visit_history(t), B.RUN).select("visit_id", "mmsi", "port_id", "arrival_at")


@query("report_run_list", f"SELECT CASE o_orderstatus WHEN 'F' THEN '{B.RUN}' ELSE '2023-' || o_orderstatus END AS run_id, count(*) AS source_rows FROM orders GROUP BY ALL", False)
def report_run_list(t: Tables) -> DataFrame:
    from tidewake import reports as P

    return P.run_list(runs(t)).select("run_id", "source_rows")


# ---------------------------------------------------------------- graph tables


def metric_table(t: Tables) -> DataFrame:
    """Metric rows of the trade network; communities by last letter, which SQL can follow."""
    ranks = network.pagerank(network.project(t.network), B.DAMPING, B.ROUNDS)
    members = ranks.select("node", F.substring("node", -1, 1).alias("community"))
    start, end = (F.lit(w).cast("timestamp") for w in B.WINDOW)
    m = network.metric_rows(ranks, members, B.RUN, start, end)
    labels = network.community_labels(m, t.nation_ports).drop("port_count")
    m = m.join(labels, ["run_id", "community_id"], "left").withColumns({"exported_at": F.lit("2024-02-04").cast("timestamp"), "is_deleted": F.lit(0)})
    return written(m.select(*(c.split()[0] for c in schemas.METRICS.split(", "))), "metrics")


def nation_visits(t: Tables) -> DataFrame:
    n = t.read("nation").select(F.concat(F.lit("WPI:"), F.col("n_nationkey").cast("string")).alias("port_id"), "n_name")
    return visit_history(t).join(n, "port_id").drop("port_id").withColumnRenamed("n_name", "port_id")


def enriched_metrics(t: Tables) -> DataFrame:
    from tidewake.sources.reference import stg_countries

    return marts.port_graph_metrics_enriched(metric_table(t), t.nation_ports, marts.countries(stg_countries(t.countries_raw)), nation_visits(t))


_RANK = f"{B.sql_round('page_rank', 9)} AS page_rank"


def _rounded(df: DataFrame) -> DataFrame:
    from tidewake.functions.expressions import round_

    return df.withColumn("page_rank", round_(F.col("page_rank"), 9))


@query("countries", "SELECT country_code, iso3, numeric_code, country_name, region, capital_city FROM country_table")
def countries(t: Tables) -> DataFrame:
    from tidewake.sources.reference import stg_countries

    return marts.countries(stg_countries(t.countries_raw))


@query("metric_rows", f"SELECT run_id, port_id, {_RANK}, community_id, CAST(snapshot_date AS VARCHAR) AS snapshot_date FROM metric_table")
def metric_rows(t: Tables) -> DataFrame:
    return _rounded(metric_table(t).select("run_id", "port_id", "page_rank", "community_id", "snapshot_date"))


@query("community_labels", "SELECT * FROM label_table")
def community_labels(t: Tables) -> DataFrame:
    return network.community_labels(metric_table(t), t.nation_ports)


@query("community_stats", "SELECT count(*) AS communities, min(port_count) AS smallest, CAST(avg(port_count) AS DOUBLE) AS mean_size, max(port_count) AS largest FROM label_table")
def community_stats(t: Tables) -> DataFrame:
    e = network.project(t.network, undirected=True)
    m = joins.endpoints(t.network).select(F.col("port_id").alias("node"), F.substring("port_id", -1, 1).alias("community"))
    return network.community_stats(e, m).drop("modularity")


@query("check_known_ports", "SELECT port_id FROM metric_table WHERE port_id NOT IN (SELECT port_id FROM nation_ports WHERE latitude < 20)")
def check_known_ports(t: Tables) -> DataFrame:
    return network.check_known_ports(metric_table(t), t.nation_ports.where("latitude < 20")).select("port_id")


@query("port_graph_metrics_enriched", f"SELECT run_id, port_id, {_RANK}, community_id, port_name, country_code, country_name, iso3, numeric_code, latitude, longitude, community_name, community_label, unique_vessels, visit_count FROM enriched_metrics")
def port_graph_metrics_enriched(t: Tables) -> DataFrame:
    return _rounded(enriched_metrics(t)).select("run_id", "port_id", "page_rank", "community_id", "port_name", "country_code", "country_name", "iso3", "numeric_code", "latitude", "longitude", "community_name", "community_label", "unique_vessels", "visit_count")


@query("port_graph_communities", "SELECT run_id, community_id, CAST(min(snapshot_date) AS VARCHAR) AS activity_date, max(community_name) AS community_name, max(community_label) AS community_label, count(DISTINCT port_id) AS port_count FROM enriched_metrics GROUP BY ALL")
def port_graph_communities(t: Tables) -> DataFrame:
    return marts.port_graph_communities(enriched_metrics(t))


def _with_faulty_run(enriched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metric rows and communities of a good run and of one whose early ports are dated a day late and are missing from the communities."""
    early = F.substring("port_id", -1, 1) < "5"
    moved = enriched.withColumns({"run_id": F.lit("moved"), "activity_date": F.when(early, F.date_add("activity_date", 1)).otherwise(F.col("activity_date"))})
    counted = marts.port_graph_communities(enriched.unionByName(moved.where(~early)))
    return enriched.unionByName(moved), counted


def _graph_reports() -> None:
    from tidewake import checks
    from tidewake import reports as P

    m = enriched_metrics
    ports = f"SELECT port_name, epoch_us(TIMESTAMP '{B.WINDOW[0]}') AS window_start, community_name, {B.sql_round('max(page_rank)', 9)} AS page_rank, CAST(sum(unique_vessels) AS BIGINT) AS unique_vessels, CAST(sum(visit_count) AS BIGINT) AS visit_count FROM enriched_metrics GROUP BY port_name, community_name"
    _report("top_ports", f"{ports} ORDER BY max(enriched_metrics.page_rank) DESC, port_name LIMIT 10", lambda t: _rounded(P.top_ports(m(t))))
    _report("bottom_ports", f"{ports} ORDER BY max(enriched_metrics.page_rank), port_name LIMIT 10", lambda t: _rounded(P.bottom_ports(m(t))))
    _report("port_map", f"SELECT port_name, latitude, longitude, {B.sql_round('sum(page_rank)', 9)} AS page_rank, CAST(sum(unique_vessels) AS BIGINT) AS unique_vessels, CAST(sum(visit_count) AS BIGINT) AS visit_count, CAST(sum(community_id) AS BIGINT) AS community_id FROM enriched_metrics GROUP BY port_name, latitude, longitude", lambda t: _rounded(P.port_map(m(t))))
    _report("community_traffic", "SELECT community_name, CAST(sum(unique_vessels) AS BIGINT) AS unique_vessels, CAST(sum(visit_count) AS BIGINT) AS visit_count FROM enriched_metrics GROUP BY 1", lambda t: P.community_traffic(m(t)))
    _report("communities_list", "SELECT run_id, '2024-01-01' AS activity_date, community_id, community_name, community_label, port_count FROM label_table", lambda t: P.communities_list(marts.port_graph_communities(m(t))))
    query("check_graph_activity_date", "SELECT DISTINCT 'moved' AS run_id FROM metric_table WHERE right(port_id, 1) < '5'")(lambda t: checks.graph_activity_date(*_with_faulty_run(m(t))))
    query("check_community_port_counts", "SELECT DISTINCT 'moved' AS run_id FROM metric_table WHERE right(port_id, 1) < '5'")(lambda t: checks.community_port_counts(*_with_faulty_run(m(t))))
    query("check_memberships", "SELECT run_id, count(*) AS ports, 0 AS several, count(*) + 1 AS members FROM metric_table GROUP BY ALL")(lambda t: network.check_memberships(metric_table(t), network.community_labels(metric_table(t), t.nation_ports).withColumn("port_count", F.col("port_count") + F.when(F.col("community_id") == 0, 1).otherwise(0))))
    query("check_visit_activity_dates", f"SELECT run_id, visit_id FROM live_visits WHERE port_id = 'WPI:1'")(lambda t: checks.visit_activity_dates(visit_history(t).withColumn("activity_date", F.when(F.col("port_id") != "WPI:1", F.col("activity_date"))), runs(t)))
    query("check_current_visit_dates", "SELECT run_id, visit_id FROM live_visits WHERE port_id = 'WPI:1'")(lambda t: checks.current_visit_dates(visit_history(t).withColumn("activity_date", F.when(F.col("port_id") != "WPI:1", F.col("activity_date"))), runs(t)))
    query("check_unique", "SELECT mmsi, epoch_us(msgtime) AS msgtime, count(*) AS copies FROM positions_raw GROUP BY mmsi, msgtime HAVING count(*) > 1")(lambda t: checks.unique(t.positions_raw, ["mmsi", "msgtime"]))
    query("check_not_null", "SELECT 'name' AS column_name, count(*) AS rows FROM positions WHERE name IS NULL HAVING count(*) > 0 UNION ALL SELECT 'navigational_status', count(*) FROM positions WHERE navigational_status IS NULL HAVING count(*) > 0")(lambda t: checks.not_null(positions(t), ["mmsi", "msgtime", "name", "navigational_status"]))


_graph_reports()


# ---------------------------------------------------------------- enrichment


def candidates(t: Tables) -> DataFrame:
    """Candidates with a hash that SQL can compute as well."""
    c = marts.enrichment_candidates(anomalies(t)).drop("input_hash")
    text = F.concat_ws("|", F.col("mmsi").cast("string"), F.col("activity_date").cast("string"), "anomaly_reason")
    return written(c.withColumn("input_hash", F.sha2(text, 256)), "candidates")


def history(t: Tables, c: DataFrame) -> DataFrame:
    k = F.explode(F.array(F.lit(1), F.lit(2)))
    h = c.select("mmsi", "activity_date", "anomaly_reason", "anomaly_score", "input_hash", k.alias("k"))
    return h.select(
        "mmsi", "activity_date", F.lit("transit").alias("activity_class"), F.lit("consistent").alias("navigation_status_quality"), F.concat(F.lit("s"), "k").alias("summary"), F.lit("n").alias("notable_behavior"), F.lit(None).cast("string").alias("data_quality_note"),
        F.when(F.col("anomaly_reason") == "stationary", "m2").otherwise("m1").alias("model"), F.lit("v1").alias("prompt_version"), F.when(F.col("anomaly_score") > 1.2, F.col("input_hash")).otherwise("stale").alias("input_hash"),
        F.concat(F.lit("r"), "k").alias("response_id"), F.lit(1).alias("input_tokens"), F.lit(1).alias("output_tokens"), F.timestamp_seconds(F.unix_seconds(F.lit("2024-03-01").cast("timestamp")) + 3600 * F.col("k")).alias("created_at"),
    )


def enriched_days(t: Tables) -> DataFrame:
    c = candidates(t)
    return marts.vessel_daily_enriched(features(t), c, history(t, c), "m1", "v1")


@query("enrichment_candidates", f"SELECT mmsi, {DAY}, anomaly_reason, anomaly_score, anomaly_rank, input_hash FROM candidates")
def enrichment_candidates(t: Tables) -> DataFrame:
    return candidates(t).select("mmsi", "activity_date", "anomaly_reason", "anomaly_score", "anomaly_rank", "input_hash")


@query("pending_enrichment", f"SELECT mmsi, {DAY}, anomaly_rank FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM history h WHERE h.mmsi = c.mmsi AND h.activity_date = c.activity_date AND h.input_hash = c.input_hash AND model = 'm1') ORDER BY c.activity_date, anomaly_rank LIMIT 5")
def pending_enrichment(t: Tables) -> DataFrame:
    c = candidates(t)
    return marts.pending_enrichment(c, history(t, c), None, "m1", "v1", 5).select("mmsi", "activity_date", "anomaly_rank")


@query("newest_response", f"SELECT mmsi, {DAY}, summary, response_id FROM responses")
def newest_response(t: Tables) -> DataFrame:
    c = candidates(t)
    mine = history(t, c).where("model = 'm1' AND prompt_version = 'v1'")
    return marts.newest_response(joins.match_exact(mine, c.select("mmsi", "activity_date", "input_hash"), ["mmsi", "activity_date", "input_hash"])).select("mmsi", "activity_date", "summary", "response_id")


@query("vessel_daily_enriched", f"SELECT f.mmsi, CAST(f.activity_date AS VARCHAR) AS activity_date, ais_points, summary AS ai_summary, response_id, CASE WHEN response_id IS NULL THEN 0 ELSE 1 END AS has_ai_enrichment FROM features f LEFT JOIN responses r USING (mmsi, activity_date)")
def vessel_daily_enriched(t: Tables) -> DataFrame:
    return enriched_days(t).select("mmsi", "activity_date", "ais_points", "ai_summary", "response_id", "has_ai_enrichment")


def _enrichment_reports() -> None:
    from tidewake import checks
    from tidewake import reports as P

    _report("enriched_anomalies", "SELECT count(DISTINCT mmsi) AS vessels FROM anomalies JOIN responses USING (mmsi, activity_date) WHERE prompt_version = 'v1'", lambda t: P.enriched_anomalies(anomalies(t), enriched_days(t), "v1"))
    _report("insights", f"SELECT CAST(a.activity_date AS VARCHAR) AS activity_date, mmsi, vessel_name, CASE anomaly_reason WHEN 'speed_and_stationary' THEN 'Speed + Stationary' WHEN 'speed' THEN 'Speed' ELSE 'Stationary' END AS anomaly_type, anomaly_score, anomaly_rank, activity_class, summary AS ai_summary FROM anomalies a LEFT JOIN responses USING (mmsi, activity_date) ORDER BY anomaly_score DESC, a.activity_date, mmsi LIMIT 100", lambda t: P.insights(anomalies(t), enriched_days(t)))
    query("check_valid_current_enrichment", f"SELECT f.mmsi, CAST(f.activity_date AS VARCHAR) AS activity_date FROM features f JOIN responses r USING (mmsi, activity_date) WHERE f.mmsi % 2 = 1")(lambda t: checks.valid_current_enrichment(enriched_days(t), candidates(t).withColumn("input_hash", F.when(F.col("mmsi") % 2 == 1, "changed").otherwise(F.col("input_hash"))), "m1", "v1"))


_enrichment_reports()


# ---------------------------------------------------------------- historical files and reference tables


@query("curate_positions", "SELECT epoch_us(date_time_utc) AS date_time, mmsi, CAST(CAST(longitude AS DECIMAL(9,6)) AS DOUBLE) AS longitude, CAST(CAST(latitude AS DECIMAL(8,6)) AS DOUBLE) AS latitude, status AS navigational_status, CASE WHEN course_over_ground < 360 THEN CAST(course_over_ground AS DOUBLE) END AS course_over_ground, CASE WHEN true_heading = 511 THEN -1 ELSE true_heading END AS true_heading, CASE WHEN speed_over_ground <> 102.30 THEN CAST(speed_over_ground AS DOUBLE) END AS speed_over_ground, CASE WHEN rate_of_turn = -128 THEN -999 ELSE rate_of_turn END AS rate_of_turn FROM historical")
def curate_positions(t: Tables) -> DataFrame:
    from tidewake.sources.files import curate_positions as run

    c = run(t.historical).fillna(-1, ["true_heading"]).fillna(-999, ["rate_of_turn"])
    return c.select("date_time", "mmsi", "longitude", "latitude", "navigational_status", "course_over_ground", "true_heading", "speed_over_ground", "rate_of_turn")


@query("curated_summary", """
    SELECT 'raw_rows' AS measure, count(*) AS value FROM historical UNION ALL SELECT 'curated_rows', count(*) FROM historical UNION ALL SELECT 'curated_required_null_rows', 0
    UNION ALL SELECT 'curated_course_over_ground_nulls', count(*) FROM historical WHERE course_over_ground >= 360 UNION ALL SELECT 'curated_true_heading_nulls', count(*) FROM historical WHERE true_heading = 511
    UNION ALL SELECT 'curated_speed_over_ground_nulls', count(*) FROM historical WHERE speed_over_ground = 102.30 UNION ALL SELECT 'curated_rate_of_turn_nulls', count(*) FROM historical WHERE rate_of_turn = -128
    UNION ALL SELECT 'curated_course_over_ground_sentinels', 0 UNION ALL SELECT 'curated_true_heading_sentinels', 0 UNION ALL SELECT 'curated_speed_over_ground_sentinels', 0 UNION ALL SELECT 'curated_rate_of_turn_sentinels', 0""")  # fmt: skip
def curated_summary(t: Tables) -> DataFrame:
    from tidewake.sources.files import curate_positions as curate
    from tidewake.sources.files import curated_summary as run

    return run(t.historical, curate(t.historical))


@query("check_curated_load", "SELECT 'curated_rows' AS measure, count(*) AS value FROM historical WHERE mmsi % 10 <> 0 UNION ALL SELECT 'curated_true_heading_sentinels', count(*) FROM historical WHERE mmsi % 10 = 7")
def check_curated_load(t: Tables) -> DataFrame:
    """A load that has lost rows and kept a missing-value code."""
    from tidewake import checks
    from tidewake.sources.files import curate_positions as curate
    from tidewake.sources.files import curated_summary as run

    faulty = curate(t.historical).where("mmsi % 10 <> 0").withColumn("true_heading", F.when(F.col("mmsi") % 10 == 7, 511).otherwise(F.col("true_heading")))
    return checks.curated_load(run(t.historical, faulty))


@query("daily_summary", f"SELECT CAST(CAST(date_time_utc AS DATE) AS VARCHAR) AS day, count(*) AS positions, count(DISTINCT mmsi) AS vessels, round(avg(CASE WHEN speed_over_ground <> 102.30 THEN CAST(speed_over_ground AS DOUBLE) END), 2) AS avg_speed FROM historical GROUP BY 1")
def daily_summary(t: Tables) -> DataFrame:
    from tidewake.sources.files import curate_positions as curate
    from tidewake.sources.files import daily_summary as run

    return run(curate(t.historical))


@query("widen_small_ints", "SELECT CAST(n_nationkey AS INT) AS a, CAST(n_regionkey AS INT) AS b, n_name FROM nation", False)
def widen_small_ints(t: Tables) -> DataFrame:
    from tidewake.sources.files import widen_small_ints as run

    return run(t.read("nation").select(F.col("n_nationkey").cast("short").alias("a"), F.col("n_regionkey").cast("byte").alias("b"), "n_name"))


@query("ports_from_index", "SELECT 'WPI:' || s_suppkey AS port_id, trim(s_name) AS name, r_name AS country, CAST(s_acctbal / 200 AS DOUBLE) AS latitude, CAST(s_suppkey % 180 AS DOUBLE) AS longitude, 1500e0 AS radius_m FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND CAST(s_acctbal / 200 AS DOUBLE) BETWEEN 0 AND 45 AND s_suppkey % 180 BETWEEN 0 AND 169", False)
def ports_from_index(t: Tables) -> DataFrame:
    from tidewake.sources.reference import ports_from_index as run

    s, n, r = t.read("supplier"), t.read("nation"), t.read("region")
    j = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])
    i = j.select(F.col("s_suppkey").alias("number"), F.col("s_name").alias("name"), F.col("r_name").alias("country"), (F.col("s_acctbal") / 200).cast("double").alias("latitude"), (F.col("s_suppkey") % 180).cast("double").alias("longitude"))
    return run(i, "ASIA", (0.0, 0.0, 45.0, 169.0))


@query("upsert_ports", "SELECT port_id, name, CASE WHEN latitude < 12 THEN epoch_us(TIMESTAMP '2023-05-01') ELSE epoch_us(TIMESTAMP '2024-05-01') END AS created_at, epoch_us(TIMESTAMP '2024-05-01') AS updated_at FROM nation_ports")
def upsert_ports(t: Tables) -> DataFrame:
    from tidewake.sources.reference import upsert_ports as run

    def at(day: str):
        return F.lit(day).cast("timestamp")

    old = t.nation_ports.where("latitude < 12").withColumns({"created_at": at("2023-05-01"), "updated_at": at("2023-05-01")})
    again = old.withColumns({"created_at": at("2023-06-01"), "updated_at": at("2023-06-01")})
    return run(old.unionByName(again), t.nation_ports, at("2024-05-01")).select("port_id", "name", "created_at", "updated_at")


# ---------------------------------------------------------------- joins and aggregates by themselves


@query("lookup", "SELECT seq, p.ship_type, coalesce(ship_type_name, 'Unknown') AS ship_type_name, coalesce(ship_category, 'Unknown') AS ship_category FROM positions p LEFT JOIN ship_types USING (ship_type)")
def lookup(t: Tables) -> DataFrame:
    p = positions(t).select("seq", "ship_type")
    return joins.lookup(p, t.ship_types, {"ship_type": "ship_type"}, {"ship_type_name": "ship_type_name", "ship_category": "ship_category"})


@query("label_stream", "SELECT seq, p.ship_type, ship_type_name FROM positions p LEFT JOIN ship_types USING (ship_type)")
def label_stream(t: Tables) -> DataFrame:
    return joins.label_stream(positions(t).select("seq", "ship_type"), t.ship_types, {"ship_type": "ship_type"}, {"ship_type_name": "ship_type_name"})


@query("eligible_only", f"SELECT d.mmsi, CAST(d.activity_date AS VARCHAR) AS activity_date, ais_points, vessel_name FROM daily d JOIN vessels v ON d.mmsi = v.mmsi AND is_ai_enrichment_eligible")
def eligible_only(t: Tables) -> DataFrame:
    d = daily.daily_aggregates(points(t), stationary=B.SLOW_KN).select("mmsi", "activity_date", "ais_points")
    return joins.eligible_only(d, vessel_table(t)).select("mmsi", "activity_date", "ais_points", "vessel_name")


@query("match_exact", "SELECT o_custkey AS custkey, o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", False)
def match_exact(t: Tables) -> DataFrame:
    o, c = t.read("orders").select(F.col("o_custkey").alias("custkey"), "o_orderkey"), t.read("customer").select(F.col("c_custkey").alias("custkey"), "c_name")
    return joins.match_exact(o, c, ["custkey"])


@query("left_marked", "SELECT c_custkey AS custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) THEN 1 ELSE 0 END AS has_big_order FROM customer", False)
def left_marked(t: Tables) -> DataFrame:
    c = t.read("customer").select(F.col("c_custkey").alias("custkey"))
    return joins.left_marked(c, t.read("orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("custkey")).distinct(), ["custkey"], "has_big_order")


@query("missing_from", "SELECT c_custkey AS custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", False)
def missing_from(t: Tables) -> DataFrame:
    c = t.read("customer").select(F.col("c_custkey").alias("custkey"), "c_name")
    return joins.missing_from(c, t.read("orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("custkey")), ["custkey"])


@query("at_latest", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)", False)
def at_latest(t: Tables) -> DataFrame:
    return joins.at_latest(t.read("orders"), "o_orderdate").select("o_orderkey", "o_custkey")


@query("distinct_per", "SELECT port_id, count(DISTINCT mmsi) AS distinct_mmsi FROM visits GROUP BY port_id")
def distinct_per(t: Tables) -> DataFrame:
    return joins.distinct_per(visit_table(t), ["port_id"], "mmsi")


@query("having", "SELECT user_id, count(*) AS events, count(*) FILTER (event_type = 'purchase') AS purchases FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'purchase') > 0.25 * count(*)", False)
def having(t: Tables) -> DataFrame:
    aggs = [F.count("*").alias("events"), F.count_if(F.col("event_type") == "purchase").alias("purchases")]
    return joins.having(t.read("events"), ["user_id"], aggs, "purchases > 0.25 * events")


@query("top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", False)
def top_n(t: Tables) -> DataFrame:
    return joins.top_n(t.read("orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 10)


@query("haversine", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(6371008.8e0 * 2 * asin(sqrt(least(1e0, greatest(0e0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))), 2) AS metres FROM (SELECT *, CAST(n_nationkey * 7 - 80 AS DOUBLE) AS lat, CAST(n_nationkey * 14 - 170 AS DOUBLE) AS lon FROM nation) a JOIN (SELECT *, CAST(n_nationkey * 7 - 80 AS DOUBLE) AS lat, CAST(n_nationkey * 14 - 170 AS DOUBLE) AS lon FROM nation) b ON a.n_regionkey = b.n_regionkey", False)
def haversine(t: Tables) -> DataFrame:
    from tidewake.functions.expressions import haversine_m

    n = t.read("nation").select("n_regionkey", F.col("n_nationkey").alias("a"), (F.col("n_nationkey") * 7 - 80).cast("double").alias("lat1"), (F.col("n_nationkey") * 14 - 170).cast("double").alias("lon1"))
    m = n.toDF("n_regionkey", "b", "lat2", "lon2")
    return n.join(m, "n_regionkey").select("a", "b", F.round(haversine_m(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")), 2).alias("metres"))


@query("edge_fingerprint", "SELECT count(*) AS edges, CAST(sum(movement_count) AS BIGINT) AS movements, CAST(sum(CAST('0x' || substr(sha256(from_port_id || '|' || to_port_id || '|' || movement_count), 1, 12) AS HUGEINT)) AS VARCHAR) AS fingerprint FROM network")
def edge_fingerprint(t: Tables) -> DataFrame:
    return network.edge_fingerprint(t.network)


@query("report_newest_gaps", "SELECT event_type, mmsi, epoch_us(gap_detected_at) AS gap_detected_at FROM gap_labels n ORDER BY n.gap_detected_at DESC, mmsi, event_type LIMIT 20")
def report_newest_gaps(t: Tables) -> DataFrame:
    from tidewake import reports as P

    return P.newest_gaps(gap_table(t)).select("event_type", "mmsi", "gap_detected_at")
