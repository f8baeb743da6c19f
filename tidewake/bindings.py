"""Vessel tables derived from the test tables, for Spark and, as SQL text, for DuckDB.

Every table here is computed from the given Parquet tables; ``CTES`` holds the
same definitions for the oracle. Parameters differ from production defaults
where the test tables would give empty results.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions.expressions import sql_round

#: Names of the codes of navigational status 0 to 8.
STATUS_NAMES = ("Under way using engine", "At anchor", "Not under command", "Restricted manoeuverability", "Constrained by her draught", "Moored", "Aground", "Engaged in fishing", "Under way sailing")
#: Ship categories by the tens of the type code.
CATEGORIES = {3: "Special craft", 5: "Service", 6: "Passenger", 7: "Cargo", 8: "Tanker"}
HOURS, POINTS, SLOW_KN, STATIONARY_FLOOR = 12, 5, 30.0, 10.0
VISIT_GAP, VISIT_STAY, VISIT_SPEED = 3600, 1200, 60.0
RUN, WINDOW = "2024-01-01T00:00:00Z", ("2024-01-01 00:00:00", "2024-02-01 00:00:00")
DAMPING, ROUNDS = 0.85, 5
SIZES, SLIDE = (5, 15, 30, 60), 5
GAP_TIMEOUT = 600
#: Positions folded into the six minutes from this time, in microseconds, so that the latest window has nearly all vessels.
FOLD_BASE, FOLD = 1_706_000_400_000_000, 360_000_000


#: First numbers of the ranges from which single users' identity numbers are taken; the first is a ship's, the others are not, or have too few digits.
NUMBERS = (257_001_000, 111_000_000, 970_000_000, 1_000, 992_570_000)
#: The identity number, and the shown name before it is blanked, of an event in SQL.
MMSI_SQL = "(CASE WHEN user_id % 4 < 3 THEN 257000000 + user_id % 4 " + " ".join(f"WHEN user_id // 4 % 5 = {k} THEN {n} + user_id" for k, n in enumerate(NUMBERS)) + " END)"
NAME_SQL = "(CASE WHEN user_id % 4 < 3 THEN 'VESSEL ' || (user_id % 4) WHEN user_id % 3 = 0 THEN 'Test boat ' || user_id WHEN event_id % 5 = 0 THEN 'FORMER ' || user_id ELSE 'BOAT ' || user_id END)"


def positions_of(events: DataFrame) -> DataFrame:
    """Positions of the event table, batch or stream.

    Three users of four are folded into three vessels, which move between five
    places; every other user is a vessel of its own, of some class of number,
    and some have test names or two names.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    ts, seconds = F.col("ts").cast("timestamp"), F.unix_seconds(F.col("ts").cast("timestamp"))
    status = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 5).when(F.col("event_type") == "signup", 8)
    user = F.col("user_id")
    place = F.pmod(F.floor(seconds / 7200) + user % 4, F.lit(5)).cast("double")
    single = F.element_at(F.array(*map(F.lit, NUMBERS)), (F.floor(user / 4) % 5 + 1).cast("int")) + user
    own = F.when(user % 3 == 0, F.concat(F.lit("Test boat "), user)).when(F.col("event_id") % 5 == 0, F.concat(F.lit("FORMER "), user)).otherwise(F.concat(F.lit("BOAT "), user))
    name = F.when(user % 4 < 3, F.concat(F.lit("VESSEL "), user % 4)).otherwise(own)
    return events.select(
        F.when(user % 4 < 3, F.lit(257000000) + user % 4).otherwise(single).cast("long").alias("mmsi"), ts.alias("msgtime"), F.col("event_id").alias("seq"),
        (60.0 + 0.1 * place + F.when(F.col("event_id") % 10 == 0, 0.05).otherwise(0.0)).alias("latitude"), F.lit(5.0).alias("longitude"),
        F.col("value").alias("speed_over_ground"), ((F.col("event_id") * 7) % 360).cast("double").alias("course_over_ground"), (F.col("event_id") % 512).cast("int").alias("true_heading"),
        status.cast("int").alias("navigational_status"), (30 + k % 60).cast("int").alias("ship_type"), F.when(k % 10 != 0, name).alias("name"),
        F.col("event_type").alias("stream"), ts.alias("ingested_at"),
    )


class Tables:
    """Lazily defined tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        """A table as a stream of its files."""
        return self.spark.readStream.schema(self.read(name).schema).parquet(f"{self.dir}/{name}.parque[t]")

    @cached_property
    def positions_raw(self) -> DataFrame:
        """Positions with later versions of every 17th event (an hour later in ingestion, one knot faster)."""
        p = positions_of(self.read("events"))
        again = p.where("seq % 17 = 0").withColumns({"ingested_at": F.col("ingested_at") + F.expr("INTERVAL 1 HOUR"), "speed_over_ground": F.col("speed_over_ground") + 1})
        return p.unionByName(again)

    def folded(self, positions: DataFrame) -> DataFrame:
        """Positions of all times as if of six minutes; every sixth vessel has no speeds."""
        at = F.timestamp_micros(F.lit(FOLD_BASE) + F.pmod(F.unix_micros("msgtime"), F.lit(FOLD)))
        return positions.withColumns({"msgtime": at, "speed_over_ground": F.when(F.col("mmsi") % 6 != 0, F.col("speed_over_ground"))})

    @cached_property
    def ports(self) -> DataFrame:
        s, n = self.read("supplier"), self.read("nation")
        return s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).select(
            F.concat(F.lit("WPI:"), F.col("s_suppkey").cast("string")).alias("port_id"), F.col("s_name").alias("name"), F.col("n_name").alias("country"),
            (60.0 + 0.1 * (F.col("s_suppkey") % 250)).alias("latitude"), F.lit(5.0).alias("longitude"), F.lit(1500.0).alias("radius_m"),
        )

    @cached_property
    def ship_types(self) -> DataFrame:
        tens = F.floor(F.col("id") / 10).cast("int")
        category = F.coalesce(*(F.when(tens == t, c) for t, c in CATEGORIES.items()))
        return self.spark.range(30, 90).select(F.col("id").cast("int").alias("ship_type"), F.concat(F.lit("Type "), F.col("id").cast("string")).alias("ship_type_name"), category.alias("ship_category")).where("ship_category IS NOT NULL")

    @cached_property
    def status_names(self) -> DataFrame:
        names = F.array(*map(F.lit, STATUS_NAMES))
        return self.spark.range(len(STATUS_NAMES)).select(F.col("id").cast("int").alias("navigational_status"), F.element_at(names, F.col("id").cast("int") + 1).alias("navigational_status_name"))

    @cached_property
    def network(self) -> DataFrame:
        """Routes from supplier to customer nations, one movement for each order line."""
        line, order = self.read("lineitem").select("l_orderkey", "l_suppkey"), self.read("orders").select("o_orderkey", "o_custkey")
        s, c = self.read("supplier").select("s_suppkey", "s_nationkey"), self.read("customer").select("c_custkey", "c_nationkey")
        n = self.read("nation").select("n_nationkey", "n_name")
        met = line.join(order, line["l_orderkey"] == order["o_orderkey"]).join(s, line["l_suppkey"] == s["s_suppkey"]).join(c, order["o_custkey"] == c["c_custkey"])
        met = met.groupBy("s_nationkey", "c_nationkey").agg(F.count("*").alias("movement_count"))
        a, b = n.toDF("s_nationkey", "from_port_id"), n.toDF("c_nationkey", "to_port_id")
        return met.join(F.broadcast(a), "s_nationkey").join(F.broadcast(b), "c_nationkey").where("from_port_id <> to_port_id").select("from_port_id", "to_port_id", "movement_count")

    @cached_property
    def countries_raw(self) -> DataFrame:
        n, r = self.read("nation"), self.read("region")
        j, name, region = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]), F.col("n_name"), F.col("n_regionkey")
        codes = F.concat(F.lit('{"alpha_2":" '), _code(), F.lit('","alpha_3":"'), F.substring(name, 1, 3), F.lit('","ccn3":"'), F.lpad(F.col("n_nationkey").cast("string"), 3, "0"), F.lit('"}'))
        two = F.concat(F.lit('[{"name":"Old"},{"name":"New '), name, F.lit('","attributes":{"primary":true}}]'))
        capitals = F.when(region < 2, two).when(region < 4, F.concat(F.lit('[{"name":"Only '), name, F.lit('"}]')))
        return j.select(codes.alias("codes"), F.concat(F.lit('{"common":"'), name, F.lit('"}')).alias("names"), F.when(region == 0, "  ").otherwise(F.col("r_name")).alias("region"), capitals.alias("capitals"))

    @cached_property
    def nation_ports(self) -> DataFrame:
        name = F.when(F.col("n_regionkey") == 0, " ").otherwise(F.concat(F.lit("Port of "), F.col("n_name")))
        return self.read("nation").select(F.col("n_name").alias("port_id"), name.alias("name"), _code().alias("country"), F.col("n_nationkey").cast("double").alias("latitude"), F.col("n_regionkey").cast("double").alias("longitude"))

    @cached_property
    def historical(self) -> DataFrame:
        e = F.col("event_id")
        speed = F.when(e % 9 == 0, F.lit("102.30").cast("decimal(6,2)")).otherwise((e % 100).cast("decimal(6,2)"))
        return self.read("events").select(
            F.col("ts").cast("timestamp").alias("date_time_utc"), (F.lit(257000000) + F.col("user_id")).cast("int").alias("mmsi"), (5.0 + 1e-3 * (e % 1000)).alias("longitude"), (60.0 + 1e-3 * (e % 500)).alias("latitude"),
            (e % 9).cast("int").alias("status"), (e % 500).cast("decimal(6,2)").alias("course_over_ground"), (e % 520).cast("int").alias("true_heading"), speed.alias("speed_over_ground"), (e % 300 - 150).cast("int").alias("rate_of_turn"),
            F.lit(0).alias("maneuvre"), F.lit("test").alias("data_source"), F.lit("A").alias("ais_class"), F.lit(1).alias("msg_type"), F.col("props").cast("binary").alias("geometry"),
        )


def _code():
    """A two-letter code of a nation."""
    return F.concat(F.char(65 + F.col("n_nationkey")), F.char(65 + F.col("n_regionkey")))


_R = sql_round
_STATUS = ", ".join(f"({k}, '{n}')" for k, n in enumerate(STATUS_NAMES))
_CATEGORY = " ".join(f"WHEN {t} THEN '{c}'" for t, c in CATEGORIES.items())

#: The class of an identity number in SQL.
CLASS_SQL = """(CASE WHEN length(CAST(mmsi AS VARCHAR)) <> 9 THEN 'invalid_length' WHEN mmsi // 1000000 = 111 THEN 'sar_aircraft' WHEN mmsi // 10000000 = 99 THEN 'aid_to_navigation'
          WHEN mmsi // 1000000 = 970 THEN 'ais_sart' WHEN mmsi // 100000000 BETWEEN 2 AND 7 THEN 'ship' ELSE 'nonstandard' END)"""

def _windows_sql(positions: str, m: int) -> str:
    return f"""SELECT mmsi, {m} AS window_minutes, make_timestamp(w * {SLIDE * 60_000_000}) AS window_start, make_timestamp(w * {SLIDE * 60_000_000} + {m * 60_000_000}) AS window_end, count(*) AS position_count,
          avg(speed_over_ground) AS avg_speed, min(speed_over_ground) AS min_speed, max(speed_over_ground) AS max_speed, arg_max(name, (msgtime, seq)) FILTER (name IS NOT NULL) AS name,
          last(ship_type ORDER BY msgtime, seq) AS ship_type, last(navigational_status ORDER BY msgtime, seq) AS last_navigation_status
          FROM (SELECT *, unnest(range(epoch_us(msgtime) // {SLIDE * 60_000_000} - {m // SLIDE - 1}, epoch_us(msgtime) // {SLIDE * 60_000_000} + 1)) AS w FROM {positions}) GROUP BY mmsi, w"""


#: DuckDB definitions; a name used in a text is defined before it.
CTES: dict[str, str] = {
    "positions_raw": f"""
        SELECT {MMSI_SQL} AS mmsi, ts AS msgtime, event_id AS seq,
          6e1 + 1e-1 * CAST((epoch_us(ts) // 1000000 // 7200 + user_id % 4) % 5 AS DOUBLE) + CASE WHEN event_id % 10 = 0 THEN 5e-2 ELSE 0e0 END AS latitude, 5e0 AS longitude,
          value AS speed_over_ground, CAST((event_id * 7) % 360 AS DOUBLE) AS course_over_ground, event_id % 512 AS true_heading,
          CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 5 WHEN 'signup' THEN 8 END AS navigational_status,
          30 + CAST(json_extract_string(props, '$.k') AS INT) % 60 AS ship_type,
          CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 10 <> 0 THEN {NAME_SQL} END AS name,
          event_type AS stream, ts AS ingested_at FROM events
        UNION ALL BY NAME
        SELECT {MMSI_SQL} AS mmsi, ts AS msgtime, event_id AS seq,
          6e1 + 1e-1 * CAST((epoch_us(ts) // 1000000 // 7200 + user_id % 4) % 5 AS DOUBLE) + CASE WHEN event_id % 10 = 0 THEN 5e-2 ELSE 0e0 END AS latitude, 5e0 AS longitude,
          value + 1 AS speed_over_ground, CAST((event_id * 7) % 360 AS DOUBLE) AS course_over_ground, event_id % 512 AS true_heading,
          CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 5 WHEN 'signup' THEN 8 END AS navigational_status,
          30 + CAST(json_extract_string(props, '$.k') AS INT) % 60 AS ship_type,
          CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 10 <> 0 THEN {NAME_SQL} END AS name,
          event_type AS stream, ts + INTERVAL 1 HOUR AS ingested_at FROM events WHERE event_id % 17 = 0""",
    "positions": "SELECT * FROM positions_raw QUALIFY row_number() OVER (PARTITION BY mmsi, msgtime ORDER BY ingested_at DESC, stream DESC) = 1",
    "ports": "SELECT 'WPI:' || s_suppkey AS port_id, s_name AS name, n_name AS country, 6e1 + 1e-1 * (s_suppkey % 250) AS latitude, 5e0 AS longitude, 1500e0 AS radius_m FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "ship_types": f"SELECT * FROM (SELECT i AS ship_type, 'Type ' || i AS ship_type_name, CASE i // 10 {_CATEGORY} END AS ship_category FROM range(30, 90) t(i)) WHERE ship_category IS NOT NULL",
    "status_names": f"SELECT * FROM (VALUES {_STATUS}) t(navigational_status, navigational_status_name)",
    "network": """
        SELECT a.n_name AS from_port_id, b.n_name AS to_port_id, count(*) AS movement_count
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey
        JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey WHERE a.n_name <> b.n_name GROUP BY ALL""",
    "stg_vessels": """
        SELECT mmsi, arg_max(trim(name), (msgtime, ingested_at, trim(name))) FILTER (nullif(trim(name), '') IS NOT NULL) AS vessel_name,
          arg_max(ship_type, (msgtime, ingested_at, ship_type)) FILTER (ship_type IS NOT NULL) AS ship_type, min(msgtime) AS first_seen, max(msgtime) AS last_seen,
          count(DISTINCT nullif(trim(name), '')) AS name_count, count(*) AS ais_message_count,
          avg(speed_over_ground) FILTER (speed_over_ground < 102.2e0) AS avg_speed_kn, max(speed_over_ground) FILTER (speed_over_ground < 102.2e0) AS max_speed_kn,
          arg_max(speed_over_ground, (msgtime, ingested_at, speed_over_ground)) FILTER (speed_over_ground < 102.2e0) AS last_speed_kn,
          arg_max(latitude, (msgtime, ingested_at, latitude)) AS last_latitude, arg_max(longitude, (msgtime, ingested_at, longitude)) AS last_longitude,
          arg_max(course_over_ground, (msgtime, ingested_at, course_over_ground)) AS last_course, arg_max(true_heading, (msgtime, ingested_at, true_heading)) AS last_heading,
          arg_max(navigational_status, (msgtime, ingested_at, navigational_status)) FILTER (navigational_status IS NOT NULL) AS last_navigational_status
        FROM positions GROUP BY mmsi""",
    "vessels": f"""
        SELECT v.*, coalesce(nullif(trim(st.ship_type_name), ''), 'Unknown') AS ship_type_name, coalesce(nullif(trim(st.ship_category), ''), 'Unknown') AS ship_category,
          coalesce(ns.navigational_status_name, 'Unknown') AS last_navigational_status_name, length(CAST(v.mmsi AS VARCHAR)) = 9 AS is_valid_mmsi, name_count > 1 AS has_identity_conflict,
          v.ship_type IS NOT NULL AND st.ship_type_name IS NULL AS has_unknown_ship_type, coalesce(contains(lower(vessel_name), 'test'), false) AS is_test_record,
          length(CAST(v.mmsi AS VARCHAR)) = 9 AND NOT coalesce(contains(lower(vessel_name), 'test'), false) AS is_dashboard_eligible, {CLASS_SQL} AS mmsi_format_class,
          length(CAST(v.mmsi AS VARCHAR)) = 9 AND NOT coalesce(contains(lower(vessel_name), 'test'), false) AND {CLASS_SQL} = 'ship' AS is_ai_enrichment_eligible
        FROM stg_vessels v LEFT JOIN ship_types st USING (ship_type) LEFT JOIN status_names ns ON v.last_navigational_status = ns.navigational_status""",
    "points": "SELECT *, CAST(msgtime AS DATE) AS activity_date, lag(navigational_status) OVER (PARTITION BY mmsi, CAST(msgtime AS DATE) ORDER BY msgtime, ingested_at, stream) AS before FROM positions",
    "dominant": f"""
        SELECT mmsi, activity_date, arg_max(navigational_status, (n, -navigational_status)) AS dominant_navigational_status, {_R("100e0 * max(n) / sum(n)", 1)} AS dominant_status_pct
        FROM (SELECT mmsi, activity_date, navigational_status, count(*) AS n FROM points WHERE navigational_status IS NOT NULL GROUP BY ALL) GROUP BY ALL""",
    "daily": f"""
        SELECT *, {_R("100e0 * nav_status_changes / nullif(nav_status_comparable_pairs, 0)", 1)} AS nav_status_change_rate_pct FROM (
        SELECT mmsi, activity_date, count(*) AS ais_points, min(msgtime) AS first_seen, max(msgtime) AS last_seen,
          {_R("(epoch_us(max(msgtime)) // 1000000 - epoch_us(min(msgtime)) // 1000000) / 3600e0", 2)} AS observation_hours,
          {_R("avg(speed_over_ground) FILTER (speed_over_ground < 102.2e0)", 2)} AS avg_speed_kn, {_R("max(speed_over_ground) FILTER (speed_over_ground < 102.2e0)", 2)} AS max_speed_kn,
          {_R(f"100e0 * count(*) FILTER (speed_over_ground < {SLOW_KN}e0) / nullif(count(*) FILTER (speed_over_ground < 102.2e0), 0)", 1)} AS stationary_observation_pct,
          arg_max(navigational_status, (msgtime, ingested_at, stream)) FILTER (navigational_status IS NOT NULL) AS last_navigational_status,
          count(*) FILTER (navigational_status IS NOT NULL AND before IS NOT NULL) AS nav_status_comparable_pairs,
          count(*) FILTER (navigational_status <> before) AS nav_status_changes
        FROM points GROUP BY ALL)""",
    "features": """
        SELECT d.mmsi, d.activity_date, vessel_name, ship_type_name, ship_category, ais_points, d.first_seen, d.last_seen, observation_hours, d.avg_speed_kn, d.max_speed_kn, stationary_observation_pct,
          d.last_navigational_status, coalesce(l.navigational_status_name, 'Unknown') AS last_navigational_status_name, dominant_navigational_status,
          coalesce(m.navigational_status_name, 'Unknown') AS dominant_navigational_status_name, dominant_status_pct, nav_status_changes, nav_status_change_rate_pct
        FROM daily d LEFT JOIN dominant USING (mmsi, activity_date) JOIN vessels v ON d.mmsi = v.mmsi AND is_ai_enrichment_eligible
        LEFT JOIN status_names l ON d.last_navigational_status = l.navigational_status LEFT JOIN status_names m ON dominant_navigational_status = m.navigational_status""",
    "observed": f"SELECT * FROM features WHERE observation_hours >= {HOURS} AND ais_points >= {POINTS}",
    "baseline": """
        SELECT o.*, b.* EXCLUDE (mmsi, activity_date) FROM observed o LEFT JOIN (
          SELECT mmsi, CAST(activity_date + CAST(k AS INT) AS DATE) AS activity_date, count(*) AS baseline_days, count(avg_speed_kn) AS baseline_speed_days, count(stationary_observation_pct) AS baseline_stationary_days,
            avg(avg_speed_kn) AS baseline_avg_speed_kn, stddev_pop(avg_speed_kn) AS baseline_sd_speed_kn, avg(stationary_observation_pct) AS baseline_stationary_pct, stddev_pop(stationary_observation_pct) AS baseline_sd_stationary_pct
          FROM observed, range(1, 8) t(k) GROUP BY 1, 2) b USING (mmsi, activity_date)""",
    "flags": f"""
        SELECT *, coalesce(baseline_speed_days >= 3 AND sd >= st, false) AS speed_anomaly, coalesce(baseline_stationary_days >= 3 AND rd >= rt, false) AS stationary_anomaly,
          coalesce(dominant_status_pct >= 85 AND (dominant_navigational_status_name IN ('At anchor', 'Moored') AND stationary_observation_pct < 40 AND avg_speed_kn >= 3
            OR dominant_navigational_status_name = 'Under way using engine' AND stationary_observation_pct >= 90 AND avg_speed_kn < 1), false) AS status_speed_mismatch,
          coalesce(nav_status_change_rate_pct >= 30 AND dominant_status_pct <= 70, false) AS navigation_status_inconsistent
        FROM (SELECT *, abs(avg_speed_kn - baseline_avg_speed_kn) AS sd, greatest(3e0, 2e0 * baseline_sd_speed_kn) AS st,
          abs(stationary_observation_pct - baseline_stationary_pct) AS rd, greatest({STATIONARY_FLOOR}e0, 2e0 * baseline_sd_stationary_pct) AS rt FROM baseline)""",
    "scored": f"""
        SELECT * EXCLUDE (baseline_avg_speed_kn, baseline_sd_speed_kn, baseline_stationary_pct, baseline_sd_stationary_pct),
          {_R("baseline_avg_speed_kn", 2)} AS baseline_avg_speed_kn, {_R("baseline_sd_speed_kn", 2)} AS baseline_sd_speed_kn, {_R("sd", 2)} AS speed_deviation_kn, {_R("st", 2)} AS speed_anomaly_threshold_kn,
          {_R("baseline_stationary_pct", 1)} AS baseline_stationary_pct, {_R("baseline_sd_stationary_pct", 1)} AS baseline_sd_stationary_pct, {_R("rd", 1)} AS stationary_deviation_pct, {_R("rt", 1)} AS stationary_anomaly_threshold_pct,
          CASE WHEN speed_anomaly AND stationary_anomaly THEN 'speed_and_stationary' WHEN speed_anomaly THEN 'speed' ELSE 'stationary' END AS anomaly_reason,
          {_R("(CASE WHEN speed_anomaly THEN sd / st ELSE 0e0 END + CASE WHEN stationary_anomaly THEN rd / rt ELSE 0e0 END + CASE WHEN status_speed_mismatch THEN 0.25e0 ELSE 0e0 END + CASE WHEN navigation_status_inconsistent THEN 0.1e0 ELSE 0e0 END)", 3)} AS anomaly_score
        FROM flags WHERE speed_anomaly OR stationary_anomaly""",
    "anomalies": "SELECT *, row_number() OVER (PARTITION BY activity_date ORDER BY anomaly_score DESC, mmsi) AS anomaly_rank FROM scored",
    "observations": """
        SELECT mmsi, msgtime, CASE WHEN n = 1 THEN lat END AS latitude, CASE WHEN n = 1 THEN lon END AS longitude, CASE WHEN n = 1 THEN speed END AS speed FROM (
          SELECT mmsi, msgtime, count(DISTINCT (latitude, longitude, speed)) AS n, min(latitude) AS lat, min(longitude) AS lon, min(speed) AS speed
          FROM (SELECT *, CASE WHEN speed_over_ground >= 0 AND speed_over_ground < 102.3e0 THEN speed_over_ground END AS speed FROM positions) GROUP BY ALL)""",
    "near": """
        SELECT mmsi, msgtime, arg_min(port_id, (m, port_id)) AS nearest, list(port_id) AS ports_inside FROM (
          SELECT o.mmsi, o.msgtime, p.port_id, radius_m, 6371008.8e0 * 2 * asin(sqrt(least(1e0, greatest(0e0, pow(sin(radians(p.latitude - o.latitude) / 2), 2) + cos(radians(o.latitude)) * cos(radians(p.latitude)) * pow(sin(radians(p.longitude - o.longitude) / 2), 2))))) AS m
          FROM observations o, ports p WHERE o.latitude IS NOT NULL) WHERE m <= radius_m GROUP BY ALL""",
    "assigned": f"SELECT o.*, nearest, CASE WHEN latitude IS NOT NULL THEN coalesce(ports_inside, []) END AS ports_inside, CASE WHEN speed <= {VISIT_SPEED}e0 THEN nearest END AS eligible FROM observations o LEFT JOIN near USING (mmsi, msgtime)",
    "islands": f"""
        SELECT *, sum(CASE WHEN first_row OR gap OR eligible IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY mmsi ORDER BY msgtime) AS island FROM (
          SELECT *, lag(msgtime) OVER w IS NULL AS first_row, coalesce(epoch_us(msgtime) - epoch_us(lag(msgtime) OVER w) > {VISIT_GAP * 1_000_000}, false) AS gap, lag(eligible) OVER w AS before, lag(ports_inside) OVER w AS previous_inside,
            lead(msgtime) OVER w AS next_time, coalesce(epoch_us(lead(msgtime) OVER w) - epoch_us(msgtime) > {VISIT_GAP * 1_000_000}, false) AS next_gap, lead(ports_inside) OVER w AS next_inside
          FROM assigned WINDOW w AS (PARTITION BY mmsi ORDER BY msgtime))""",
    "visits": f"""
        SELECT mmsi, port_id, arrival_at, last_observed_at, CASE WHEN end_reason = 'observed_exit' THEN next_time END AS departure_at, arrival_censored, end_reason, observation_count, observed_stay_seconds,
          sha256('[' || mmsi || ',"' || port_id || '","' || CASE WHEN epoch_us(arrival_at) % 1000000 = 0 THEN strftime(arrival_at, '%Y-%m-%d %H:%M:%S') ELSE strftime(arrival_at, '%Y-%m-%d %H:%M:%S.%f') END || '+00:00"]') AS visit_id
        FROM (SELECT *, CASE WHEN next_time IS NULL THEN 'window_end' WHEN next_gap THEN 'data_gap' WHEN next_inside IS NOT NULL AND NOT list_contains(next_inside, port_id) THEN 'observed_exit' ELSE 'movement_or_unknown' END AS end_reason,
          CASE WHEN first_row OR gap OR previous_inside IS NULL OR list_contains(previous_inside, port_id) THEN 1 ELSE 0 END AS arrival_censored, (epoch_us(last_observed_at) - epoch_us(arrival_at)) / 1e6 AS observed_stay_seconds
        FROM (SELECT mmsi, eligible AS port_id, count(*) AS observation_count, min(msgtime) AS arrival_at, max(msgtime) AS last_observed_at, arg_min(first_row, msgtime) AS first_row, arg_min(gap, msgtime) AS gap,
            first(previous_inside ORDER BY msgtime) AS previous_inside, last(next_time ORDER BY msgtime) AS next_time, last(next_gap ORDER BY msgtime) AS next_gap, last(next_inside ORDER BY msgtime) AS next_inside
          FROM islands WHERE eligible IS NOT NULL GROUP BY mmsi, island, eligible)) WHERE observation_count >= 2 AND observed_stay_seconds >= {VISIT_STAY}""",
    "moves": "SELECT * FROM (SELECT mmsi, port_id AS to_port_id, arrival_at, lag(port_id) OVER w AS from_port_id, lag(arrival_at) OVER w AS from_arrival_at FROM visits WINDOW w AS (PARTITION BY mmsi ORDER BY arrival_at, visit_id)) WHERE from_port_id <> to_port_id",
    "routes": "SELECT from_port_id, to_port_id, count(*) AS movement_count, count(DISTINCT mmsi) AS vessel_count, min(from_arrival_at) AS first_seen, max(arrival_at) AS last_seen FROM moves GROUP BY ALL",
    "ranks": f"""
        WITH RECURSIVE share AS (SELECT from_port_id AS src, to_port_id AS dst, movement_count / sum(movement_count) OVER (PARTITION BY from_port_id) AS s FROM network),
        nodes AS (SELECT src AS node FROM share UNION SELECT dst FROM share),
        step(k, node, page_rank) AS (
          SELECT 0, node, CAST({1 - DAMPING} AS DOUBLE) FROM nodes
          UNION ALL
          SELECT any_value(k) + 1, n.node, CAST({1 - DAMPING} AS DOUBLE) + CAST({DAMPING} AS DOUBLE) * coalesce(sum(page_rank * s) FILTER (dst = n.node), 0)
          FROM nodes n, step JOIN share ON step.node = share.src WHERE k < {ROUNDS} GROUP BY n.node)
        SELECT node, page_rank FROM step WHERE k = {ROUNDS}""",
    "window_features": " UNION ALL ".join(_windows_sql("positions", m) for m in SIZES),
    "window_labels": "SELECT f.*, ship_type_name, ship_category, navigational_status_name AS last_navigation_status_name FROM window_features f LEFT JOIN ship_types USING (ship_type) LEFT JOIN status_names ON last_navigation_status = navigational_status",
    "folded": f"""
        SELECT * REPLACE (make_timestamp({FOLD_BASE} + epoch_us(msgtime) % {FOLD}) AS msgtime, CASE WHEN mmsi % 6 <> 0 THEN speed_over_ground END AS speed_over_ground) FROM positions""",
    "folded_windows": _windows_sql("folded", 30),
    "folded_labels": "SELECT f.*, ship_type_name, ship_category, navigational_status_name AS last_navigation_status_name FROM folded_windows f LEFT JOIN ship_types USING (ship_type) LEFT JOIN status_names ON last_navigation_status = navigational_status",
    "gap_pairs": f"""
        SELECT * FROM (SELECT mmsi, name, msgtime AS last_at, navigational_status, ship_type, lead(msgtime) OVER w AS resumed_at, lead(navigational_status) OVER w AS resumed_status, lead(ship_type) OVER w AS resumed_type,
            coalesce(lead(name) OVER w, name) AS resumed_name, latitude, longitude
          FROM positions WINDOW w AS (PARTITION BY mmsi ORDER BY msgtime)) WHERE resumed_at IS NULL OR epoch_us(resumed_at) - epoch_us(last_at) > {GAP_TIMEOUT * 1_000_000}""",
    "gaps": f"""
        SELECT 'AIS_GAP_DETECTED' AS event_type, mmsi, name, last_at AS last_event_msgtime, NULL AS resumed_event_msgtime, last_at + INTERVAL {GAP_TIMEOUT} SECOND AS gap_detected_at, NULL AS gap_ended_at, NULL AS gap_duration_seconds,
          ship_type, navigational_status AS navigation_status FROM gap_pairs
        UNION ALL
        SELECT 'AIS_GAP_ENDED', mmsi, resumed_name, last_at, resumed_at, last_at + INTERVAL {GAP_TIMEOUT} SECOND, resumed_at, (epoch_us(resumed_at) - epoch_us(last_at)) / 1e6, resumed_type, resumed_status FROM gap_pairs WHERE resumed_at IS NOT NULL""",
    "gap_labels": "SELECT g.*, ship_type_name, ship_category, navigational_status_name AS navigation_status_name FROM gaps g LEFT JOIN ship_types USING (ship_type) LEFT JOIN status_names ON navigation_status = navigational_status",
    "visits_1": f"SELECT '{RUN}' AS run_id, DATE '2024-01-01' AS activity_date, * FROM visits",
    "visit_history": """
        SELECT *, TIMESTAMP '2024-02-02' AS updated_at, 0 AS is_deleted FROM visits_1
        UNION ALL SELECT *, TIMESTAMP '2024-02-02 00:00:00.000001', CASE WHEN observation_count % 3 <> 0 THEN 0 ELSE 1 END FROM visits_1""",
    "live_visits": "SELECT * FROM (SELECT * FROM visit_history QUALIFY row_number() OVER (PARTITION BY run_id, visit_id ORDER BY updated_at DESC) = 1) WHERE is_deleted = 0",
    "countries_raw": """
        SELECT '{"alpha_2":" ' || chr(CAST(65 + n_nationkey AS INT)) || chr(CAST(65 + n_regionkey AS INT)) || '","alpha_3":"' || substr(n_name, 1, 3) || '","ccn3":"' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') || '"}' AS codes,
          '{"common":"' || n_name || '"}' AS names, CASE WHEN n_regionkey = 0 THEN '  ' ELSE r_name END AS region,
          CASE WHEN n_regionkey < 2 THEN '[{"name":"Old"},{"name":"New ' || n_name || '","attributes":{"primary":true}}]' WHEN n_regionkey < 4 THEN '[{"name":"Only ' || n_name || '"}]' END AS capitals
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "country_table": """
        SELECT trim(json_extract_string(codes, '$.alpha_2')) AS country_code, trim(json_extract_string(codes, '$.alpha_3')) AS iso3, trim(json_extract_string(codes, '$.ccn3')) AS numeric_code, json_extract_string(names, '$.common') AS country_name,
          nullif(trim(region), '') AS region, CASE WHEN json_extract_string(capitals, '$[1].name') IS NOT NULL THEN json_extract_string(capitals, '$[1].name') ELSE json_extract_string(capitals, '$[0].name') END AS capital_city FROM countries_raw""",
    "nation_ports": "SELECT n_name AS port_id, CASE WHEN n_regionkey = 0 THEN ' ' ELSE 'Port of ' || n_name END AS name, chr(CAST(65 + n_nationkey AS INT)) || chr(CAST(65 + n_regionkey AS INT)) AS country, CAST(n_nationkey AS DOUBLE) AS latitude, CAST(n_regionkey AS DOUBLE) AS longitude FROM nation",
    "metric_table": f"SELECT '{RUN}' AS run_id, node AS port_id, page_rank, dense_rank() OVER (ORDER BY right(node, 1)) - 1 AS community_id, DATE '2024-01-01' AS snapshot_date FROM ranks",
    "label_table": """
        SELECT run_id, community_id, arg_min(shown, place) AS community_name, string_agg(shown, ' / ' ORDER BY place) FILTER (place <= 3) AS community_label, count(*) AS port_count
        FROM (SELECT m.*, coalesce(nullif(trim(name), ''), m.port_id) AS shown, row_number() OVER (PARTITION BY run_id, community_id ORDER BY page_rank DESC, m.port_id) AS place FROM metric_table m LEFT JOIN nation_ports USING (port_id)) GROUP BY ALL""",
    "enriched_metrics": """
        SELECT m.*, p.name AS port_name, p.country AS country_code, country_name, iso3, numeric_code, latitude, longitude, community_name, community_label, coalesce(unique_vessels, 0) AS unique_vessels, coalesce(visit_count, 0) AS visit_count
        FROM metric_table m LEFT JOIN label_table USING (run_id, community_id) LEFT JOIN nation_ports p USING (port_id) LEFT JOIN country_table c ON p.country = c.country_code
        LEFT JOIN (SELECT run_id, n_name AS port_id, count(DISTINCT mmsi) AS unique_vessels, count(*) AS visit_count FROM live_visits JOIN nation ON port_id = 'WPI:' || n_nationkey GROUP BY ALL) v USING (run_id, port_id)""",
    "candidates": "SELECT *, sha256(mmsi || '|' || activity_date || '|' || anomaly_reason) AS input_hash FROM anomalies WHERE anomaly_rank <= 100",
    "history": """
        SELECT mmsi, activity_date, 'transit' AS activity_class, 'consistent' AS navigation_status_quality, 's' || k AS summary, CASE WHEN anomaly_reason = 'stationary' THEN 'm2' ELSE 'm1' END AS model, 'v1' AS prompt_version,
          CASE WHEN anomaly_score > 1.2e0 THEN input_hash ELSE 'stale' END AS input_hash, 'r' || k AS response_id, TIMESTAMP '2024-03-01' + INTERVAL 1 HOUR * k AS created_at FROM candidates, range(1, 3) t(k)""",
    "responses": "SELECT h.* FROM history h JOIN candidates USING (mmsi, activity_date, input_hash) WHERE model = 'm1' AND prompt_version = 'v1' QUALIFY row_number() OVER (PARTITION BY h.mmsi, h.activity_date ORDER BY created_at DESC, response_id DESC) = 1",
    "historical": """
        SELECT ts AS date_time_utc, CAST(257000000 + user_id AS INT) AS mmsi, 5e0 + 1e-3 * (event_id % 1000) AS longitude, 6e1 + 1e-3 * (event_id % 500) AS latitude, CAST(event_id % 9 AS INT) AS status, CAST(event_id % 500 AS DECIMAL(6,2)) AS course_over_ground,
          CAST(event_id % 520 AS INT) AS true_heading, CASE WHEN event_id % 9 = 0 THEN CAST(102.30 AS DECIMAL(6,2)) ELSE CAST(event_id % 100 AS DECIMAL(6,2)) END AS speed_over_ground, CAST(event_id % 300 - 150 AS INT) AS rate_of_turn FROM events""",
}


def with_tables(query: str) -> str:
    """``query`` preceded by the definitions that it uses, directly or not."""
    needed: set[str] = set()
    todo = [query]
    while todo:
        text = todo.pop()
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(CTES[name])
    listed = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in CTES if n in needed)
    return f"WITH {listed}\n{query}" if listed else query
