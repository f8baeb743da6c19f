"""Report queries. Each takes the tables it reads; "last hours" count back from ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.functions.expressions import ANOMALY_LABELS, GAP_LABELS, label, round_
from tidewake.operators.joins import anomalies_with_enrichment, at_latest, matched_lifecycle
from tidewake.operators.versioned import latest_by_key

# ---------------------------------------------------------------- ports and communities


def _port_ranks(metrics: DataFrame, country: str | None, day: str | None) -> DataFrame:
    m = metrics.where(F.col("country_name") == country) if country else metrics
    m = m.where(F.col("activity_date") == F.lit(day).cast("date")) if day else m
    return m.groupBy("port_name", "window_start", "community_name").agg(F.max("page_rank").alias("page_rank"), F.sum("unique_vessels").alias("unique_vessels"), F.sum("visit_count").alias("visit_count"))


def top_ports(metrics: DataFrame, n: int = 10, country: str | None = None, day: str | None = None) -> DataFrame:
    return _port_ranks(metrics, country, day).orderBy(F.desc("page_rank"), "port_name", "window_start").limit(n)


def bottom_ports(metrics: DataFrame, n: int = 10, country: str | None = None, day: str | None = None) -> DataFrame:
    return _port_ranks(metrics, country, day).orderBy("page_rank", "port_name", "window_start").limit(n)


def port_map(metrics: DataFrame) -> DataFrame:
    """Sums by port and place; the community number is summed too, as the map shows it."""
    return metrics.where("page_rank IS NOT NULL").groupBy("port_name", "latitude", "longitude").agg(
        F.sum("page_rank").alias("page_rank"), F.sum("unique_vessels").alias("unique_vessels"), F.sum("visit_count").alias("visit_count"), F.sum("community_id").alias("community_id")
    )


def community_traffic(metrics: DataFrame) -> DataFrame:
    g = metrics.groupBy("community_name").agg(F.sum("unique_vessels").alias("unique_vessels"), F.sum("visit_count").alias("visit_count"))
    return g.orderBy(F.desc("visit_count"), "community_name")


def communities_list(communities: DataFrame) -> DataFrame:
    return communities.select("run_id", "activity_date", "community_id", "community_name", "community_label", "port_count").orderBy(F.desc("port_count"), "run_id", "community_id")


# ---------------------------------------------------------------- vessels


def total_vessels(vessels: DataFrame) -> DataFrame:
    return vessels.where("is_dashboard_eligible").agg(F.count("*").alias("vessels"))


def active_vessels(vessels: DataFrame, as_of: Column) -> DataFrame:
    return vessels.where(F.col("is_dashboard_eligible") & (F.col("last_seen") >= as_of - F.expr("INTERVAL 24 HOURS"))).agg(F.count("*").alias("vessels"))


def vessels_by_category(vessels: DataFrame) -> DataFrame:
    return vessels.where("is_dashboard_eligible").groupBy("ship_category").agg(F.count("*").alias("vessels")).orderBy(F.desc("vessels"), "ship_category")


def vessels_by_status(vessels: DataFrame) -> DataFrame:
    return vessels.where("is_dashboard_eligible").groupBy("last_navigational_status_name").agg(F.count("*").alias("vessels")).orderBy(F.desc("vessels"), "last_navigational_status_name")


def last_positions(vessels: DataFrame) -> DataFrame:
    ok = F.col("is_dashboard_eligible") & F.col("last_latitude").between(-90, 90) & F.col("last_longitude").between(-180, 180)
    return vessels.where(ok).select("mmsi", "vessel_name", "ship_category", "last_latitude", "last_longitude", F.date_trunc("minute", "last_seen").alias("last_seen")).distinct()


def vessel_details(vessels: DataFrame, day: str) -> DataFrame:
    v = vessels.where(F.col("is_dashboard_eligible") & (F.to_date("last_seen") == F.lit(day).cast("date")))
    return v.select("mmsi", "vessel_name", "ship_type_name", "ship_category", "ais_message_count", "last_speed_kn", "last_navigational_status_name").distinct().orderBy(F.desc("ais_message_count"), "mmsi")


# ---------------------------------------------------------------- anomalies


def anomaly_days(anomalies: DataFrame) -> DataFrame:
    return anomalies.agg(F.count("*").alias("vessel_days"))


def enriched_anomalies(anomalies: DataFrame, enriched: DataFrame, prompt_version: str, max_rank: int = 100) -> DataFrame:
    met = anomalies_with_enrichment(anomalies.where(F.col("anomaly_rank") <= max_rank), enriched, "inner")
    return met.where(F.col("ai_prompt_version") == prompt_version).agg(F.count_distinct("mmsi").alias("vessels"))


def speed_and_stationary(anomalies: DataFrame) -> DataFrame:
    return anomalies.where("anomaly_reason = 'speed_and_stationary'").agg(F.count("*").alias("vessel_days"))


def average_score(anomalies: DataFrame) -> DataFrame:
    return anomalies.agg(round_(F.avg("anomaly_score"), 3).alias("avg_score"))


def anomalies_by_type(anomalies: DataFrame) -> DataFrame:
    shown = label(F.col("anomaly_reason"), ANOMALY_LABELS).alias("anomaly_type")
    return anomalies.groupBy(shown).agg(F.count("*").alias("vessel_days")).orderBy(F.desc("vessel_days"), "anomaly_type")


def top_anomalies(anomalies: DataFrame, n: int = 10) -> DataFrame:
    return anomalies.select("activity_date", "mmsi", "vessel_name", "anomaly_reason", "anomaly_score").orderBy(F.desc("anomaly_score"), "activity_date", "mmsi").limit(n)


def insights(anomalies: DataFrame, enriched: DataFrame, n: int = 100) -> DataFrame:
    met = anomalies_with_enrichment(anomalies, enriched, "left").withColumn("anomaly_type", label(F.col("anomaly_reason"), ANOMALY_LABELS))
    return met.select("activity_date", "mmsi", "vessel_name", "anomaly_type", "anomaly_score", "anomaly_rank", "activity_class", "ai_summary").orderBy(F.desc("anomaly_score"), "activity_date", "mmsi").limit(n)


# ---------------------------------------------------------------- window features


def _latest_window(features: DataFrame, minutes: int | None) -> DataFrame:
    return at_latest(features.where(F.col("window_minutes") == minutes) if minutes else features, "window_end")


def active_vessels_latest(features: DataFrame, minutes: int | None = None) -> DataFrame:
    return _latest_window(features, minutes).agg(F.count_distinct("mmsi").alias("active_vessels"))


def average_speed_latest(features: DataFrame, minutes: int | None = None) -> DataFrame:
    """Mean of the vessels' means, not weighted by their positions."""
    return _latest_window(features, minutes).where("avg_speed IS NOT NULL").agg(round_(F.avg("avg_speed"), 2).alias("avg_speed"))


def fastest_latest(features: DataFrame, minutes: int | None = None, n: int = 10) -> DataFrame:
    f = _latest_window(features, minutes).where("max_speed IS NOT NULL").orderBy(F.desc("max_speed"), "mmsi", "window_minutes").limit(n)
    return f.select("mmsi", "name", "ship_category", "last_navigation_status_name", round_(F.col("avg_speed"), 2).alias("avg_speed"), round_(F.col("max_speed"), 2).alias("max_speed"))


def categories_latest(features: DataFrame, minutes: int | None = None) -> DataFrame:
    shown = F.coalesce("ship_category", F.lit("Unknown")).alias("ship_category")
    return _latest_window(features, minutes).groupBy(shown).agg(F.count_distinct("mmsi").alias("vessels")).orderBy(F.desc("vessels"), "ship_category")


def statuses_latest(features: DataFrame, minutes: int | None = None) -> DataFrame:
    shown = F.coalesce("last_navigation_status_name", F.lit("Unknown")).alias("navigation_status")
    return _latest_window(features, minutes).groupBy(shown).agg(F.count_distinct("mmsi").alias("vessels")).orderBy(F.desc("vessels"), "navigation_status")


def features_latest(features: DataFrame, minutes: int | None = None, n: int = 100) -> DataFrame:
    f = _latest_window(features, minutes).orderBy(F.desc_nulls_last("max_speed"), "mmsi", "window_minutes").limit(n)
    speeds = (round_(F.col(c), 2).alias(c) for c in ("avg_speed", "min_speed", "max_speed"))
    return f.select("name", "mmsi", "ship_category", F.col("last_navigation_status_name").alias("navigation_status"), "position_count", *speeds, "window_start", "window_end")


def windows_by_size(features: DataFrame) -> DataFrame:
    return features.groupBy("window_minutes").agg(F.count("*").alias("windows")).orderBy("window_minutes")


def newest_features(features: DataFrame, n: int = 20) -> DataFrame:
    return features.orderBy(F.desc("window_end"), "mmsi", "window_minutes").limit(n)


# ---------------------------------------------------------------- gaps


def _since(column: str, as_of: Column, hours: int) -> Column:
    return F.col(column) >= as_of - F.expr(f"INTERVAL {hours} HOURS")


def _recovered(gaps: DataFrame, as_of: Column, hours: int) -> DataFrame:
    return gaps.where((F.col("event_type") == "AIS_GAP_ENDED") & _since("gap_ended_at", as_of, hours))


def gaps_detected(gaps: DataFrame, as_of: Column, hours: int = 1) -> DataFrame:
    return gaps.where((F.col("event_type") == "AIS_GAP_DETECTED") & _since("gap_detected_at", as_of, hours)).agg(F.count("*").alias("gaps_detected"))


def gaps_recovered(gaps: DataFrame, as_of: Column, hours: int = 1) -> DataFrame:
    return _recovered(gaps, as_of, hours).agg(F.count("*").alias("gaps_recovered"))


def _newest_known(column: str) -> Column:
    """The newest value that is not null."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col("gap_ended_at"))).alias(column)


def most_recovered(gaps: DataFrame, as_of: Column, hours: int = 24, n: int = 10) -> DataFrame:
    g = _recovered(gaps, as_of, hours).where("gap_duration_seconds IS NOT NULL").groupBy("mmsi").agg(
        _newest_known("name"), _newest_known("ship_category"), F.count("*").alias("recovered_gaps"),
        round_(F.avg("gap_duration_seconds") / 60, 1).alias("avg_gap_minutes"), round_(F.max("gap_duration_seconds") / 60, 1).alias("max_gap_minutes"),
    )
    return g.orderBy(F.desc("recovered_gaps"), F.desc("max_gap_minutes"), "mmsi").limit(n)


def average_gap(gaps: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    return _recovered(gaps, as_of, hours).agg(round_(F.avg("gap_duration_seconds") / 60, 1).alias("avg_gap_minutes"))


#: Upper bounds in seconds and texts of the duration buckets, in display order.
GAP_BUCKETS = ((900, "10–15 min"), (1800, "15–30 min"), (3600, "30–60 min"))


def gap_durations(gaps: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Recovered gaps by duration, in the buckets' own order."""
    s, bucket = F.col("gap_duration_seconds"), F.lit(len(GAP_BUCKETS))
    for k in range(len(GAP_BUCKETS) - 1, -1, -1):
        bucket = F.when(s < GAP_BUCKETS[k][0], k).otherwise(bucket)
    names = F.array(*(F.lit(t) for _, t in GAP_BUCKETS), F.lit("60+ min"))
    g = _recovered(gaps, as_of, hours).where(s.isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("gaps"))
    return g.orderBy("bucket").select(F.element_at(names, F.col("bucket") + 1).alias("gap_duration"), "gaps")


def latest_gap_events(gaps: DataFrame, as_of: Column, hours: int = 24, n: int = 100) -> DataFrame:
    g = gaps.withColumn("event_time", F.coalesce("gap_ended_at", "gap_detected_at")).where(_since("event_time", as_of, hours))
    g = g.orderBy(F.desc("event_time"), "mmsi", "event_type").limit(n)
    return g.select(label(F.col("event_type"), GAP_LABELS).alias("event_type"), "name", "mmsi", "ship_category", "navigation_status_name", "gap_detected_at", "gap_ended_at", round_(F.col("gap_duration_seconds") / 60, 1).alias("gap_minutes"), "event_time")


def long_recovered(gaps: DataFrame, seconds: float = 1800, n: int = 20) -> DataFrame:
    """The longest silences that have ended (ties: vessel, detection)."""
    return gaps.where((F.col("event_type") == "AIS_GAP_ENDED") & (F.col("gap_duration_seconds") >= seconds)).orderBy(F.desc("gap_duration_seconds"), "mmsi", "gap_detected_at").limit(n)


def gaps_by_type(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("event_type").agg(F.count("*").alias("events")).orderBy("event_type")


matched_gap = matched_lifecycle


# ---------------------------------------------------------------- visit runs


def visits_of_run(visits: DataFrame, run: str) -> DataFrame:
    mine = latest_by_key(visits.where(F.col("run_id") == run), ["run_id", "visit_id"], ["updated_at"]).where("is_deleted = 0")
    return mine.orderBy("mmsi", "arrival_at", "visit_id")


def run_list(runs: DataFrame) -> DataFrame:
    return latest_by_key(runs, ["run_id"], ["completed_at"]).orderBy(F.desc("window_start"), "run_id")


def newest_gaps(gaps: DataFrame, n: int = 20) -> DataFrame:
    """The gap events of the newest detections (ties: vessel, event type)."""
    return gaps.orderBy(F.desc("gap_detected_at"), "mmsi", "event_type").limit(n)
