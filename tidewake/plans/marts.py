"""The composed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.functions.expressions import MAX_VALID_SPEED_KN, input_hash, round_
from tidewake.operators import daily
from tidewake.operators.joins import eligible_only, left_marked, lookup, match_exact, missing_from
from tidewake.operators.versioned import active, current_port_visits, latest_by_key

__all__ = ["countries", "current_port_visits", "enrichment_candidates", "port_graph_communities", "port_graph_metrics_enriched", "vessel_daily_anomalies", "vessel_daily_enriched", "vessel_daily_features", "vessels"]

vessel_daily_anomalies = daily.daily_anomalies


def vessels(stg: DataFrame, ship_types: DataFrame, status_names: DataFrame) -> DataFrame:
    """The vessel dimension with labels, class, quality flags and eligibility."""
    v = lookup(stg, ship_types, {"ship_type": "ship_type"}, {"ship_type_name": "ship_type_name", "ship_category": "ship_category"})
    v = lookup(v, status_names, {"last_navigational_status": "navigational_status"}, {"last_navigational_status_name": "navigational_status_name"})
    return daily.vessel_flags(v, F.col("ship_type_name") != "Unknown")


def countries(stg: DataFrame) -> DataFrame:
    return stg.select("country_code", "iso3", "numeric_code", "country_name", "region", "capital_city")


def vessel_daily_features(positions: DataFrame, vessel_table: DataFrame, status_names: DataFrame, start: str | None = None, max_speed: float = MAX_VALID_SPEED_KN, stationary: float = 0.5) -> DataFrame:
    """Movement features of every eligible vessel and day."""
    points = daily.newest_positions(positions, start).withColumn("activity_date", F.to_date("msgtime"))
    points = daily.with_previous_status(points)
    d = daily.daily_aggregates(points, max_speed, stationary).join(daily.dominant_status(points), ["mmsi", "activity_date"], "left")
    d = eligible_only(d, vessel_table)
    d = lookup(d, status_names, {"last_navigational_status": "navigational_status"}, {"last_navigational_status_name": "navigational_status_name"})
    d = lookup(d, status_names, {"dominant_navigational_status": "navigational_status"}, {"dominant_navigational_status_name": "navigational_status_name"})
    return d.select(
        "mmsi", "activity_date", "vessel_name", "ship_type_name", "ship_category", "ais_points", "first_seen", "last_seen", "observation_hours", "avg_speed_kn", "max_speed_kn", "stationary_observation_pct",
        "last_navigational_status", "last_navigational_status_name", "dominant_navigational_status", "dominant_navigational_status_name", "dominant_status_pct", "nav_status_changes", "nav_status_change_rate_pct",
    )


def enrichment_candidates(anomalies: DataFrame, max_rank: int = 100) -> DataFrame:
    """The day's first anomalies with fixed rounding and a hash of all fields."""
    two, one = ("observation_hours", "avg_speed_kn", "max_speed_kn"), ("stationary_observation_pct", "dominant_status_pct", "nav_status_change_rate_pct")
    c = anomalies.where(F.col("anomaly_rank") <= max_rank).withColumns({x: round_(F.col(x), 2) for x in two} | {x: round_(F.col(x), 1) for x in one})
    return c.select(*daily.ANOMALY_COLUMNS, input_hash(daily.ANOMALY_COLUMNS).alias("input_hash"))


def pending_enrichment(candidates: DataFrame, history: DataFrame, day: Column | None, model: str, prompt_version: str, limit: int | None = None) -> DataFrame:
    """Candidates without a response to exactly this input, model and prompt, in rank order; the limit counts only these."""
    done = history.where((F.col("model") == model) & (F.col("prompt_version") == prompt_version)).select("mmsi", "activity_date", "input_hash")
    left = missing_from(candidates if day is None else candidates.where(F.col("activity_date") == day), done, ["mmsi", "activity_date", "input_hash"])
    ranked = left.orderBy("activity_date", "anomaly_rank")
    return ranked if limit is None else ranked.limit(limit)


def newest_response(responses: DataFrame) -> DataFrame:
    """One response per vessel-day: the newest, then the greater response id."""
    order = W.partitionBy("activity_date", "mmsi").orderBy(F.desc("created_at"), F.desc("response_id"))
    return responses.withColumn("response_rank", F.row_number().over(order)).where("response_rank = 1").drop("response_rank")


def vessel_daily_enriched(features: DataFrame, candidates: DataFrame, history: DataFrame, model: str, prompt_version: str) -> DataFrame:
    """Daily features with the enrichment of exactly the current input, or nulls."""
    current = candidates.select("mmsi", "activity_date", "input_hash")
    mine = history.where((F.col("model") == model) & (F.col("prompt_version") == prompt_version))
    e = newest_response(match_exact(mine, current, ["mmsi", "activity_date", "input_hash"]))
    renamed = {"summary": "ai_summary", "notable_behavior": "ai_notable_behavior", "data_quality_note": "ai_data_quality_note", "model": "ai_model", "prompt_version": "ai_prompt_version", "input_hash": "ai_input_hash", "input_tokens": "ai_input_tokens", "output_tokens": "ai_output_tokens", "created_at": "ai_created_at"}
    return left_marked(features, e.withColumnsRenamed(renamed), ["mmsi", "activity_date"], "has_ai_enrichment")


def port_graph_metrics_enriched(metrics: DataFrame, ports: DataFrame, country_table: DataFrame, visits: DataFrame) -> DataFrame:
    """Active metric rows with port, country and visit counts of their run."""
    m = active(metrics, ["run_id", "port_id"], ["exported_at"]).drop("is_deleted")
    v = active(visits, ["run_id", "visit_id"], ["updated_at"]).groupBy("run_id", "port_id").agg(F.count_distinct("mmsi").alias("unique_vessels"), F.count("*").alias("visit_count"))
    p = ports.select("port_id", F.col("name").alias("port_name"), F.col("country").alias("country_code"), "latitude", "longitude")
    c = country_table.select("country_code", "country_name", "iso3", "numeric_code")
    out = m.withColumn("activity_date", F.col("snapshot_date")).join(p, "port_id", "left").join(c, "country_code", "left").join(v, ["run_id", "port_id"], "left")
    return out.fillna(0, ["unique_vessels", "visit_count"])


def port_graph_communities(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy("run_id", "community_id").agg(
        F.min("activity_date").alias("activity_date"), F.max("community_name").alias("community_name"), F.max("community_label").alias("community_label"), F.count_distinct("port_id").alias("port_count")
    )


def newest_ports(ports: DataFrame) -> DataFrame:
    return latest_by_key(ports, ["port_id"], ["updated_at"])
