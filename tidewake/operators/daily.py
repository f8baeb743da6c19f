"""Vessel-day aggregates, their anomalies and the vessel dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.functions.expressions import MAX_VALID_SPEED_KN, mmsi_format_class, round_, valid_speed
from tidewake.operators.joins import rolling_baseline
from tidewake.operators.versioned import latest_by_key

POSITION_KEY, POSITION_VERSION = ["mmsi", "msgtime"], ["ingested_at", "stream"]


def newest_positions(positions: DataFrame, start: str | None = None) -> DataFrame:
    """One row per vessel and time from a date on; the filter comes before the aggregation, so files are pruned."""
    p = positions.where(F.col("msgtime") >= F.lit(start).cast("timestamp")) if start else positions
    return latest_by_key(p, POSITION_KEY, POSITION_VERSION)


def _latest(value: Column, when: Column) -> Column:
    """Value of the newest row for which ``when`` holds (ties: by ingestion, then the greater value)."""
    return F.max_by(value, F.when(when, F.struct("msgtime", "ingested_at", value.alias("tie"))))


def stg_vessels(positions: DataFrame, start: str | None = None, max_speed: float = MAX_VALID_SPEED_KN) -> DataFrame:
    """The vessel dimension's aggregate over newest positions, in one pass."""
    p = newest_positions(positions, start).withColumns({"name": F.nullif(F.trim("name"), F.lit("")), "speed": valid_speed(F.col("speed_over_ground"), max_speed)})

    def last(column: str) -> Column:
        return _latest(F.col(column), F.col(column).isNotNull())

    return p.groupBy("mmsi").agg(
        last("name").alias("vessel_name"), last("ship_type").alias("ship_type"), F.min("msgtime").alias("first_seen"), F.max("msgtime").alias("last_seen"),
        F.count_distinct("name").alias("name_count"), F.count("*").alias("ais_message_count"), F.avg("speed").alias("avg_speed_kn"), F.max("speed").alias("max_speed_kn"),
        last("speed").alias("last_speed_kn"), last("latitude").alias("last_latitude"), last("longitude").alias("last_longitude"),
        last("course_over_ground").alias("last_course"), last("true_heading").alias("last_heading"), last("navigational_status").alias("last_navigational_status"),
    )


#: What the vessel dimension shows of the newest position that has it, by column of the positions.
_LAST = {
    "name": "vessel_name", "ship_type": "ship_type", "speed": "last_speed_kn", "latitude": "last_latitude", "longitude": "last_longitude",
    "course_over_ground": "last_course", "true_heading": "last_heading", "navigational_status": "last_navigational_status",
}


def vessel_days(positions: DataFrame, max_speed: float = MAX_VALID_SPEED_KN) -> DataFrame:
    """Mergeable partials of the vessel dimension: one row for each vessel and day of the positions.

    Versions of a position share its time, hence its day, so the days of a
    vessel can be computed apart and folded by ``fold_vessel_days`` in any
    order. Of each value shown, the newest is kept with its time, ingestion
    and, for ties, itself; of names, the different ones.
    """
    p = newest_positions(positions).withColumns({"name": F.nullif(F.trim("name"), F.lit("")), "speed": valid_speed(F.col("speed_over_ground"), max_speed)})

    def newest(column: str) -> Column:
        known = F.struct("msgtime", "ingested_at", F.col(column).alias("value"))
        return F.max(F.when(F.col(column).isNotNull(), known)).alias(f"newest_{column}")

    return p.groupBy("mmsi", F.to_date("msgtime").alias("activity_date")).agg(
        F.min("msgtime").alias("first_seen"), F.max("msgtime").alias("last_seen"), F.count("*").alias("messages"), F.sum("speed").alias("speed_sum"), F.count("speed").alias("speeds"),
        F.max("speed").alias("max_speed_kn"), F.collect_set("name").alias("names"), *map(newest, _LAST),
    )


def fold_vessel_days(days: DataFrame) -> DataFrame:
    """The vessel dimension's aggregate (as ``stg_vessels`` gives it) of partials, one row a vessel and day."""
    names = days.select("mmsi", F.explode("names").alias("name")).groupBy("mmsi").agg(F.count_distinct("name").alias("name_count"))
    folded = days.groupBy("mmsi").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("messages").alias("ais_message_count"),
        F.try_divide(F.sum("speed_sum"), F.sum("speeds")).alias("avg_speed_kn"), F.max("max_speed_kn").alias("max_speed_kn"), *(F.max(f"newest_{c}")["value"].alias(shown) for c, shown in _LAST.items()),
    )
    v = folded.join(names, "mmsi", "left").withColumn("name_count", F.coalesce("name_count", F.lit(0)).cast("long"))
    return v.select(
        "mmsi", "vessel_name", "ship_type", "first_seen", "last_seen", "name_count", "ais_message_count", "avg_speed_kn", "max_speed_kn", "last_speed_kn", "last_latitude", "last_longitude",
        "last_course", "last_heading", "last_navigational_status",
    )


def vessel_flags(vessels: DataFrame, known_type: Column) -> DataFrame:
    """Quality flags and eligibility of vessels; ``known_type`` says whether the ship type has a label."""
    valid = F.length(F.col("mmsi").cast("string")) == 9
    test = F.coalesce(F.instr(F.lower("vessel_name"), "test") > 0, F.lit(False))
    ship_class = mmsi_format_class(F.col("mmsi"))
    return vessels.withColumns({
        "is_valid_mmsi": valid, "has_identity_conflict": F.col("name_count") > 1, "has_unknown_ship_type": F.col("ship_type").isNotNull() & ~known_type,
        "is_test_record": test, "is_dashboard_eligible": valid & ~test, "mmsi_format_class": ship_class, "is_ai_enrichment_eligible": valid & ~test & (ship_class == "ship"),
    })


def with_previous_status(points: DataFrame) -> DataFrame:
    """Each point with the status before it within its vessel-day."""
    order = W.partitionBy("mmsi", "activity_date").orderBy("msgtime", "ingested_at", "stream")
    return points.withColumn("previous_navigational_status", F.lag("navigational_status").over(order))


def daily_aggregates(points: DataFrame, max_speed: float = MAX_VALID_SPEED_KN, stationary: float = 0.5) -> DataFrame:
    """One row per vessel and day of points that know their previous status."""
    speed = valid_speed(F.col("speed_over_ground"), max_speed)
    status, before = F.col("navigational_status"), F.col("previous_navigational_status")
    known = status.isNotNull() & before.isNotNull()
    seconds = F.timestamp_diff("SECOND", F.date_trunc("second", F.min("msgtime")), F.date_trunc("second", F.max("msgtime")))
    last_status = F.max_by(status, F.when(status.isNotNull(), F.struct("msgtime", "ingested_at", "stream")))
    out = points.groupBy("mmsi", "activity_date").agg(
        F.count("*").alias("ais_points"), F.min("msgtime").alias("first_seen"), F.max("msgtime").alias("last_seen"), round_(seconds / 3600.0, 2).alias("observation_hours"),
        round_(F.avg(speed), 2).alias("avg_speed_kn"), round_(F.max(speed), 2).alias("max_speed_kn"),
        round_(F.try_divide(100.0 * F.count_if(speed < stationary), F.count(speed)), 1).alias("stationary_observation_pct"),
        last_status.alias("last_navigational_status"), F.count_if(known).alias("nav_status_comparable_pairs"), F.count_if(known & (status != before)).alias("nav_status_changes"),
    )
    rate = round_(F.try_divide(100.0 * F.col("nav_status_changes"), F.col("nav_status_comparable_pairs")), 1)
    return out.withColumn("nav_status_change_rate_pct", rate)


def dominant_status(points: DataFrame) -> DataFrame:
    """Most frequent status of each vessel-day (ties: the smallest) and its share of the known ones."""
    counts = points.where("navigational_status IS NOT NULL").groupBy("mmsi", "activity_date", "navigational_status").agg(F.count("*").alias("n"))
    best = F.max_by(F.struct("navigational_status", "n"), F.struct(F.col("n"), -F.col("navigational_status"))).alias("best")
    out = counts.groupBy("mmsi", "activity_date").agg(best, F.sum("n").alias("total"))
    return out.select("mmsi", "activity_date", F.col("best.navigational_status").alias("dominant_navigational_status"), round_(100.0 * F.col("best.n") / F.col("total"), 1).alias("dominant_status_pct"))


def well_observed(df: DataFrame, hours: float = 12, points: int = 100) -> DataFrame:
    return df.where((F.col("observation_hours") >= hours) & (F.col("ais_points") >= points))


def daily_anomalies(features: DataFrame, hours: float = 12, points: int = 100, days: int = 7, speed_floor: float = 3.0, stationary_floor: float = 30.0, deviations: float = 2.0, least_days: int = 3) -> DataFrame:
    """Well observed vessel-days whose speed or rest departs from the vessel's own previous days, scored and ranked by day.

    Scores use unrounded values; the statistics are rounded only for output.
    """
    f = rolling_baseline(well_observed(features, hours, points), days)
    speed, rest = F.abs(F.col("avg_speed_kn") - F.col("baseline_avg_speed_kn")), F.abs(F.col("stationary_observation_pct") - F.col("baseline_stationary_pct"))
    f = f.withColumns({
        "speed_deviation_kn": speed, "speed_anomaly_threshold_kn": F.greatest(F.lit(speed_floor), deviations * F.col("baseline_sd_speed_kn")),
        "stationary_deviation_pct": rest, "stationary_anomaly_threshold_pct": F.greatest(F.lit(stationary_floor), deviations * F.col("baseline_sd_stationary_pct")),
    })

    def flag(condition: str) -> Column:
        return F.coalesce(F.expr(condition), F.lit(False))

    f = f.withColumns({
        "speed_anomaly": flag(f"baseline_speed_days >= {least_days} AND speed_deviation_kn >= speed_anomaly_threshold_kn"),
        "stationary_anomaly": flag(f"baseline_stationary_days >= {least_days} AND stationary_deviation_pct >= stationary_anomaly_threshold_pct"),
        "status_speed_mismatch": flag(
            "dominant_status_pct >= 85 AND (dominant_navigational_status_name IN ('At anchor', 'Moored') AND stationary_observation_pct < 40 AND avg_speed_kn >= 3 "
            "OR dominant_navigational_status_name = 'Under way using engine' AND stationary_observation_pct >= 90 AND avg_speed_kn < 1)"
        ),
        "navigation_status_inconsistent": flag("nav_status_change_rate_pct >= 30 AND dominant_status_pct <= 70"),
    })

    def part(name: str, value: Column) -> Column:
        return F.when(F.col(name), value).otherwise(0.0)

    score = (
        part("speed_anomaly", F.col("speed_deviation_kn") / F.col("speed_anomaly_threshold_kn"))
        + part("stationary_anomaly", F.col("stationary_deviation_pct") / F.col("stationary_anomaly_threshold_pct"))
        + part("status_speed_mismatch", F.lit(0.25)) + part("navigation_status_inconsistent", F.lit(0.10))
    )
    reason = F.when(F.col("speed_anomaly") & F.col("stationary_anomaly"), "speed_and_stationary").when(F.col("speed_anomaly"), "speed").otherwise("stationary")
    f = f.where("speed_anomaly OR stationary_anomaly").withColumns({"anomaly_reason": reason, "anomaly_score": round_(score, 3)})
    two, one = ("baseline_avg_speed_kn", "baseline_sd_speed_kn", "speed_deviation_kn", "speed_anomaly_threshold_kn"), ("baseline_stationary_pct", "baseline_sd_stationary_pct", "stationary_deviation_pct", "stationary_anomaly_threshold_pct")
    f = f.withColumns({c: round_(F.col(c), 2) for c in two} | {c: round_(F.col(c), 1) for c in one})
    return rank_anomalies(f).select(*ANOMALY_COLUMNS)


def rank_anomalies(df: DataFrame) -> DataFrame:
    """Rank within a day: highest score first, then the smaller vessel number."""
    return df.withColumn("anomaly_rank", F.row_number().over(W.partitionBy("activity_date").orderBy(F.desc("anomaly_score"), "mmsi")))


#: The contract of the anomaly table, whose fields also make the enrichment input.
ANOMALY_COLUMNS = [
    "mmsi", "activity_date", "vessel_name", "ship_type_name", "ship_category", "ais_points", "observation_hours", "avg_speed_kn", "max_speed_kn", "stationary_observation_pct",
    "dominant_navigational_status_name", "dominant_status_pct", "nav_status_change_rate_pct", "baseline_days", "baseline_avg_speed_kn", "baseline_sd_speed_kn", "speed_deviation_kn",
    "speed_anomaly_threshold_kn", "speed_anomaly", "baseline_stationary_pct", "baseline_sd_stationary_pct", "stationary_deviation_pct", "stationary_anomaly_threshold_pct",
    "stationary_anomaly", "status_speed_mismatch", "navigation_status_inconsistent", "anomaly_reason", "anomaly_score", "anomaly_rank",
]


def busiest_vessels(positions: DataFrame, n: int = 10) -> DataFrame:
    """Vessels with most position rows, with their mean speed and first and last time."""
    out = positions.groupBy("mmsi").agg(F.count("*").alias("positions"), round_(F.avg("speed_over_ground"), 2).alias("avg_speed"), F.min("msgtime").alias("first_seen"), F.max("msgtime").alias("last_seen"))
    return out.orderBy(F.desc("positions"), "mmsi").limit(n)
