"""Lookups, membership joins and the point-in-radius join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.functions.expressions import haversine_m

#: Seed tables are code lists; more rows than this are joined without a broadcast hint.
SEED_ROWS = 10_000


def _small(df: DataFrame, rows: int = SEED_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (checked by a limited count)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def lookup(df: DataFrame, seed: DataFrame, on: dict[str, str], names: dict[str, str], default: str | None = "Unknown") -> DataFrame:
    """Left join to a code list: ``on`` maps a column to the seed's key, ``names`` an output to the seed's column.

    Blank and missing labels become ``default``.
    """
    found = seed.select(*(F.col(k).alias(f"seed_{k}") for k in on.values()), *(F.col(c).alias(f"seed_{o}") for o, c in names.items()))
    condition = [df[a] == found[f"seed_{b}"] for a, b in on.items()]
    out = df.join(_small(found), condition, "left")
    for o in names:
        shown = F.nullif(F.trim(f"seed_{o}"), F.lit(""))
        out = out.withColumn(o, F.coalesce(shown, F.lit(default)) if default is not None else shown)
    return out.drop(*found.columns)


def label_stream(df: DataFrame, seed: DataFrame, on: dict[str, str], names: dict[str, str]) -> DataFrame:
    """Stream-side lookup: codes stay, labels of unknown codes are null."""
    return lookup(df, seed, on, names, default=None)


def eligible_only(daily: DataFrame, vessels: DataFrame) -> DataFrame:
    """Daily rows of eligible vessels, with the vessel's names."""
    v = vessels.where("is_ai_enrichment_eligible").select("mmsi", "vessel_name", "ship_type_name", "ship_category")
    return daily.join(v, "mmsi")


def rolling_baseline(features: DataFrame, days: int = 7) -> DataFrame:
    """Mean, population deviation and day counts of the ``days`` calendar days before each vessel-day.

    A range frame on day numbers: one shuffle, and no row is multiplied.
    """
    before = W.partitionBy("mmsi").orderBy("day_number").rangeBetween(-days, -1)
    f = features.withColumn("day_number", F.unix_date("activity_date"))
    return f.withColumns({
        "baseline_days": F.count("*").over(before),
        "baseline_speed_days": F.count("avg_speed_kn").over(before),
        "baseline_stationary_days": F.count("stationary_observation_pct").over(before),
        "baseline_avg_speed_kn": F.avg("avg_speed_kn").over(before),
        "baseline_sd_speed_kn": F.stddev_pop("avg_speed_kn").over(before),
        "baseline_stationary_pct": F.avg("stationary_observation_pct").over(before),
        "baseline_sd_stationary_pct": F.stddev_pop("stationary_observation_pct").over(before),
    }).drop("day_number")


def rolling_baseline_by_days(features: DataFrame, days: int = 7) -> DataFrame:
    """The same by giving each day to the ``days`` after it and an equality join; the twin that tests compare."""
    given = features.select("mmsi", F.explode(F.sequence(F.date_add("activity_date", 1), F.date_add("activity_date", days))).alias("activity_date"), "avg_speed_kn", "stationary_observation_pct")
    base = given.groupBy("mmsi", "activity_date").agg(
        F.count("*").alias("baseline_days"), F.count("avg_speed_kn").alias("baseline_speed_days"), F.count("stationary_observation_pct").alias("baseline_stationary_days"),
        F.avg("avg_speed_kn").alias("baseline_avg_speed_kn"), F.stddev_pop("avg_speed_kn").alias("baseline_sd_speed_kn"),
        F.avg("stationary_observation_pct").alias("baseline_stationary_pct"), F.stddev_pop("stationary_observation_pct").alias("baseline_sd_stationary_pct"),
    )
    out = features.join(base, ["mmsi", "activity_date"], "left")
    return out.fillna(0, ["baseline_days", "baseline_speed_days", "baseline_stationary_days"])


def port_circles(ports: DataFrame) -> DataFrame:
    """The different circles: of all ports with equal place and radius the smallest id, and how many they are (``ports``)."""
    return ports.groupBy("latitude", "longitude", "radius_m").agg(F.min("port_id").alias("port_id"), F.count("*").alias("ports"))


def ports_within_radius(points: DataFrame, ports: DataFrame, cell: float = 0.1, carried: tuple[str, ...] = (), how: str = "inner") -> DataFrame:
    """Every (point, port) whose distance is at most the port's radius, with ``distance_m`` and the port's ``carried`` columns.

    With ``how="left"`` no point is lost: one may also come with null instead
    of a port, whether it is in another's circle or in none.

    Ports (the small side) are put into all grid cells that their circle can
    touch, so points are neither multiplied nor compared with far ports. The
    number of a circle's cells follows from its latitude; longitudes wrap, and
    a circle that comes near a pole covers all longitudes.
    """
    lat, lon, radius = F.col("latitude"), F.col("longitude"), F.col("radius_m")
    per_row, n_cols = 100_000.0 * cell, round(360 / cell)
    widest = F.abs(lat) + radius / 100_000.0
    rows = F.ceil(radius / per_row).cast("int")
    near = F.ceil(radius / (per_row * F.greatest(F.cos(F.radians(widest)), F.lit(1e-4)))).cast("int")
    cols = F.when(widest >= 89.9, n_cols // 2).otherwise(F.least(F.lit(n_cols // 2), near))
    row, col = F.floor(lat / cell).cast("int"), F.floor(lon / cell).cast("int")
    p = ports.select(F.col("port_id"), *carried, lat.alias("port_latitude"), lon.alias("port_longitude"), radius, row.alias("row0"), col.alias("col0"), rows.alias("rows"), cols.alias("cols"))
    p = p.withColumn("cell_row", F.explode(F.expr("sequence(row0 - rows, row0 + rows)"))).withColumn("cell_col", F.explode(F.expr("sequence(col0 - cols, col0 + cols)")))
    p = p.withColumn("cell_col", F.pmod("cell_col", F.lit(n_cols))).drop("row0", "col0", "rows", "cols").distinct()
    q = points.withColumns({"cell_row": row, "cell_col": F.pmod(col, F.lit(n_cols))})
    met = q.join(_small(p, 1_000_000), ["cell_row", "cell_col"], how).withColumn("distance_m", haversine_m(lat, lon, F.col("port_latitude"), F.col("port_longitude")))
    near = F.col("distance_m") <= radius
    met = met.withColumns({c: F.when(near, F.col(c)) for c in (*carried, "port_id", "distance_m")}) if how == "left" else met.where(near)
    return met.drop("cell_row", "cell_col", "port_latitude", "port_longitude", "radius_m")


def match_exact(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``a`` whose composite key ``b`` has, with ``b``'s other columns."""
    return a.join(b, keys)


def left_marked(a: DataFrame, b: DataFrame, keys: list[str], marker: str) -> DataFrame:
    """Left join with a column that says, as 0 or 1, whether there was a match."""
    return a.join(b.withColumn(marker, F.lit(1)), keys, "left").fillna(0, [marker])


def missing_from(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b.select(*keys), keys, "left_anti")


def at_latest(df: DataFrame, column: str) -> DataFrame:
    """Rows at the greatest value of a column."""
    return df.where(F.col(column) == df.agg(F.max(column).alias("latest")).scalar())


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("from_port_id").alias("port_id")).union(edges.select("to_port_id")).distinct()


def matched_lifecycle(gaps: DataFrame) -> DataFrame:
    """Both events of the newest silence that has been detected and has ended (newest detection, then vessel)."""
    key = ["mmsi", "gap_detected_at"]
    whole = gaps.groupBy(*key).agg(
        F.count_if(F.col("event_type") == "AIS_GAP_DETECTED").alias("detected"), F.count_if(F.col("event_type") == "AIS_GAP_ENDED").alias("ended")
    ).where("detected > 0 AND ended > 0")
    one = whole.orderBy(F.desc("gap_detected_at"), F.asc("mmsi")).limit(1)
    return gaps.join(F.broadcast(one.select(*key)), key, "left_semi")


def anomalies_with_enrichment(anomalies: DataFrame, enriched: DataFrame, how: str = "inner") -> DataFrame:
    """Anomalies joined to their enrichment on vessel and day; rows without one are left out (inner) or null (left)."""
    e = enriched.where("has_ai_enrichment = 1").select("mmsi", "activity_date", "activity_class", "navigation_status_quality", "ai_summary", "ai_notable_behavior", "ai_data_quality_note", "ai_prompt_version")
    return anomalies.join(e, ["mmsi", "activity_date"], how)


def having(df: DataFrame, keys: list[str], aggs: list[Column], condition: str) -> DataFrame:
    return df.groupBy(*keys).agg(*aggs).where(condition)


def distinct_per(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Exact number of different values per key."""
    return df.groupBy(*keys).agg(F.count_distinct(column).alias(f"distinct_{column}"))


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)
