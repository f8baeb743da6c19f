"""Data-quality checks: each returns the offending rows, so an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.operators.versioned import active, current_port_visits, latest_by_key


def not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rows) of columns with nulls."""
    one = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*columns))).alias("column_name", "rows")).where("rows > 0")


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def valid_current_enrichment(enriched: DataFrame, candidates: DataFrame, model: str, prompt_version: str, max_rank: int = 100) -> DataFrame:
    """Vessel-days whose enrichment is not of the current input, model, prompt and rank, or that show some without having one."""
    c = candidates.select("mmsi", "activity_date", F.col("input_hash").alias("current_hash"), "anomaly_rank")
    e = enriched.join(c, ["mmsi", "activity_date"], "left")
    shown = ("activity_class", "navigation_status_quality", "ai_summary", "ai_notable_behavior", "ai_data_quality_note", "ai_model", "ai_prompt_version", "ai_input_hash", "response_id", "ai_input_tokens", "ai_output_tokens", "ai_created_at")
    good = (F.col("current_hash") == F.col("ai_input_hash")) & F.col("anomaly_rank").between(1, max_rank) & (F.col("ai_model") == model) & (F.col("ai_prompt_version") == prompt_version)
    stale = (F.col("has_ai_enrichment") == 1) & ~F.coalesce(good, F.lit(False))
    stray = (F.col("has_ai_enrichment") == 0) & F.coalesce(*(F.col(x).cast("string") for x in shown)).isNotNull()
    return e.where(stale | stray).select("mmsi", "activity_date")


def visit_activity_dates(visits: DataFrame, runs: DataFrame) -> DataFrame:
    """Active visits whose day is missing or is not that of their run."""
    r = latest_by_key(runs, ["run_id"], ["completed_at"]).select("run_id", F.to_date("window_start").alias("run_date"))
    v = active(visits, ["run_id", "visit_id"], ["updated_at"]).join(r, "run_id", "left")
    return v.where("NOT coalesce(activity_date = run_date, false)").select("run_id", "visit_id")


def current_visit_dates(visits: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of the current view that the base table does not have with the same day."""
    base = active(visits, ["run_id", "visit_id"], ["updated_at"]).select("run_id", "visit_id", F.col("activity_date").alias("base_date"))
    c = current_port_visits(visits, runs).join(base, ["run_id", "visit_id"], "left")
    return c.where("NOT coalesce(activity_date = base_date, false)").select("run_id", "visit_id")


def graph_activity_date(enriched: DataFrame, communities: DataFrame) -> DataFrame:
    """Runs without exactly one day, equal to the snapshot's and to the window's start."""
    a = enriched.select("run_id", "activity_date", "snapshot_date", F.to_date("window_start").alias("processing_date"))
    b = communities.select("run_id", "activity_date", F.col("activity_date").alias("snapshot_date"), F.col("activity_date").alias("processing_date"))
    g = a.unionByName(b).groupBy("run_id").agg(F.count_distinct("activity_date").alias("days"), F.count_if(F.expr("activity_date <> snapshot_date OR snapshot_date <> processing_date")).alias("bad"))
    return g.where("days <> 1 OR bad > 0").select("run_id")


def community_port_counts(enriched: DataFrame, communities: DataFrame) -> DataFrame:
    """Runs whose communities do not add up to their ports."""
    zero = F.lit(0).cast("long")
    a = communities.select("run_id", F.col("port_count").alias("community_ports"), zero.alias("metric_ports"))
    b = enriched.select("run_id", zero.alias("community_ports"), F.lit(1).cast("long").alias("metric_ports"))
    g = a.unionByName(b).groupBy("run_id").agg(F.sum("community_ports").alias("community_ports"), F.sum("metric_ports").alias("metric_ports"))
    return g.where("community_ports <> metric_ports").select("run_id")


def curated_load(summary: DataFrame) -> DataFrame:
    """Measures of a curated month (see sources.files.curated_summary) that are wrong: row counts that differ, required nulls, sentinels."""
    m = summary
    rows = m.where("measure IN ('raw_rows', 'curated_rows')").agg(F.count_distinct("value").alias("kinds")).scalar()
    wrong = (F.col("measure").endswith("_sentinels") | (F.col("measure") == "curated_required_null_rows")) & (F.col("value") > 0)
    return m.where(wrong | ((F.col("measure") == "curated_rows") & (rows != 1))).select("measure", "value")
