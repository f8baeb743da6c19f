"""Versioned tables: rows are only appended, and the newest version of a key is read."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_by_key(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The row of the greatest version of each key.

    One aggregation whose partial step shrinks the data before the shuffle;
    no sort of whole keys as a window would need.
    """
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*version)).alias("newest")
    return df.groupBy(*keys).agg(newest).select(*keys, "newest.*").select(*df.columns)


def duplicate_keys(df: DataFrame, keys: list[str], limit: int = 20) -> DataFrame:
    """Keys with several physical rows, most first."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1").orderBy(F.desc("copies"), *keys).limit(limit)


def row_versions(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: physical rows and logical keys."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("physical_rows"), F.count("*").alias("logical_rows"))


def active(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Newest versions that are no tombstones."""
    return latest_by_key(df, keys, version).where("is_deleted = 0")


def membership_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one side only, with ``side`` (old or new)."""
    gone = old.select(*keys).distinct().join(new.select(*keys), keys, "left_anti").withColumn("side", F.lit("old"))
    came = new.select(*keys).distinct().join(old.select(*keys), keys, "left_anti").withColumn("side", F.lit("new"))
    return gone.unionByName(came)


def next_version(history: DataFrame, version: str, now: datetime | Column) -> Column:
    """``now``, or a microsecond after the newest version in all of history, tombstones included."""
    latest = history.agg(F.max(version).alias("v")).select(F.timestamp_micros(F.unix_micros("v") + 1).alias("v")).scalar()
    at = now if isinstance(now, Column) else F.lit(now)
    return F.greatest(at, latest)


def publish_snapshot(history: DataFrame, new: DataFrame, run: str, keys: list[str], version: str, now: datetime | Column, *, window: list[str] | None = None) -> DataFrame:
    """Rows to append so that the active rows of ``run`` become ``new``: its rows, and tombstones of the vanished.

    Keys of ``new`` must be unique and of this run, and with ``window`` those
    columns must be what the run has always had; else the returned rows raise
    an error when they are computed. An empty snapshot is allowed.
    """
    mine = history.where(F.col("run_id") == run)
    stamp = next_version(mine, version, now)
    alive = active(mine, keys, [version])
    fresh = new.withColumns({"is_deleted": F.lit(0), version: stamp})
    gone = alive.join(new.select(*keys), keys, "left_anti").withColumns({"is_deleted": F.lit(1), version: stamp})
    twice = new.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).scalar()
    strangers = new.agg(F.count_if(~F.col("run_id").eqNullSafe(F.lit(run))).alias("n")).scalar()
    bad = (twice > 1) | (strangers > 0)
    if window:
        both = mine.select(*window).unionByName(new.select(*window)).distinct().agg(F.count("*").alias("n"))
        bad = bad | (both.scalar() > 1)
    checked = F.when(bad, F.raise_error(F.lit(f"snapshot of run {run} has duplicate keys, foreign rows or a changed window"))).otherwise(F.lit(0))
    rows = fresh.unionByName(gone.select(*fresh.columns))
    return rows.withColumn("is_deleted", F.col("is_deleted") + checked)


def check_run_window(runs: DataFrame, run: str, start: datetime, end: datetime) -> None:
    """A run id belongs to one window: a retry with other bounds is refused."""
    other = runs.where((F.col("run_id") == run) & ~((F.col("window_start") == start) & (F.col("window_end") == end)))
    if not other.isEmpty():
        raise ValueError(f"run {run} already has a different window")


def complete_run(runs: DataFrame, row: dict) -> DataFrame:
    """The registry with a run's row added; to be called only after its publication succeeded."""
    return runs.unionByName(runs.sparkSession.createDataFrame([row], runs.schema))


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest completed run (one row): by completion, then id."""
    newest = latest_by_key(runs, ["run_id"], ["completed_at"])
    return newest.orderBy(F.desc("completed_at"), F.desc("run_id")).limit(1)


def current_port_visits(visits: DataFrame, runs: DataFrame) -> DataFrame:
    """Active visits of the newest completed run."""
    alive = active(visits, ["run_id", "visit_id"], ["updated_at"])
    return alive.join(F.broadcast(latest_run(runs).select("run_id")), "run_id", "left_semi").drop("is_deleted")


def completed_visits(visits: DataFrame, runs: DataFrame, run: str) -> DataFrame:
    """Active visits of one completed run; their number must be what the registry says."""
    known = latest_by_key(runs.where(F.col("run_id") == run), ["run_id"], ["completed_at"]).select("visit_count").first()
    if known is None:
        raise ValueError(f"run {run} is not complete")
    mine = active(visits.where(F.col("run_id") == run), ["run_id", "visit_id"], ["updated_at"])
    if (found := mine.count()) != known["visit_count"]:
        raise ValueError(f"run {run} has {found} visits; the registry says {known['visit_count']}")
    return mine


def _versions_after(df: DataFrame, version: str) -> Column:
    return F.timestamp_micros(F.unix_micros(F.col(version)) + 1)


def backfill_activity_dates(visits: DataFrame, runs: DataFrame) -> DataFrame:
    """New versions of active visits without activity date, dated by the start of their run's window.

    A visit of an unknown run makes the result raise an error when computed.
    Nothing is written here; the caller appends the rows or looks at them.
    """
    undated = active(visits, ["run_id", "visit_id"], ["updated_at"]).where("activity_date IS NULL").drop("activity_date")
    days = latest_by_key(runs, ["run_id"], ["completed_at"]).select("run_id", F.to_date("window_start").alias("activity_date"))
    met = undated.join(days, "run_id", "left")
    day = F.when(F.col("activity_date").isNull(), F.raise_error(F.concat(F.lit("no registry row for run "), F.col("run_id")))).otherwise(F.col("activity_date"))
    return met.withColumns({"activity_date": day.cast("date"), "updated_at": _versions_after(met, "updated_at")}).select(*visits.columns)


def backfill_snapshot_dates(metrics: DataFrame) -> DataFrame:
    """New versions of metric rows whose snapshot date is not the window's start date; crossing months is refused."""
    wrong = latest_by_key(metrics, ["run_id", "port_id"], ["exported_at"]).where("snapshot_date <> to_date(window_start)")
    day = F.to_date("window_start")
    same_month = F.date_trunc("month", "snapshot_date") == F.date_trunc("month", day)
    fixed = F.when(same_month, day).otherwise(F.raise_error(F.concat(F.lit("correction would cross months: "), F.col("run_id"))).cast("date"))
    return wrong.withColumns({"snapshot_date": fixed, "exported_at": _versions_after(wrong, "exported_at")}).select(*metrics.columns)


def missing_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of ``a`` that ``b`` lacks."""
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def latest_vessel_rows(positions: DataFrame) -> DataFrame:
    """One row per vessel from its newest observation, whatever that says."""
    return latest_by_key(positions.select("mmsi", "msgtime", "latitude", "longitude", "name", "ship_type", "ingested_at"), ["mmsi"], ["msgtime", "ingested_at"])
