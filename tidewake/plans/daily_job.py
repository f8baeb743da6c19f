"""The daily job: one Spark application from positions to marts, visits, network and checks of one day."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake import checks, schemas
from tidewake.operators import daily, network, versioned, visits
from tidewake.plans import marts
from tidewake.plans.enrichment import RESPONSES, apply_enrichment
from tidewake.shared import written
from tidewake.sources.files import read_or_empty
from tidewake.sources.positions import positions_window
from tidewake.sources.reference import dataset_hash, stg_countries


def activity_window(conf: dict | None, now: datetime) -> tuple[datetime, datetime]:
    """[day, day + 1) of an explicit ``activity_date`` (YYYY-MM-DD), or of the day before ``now``; start and end are refused."""
    conf = conf or {}
    if {"start", "end"} & set(conf):
        raise ValueError("give activity_date, not start and end")
    text = conf.get("activity_date")
    if text is not None and not re.fullmatch(r"\d{4}-\d{2}-\d{2}", str(text)):
        raise ValueError(f"activity_date {text!r} is not YYYY-MM-DD")
    day = date.fromisoformat(text) if text else (now.astimezone(UTC) - timedelta(days=1)).date()
    start = datetime(day.year, day.month, day.day, tzinfo=UTC)
    return start, start + timedelta(days=1)


@dataclass
class Paths:
    """Where the job reads and writes; all tables are Parquet folders.

    ``countries`` (raw country records) may be left out; ports then have no
    country names. ``options`` overrides thresholds, names ``model`` and
    ``prompt_version``, and gives ``enrich``, the user's function for
    candidates; without it they stay pending. ``analysis_start`` (a date; else
    that of the first position) is where the vessel dimension's history begins;
    ``max_rows`` refuses a window of positions with more rows.
    """

    positions: str
    ports: str
    ship_types: str
    status_names: str
    out: str
    countries: str | None = None
    options: dict = field(default_factory=dict)

    def table(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        """A versioned table, which only grows; empty before the first append."""
        return read_or_empty(spark, f"{self.out}/{name}", schema)

    def append(self, df: DataFrame, name: str) -> None:
        df.write.mode("append").parquet(f"{self.out}/{name}")

    def of_run(self, spark: SparkSession, name: str, schema: str, run: str) -> DataFrame:
        """The versions of one run, which have a folder of their own in tables that runs publish to."""
        return read_or_empty(spark, f"{self.out}/{name}/of_run={_folder(run)}", schema)

    def publish(self, df: DataFrame, name: str, run: str) -> None:
        """Append a run's versions to its folder."""
        df.write.mode("append").parquet(f"{self.out}/{name}/of_run={_folder(run)}")


def _folder(run: str) -> str:
    """A run's name as a folder: no characters that file systems or readers take for something else."""
    return run.replace(":", "")


def run_day(spark: SparkSession, day: str, paths: Paths, now: datetime | None = None) -> dict[str, int]:
    """Compute and write the day's tables; returns the number of offending rows of each check (all must be 0).

    In turn: vessels, features and anomalies; visits, published as a snapshot
    and then registered as a run; routes and network metrics of the registered
    visits, published likewise; enriched metrics and communities; candidates,
    the enrichment of those that are new, and enriched days; checks. A rerun of
    a day with other positions leaves tombstones for what has vanished.
    """
    start, end = activity_window({"activity_date": day}, now or datetime.now(UTC))
    o, now = paths.options, now or datetime.now(UTC)
    today = F.col("activity_date") == F.lit(day).cast("date")
    run = start.strftime("%Y-%m-%dT%H:%M:%SZ")
    ports, status_names = spark.read.parquet(paths.ports), spark.read.parquet(paths.status_names)

    features, anomalies = _movement(spark, paths, start, end, status_names)
    _write(features.where(today), f"{paths.out}/vessel_daily_features", day)
    _write(anomalies.where(today), f"{paths.out}/vessel_daily_anomalies", day)
    stays = _publish_visits(spark, paths, run, start, end, ports, now)
    _publish_metrics(spark, paths, run, start, end, ports, stays, now)
    enriched, communities = _ports(spark, paths, run, ports)
    _write(enriched, f"{paths.out}/port_graph_metrics_enriched", day)
    _write(communities, f"{paths.out}/port_graph_communities", day)
    _enrich(spark, paths, day)

    found = _checks(spark, paths, day)
    if any(found.values()):
        raise ValueError(f"checks failed for {day}: {found}")
    return found


def _vessel_days(spark: SparkSession, paths: Paths, start: datetime, end: datetime) -> DataFrame:
    """Partials of the vessel dimension from the analysis start to the end of the day, one folder a day.

    The run's day is computed again, since its positions may have changed, and
    of the days before those that no run has noted as done: all of them in the
    first run, none later. Other days' positions are not read. Days without
    positions are noted too. A late position of an earlier day counts once that
    day is run again.
    """
    out, today = f"{paths.out}/vessel_days", start.date()
    p = spark.read.parquet(paths.positions)
    noted = paths.table(spark, "vessel_days_done", "activity_date date, completed_at timestamp").select("activity_date").distinct()
    known = {r["activity_date"] for r in noted.collect()}  # a row a day
    given = paths.options.get("analysis_start")
    first = date.fromisoformat(str(given)) if given else min(known) if known else p.agg(F.to_date(F.min("msgtime")).alias("d")).first()["d"]
    first = today if first is None else min(first, today)
    missing = [d for d in (first + timedelta(days=k) for k in range((today - first).days)) if d not in known]
    day = daily.vessel_days(positions_window(p, start, end, paths.options.get("max_rows")))
    if missing:
        low = datetime.combine(missing[0], datetime.min.time(), UTC)
        past = daily.vessel_days(positions_window(p, low, start)).where(F.col("activity_date").isin(missing)).withColumn("day", F.col("activity_date").cast("string"))
        past.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(out)
    _write(day, out, today.isoformat())
    done = [(d, datetime.now(UTC)) for d in (*missing, today)]
    paths.append(spark.createDataFrame(done, "activity_date date, completed_at timestamp").coalesce(1), "vessel_days_done")
    return spark.read.schema(f"{_ddl(day)}, day string").parquet(out).where((F.col("day") >= first.isoformat()) & (F.col("day") <= today.isoformat()))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _movement(spark: SparkSession, paths: Paths, start: datetime, end: datetime, status_names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features and anomalies of the day and of the seven before it, which the baseline needs; vessels are written on the way."""
    o, p = paths.options, spark.read.parquet(paths.positions)
    vessels = marts.vessels(daily.fold_vessel_days(_vessel_days(spark, paths, start, end)), spark.read.parquet(paths.ship_types), status_names)
    _write(vessels, f"{paths.out}/vessels", start.date().isoformat())
    vessels = spark.read.parquet(f"{paths.out}/vessels/day={start.date().isoformat()}")
    recent = positions_window(p, start - timedelta(days=7), end, o.get("max_rows"))
    features = written(marts.vessel_daily_features(recent, vessels, status_names, stationary=o.get("stationary", 0.5)), "features")
    return features, daily.daily_anomalies(features, o.get("hours", 12), o.get("points", 100))


def _publish_visits(spark: SparkSession, paths: Paths, run: str, start: datetime, end: datetime, ports: DataFrame, now: datetime) -> DataFrame:
    """Publish the visits of the day, then register the run; returns its visits as registered."""
    o, day = paths.options, start.date().isoformat()
    runs = paths.table(spark, "port_visit_runs", schemas.RUNS)
    versioned.check_run_window(runs, run, start, end)
    seen = daily.newest_positions(positions_window(spark.read.parquet(paths.positions), start, end, o.get("max_rows")))
    limits = (o.get("min_stay", 1200), o.get("max_gap", 900), o.get("max_speed", 3.0))
    new = visits.detect_visits(seen, ports, *limits).withColumns({"run_id": F.lit(run), "activity_date": F.lit(day).cast("date")})
    new = written(new, "day-visits")
    paths.publish(versioned.publish_snapshot(paths.of_run(spark, "port_visits", schemas.VISITS, run), new, run, ["run_id", "visit_id"], "updated_at", now), "port_visits", run)
    row = {"run_id": run, "window_start": start, "window_end": end, "dataset_hash": dataset_hash(ports), "parameters": repr(limits), "source_rows": seen.count(), "visit_count": new.count(), "completed_at": now}
    paths.append(versioned.complete_run(runs.limit(0), row), "port_visit_runs")
    return versioned.completed_visits(paths.of_run(spark, "port_visits", schemas.VISITS, run), paths.table(spark, "port_visit_runs", schemas.RUNS), run)


def _publish_metrics(spark: SparkSession, paths: Paths, run: str, start: datetime, end: datetime, ports: DataFrame, stays: DataFrame, now: datetime) -> None:
    """Write the day's routes and publish the metrics of their network; a day without routes takes its earlier rows back."""
    day = start.date().isoformat()
    _write(network.port_connections(stays).withColumn("run_id", F.lit(run)), f"{paths.out}/port_routes", day)
    routes = network.validate_edges(spark.read.parquet(f"{paths.out}/port_routes/day={day}"), ports)
    ranks = network.pagerank(network.project(routes))
    members = network.louvain(network.project(routes, undirected=True))
    metrics = network.metric_rows(ranks, members, run, F.lit(start), F.lit(end))
    metrics = metrics.join(network.community_labels(metrics, ports).drop("port_count"), ["run_id", "community_id"], "left")
    metrics = written(metrics, "day-metrics")
    history = paths.of_run(spark, "port_graph_metrics", schemas.METRICS, run)
    paths.publish(versioned.publish_snapshot(history, metrics, run, ["run_id", "port_id"], "exported_at", now, window=["window_start", "window_end"]), "port_graph_metrics", run)


def _ports(spark: SparkSession, paths: Paths, run: str, ports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metrics of the run with names and visit counts, and its communities."""
    nothing = spark.createDataFrame([], "country_code string, iso3 string, numeric_code string, country_name string, region string, capital_city string")
    countries = marts.countries(stg_countries(spark.read.parquet(paths.countries))) if paths.countries else nothing
    metrics, stays = (paths.of_run(spark, n, s, run) for n, s in (("port_graph_metrics", schemas.METRICS), ("port_visits", schemas.VISITS)))
    enriched = marts.port_graph_metrics_enriched(metrics, ports, countries, stays)
    return enriched, marts.port_graph_communities(enriched)


def _enrich(spark: SparkSession, paths: Paths, day: str) -> None:
    """Write the day's candidates, give the new ones to the user's function, and write the enriched days."""
    o = paths.options
    model, prompt = o.get("model", "none"), o.get("prompt_version", "v1")
    _write(marts.enrichment_candidates(spark.read.parquet(f"{paths.out}/vessel_daily_anomalies/day={day}"), o.get("max_rank", 100)), f"{paths.out}/enrichment_candidates", day)
    candidates = spark.read.parquet(f"{paths.out}/enrichment_candidates/day={day}")
    if o.get("enrich"):
        pending = marts.pending_enrichment(candidates, paths.table(spark, "enrichment_responses", RESPONSES), None, model, prompt, o.get("limit"))
        answers, failures = apply_enrichment(pending, o["enrich"], model, prompt)
        paths.append(answers, "enrichment_responses")
        _write(failures, f"{paths.out}/enrichment_failures", day)
    history = paths.table(spark, "enrichment_responses", RESPONSES)
    _write(marts.vessel_daily_enriched(spark.read.parquet(f"{paths.out}/vessel_daily_features/day={day}"), candidates, history, model, prompt), f"{paths.out}/vessel_daily_enriched", day)


def _checks(spark: SparkSession, paths: Paths, day: str) -> dict[str, int]:
    """Numbers of offending rows of what the day has written."""
    o = paths.options
    t = {n: spark.read.parquet(f"{paths.out}/{n}/day={day}") for n in ("vessel_daily_features", "vessel_daily_anomalies", "vessel_daily_enriched", "enrichment_candidates", "port_graph_metrics_enriched", "port_graph_communities")}
    v, r = paths.table(spark, "port_visits", schemas.VISITS), paths.table(spark, "port_visit_runs", schemas.RUNS)
    offending = {
        "features": checks.unique(t["vessel_daily_features"], ["mmsi", "activity_date"]), "anomalies": checks.unique(t["vessel_daily_anomalies"], ["activity_date", "anomaly_rank"]),
        "visits": checks.unique(versioned.active(v, ["run_id", "visit_id"], ["updated_at"]), ["run_id", "visit_id"]), "visit_dates": checks.visit_activity_dates(v, r), "current_visit_dates": checks.current_visit_dates(v, r),
        "metrics": checks.unique(t["port_graph_metrics_enriched"], ["run_id", "port_id"]), "graph_dates": checks.graph_activity_date(t["port_graph_metrics_enriched"], t["port_graph_communities"]),
        "community_ports": checks.community_port_counts(t["port_graph_metrics_enriched"], t["port_graph_communities"]),
        "enrichment": checks.valid_current_enrichment(t["vessel_daily_enriched"], t["enrichment_candidates"], o.get("model", "none"), o.get("prompt_version", "v1"), o.get("max_rank", 100)),
    }
    return {n: df.count() for n, df in offending.items()}


def _write(df: DataFrame, path: str, day: str) -> None:
    df.write.mode("overwrite").parquet(f"{path}/day={day}")


def run_range(spark: SparkSession, first: str, last: str, paths: Paths) -> list[str]:
    """Run every day of an inclusive range; the first failure stops it."""
    a, b = date.fromisoformat(first), date.fromisoformat(last)
    if b < a:
        raise ValueError("the range ends before it begins")
    done = []
    for k in range((b - a).days + 1):
        day = (a + timedelta(days=k)).isoformat()
        run_day(spark, day, paths)
        done.append(day)
    return done
