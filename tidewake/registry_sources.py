"""Registered queries of the sources, sinks, streams and runs: their inputs are texts and files that Spark derives from the tables."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake import bindings as B
from tidewake import registry as R
from tidewake import schemas
from tidewake.bindings import Tables
from tidewake.operators import joins, network, versioned
from tidewake.registry import query, us
from tidewake.shared import shared_folder, written
from tidewake.sources import derived, files, positions, reference

# ---------------------------------------------------------------- JSON texts

_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def messages(t: Tables) -> DataFrame:
    """Events as JSON messages of the live source; one in eleven is broken, one in seven has an impossible identity."""
    e, k = t.read("events"), F.col("event_id")
    body = F.to_json(F.struct(
        F.when(k % 7 == 0, F.lit("x")).otherwise((F.lit(257000000) + F.col("user_id")).cast("string")).alias("mmsi"), F.date_format(F.col("ts").cast("timestamp"), _MICROS).alias("msgtime"),
        F.lit(60.5).alias("latitude"), F.lit(5.25).alias("longitude"), F.col("value").alias("speedOverGround"), (k % 9).cast("int").alias("navigationalStatus"), (k % 90).cast("int").alias("shipType"),
        F.concat(F.lit("V"), F.col("user_id")).alias("name"),
    ))
    return e.select(F.when(k % 11 == 0, F.concat(F.lit("{broken "), body)).otherwise(body).alias("value"))


_GOOD = "FROM events WHERE event_id % 11 <> 0 AND event_id % 7 <> 0"


@query("positions_from_json", f"SELECT 257000000 + user_id AS mmsi, epoch_us(ts) AS msgtime, epoch_us(ts) * 1000 AS msgtime_ns, 60.5e0 AS latitude, value AS speed_over_ground, CAST(event_id % 9 AS INT) AS navigational_status, 'V' || user_id AS name {_GOOD}", False)
def positions_from_json(t: Tables) -> DataFrame:
    numbers = messages(t).select(F.regexp_replace("value", '"mmsi":"([0-9]+)"', '"mmsi":$1').alias("value"))
    return positions.positions_from_json(numbers).select("mmsi", "msgtime", "msgtime_ns", "latitude", "speed_over_ground", "navigational_status", "name")


@query("parse_gap_events", f"SELECT 257000000 + user_id AS mmsi, 'V' || user_id AS name, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS msgtime, 5.25e0 AS longitude, CAST(event_id % 90 AS INT) AS ship_type, CAST(event_id % 9 AS INT) AS navigation_status {_GOOD}", False)
def parse_gap_events(t: Tables) -> DataFrame:
    return positions.parse_gap_events(messages(t)).select("mmsi", "name", "msgtime", "longitude", "ship_type", "navigation_status")


@query("parse_feature_events", f"SELECT 257000000 + user_id AS mmsi, epoch_us(ts) // 1000 * 1000 AS event_time, value AS speed, CAST(event_id % 90 AS INT) AS ship_type {_GOOD}", False)
def parse_feature_events(t: Tables) -> DataFrame:
    return positions.parse_feature_events(messages(t)).select("mmsi", "event_time", "speed", "ship_type")


@query("normalize_historic", "SELECT 257000000 + user_id AS mmsi, epoch_us(ts) AS msgtime, value AS speed_over_ground, event_type AS name, 'historic' AS stream FROM events WHERE event_id % 5 <> 0", False)
def normalize_historic(t: Tables) -> DataFrame:
    k = F.col("event_id")
    landed = t.read("events").select(
        (F.lit(257000000) + F.col("user_id")).cast("long").alias("mmsi"), F.when(k % 10 != 0, F.date_format(F.col("ts").cast("timestamp"), _MICROS)).alias("dateTimeUtc"), F.when(k % 5 != 0, F.lit(60.0)).alias("latitude"), F.lit(5.0).alias("longitude"),
        F.col("value").alias("speedOverGround"), *(F.lit(1.0).alias(c) for c in ("courseOverGround", "rateOfTurn")), *(F.lit(1).alias(c) for c in ("trueHeading", "navigationalStatus", "shipType")), F.col("event_type").alias("name"),
    )
    return positions.normalize_historic(landed).select("mmsi", "msgtime", "speed_over_ground", "name", "stream")


def _json(df: DataFrame, skip: tuple[str, ...]) -> DataFrame:
    kept = [F.date_format(f.name, _MICROS).alias(f.name) if f.dataType.typeName() == "timestamp" else F.col(f.name) for f in df.schema.fields if f.name not in skip]
    return df.select(F.to_json(F.struct(*kept)).alias("value"))


@query("ingest_features", f"SELECT mmsi, window_minutes, {us('window_start', 'window_end')}, position_count, max_speed, ship_category, CAST(CAST(window_end AS DATE) AS VARCHAR) AS activity_date FROM window_labels")
def ingest_features(t: Tables) -> DataFrame:
    """Feature windows written as texts and taken in again."""
    texts = _json(R.window_table(t), ("activity_date",))
    return derived.ingest_features(texts).select("mmsi", "window_minutes", "window_start", "window_end", "position_count", "max_speed", "ship_category", "activity_date")


@query("ingest_gap_events", f"SELECT event_type, mmsi, {us('last_event_msgtime', 'gap_detected_at')}, gap_duration_seconds, navigation_status_name, CAST(CAST(coalesce(gap_ended_at, gap_detected_at) AS DATE) AS VARCHAR) AS activity_date FROM gap_labels")
def ingest_gap_events(t: Tables) -> DataFrame:
    texts = _json(R.gap_table(t), ())
    return derived.ingest_gap_events(texts).select("event_type", "mmsi", "last_event_msgtime", "gap_detected_at", "gap_duration_seconds", "navigation_status_name", "activity_date")


# ---------------------------------------------------------------- files


@query("inspect_parquet", " UNION ALL ".join(f"SELECT '{n}.parquet' AS file, count(*) AS rows FROM {n}" for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")), False)
def inspect_parquet(t: Tables) -> DataFrame:
    found = files.inspect_parquet(t.spark, t.dir).select(F.element_at(F.split("path", "/"), -1).alias("file"), "rows")
    return found.where(F.col("file").isin(*(f"{n}.parquet" for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"))))


@query("replace_table", "SELECT o_orderstatus, count(*) AS orders FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1", False)
def replace_table(t: Tables) -> DataFrame:
    """A table written twice; the second version is what readers see."""
    path = shared_folder(t.spark, "replaced")
    o = t.read("orders")
    files.replace_table(o, path, o.count())
    files.replace_table(o.where("o_orderkey % 2 = 0"), path)
    return files.read_table(t.spark, path).groupBy("o_orderstatus").agg(F.count("*").alias("orders"))


@query("load_curated", "SELECT CAST(CAST(date_time_utc AS DATE) AS VARCHAR) AS day, count(*) AS rows, count(CASE WHEN true_heading <> 511 THEN 1 END) AS headings FROM historical GROUP BY 1")
def load_curated(t: Tables) -> DataFrame:
    path = files.load_curated(t.historical, shared_folder(t.spark, "curated"))
    return t.spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("rows"), F.count("true_heading").alias("headings"))


@query("write_partitioned", f"SELECT strftime(ts, '%Y-%m') AS month, {B.MMSI_SQL} AS mmsi, count(*) AS positions FROM events GROUP BY ALL", False)
def write_partitioned(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "by-month")
    files.write_partitioned(B.positions_of(t.read("events")), path, "msgtime")
    return t.spark.read.parquet(path).groupBy(F.col("month").cast("string").alias("month"), "mmsi").agg(F.count("*").alias("positions"))


_TWO_DAYS = "msgtime >= TIMESTAMP '2024-01-05 12:00:00' AND msgtime < TIMESTAMP '2024-01-07'"


@query("positions_window_by_folder", f"SELECT unit, mmsi, epoch_us(msgtime) AS msgtime, seq FROM positions_raw, (VALUES ('month'), ('day')) u(unit) WHERE {_TWO_DAYS}")
def positions_window_by_folder(t: Tables) -> DataFrame:
    """A time range of positions that lie in folders of months and of days; only folders of the range are opened."""
    def of(unit: str) -> DataFrame:
        path = shared_folder(t.spark, f"by-{unit}")
        files.write_partitioned(t.positions_raw, path, "msgtime", unit)
        return positions.positions_window(t.spark.read.parquet(path), "2024-01-05 12:00:00", "2024-01-07").select(F.lit(unit).alias("unit"), "mmsi", "msgtime", "seq")

    return of("month").unionByName(of("day"))


@query("read_seed", "SELECT CAST(n_nationkey AS INT) AS code, CASE WHEN n_regionkey > 0 THEN n_name END AS label FROM nation", False)
def read_seed(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "seed")
    n = t.read("nation").select(F.concat(F.lit(" "), F.col("n_nationkey").cast("string")).alias("code"), F.when(F.col("n_regionkey") > 0, F.col("n_name")).otherwise("  ").alias("label"))
    n.coalesce(1).write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return files.read_seed(t.spark, path, "code", ("label",))


@query("validate_ports", "SELECT port_id, latitude FROM ports")
def validate_ports(t: Tables) -> DataFrame:
    return reference.validate_ports(t.ports).select("port_id", "latitude")


# ---------------------------------------------------------------- runs and network


@query("completed_visits", "SELECT run_id, visit_id, mmsi FROM live_visits")
def completed_visits(t: Tables) -> DataFrame:
    """The visits of a run that was registered after its publication."""
    history = R.visit_history(t)
    alive = versioned.active(history, ["run_id", "visit_id"], ["updated_at"]).count()
    start, end = (F.lit(w).cast("timestamp") for w in B.WINDOW)
    row = t.read("region").limit(1).select(F.lit(B.RUN).alias("run_id"), start.alias("window_start"), end.alias("window_end"), F.lit("h").alias("dataset_hash"), F.lit("p").alias("parameters"), F.lit(1).cast("long").alias("source_rows"), F.lit(alive).cast("long").alias("visit_count"), start.alias("completed_at")).first()
    runs = versioned.complete_run(t.spark.createDataFrame([], schemas.RUNS), row.asDict())
    versioned.check_run_window(runs, B.RUN, row["window_start"], row["window_end"])
    return versioned.completed_visits(history, runs, B.RUN).select("run_id", "visit_id", "mmsi")


@query("backfill_snapshot_dates", f"SELECT run_id, port_id, '2024-01-01' AS snapshot_date, epoch_us(TIMESTAMP '2024-02-04') + 1 AS exported_at FROM metric_table WHERE right(port_id, 1) < '5'")
def backfill_snapshot_dates(t: Tables) -> DataFrame:
    wrong = R.metric_table(t).withColumn("snapshot_date", F.when(F.substring("port_id", -1, 1) < "5", F.date_add("snapshot_date", 3)).otherwise(F.col("snapshot_date")))
    return versioned.backfill_snapshot_dates(wrong).select("run_id", "port_id", "snapshot_date", "exported_at")


@query("empty_snapshot", f"SELECT run_id, port_id, 1 AS is_deleted, epoch_us(TIMESTAMP '2024-02-05') AS exported_at FROM metric_table")
def empty_snapshot(t: Tables) -> DataFrame:
    """A rerun without edges: no ranks, no communities, and tombstones for all rows published before."""
    nothing = t.network.limit(0)
    start, end = (F.lit(w).cast("timestamp") for w in B.WINDOW)
    none = network.metric_rows(network.pagerank(network.project(nothing)), network.louvain(network.project(nothing, undirected=True)), B.RUN, start, end)
    history = R.metric_table(t)
    none = none.withColumns({"community_name": F.lit(None).cast("string"), "community_label": F.lit(None).cast("string")})
    rows = versioned.publish_snapshot(history, none, B.RUN, ["run_id", "port_id"], "exported_at", F.lit("2024-02-05").cast("timestamp"), window=["window_start", "window_end"])
    return rows.select("run_id", "port_id", "is_deleted", "exported_at")


@query("validate_edges", "SELECT from_port_id, to_port_id, movement_count FROM network")
def validate_edges(t: Tables) -> DataFrame:
    edges = written(t.network, "edges")
    return network.validate_edges(edges, t.nation_ports, edges.count())


@query("pagerank_20", f"""
    WITH RECURSIVE share AS (SELECT from_port_id AS src, to_port_id AS dst, movement_count / sum(movement_count) OVER (PARTITION BY from_port_id) AS s FROM ({B.CTES['network']})),
    nodes AS (SELECT src AS node FROM share UNION SELECT dst FROM share),
    step(k, node, page_rank) AS (
      SELECT 0, node, CAST(0.15 AS DOUBLE) FROM nodes UNION ALL
      SELECT any_value(k) + 1, n.node, CAST(0.15 AS DOUBLE) + CAST(0.85 AS DOUBLE) * coalesce(sum(page_rank * s) FILTER (dst = n.node), 0) FROM nodes n, step JOIN share ON step.node = share.src WHERE k < 20 GROUP BY n.node)
    SELECT node, {B.sql_round('page_rank', 9)} AS page_rank FROM step WHERE k = 20""", False)  # fmt: skip
def pagerank_20(t: Tables) -> DataFrame:
    """With the default of 20 rounds."""
    from tidewake.functions.expressions import round_

    return network.pagerank(network.project(t.network)).withColumn("page_rank", round_(F.col("page_rank"), 9))


@query("apply_enrichment", f"SELECT mmsi, CAST(activity_date AS VARCHAR) AS activity_date, CASE WHEN anomaly_reason = 'speed' THEN 'failed' ELSE 'rank ' || anomaly_rank END AS summary FROM candidates")
def apply_enrichment(t: Tables) -> DataFrame:
    """A function that fails for one kind of candidate: the others get their answers."""
    from tidewake.plans.enrichment import apply_enrichment as run

    def fn(row: dict) -> dict:
        if row["anomaly_reason"] == "speed":
            raise ValueError("no answer")
        return {"activity_class": "transit", "navigation_status_quality": "consistent", "summary": f"rank {row['anomaly_rank']}", "notable_behavior": "n"}

    good, bad = run(R.candidates(t), fn, "m", "v1")
    return good.select("mmsi", "activity_date", "summary").unionByName(bad.select("mmsi", "activity_date", F.lit("failed").alias("summary")))


# ---------------------------------------------------------------- streams


@query("stream_without_repeats", f"SELECT DISTINCT {B.MMSI_SQL} AS mmsi, epoch_us(ts) AS event_time FROM events", False)
def stream_without_repeats(t: Tables) -> DataFrame:
    """Events that arrive twice are kept once."""
    from tidewake.streaming.windows import dedupe_stream

    e = B.positions_of(t.stream("events")).select("mmsi", F.col("msgtime").alias("event_time"), F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return R.run_stream(t, dedupe_stream(e).drop("copy"), "stream-dedupe")


@query("stream_late_events", f"""
    SELECT mmsi, minutes AS window_minutes, epoch_us(make_timestamp(epoch_us(ts) // (CAST(minutes AS BIGINT) * 60000000) * (CAST(minutes AS BIGINT) * 60000000))) AS window_start, CAST(sum(CASE WHEN late AND epoch_us(ts) // (CAST(minutes AS BIGINT) * 60000000) * (CAST(minutes AS BIGINT) * 60000000) + CAST(minutes AS BIGINT) * 60000000 <= seen THEN 0 ELSE 1 END) AS BIGINT) AS position_count
    FROM (SELECT {B.MMSI_SQL} AS mmsi, ts, event_id % 4 = 0 AS late, (SELECT max(epoch_us(ts)) // 1000 * 1000 - 30000000 FROM events WHERE event_id % 4 <> 0) AS seen FROM events), (VALUES (5), (1440)) w(minutes)
    WHERE epoch_us(ts) // (CAST(minutes AS BIGINT) * 60000000) * (CAST(minutes AS BIGINT) * 60000000) + CAST(minutes AS BIGINT) * 60000000 <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - 30000000 FROM events) GROUP BY ALL HAVING position_count > 0""", False)  # fmt: skip
def stream_late_events(t: Tables) -> DataFrame:
    """A quarter of the events arrives after the others: windows that have closed lose them, longer ones that are open count them."""
    from tidewake.streaming import windows as W

    folder = shared_folder(t.spark, "late")
    p = B.positions_of(t.read("events")).select("mmsi", F.col("msgtime").alias("event_time"), "seq", "name", F.col("speed_over_ground").alias("speed"), "ship_type", F.col("navigational_status").alias("navigation_status"))
    for late in (F.col("seq") % 4 != 0, F.col("seq") % 4 == 0):
        p.where(late).drop("seq").write.mode("append").parquet(f"{folder}/in")
        for size in (5, 1440):
            stream = t.spark.readStream.schema(p.drop("seq").schema).parquet(f"{folder}/in")
            W.start_query(W.window_features(stream, (size,), size, watermark="30 seconds"), f"{folder}/out-{size}", f"{folder}/checkpoint-{size}", available_now=True).awaitTermination()
    out = t.spark.read.parquet(f"{folder}/out-5").unionByName(t.spark.read.parquet(f"{folder}/out-1440"))
    return out.select("mmsi", "window_minutes", "window_start", "position_count")


_SILENCES_SQL = """
    WITH n AS (SELECT user_id AS mmsi, epoch_us(ts) AS stamp, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    a AS (SELECT * FROM n WHERE k = 1), b AS (SELECT * FROM n WHERE k = 2)
    SELECT 'AIS_GAP_DETECTED' AS event_type, mmsi, 'V' || mmsi AS name, CAST(a.stamp AS VARCHAR) AS earlier_msgtime, '' AS resumed_msgtime, CAST(a.event_id % 9 AS INT) AS earlier_status, -1 AS resumed_status, 1 AS paired FROM a JOIN b USING (mmsi)
    UNION ALL SELECT 'AIS_GAP_ENDED', mmsi, 'V' || mmsi, CAST(a.stamp AS VARCHAR), CAST(b.stamp AS VARCHAR), CAST(a.event_id % 9 AS INT), CAST(b.event_id % 9 AS INT), 1 FROM a JOIN b USING (mmsi)"""


class Silences:
    """Every user reports once, is silent past the timeout, and reports again without a name; the detector runs beside, and may be stopped and started again."""

    def __init__(self, t: Tables, name: str, timeout: float) -> None:
        from tidewake.streaming.windows import RECOVERABLE, stream_session

        self.spark, self.timeout, self.folder, self.query = stream_session(t.spark, RECOVERABLE), timeout, shared_folder(t.spark, name), None
        self.events = _two_reports(t)
        self.vessels = self.events.where("k = 1").count()
        self.schema = self.events.drop("k").schema

    def send(self, k: int) -> None:
        self.events.where(F.col("k") == k).drop("k").write.mode("append").parquet(f"{self.folder}/in")

    def start(self) -> None:
        """From the checkpoint, if there is one. A batch that comes again after a stop writes its folder again."""
        from tidewake.streaming.gaps import gap_events

        found = gap_events(self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/in"), timeout=self.timeout)
        self.columns = found.schema.simpleString()[7:-1].replace(":", " ")
        out = found.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{self.folder}/out/batch={n}")).outputMode("update")
        self.query = out.option("checkpointLocation", f"{self.folder}/checkpoint").trigger(processingTime="1 second").start()

    def stop(self) -> None:
        """Between two batches if there is a pause soon, else within one, which is then done again from the checkpoint."""
        end = time.monotonic() + 5
        while time.monotonic() < end and self.query.isActive and self.query.status["isTriggerActive"]:
            time.sleep(0.1)
        self.query.stop()

    def out(self) -> DataFrame:
        return files.read_or_empty(self.spark, f"{self.folder}/out", self.columns)

    def wait(self, what: str, reached) -> None:
        end = time.monotonic() + 300
        while time.monotonic() < end and self.query.isActive:
            if reached():
                return
            time.sleep(0.5)
        raise TimeoutError(f"{what} of {self.vessels} vessels did not come: {self.query.exception()}")

    def wait_for(self, kind: str) -> None:
        self.wait(kind, lambda: self.out().where(F.col("event_type") == kind).select("mmsi").distinct().count() >= self.vessels)


def _two_reports(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W

    order = W.partitionBy("mmsi").orderBy("ts", "event_id")
    e = t.read("events").select(F.col("user_id").cast("long").alias("mmsi"), F.col("ts").cast("timestamp").alias("ts"), "event_id").withColumns({"k": F.row_number().over(order), "n": F.count("*").over(W.partitionBy("mmsi"))})
    return written(e.where("k <= 2 AND n > 1").select(
        "k", "mmsi", F.when(F.col("k") == 1, F.concat(F.lit("V"), "mmsi")).alias("name"), F.unix_micros("ts").cast("string").alias("msgtime"), F.lit(60.0).alias("latitude"), F.lit(5.0).alias("longitude"), F.lit(70).alias("ship_type"), (F.col("event_id") % 9).cast("int").alias("navigation_status"),
    ), "gap-input")


@query("stream_gap_events", _SILENCES_SQL, False)
def stream_gap_events(t: Tables) -> DataFrame:
    """``paired`` says whether both events of a silence name one detection."""
    s = Silences(t, "gap-stream", 2)
    s.send(1)
    s.start()
    try:
        if s.vessels:
            s.wait_for("AIS_GAP_DETECTED")
            s.send(2)
            s.wait_for("AIS_GAP_ENDED")
    finally:
        s.stop()
    return _first_silences(t, s)


@query("stream_gap_recovery", _SILENCES_SQL, False)
def stream_gap_recovery(t: Tables) -> DataFrame:
    """The detector is stopped when it has read the first reports, with timers pending, and again after its own; from one checkpoint it still reports every silence once and every return once."""
    s = Silences(t, "gap-recovery", 5)
    s.send(1)
    s.start()
    try:
        if s.vessels:
            s.wait("reports", lambda: sum(p.sources[0].numInputRows for p in s.query.recentProgress) >= s.vessels)
            s.stop()
            s.start()
            s.wait_for("AIS_GAP_DETECTED")
            s.stop()
            s.send(2)
            s.start()
            s.wait_for("AIS_GAP_ENDED")
    finally:
        s.stop()
    return _first_silences(t, s)


def _first_silences(t: Tables, s: Silences) -> DataFrame:
    """The events of the silence between the two reports of each vessel."""
    first = s.events.where("k = 1").select("mmsi", F.col("msgtime").alias("first_msgtime"))
    g = s.out().join(first, "mmsi").withColumn("earlier_msgtime", F.coalesce("previous_event_msgtime", "last_event_msgtime")).where("earlier_msgtime = first_msgtime")
    paired = joins.distinct_per(g, ["mmsi"], "gap_detected_at").select("mmsi", (F.col("distinct_gap_detected_at") == 1).alias("paired"))
    ended = F.col("event_type") == "AIS_GAP_ENDED"
    return g.join(paired, "mmsi").select(
        "event_type", "mmsi", "name", "earlier_msgtime", F.coalesce("resumed_event_msgtime", F.lit("")).alias("resumed_msgtime"),
        F.when(ended, F.col("previous_navigation_status")).otherwise(F.col("navigation_status")).alias("earlier_status"), F.coalesce("resumed_navigation_status", F.lit(-1)).alias("resumed_status"), "paired",
    )


@query("stream_vessel_state", "SELECT mmsi, epoch_us(msgtime) AS msgtime, seq, name FROM positions QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY msgtime DESC, seq DESC) = 1")
def stream_vessel_state(t: Tables) -> DataFrame:
    """Newest state per vessel, kept by a stream of several batches; the last of them is run twice, as after a crash before its checkpoint."""
    from tidewake.streaming.upsert import UpsertSink

    folder = shared_folder(t.spark, "vessel-state")
    p = R.positions(t).select("mmsi", "msgtime", "seq", "name")
    p.repartition(4, "seq").write.parquet(f"{folder}/in")
    sink = UpsertSink(t.spark, f"{folder}/state", "mmsi", ("msgtime", "seq"), "mmsi long, msgtime timestamp, seq long, name string", 16)

    def run() -> None:
        s = t.spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        s.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    run()
    if commits := sink.commits():
        files.forget(t.spark, f"{folder}/checkpoint/commits/{commits[-1]}")
        run()
    return sink.read()


@query("stream_idle_source", f"""
    SELECT mmsi, {B.SLIDE * 3} AS window_minutes, epoch_us(make_timestamp(w * {B.SLIDE * 60_000_000})) AS window_start, count(*) AS position_count, max(value) AS max_speed
    FROM (SELECT {B.MMSI_SQL} AS mmsi, value, unnest(range(epoch_us(ts) // {B.SLIDE * 60_000_000} - 2, epoch_us(ts) // {B.SLIDE * 60_000_000} + 1)) AS w FROM events)
    WHERE w * {B.SLIDE * 60_000_000} + {B.SLIDE * 3 * 60_000_000} <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - 30000000 FROM events) GROUP BY mmsi, w""", False)  # fmt: skip
def stream_idle_source(t: Tables) -> DataFrame:
    """Two sources, one of which has sent only its first event: the other's windows close all the same."""
    from tidewake.streaming import windows as W

    own = W.stream_session(t.spark, W.IDLE_SOURCES)
    folder = shared_folder(t.spark, "idle-source")
    p = B.positions_of(t.read("events")).select("seq", "mmsi", F.col("msgtime").alias("event_time"), "name", F.col("speed_over_ground").alias("speed"), "ship_type", F.col("navigational_status").alias("navigation_status"))
    first = p.agg(F.min_by("seq", F.struct("event_time", "seq"))).first()[0]
    p.where(F.col("seq") != F.lit(first)).drop("seq").write.parquet(f"{folder}/busy")
    p.where(F.col("seq") == F.lit(first)).drop("seq").write.parquet(f"{folder}/idle")
    sources = [own.readStream.schema(p.drop("seq").schema).parquet(f"{folder}/{n}").withWatermark("event_time", "30 seconds") for n in ("busy", "idle")]
    both = W.window_features(sources[0].unionByName(sources[1]), (3 * B.SLIDE,), B.SLIDE, watermark="")
    W.start_query(both, f"{folder}/out", f"{folder}/checkpoint", available_now=True).awaitTermination()
    return t.spark.read.schema(both.schema).parquet(f"{folder}/out").select("mmsi", "window_minutes", "window_start", "position_count", "max_speed")
