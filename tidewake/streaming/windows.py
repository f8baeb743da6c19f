"""Sliding event-time features per vessel, for batches and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.operators.joins import label_stream

SIZES, SLIDE = (5, 15, 30, 60), 5


def check_windows(sizes: tuple[int, ...] = SIZES, slide: int = SLIDE) -> tuple[int, ...]:
    """Window sizes in minutes: different positive multiples of the slide."""
    if slide <= 0 or not sizes or len(set(sizes)) != len(sizes) or any(s <= 0 or s % slide for s in sizes):
        raise ValueError(f"window sizes {sizes} must be different positive multiples of {slide}")
    return tuple(sizes)


def window_aggregates(order: list[str]) -> list[Column]:
    """Mergeable aggregates of a window; codes come from the newest event even if null, the name from the newest that has one.

    ``order`` says which event is newest (its last columns break ties).
    """
    newest = F.struct(*order)
    latest = F.max_by(F.struct("ship_type", "navigation_status"), newest)
    return [
        F.count("*").alias("position_count"), F.avg("speed").alias("avg_speed"), F.min("speed").alias("min_speed"), F.max("speed").alias("max_speed"),
        F.max_by("name", F.when(F.col("name").isNotNull(), newest)).alias("name"), latest["ship_type"].alias("ship_type"), latest["navigation_status"].alias("last_navigation_status"),
    ]


def window_features(events: DataFrame, sizes: tuple[int, ...] = SIZES, slide: int = SLIDE, watermark: str | None = None, order: tuple[str, ...] = ("event_time",)) -> DataFrame:
    """Features of (mmsi, event_time, name, speed, ship_type, navigation_status) for windows of several sizes, [start, end), aligned to the epoch.

    With ``watermark`` (empty if the events' sources have their own) the result streams in append mode: a late event is lost
    to windows that have closed and still counts in longer ones, so every size
    aggregates the events themselves. Without, events are reduced to panes of
    one slide, and only panes are put into the windows that hold them.
    """
    sizes = check_windows(sizes, slide)
    if watermark is None:
        return _of_panes(events, sizes, slide, order)
    e = events.withWatermark("event_time", watermark) if watermark else events
    out = None
    for size in sizes:
        by = F.window("event_time", f"{size} minutes", f"{slide} minutes")
        one = e.groupBy("mmsi", by.alias("w")).agg(*window_aggregates(list(order)))
        one = one.select("mmsi", F.lit(size).alias("window_minutes"), F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *_FEATURES)
        out = one if out is None else out.unionByName(one)
    return out


_FEATURES = ("position_count", "avg_speed", "min_speed", "max_speed", "name", "ship_type", "last_navigation_status")


def _start(size: int):
    return lambda first: F.struct(first.alias("start"), F.lit(size).alias("window_minutes"))


def _of_panes(events: DataFrame, sizes: tuple[int, ...], slide: int, order: tuple[str, ...]) -> DataFrame:
    """Windows of all sizes from mergeable aggregates of panes, which are numbered from the epoch."""
    micros = slide * 60_000_000
    newest = F.struct(*order)
    panes = events.groupBy("mmsi", F.floor(F.unix_micros("event_time") / F.lit(micros)).alias("pane")).agg(
        F.count("*").alias("n"), F.sum("speed").alias("speed_sum"), F.count("speed").alias("speeds"), F.min("speed").alias("low"), F.max("speed").alias("high"),
        F.max(newest).alias("newest"), F.max_by(F.struct("ship_type", "navigation_status"), newest).alias("codes"), F.max_by(F.struct(newest.alias("at"), "name"), F.when(F.col("name").isNotNull(), newest)).alias("named"),
    )
    starts = F.concat(*(F.transform(F.sequence(F.col("pane") - (size // slide - 1), F.col("pane")), _start(size)) for size in sizes))
    w = panes.withColumn("window", F.explode(starts)).select("*", "window.*")
    w = w.groupBy("mmsi", "window_minutes", "start").agg(
        F.sum("n").alias("position_count"), F.try_divide(F.sum("speed_sum"), F.sum("speeds")).alias("avg_speed"), F.min("low").alias("min_speed"), F.max("high").alias("max_speed"),
        F.max_by("named.name", "named.at").alias("name"), F.max_by("codes", "newest").alias("codes"),
    )
    start = F.timestamp_micros(F.col("start") * micros)
    end = F.timestamp_micros(F.col("start") * micros + F.col("window_minutes").cast("long") * 60_000_000)
    return w.select("mmsi", "window_minutes", start.alias("window_start"), end.alias("window_end"), *_FEATURES[:5], F.col("codes.ship_type").alias("ship_type"), F.col("codes.navigation_status").alias("last_navigation_status"))


def labelled(features: DataFrame, ship_types: DataFrame, status_names: DataFrame) -> DataFrame:
    """Features with labels of their codes (null for unknown ones) and the day of the window's end."""
    f = label_stream(features, ship_types, {"ship_type": "ship_type"}, {"ship_type_name": "ship_type_name", "ship_category": "ship_category"})
    f = label_stream(f, status_names, {"last_navigation_status": "navigational_status"}, {"last_navigation_status_name": "navigational_status_name"})
    return f.withColumn("activity_date", F.to_date("window_end"))


def dedupe_stream(events: DataFrame, keys: tuple[str, ...] = ("mmsi", "event_time"), watermark: str = "30 seconds") -> DataFrame:
    """Events without repetitions that arrive within the watermark."""
    return events.withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(list(keys))


#: Settings that a stream of the silence detector and one with an idle source need.
RECOVERABLE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
IDLE_SOURCES = {"spark.sql.streaming.multipleWatermarkPolicy": "max"}


def stream_session(spark: SparkSession, *settings: dict[str, str]) -> SparkSession:
    """A session beside this one for one query, with settings of its own; streams are read from it.

    With ``IDLE_SOURCES`` the watermark of several sources follows the fastest
    one, so that one without events does not hold back the others' windows; a
    query keeps the policy that it first started with. With ``RECOVERABLE``
    state is kept by RocksDB, each batch stores what it has changed, and small
    stores reserve no disk ahead.
    """
    own = spark.newSession()
    for setting in settings:
        for name, value in setting.items():
            own.conf.set(name, value)
    return own


def start_query(df: DataFrame, path: str, checkpoint: str, available_now: bool = False, name: str | None = None):
    """An append query to Parquet files; offsets, state and timers recover from the checkpoint, and the file sink writes each row once."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    w = w.queryName(name) if name else w
    return (w.trigger(availableNow=True) if available_now else w).start()
