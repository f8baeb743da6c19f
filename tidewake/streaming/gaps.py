"""Silence and return of vessels: a stateful detector for streams and its twin over history."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewake.operators.joins import label_stream
from tidewake.operators.segments import across, ends, inside, segment_of
from tidewake.shared import written

TIMEOUT = 600
STATE = "seen_ms long, alerted boolean, name string, msgtime string, latitude double, longitude double, ship_type int, navigation_status int, timer_ms long, detected_ms long"
EVENTS = (
    "event_type string, mmsi long, name string, last_event_msgtime string, previous_event_msgtime string, resumed_event_msgtime string, last_latitude double, last_longitude double, "
    "gap_detected_ms long, gap_ended_ms long, gap_duration_seconds double, gap_timeout_seconds double, ship_type int, navigation_status int, previous_navigation_status int, resumed_navigation_status int"
)
_COLUMNS = [c.split()[0] for c in EVENTS.split(", ")]


def _row(**values) -> dict:
    return {c: values.get(c) for c in _COLUMNS}


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS).astype({c: "Int64" for c in ("mmsi", "gap_detected_ms", "gap_ended_ms", "ship_type", "navigation_status", "previous_navigation_status", "resumed_navigation_status")})


def _event(frame: pd.DataFrame, at: int) -> dict:
    return {k: None if pd.isna(v) else v for k, v in frame.iloc[at].items()}


class GapDetector(StatefulProcessor):
    """Per vessel: the newest observation and whether its silence was reported.

    Time is processing time. An observation cancels the timer, so one that
    comes in the same batch as a due timer means no gap. A reported silence
    keeps its state until the vessel returns, with the time of its report, which
    both events of a silence carry. Of a batch's observations only the first,
    the last and the last known name matter, so a vessel with very many costs
    no Python step for each.
    """

    def __init__(self, timeout: float = TIMEOUT) -> None:
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("vessel", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, mmsi = timerValues.getCurrentProcessingTimeInMs(), int(key[0])
        old, out, event, name = self._state(), [], None, None
        for frame in rows:
            if frame.empty:
                continue
            if event is None and old and old["alerted"]:
                out.append(self._ended(mmsi, old, _event(frame, 0), now))
            event = _event(frame, -1)
            named = frame["name"][frame["name"].notna() & (frame["name"] != "")]
            name = named.iloc[-1] if len(named) else name
        if event is not None:
            before = old or {}
            old = {
                "seen_ms": now, "alerted": False, "name": name or before.get("name"), "msgtime": event["msgtime"], "latitude": event["latitude"], "longitude": event["longitude"],
                "ship_type": event["ship_type"], "navigation_status": event["navigation_status"], "timer_ms": before.get("timer_ms"), "detected_ms": None,
            }
            if old["timer_ms"]:
                self.handle.deleteTimer(old["timer_ms"])
            old["timer_ms"] = now + int(self.timeout * 1000)
            self.handle.registerTimer(old["timer_ms"])
            self._keep(old)
        if out:
            yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, old = timerValues.getCurrentProcessingTimeInMs(), self._state()
        if old and not old["alerted"] and now - old["seen_ms"] >= self.timeout * 1000:
            self._keep(old | {"alerted": True, "timer_ms": None, "detected_ms": now})
            yield _frame([_row(
                event_type="AIS_GAP_DETECTED", mmsi=int(key[0]), name=old["name"], last_event_msgtime=old["msgtime"], last_latitude=old["latitude"], last_longitude=old["longitude"],
                gap_detected_ms=now, gap_timeout_seconds=float(self.timeout), ship_type=old["ship_type"], navigation_status=old["navigation_status"],
            )])

    def close(self) -> None:
        pass

    def _state(self) -> dict | None:
        return dict(zip((c.split()[0] for c in STATE.split(", ")), self.state.get(), strict=True)) if self.state.exists() else None

    def _keep(self, s: dict) -> None:
        def whole(x):
            return None if x is None else int(x)

        self.state.update((int(s["seen_ms"]), bool(s["alerted"]), s["name"], s["msgtime"], s["latitude"], s["longitude"], whole(s["ship_type"]), whole(s["navigation_status"]), whole(s["timer_ms"]), whole(s["detected_ms"])))

    def _ended(self, mmsi: int, old: dict, event: dict, now: int) -> dict:
        return _row(
            event_type="AIS_GAP_ENDED", mmsi=mmsi, name=event["name"] or old["name"], previous_event_msgtime=old["msgtime"], resumed_event_msgtime=event["msgtime"], last_latitude=old["latitude"],
            last_longitude=old["longitude"], gap_detected_ms=old["detected_ms"], gap_ended_ms=now, gap_duration_seconds=(now - old["seen_ms"]) / 1000, gap_timeout_seconds=float(self.timeout),
            ship_type=event["ship_type"], navigation_status=event["navigation_status"], previous_navigation_status=old["navigation_status"], resumed_navigation_status=event["navigation_status"],
        )


def _beats(stream: DataFrame) -> DataFrame:
    """A source that has a row at every trigger, without its rows, in the columns of a stream."""
    beats = stream.sparkSession.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    return beats.where("value < 0").select(*(F.lit(None).cast(c.dataType).alias(c.name) for c in stream.schema))


def gap_events(stream: DataFrame, timeout: float = TIMEOUT) -> DataFrame:
    """Gap events of a stream of parsed events (see sources.positions.parse_gap_events), in update mode.

    The state store must be RocksDB (spark.sql.streaming.stateStore.providerClass).
    A query that has been started again runs no batch before a source has
    something new, so timers pending from before would wait for the next
    message. A second source of beats, none of which reaches the detector, has
    something new at every trigger; it is part of the checkpoint.
    """
    found = stream.unionByName(_beats(stream)).groupBy("mmsi").transformWithStateInPandas(statefulProcessor=GapDetector(timeout), outputStructType=EVENTS, outputMode="Update", timeMode="ProcessingTime")
    times = {"gap_detected_at": F.timestamp_millis("gap_detected_ms"), "gap_ended_at": F.timestamp_millis("gap_ended_ms")}
    return found.withColumns(times).drop("gap_detected_ms", "gap_ended_ms").withColumn("activity_date", F.to_date(F.coalesce("gap_ended_at", "gap_detected_at")))


def gap_events_batch(positions: DataFrame, timeout: float = TIMEOUT, as_of: Column | None = None) -> DataFrame:
    """The same over history: silences between consecutive observations longer than the timeout, and those open at ``as_of`` (default: any last observation).

    Detection is the timeout after the last observation; the duration is from
    observation to observation. Within a vessel's day, only silences and the
    day's first and last observation are kept, and a vessel's days are joined
    by these, so no task has all rows of a vessel.
    """
    here = F.struct("msgtime", "name", "ship_type", "navigational_status")
    day = inside("mmsi", "msgtime")
    p = positions.select("mmsi", here.alias("here"), "msgtime", segment_of("msgtime").alias("segment"))
    p = p.withColumns({"next": F.lead("here").over(day), "opens": F.lag("msgtime").over(day).isNull()})

    def micros(time: str) -> Column:
        return F.unix_micros(time)

    silent = micros("next.msgtime") - micros("here.msgtime") > int(timeout * 1_000_000)
    kept = written(p.where(silent | F.col("next").isNull() | F.col("opens")).select("mmsi", "segment", "here", "next"), "gap-ends")
    over = across(ends(kept, "mmsi", F.col("here"), F.col("here.msgtime")), "mmsi").select("mmsi", F.col("last").alias("here"), F.col("following").alias("next"))
    detected = F.timestamp_micros(micros("here.msgtime") + F.lit(int(timeout * 1_000_000)))
    open_ = F.col("next").isNull() & (F.lit(True) if as_of is None else (detected <= as_of))
    p = kept.where("next IS NOT NULL").select("mmsi", "here", "next").unionByName(over).where(silent | open_).withColumn("gap_detected_at", detected)
    p = p.select("mmsi", "here.*", "gap_detected_at", *(F.col(f"next.{c}").alias(f"next_{c}") for c in ("msgtime", "name", "ship_type", "navigational_status")))
    one = p.select(
        F.lit("AIS_GAP_DETECTED").alias("event_type"), "mmsi", "name", F.col("msgtime").alias("last_event_msgtime"), F.lit(None).cast("timestamp").alias("resumed_event_msgtime"), "gap_detected_at",
        F.lit(None).cast("timestamp").alias("gap_ended_at"), F.lit(None).cast("double").alias("gap_duration_seconds"), "ship_type", F.col("navigational_status").alias("navigation_status"),
    )
    two = p.where("next_msgtime IS NOT NULL").select(
        F.lit("AIS_GAP_ENDED").alias("event_type"), "mmsi", F.coalesce("next_name", "name").alias("name"), F.col("msgtime").alias("last_event_msgtime"), F.col("next_msgtime").alias("resumed_event_msgtime"), "gap_detected_at",
        F.col("next_msgtime").alias("gap_ended_at"), ((F.unix_micros("next_msgtime") - F.unix_micros("msgtime")) / 1e6).alias("gap_duration_seconds"), F.col("next_ship_type").alias("ship_type"), F.col("next_navigational_status").alias("navigation_status"),
    )
    return one.unionByName(two)


def labelled(gaps: DataFrame, ship_types: DataFrame, status_names: DataFrame) -> DataFrame:
    g = label_stream(gaps, ship_types, {"ship_type": "ship_type"}, {"ship_type_name": "ship_type_name", "ship_category": "ship_category"})
    for c in [x for x in ("navigation_status", "previous_navigation_status", "resumed_navigation_status") if x in g.columns]:
        g = label_stream(g, status_names, {c: "navigational_status"}, {f"{c}_name": "navigational_status_name"})
    return g


def upsert_vessel_state(state: DataFrame, batch: DataFrame, order: tuple[str, ...] = ("msgtime", "seq")) -> DataFrame:
    """Newest state per vessel after a batch; for ``foreachBatch``, which writes the result."""
    both = state.unionByName(batch.select(*state.columns))
    rest = [c for c in state.columns if c != "mmsi"]
    return both.groupBy("mmsi").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s")).select("mmsi", "s.*")
