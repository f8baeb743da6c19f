"""Strict ingestion of derived JSON events: what does not fit fails the batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake import schemas
from tidewake.functions.expressions import MAX_MMSI
from tidewake.sources.positions import ZONED


def _fail_if(condition: Column, message: Column | str, value: Column) -> Column:
    text = message if isinstance(message, Column) else F.lit(message)
    return F.when(F.coalesce(condition, F.lit(False)), F.raise_error(text)).otherwise(value)


def _strict(df: DataFrame, schema: str, skip: tuple[str, ...]) -> DataFrame:
    """Objects of JSON texts in ``value``: unknown fields, bad types and bad times raise an error; absent fields are null.

    Numbers may be given as text and keep all their digits; times must have a
    zone.
    """
    fields = [(f.rsplit(" ", 1)[0], f.rsplit(" ", 1)[1]) for f in schema.split(", ") if f.split()[0] not in skip]
    names = [n for n, _ in fields]
    keys = F.json_object_keys("value")
    unknown = F.array_except(keys, F.array(*map(F.lit, names)))
    checked = _fail_if(keys.isNull() | (F.size(unknown) > 0), F.concat(F.lit("not a known event: "), F.col("value")), F.col("value"))
    e = df.select(F.from_json(checked, ", ".join(f"{n} string" for n in names), {"mode": "FAILFAST"}).alias("e")).select("e.*")
    out = []
    for name, kind in fields:
        text = F.col(name)
        if kind == "timestamp":
            value = F.when(text.rlike(ZONED), F.try_to_timestamp(text))
        else:
            value = text if kind == "string" else text.try_cast(kind)
        out.append(_fail_if(text.isNotNull() & value.isNull(), F.concat(F.lit(f"bad {name}: "), text), value).cast(kind).alias(name))
    return e.select(*out)


def _checked(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    first = df.columns[0]
    value = F.col(first)
    for message, good in conditions.items():
        value = _fail_if(~F.coalesce(good, F.lit(False)), message, value)
    return df.withColumn(first, value)


def ingest_features(df: DataFrame) -> DataFrame:
    """Feature windows of JSON texts, typed and checked, with the day of the window's end."""
    f = _strict(df, schemas.FEATURES, ("activity_date", "ingested_at"))
    f = _checked(f, {
        "mmsi out of range": F.col("mmsi").between(1, MAX_MMSI), "window is empty": F.col("window_start") < F.col("window_end"),
        "window_minutes not positive": F.col("window_minutes") > 0, "position_count not positive": F.col("position_count") > 0,
    })
    return f.withColumns({"activity_date": F.to_date("window_end"), "ingested_at": F.current_timestamp()})


def ingest_gap_events(df: DataFrame) -> DataFrame:
    """Gap events of JSON texts, typed and checked, with the day of the end (ended) or of the detection."""
    g = _strict(df, schemas.GAPS, ("activity_date", "ingested_at"))
    ended = F.col("event_type") == "AIS_GAP_ENDED"
    g = _checked(g, {"mmsi out of range": F.col("mmsi").between(1, MAX_MMSI), "unknown event type": F.col("event_type").isin("AIS_GAP_DETECTED", "AIS_GAP_ENDED")})
    return g.withColumns({"activity_date": F.to_date(F.when(ended, F.col("gap_ended_at")).otherwise(F.col("gap_detected_at"))), "ingested_at": F.current_timestamp()})
