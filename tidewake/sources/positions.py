"""Position sources: live JSON, historical records, bounded reads and topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake import schemas
from tidewake.functions.expressions import MAX_MMSI
from tidewake.sources.files import time_range

#: A time with a zone, as the strict policy wants it.
ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?(Z|[+-]\d{2}(:?\d{2})?)$"
SNAKE = {
    "speedOverGround": "speed_over_ground", "courseOverGround": "course_over_ground", "rateOfTurn": "rate_of_turn",
    "trueHeading": "true_heading", "navigationalStatus": "navigational_status", "shipType": "ship_type",
}


def _nanoseconds(text: Column) -> Column:
    """Nanoseconds since the epoch of ISO text: whole seconds from the timestamp, the fraction from the text."""
    seconds = F.unix_seconds(F.to_timestamp(text))
    fraction = F.rpad(F.substring(F.regexp_extract(text, r"[.,](\d+)", 1), 1, 9), 9, "0")
    return seconds * F.lit(1_000_000_000) + F.coalesce(fraction.try_cast("long"), F.lit(0))


def positions_from_json(df: DataFrame, ingested_at: Column | None = None) -> DataFrame:
    """Position rows of JSON texts in column ``value``; broken texts give no row. Works on batches and streams."""
    e = df.select(F.from_json(F.col("value").cast("string"), schemas.POSITION_EVENT).alias("e")).select("e.*").withColumnsRenamed(SNAKE)
    e = e.withColumns({"at": F.try_to_timestamp("msgtime"), "msgtime_ns": F.when(F.try_to_timestamp("msgtime").isNotNull(), _nanoseconds(F.col("msgtime")))})
    e = e.where("mmsi IS NOT NULL AND at IS NOT NULL").withColumns({"msgtime": F.col("at"), "ingested_at": F.current_timestamp() if ingested_at is None else ingested_at})
    return e.select(*(c.split()[0] for c in schemas.POSITIONS.split(", ")))


def _identity(event: Column) -> Column:
    """An identity number given as JSON integer or digits; booleans, fractions, 0 and longer numbers are null."""
    kind = F.schema_of_variant(F.try_variant_get(event, "$.mmsi", "variant"))
    text = F.try_variant_get(event, "$.mmsi", "string")
    number = F.when((kind.isin("BIGINT", "STRING")) & text.rlike("^[0-9]{1,9}$"), text.try_cast("long"))
    return F.when(number.between(1, MAX_MMSI), number)


def _number(event: Column, field: str) -> Column:
    """A finite JSON number, else null (text and booleans are no numbers)."""
    kind = F.schema_of_variant(F.try_variant_get(event, f"$.{field}", "variant"))
    x = F.try_variant_get(event, f"$.{field}", "double")
    return F.when(~kind.isin("STRING", "BOOLEAN", "VOID") & ~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _text(event: Column, field: str) -> Column:
    return F.try_variant_get(event, f"$.{field}", "string")


def _code(event: Column, field: str) -> Column:
    return F.try_variant_get(event, f"$.{field}", "int")


def parse_gap_events(df: DataFrame) -> DataFrame:
    """Events for the gap detector from JSON texts in ``value``: malformed and non-object texts and bad identities are dropped."""
    e = df.select(*(c for c in df.columns if c != "value"), F.try_parse_json(F.col("value").cast("string")).alias("e"))
    v = F.col("e")
    e = e.where(F.schema_of_variant(v).startswith("OBJECT")).withColumn("mmsi", _identity(v)).where("mmsi IS NOT NULL")
    return e.select(
        *(c for c in df.columns if c != "value"), "mmsi", _text(v, "name").alias("name"), _text(v, "msgtime").alias("msgtime"), _number(v, "latitude").alias("latitude"),
        _number(v, "longitude").alias("longitude"), _code(v, "shipType").alias("ship_type"), _code(v, "navigationalStatus").alias("navigation_status"),
    )


def parse_feature_events(df: DataFrame) -> DataFrame:
    """Events for windowed features: as for gaps, and the time must have a zone; a bad speed is null but the event stays."""
    e = df.select(*(c for c in df.columns if c != "value"), F.try_parse_json(F.col("value").cast("string")).alias("e"))
    v = F.col("e")
    at = F.when(_text(v, "msgtime").rlike(ZONED), F.try_to_timestamp(_text(v, "msgtime")))
    e = e.where(F.schema_of_variant(v).startswith("OBJECT")).withColumns({"mmsi": _identity(v), "event_time": F.date_trunc("millisecond", at)}).where("mmsi IS NOT NULL AND event_time IS NOT NULL")
    return e.select(
        *(c for c in df.columns if c != "value"), "mmsi", "event_time", _text(v, "name").alias("name"), _number(v, "speedOverGround").alias("speed"),
        _code(v, "shipType").alias("ship_type"), _code(v, "navigationalStatus").alias("navigation_status"),
    )


def uppercase_stream(df: DataFrame) -> DataFrame:
    """Six fields with the stream's name in capitals; rows without identity are dropped. Works on batches and streams."""
    return df.where("mmsi IS NOT NULL").select("mmsi", "msgtime", "latitude", "longitude", "name", F.upper("stream").alias("stream"))


def normalize_historic(df: DataFrame, stream: str = "historic") -> DataFrame:
    """Position rows of landed historical records; those without time or place are skipped."""
    d = df.withColumnsRenamed(SNAKE).withColumn("msgtime", F.try_to_timestamp("dateTimeUtc"))
    d = d.where("msgtime IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL")
    return d.select("mmsi", "msgtime", "latitude", "longitude", *SNAKE.values(), "name", F.lit(stream).alias("stream"))


def positions_window(df: DataFrame, start, end, max_rows: int | None = None) -> DataFrame:
    """Positions of [start, end); only folders of that range are opened where positions lie by month or day.

    With ``max_rows`` a window of more rows is refused before it is used, never cut.
    """
    rows = time_range(df, "msgtime", start, end)
    if max_rows is not None and (n := rows.limit(max_rows + 1).count()) > max_rows:
        raise ValueError(f"the window holds at least {n} rows; the ceiling is {max_rows}")
    return rows


def read_topic(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """A stream of messages; a fresh query begins with new messages. Needs Spark's Kafka package."""
    return spark.readStream.format("kafka").options(**{"startingOffsets": "latest", "failOnDataLoss": "true"} | options).load()


def write_topic(df: DataFrame, options: dict[str, str], checkpoint: str):
    """At-least-once sink of (key, value) rows; the sink topic must not be the source's."""
    if options.get("topic") == options.get("sourceTopic"):
        raise ValueError("source and sink topic must differ")
    out = {k: v for k, v in options.items() if k != "sourceTopic"}
    return df.writeStream.format("kafka").options(**out).option("checkpointLocation", checkpoint).outputMode("append").start()
