"""Reference tables: ports and countries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.functions.expressions import blank_to_null

RADIUS_M = 1500.0


def ports_from_index(df: DataFrame, country: str, bbox: tuple[float, float, float, float], radius_m: float = RADIUS_M) -> DataFrame:
    """Ports of a country inside (south, west, north, east) from a landed index (number, name, country, latitude, longitude), by id."""
    south, west, north, east = bbox
    inside = (F.col("country") == country) & F.col("latitude").between(south, north) & F.col("longitude").between(west, east)
    return df.where(inside).select(F.concat(F.lit("WPI:"), F.col("number").cast("string")).alias("port_id"), F.trim("name").alias("name"), "country", "latitude", "longitude", F.lit(radius_m).alias("radius_m")).orderBy("port_id")


def validate_ports(df: DataFrame) -> DataFrame:
    """``df``, or an error: not empty, unique ids, names present, finite numbers in range (radius 1 to 50,000 m)."""
    def outside(c: str, low: float, high: float) -> Column:
        return F.coalesce(F.isnan(c) | ~F.col(c).between(low, high), F.lit(True))

    r = df.agg(
        F.count("*").alias("rows"), (F.count("*") - F.count_distinct("port_id")).alias("repeated_ids"), F.count_if(blank_to_null(F.col("port_id")).isNull() | blank_to_null(F.col("name")).isNull()).alias("unnamed"),
        F.count_if(outside("latitude", -90, 90) | outside("longitude", -180, 180) | outside("radius_m", 1, 50_000)).alias("out_of_range"),
    ).first()
    if not r["rows"] or r["repeated_ids"] or r["unnamed"] or r["out_of_range"]:
        raise ValueError(f"bad ports: {r.asDict()}")
    return df


def dataset_hash(ports: DataFrame) -> str:
    """Order-independent hash of a port list (a list of ports is small)."""
    line = F.to_json(F.struct(*sorted(ports.columns)), {"ignoreNullFields": "false"})
    return ports.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("h")).first()["h"]


def upsert_ports(existing: DataFrame, new: DataFrame, now: datetime | Column) -> DataFrame:
    """Version rows to append for ``new``, each with its port's first ``created_at``."""
    first = existing.groupBy("port_id").agg(F.min("created_at").alias("created_at"))
    stamp = now if isinstance(now, Column) else F.lit(now)
    return new.join(first, "port_id", "left").withColumns({"created_at": F.coalesce("created_at", stamp), "updated_at": stamp})


CODES = "alpha_2 string, alpha_3 string, ccn3 string"
CAPITALS = "array<struct<name:string,attributes:struct<primary:boolean>>>"


def stg_countries(df: DataFrame) -> DataFrame:
    """Countries of JSON texts (codes, names, capitals) with a two-letter code; the capital is the primary one, else the first."""
    codes, names, capitals = F.from_json("codes", CODES), F.from_json("names", "common string"), F.from_json("capitals", CAPITALS)
    primary = F.filter(capitals, lambda c: F.coalesce(c["attributes"]["primary"], F.lit(False)))
    capital = F.coalesce(blank_to_null(F.get(primary, F.lit(0))["name"]), blank_to_null(F.get(capitals, F.lit(0))["name"]))
    out = df.select(
        blank_to_null(codes["alpha_2"]).alias("country_code"), blank_to_null(codes["alpha_3"]).alias("iso3"), blank_to_null(codes["ccn3"]).alias("numeric_code"),
        blank_to_null(names["common"]).alias("country_name"), blank_to_null(F.col("region")).alias("region"), capital.alias("capital_city"),
    )
    return out.where(F.col("country_code").rlike("^[A-Z]{2}$"))
