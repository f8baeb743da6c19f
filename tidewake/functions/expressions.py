"""Column expressions shared by the operators; all stay inside code generation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.8
MAX_VALID_SPEED_KN = 102.2
MAX_MMSI = 999_999_999
HALF = 0.500000001


def round_(x: Column, digits: int) -> Column:
    """Half away from zero. All marts round through this one function.

    A mean that lies on a half may come out a last bit below it, depending on
    the order of addition; ``HALF`` is wide enough for both to round alike.
    """
    scale = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + HALF) / scale


def sql_round(x: str, digits: int) -> str:
    """The same in SQL text."""
    scale = f"{10**digits}.0"
    return f"(sign({x}) * floor(abs({x}) * CAST({scale} AS DOUBLE) + CAST({HALF} AS DOUBLE)) / CAST({scale} AS DOUBLE))"


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def mmsi_format_class(mmsi: Column) -> Column:
    """Class of an identity number by its digits; the first rule that holds."""
    digits = mmsi.cast("string")
    found = F.when(F.length(digits) != 9, "invalid_length")
    for start, name in MMSI_PREFIXES:
        found = found.when(digits.startswith(start), name)
    return found.when(F.substring(digits, 1, 1).isin(*"234567"), "ship").otherwise("nonstandard")


#: Leading digits of identity numbers, in the order in which they are tried.
MMSI_PREFIXES = (
    ("00", "coast_station"),
    ("0", "group_call"),
    ("111", "sar_aircraft"),
    ("99", "aid_to_navigation"),
    ("98", "parent_ship_craft"),
    ("970", "ais_sart"),
    ("972", "mob_device"),
    ("974", "epirb_ais"),
    ("8", "handheld_vhf"),
)


def run_id(start: Column) -> Column:
    """Canonical id of a run: UTC start in whole seconds; fractions are cut, not rounded."""
    return F.date_format(F.date_trunc("second", start), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres; the argument of the arc sine is clamped."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return EARTH_RADIUS_M * 2 * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def visit_id(mmsi: Column, port_id: Column, arrival_at: Column) -> Column:
    """SHA-256 of the compact list [mmsi, port, arrival], arrival as UTC text with six digits only if there are any."""
    whole = F.date_format(arrival_at, "yyyy-MM-dd HH:mm:ss")
    micros = F.pmod(F.unix_micros(arrival_at), F.lit(1_000_000))
    at = F.when(micros == 0, whole).otherwise(F.concat(whole, F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    return F.sha2(F.concat(F.lit("["), mmsi.cast("string"), F.lit(',"'), port_id, F.lit('","'), at, F.lit('+00:00"]')), 256)


def input_hash(fields: list[str]) -> Column:
    """SHA-256 of the named fields as compact JSON with sorted names; nulls are kept."""
    return F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256)


def valid_speed(speed: Column, limit: float = MAX_VALID_SPEED_KN) -> Column:
    """The speed if it is below the limit of valid reports, else null."""
    return F.when(speed < limit, speed)


def label(code: Column, names: Mapping[str, str]) -> Column:
    """Display text of a code; unknown codes stay as they are."""
    shown = F.when(F.lit(False), code)
    for key, text in names.items():
        shown = shown.when(code == key, text)
    return shown.otherwise(code)


#: Display texts of anomaly reasons and gap event types.
ANOMALY_LABELS = {"speed_and_stationary": "Speed + Stationary", "speed": "Speed", "stationary": "Stationary"}
GAP_LABELS = {"AIS_GAP_DETECTED": "Detected", "AIS_GAP_ENDED": "Recovered"}
