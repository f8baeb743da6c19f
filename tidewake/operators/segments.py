"""Scans over a key's rows in order that never bring the rows of a key together.

Rows are taken by (key, day). Within a day, neighbours come from windows over
key and day; what crosses midnight is carried by one row a day with its first
and last row, and only these are scanned over the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def segment_of(time: str) -> Column:
    """The day of a time, as a number."""
    return F.floor(F.unix_micros(time) / F.lit(DAY_MICROS)).cast("int")


def inside(key: str, *order: str) -> W:
    """The window of a key's rows of one day."""
    return W.partitionBy(key, "segment").orderBy(*order)


def ends(rows: DataFrame, key: str, here: Column, order: Column) -> DataFrame:
    """One row for each key and day: ``here`` of its first and last row in order."""
    return rows.groupBy(key, "segment").agg(F.min_by(here, order).alias("first"), F.max_by(here, order).alias("last"))


def across(days: DataFrame, key: str) -> DataFrame:
    """Days with the last row of the day before that has any (``previous``) and the first of the one after (``following``)."""
    order = W.partitionBy(key).orderBy("segment")
    return days.withColumns({"previous": F.lag("last").over(order), "following": F.lead("first").over(order)})
