"""Shared pieces of the corpus operators: words, table access and lineage cuts."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.shared import discard
from tidewake.shared import written as cut

__all__ = ["SPACES", "SPACE_RUN", "bitmap", "cut", "discard", "in_order", "marked", "named", "places", "row_key", "row_name", "ship", "table", "words"]

#: Words are maximal runs of characters other than ASCII white space.
SPACE_RUN = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: A bitmap of keys has at most this many rows of 64 bits; beyond some ten million keys it lets nearly all rows pass, and the join on keys alone decides.
BITMAP_ROWS = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*columns: str) -> Column:
    """A 64-bit name of a row's content, for lookups that a clash does not harm; equal rows share it."""
    return F.xxhash64(*columns)


def row_name(*columns: str) -> Column:
    """Names a row by 128-bit digests of some columns; equal rows share it, nulls differ from all values."""
    return F.concat_ws("/", *(F.coalesce(F.md5(F.col(c).cast("string").cast("binary")), F.lit("-")) for c in columns))


def words(text: Column) -> Column:
    """Array of the words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def bitmap(keys: DataFrame) -> DataFrame:
    """A bounded summary (word, bits) of a column ``key`` of 64-bit hashes."""
    word = F.pmod(F.col("key"), F.lit(BITMAP_ROWS))
    bit = F.expr("shiftleft(1L, CAST(shiftright(key, 40) & 63 AS INT))")
    return keys.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def marked(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """``rows`` with ``marked``: false only if the row's ``key`` is certainly not in the bitmap, which is bounded and broadcast."""
    found = rows.withColumn("word", F.pmod(F.col("key"), F.lit(BITMAP_ROWS))).join(F.broadcast(bits), "word", "left")
    return found.withColumn("marked", F.expr("coalesce(shiftright(bits, CAST(shiftright(key, 40) & 63 AS INT)) & 1, 0) = 1")).drop("word", "bits")


def named(value: Column) -> Column:
    """A text that is never null and tells null from all values; it sorts as the values' UTF-8 bytes do, null first."""
    return F.when(value.isNotNull(), F.concat(F.lit("="), value.cast("string"))).otherwise(F.lit(""))


def in_order(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` sorted by ``keys`` over all tasks, with ``at``, a number that rises in this order; written to the shared folder.

    Rows are dealt by ranges of all keys, so no group of equal first keys is one task's work. ``at`` has the task
    above its lowest 33 bits and counts a task's rows from 0 in these.
    """
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return cut(dealt.withColumn("at", F.monotonically_increasing_id()), name)


def places(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` of ``in_order`` (sorted by ``by`` first) with ``place``, a row's number from 0 among those of equal ``by``, none of which is null.

    A group's rows in one task are numbered by ``at``; the numbers of rows in
    the tasks before, one row for each group and task, are added up and joined
    on group and task.
    """
    task = F.shiftright("at", 33).alias("task")
    parts = rows.groupBy(*by, task).agg(F.min("at").alias("first_at"), F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy(*by).orderBy("task").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    parts = parts.select(*by, "task", "first_at", before.alias("before"))
    return rows.withColumn("task", task).join(parts, [*by, "task"]).withColumn("place", F.col("before") + F.col("at") - F.col("first_at")).drop("task", "first_at", "before")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application."""
    sc = spark.sparkContext
    if not getattr(sc, "_tidewake_shipped", False):
        root = Path(__file__).resolve().parents[2]
        sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/tidewake", "zip", root, "tidewake"))
        sc._tidewake_shipped = True
